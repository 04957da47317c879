"""Label every episode with its next admission and the recurrence outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from episodica import schema as S
from episodica.functions.numeric import count_when, percent2
from episodica.functions.temporal import days_between
from episodica.operators.heavy import HeavyKeys
from episodica.operators.nextevent import next_event
from episodica.operators.signals import (
    billing_procedure_rows,
    normalised_icd,
    procedure_flags,
    raw_procedure_rows,
    unplanned,
)
from episodica.schema import EpisodeConfig

NEXT_COLUMNS = {
    "executante": "next_executante",
    "municipioexecutante": "next_municipioexecutante",
    "carater": "next_carater",
    "codigocid": "next_codigocid",
}


def next_episode(
    episodes: DataFrame,
    signals: DataFrame | None = None,
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """First episode of the subject that starts strictly after this discharge."""
    return next_event(
        episodes,
        key=S.ID,
        start=S.ADMISSION,
        end=S.DISCHARGE,
        tie=S.ADMISSION_TEXT,
        next_start="next_admission_ts",
        carry=NEXT_COLUMNS,
        signals=signals,
        heavy=heavy,
    )


def next_timeline(episodes: DataFrame, raw: DataFrame, billing: DataFrame) -> list[DataFrame]:
    """The tables whose rows lie on a subject's timeline: ends, starts and procedures."""
    return [episodes, episodes, raw, billing]


def days_until_next() -> Column:
    return days_between(S.DISCHARGE, "next_admission_ts")


def eligible(cfg: EpisodeConfig = EpisodeConfig()) -> Column:
    """0 after an excluded reason or without a discharge, else 1; a NULL reason does not exclude."""
    excluded = F.col("motivoalta").isin(*cfg.ineligible_reasons) | F.col(S.DISCHARGE).isNull()
    return F.when(excluded, 0).otherwise(1)


def is_candidate(cfg: EpisodeConfig = EpisodeConfig()) -> Column:
    return (F.col(S.ELIGIBLE) == 1) & F.col(S.DAYS_NEXT).between(*cfg.recurrence_days)


def with_next(
    episodes: DataFrame,
    raw: DataFrame,
    billing: DataFrame,
    cfg: EpisodeConfig = EpisodeConfig(),
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """Episodes with next admission, gap, eligibility and the procedure flags of the next admission."""
    rows = raw_procedure_rows(raw, cfg).unionByName(billing_procedure_rows(billing))
    matched = next_episode(episodes, procedure_flags(rows, cfg), heavy)
    return matched.withColumn(S.DAYS_NEXT, days_until_next()).withColumn(S.ELIGIBLE, eligible(cfg))


def build_target(
    episodes: DataFrame,
    raw: DataFrame,
    billing: DataFrame,
    cfg: EpisodeConfig = EpisodeConfig(),
    heavy: HeavyKeys | None = None,
    labels_by_key: bool = False,
) -> DataFrame:
    """The labelled episode table.

    The label is a function of the row and its next admission. Where two
    episodes share (subject, admission time), set ``labels_by_key`` to match
    labels by that key; the invariants then report rows that multiply.
    """
    base = with_next(episodes, raw, billing, cfg, heavy)
    verdict = unplanned(F.col("next_carater"), normalised_icd("next_codigocid"), cfg)
    label = F.when(is_candidate(cfg), verdict)
    if labels_by_key:
        # The candidates of a key give every episode of the key their labels, without a second computation of the base.
        known = F.col(S.ID).isNotNull() & F.col(S.ADMISSION).isNotNull()
        labels = F.collect_list(F.when(known, label)).over(Window.partitionBy(S.ID, S.ADMISSION))
        base = base.withColumn("__labels", labels).withColumn("__label", F.explode_outer("__labels"))
        label = F.col("__label")
    else:
        # An episode without an admission time matches no label.
        label = F.when(F.col(S.ADMISSION).isNotNull(), label)
    clean = (F.col(S.ELIGIBLE) == 1) & F.col(S.DAYS_NEXT).between(*cfg.recurrence_days)
    return base.select(
        *episodes.columns,
        "next_admission_ts",
        "next_executante",
        "next_municipioexecutante",
        S.DAYS_NEXT,
        S.ELIGIBLE,
        F.when(F.col(S.ELIGIBLE) == 1, F.coalesce(label, F.lit(0))).cast("int").alias(S.LABEL),
        F.coalesce(F.col(S.DAYS_NEXT).between(*cfg.raw_recurrence_days), F.lit(False))
        .cast("int")
        .alias("readmitted_30d_raw"),
        F.coalesce(clean, F.lit(False)).cast("int").alias("readmitted_30d_clean"),
    )


def has_duplicate_keys(episodes: DataFrame) -> bool:
    """True when two episodes share (subject, admission time)."""
    keys = episodes.filter(F.col(S.ADMISSION).isNotNull()).groupBy(S.ID, S.ADMISSION).count()
    return (keys.agg(F.max("count")).head()[0] or 0) > 1


def target_invariants(episodes: DataFrame, target: DataFrame, cfg: EpisodeConfig = EpisodeConfig()) -> DataFrame:
    """One row of counts; all but the first two must be 0 and those two equal."""
    inside = F.col(S.DAYS_NEXT).between(*cfg.recurrence_days)
    return target.agg(
        F.count(F.lit(1)).alias("target_episodes"),
        count_when((F.col(S.ELIGIBLE) == 0) & F.col(S.LABEL).isNotNull()).alias("ineligible_with_label"),
        count_when((F.col(S.ELIGIBLE) == 1) & F.col(S.LABEL).isNull()).alias("eligible_without_label"),
        count_when((F.col(S.LABEL) == 1) & ~inside).alias("positives_outside_window"),
    ).select(
        episodes.agg(F.count(F.lit(1))).scalar().alias("clean_episodes"),
        "target_episodes",
        "ineligible_with_label",
        "eligible_without_label",
        "positives_outside_window",
    )


def check_target(episodes: DataFrame, target: DataFrame, cfg: EpisodeConfig = EpisodeConfig()) -> None:
    """Raise when the target breaks an invariant."""
    row = target_invariants(episodes, target, cfg).head()
    if row["clean_episodes"] != row["target_episodes"]:
        raise ValueError(f"Episode count changed: {row['clean_episodes']:,} -> {row['target_episodes']:,}")
    bad = row["ineligible_with_label"] + row["eligible_without_label"] + row["positives_outside_window"]
    if bad:
        raise ValueError(f"Invalid target records: {bad:,}")


def target_summary(target: DataFrame) -> DataFrame:
    eligible_rows = count_when(F.col(S.ELIGIBLE) == 1)
    positives = count_when(F.col(S.LABEL) == 1)
    return target.agg(
        F.count(F.lit(1)).alias("total_episodes"),
        eligible_rows.alias("eligible_episodes"),
        positives.alias("unplanned_readmissions"),
        percent2(positives, eligible_rows).alias("unplanned_readmission_rate"),
    )
