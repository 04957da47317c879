"""Counts, gaps and consistency of the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from episodica import schema as S
from episodica.functions import vocabulary as V
from episodica.functions.numeric import count_when, percent2, round2
from episodica.functions.temporal import days_between
from episodica.operators.episodes import request_date
from episodica.operators.reports import count_by, histogram, random_sample, share_of_total, top_k
from episodica.operators.target import is_candidate
from episodica.schema import EpisodeConfig

_TRACE = (
    S.ID, S.ADMISSION, S.DISCHARGE, "next_admission_ts", S.DAYS_NEXT, "motivoalta",
    "executante", "especialidade", "codigocid", "readmitted_30d_clean",
)


def episode_counts(target: DataFrame) -> DataFrame:
    return target.agg(
        F.count(F.lit(1)).alias("total_episodes"), F.count_distinct(S.ID).alias("patients")
    ).withColumn(
        "avg_episodes_per_patient",
        round2(F.col("total_episodes").cast("double") / F.nullif(F.col("patients").cast("double"), F.lit(0.0))),
    )


def top_patients(target: DataFrame, k: int = 30) -> DataFrame:
    return top_k(count_by(target, [S.ID], "episodes"), k, F.col("episodes").desc(), F.col(S.ID).asc_nulls_last())


def duplicates(target: DataFrame, k: int = 30) -> DataFrame:
    repeated = count_by(target, [S.ID, S.ADMISSION], "records").filter(F.col("records") > 1)
    return top_k(
        repeated, k, F.col("records").desc(), F.col(S.ID).asc_nulls_last(), F.col(S.ADMISSION).asc_nulls_last()
    )


def stay_quality(target: DataFrame) -> DataFrame:
    los = F.col("los")
    return target.withColumn("los", days_between(S.ADMISSION, S.DISCHARGE)).agg(
        F.count(F.lit(1)).alias("total"),
        count_when(F.col(S.DISCHARGE).isNull()).alias("missing_discharge"),
        count_when(los < 0).alias("negative_los"),
        count_when(los == 0).alias("zero_day_los"),
        count_when(los > 365).alias("los_over_365"),
        F.min(los).alias("min_los"),
        F.max(los).alias("max_los"),
        round2(F.avg(los)).alias("avg_los"),
    )


def gap_histogram(target: DataFrame, low: int, high: int, reason: str | None = None) -> DataFrame:
    """Episodes per gap in days, optionally after one discharge reason."""
    rows = target.filter(F.col(S.DAYS_NEXT).between(low, high))
    if reason is not None:
        rows = rows.filter(F.col("motivoalta") == reason)
    return histogram(rows, S.DAYS_NEXT)


def death_then_admission(target: DataFrame) -> DataFrame:
    followed = (F.col("motivoalta") == V.DEATH) & F.col("next_admission_ts").isNotNull()
    return target.filter(followed).agg(F.count(F.lit(1)).alias("death_followed_by_admission"))


def target_distribution(target: DataFrame) -> DataFrame:
    return share_of_total(target, ["readmitted_30d_clean"], "episodes").orderBy("readmitted_30d_clean")


def rate_by_reason(target: DataFrame) -> DataFrame:
    clean = F.col("readmitted_30d_clean")
    return (
        target.groupBy("motivoalta")
        .agg(
            F.count(F.lit(1)).alias("episodes"),
            F.sum(clean).cast("bigint").alias("readmissions"),
            round2(F.avg(clean) * 100).alias("readmission_rate"),
        )
        .orderBy(F.col("episodes").desc(), F.col("motivoalta").asc_nulls_last())
    )


def sample_positives(target: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    rows = target.filter(F.col("readmitted_30d_clean") == 1).select(*_TRACE)
    return random_sample(rows, n, [S.ID, S.ADMISSION], seed)


def top_patient_episodes(target: DataFrame, k: int = 5) -> DataFrame:
    """All episodes of the k subjects with most episodes; only k keys are broadcast."""
    keys = top_patients(target, k).select(S.ID)
    return target.select(*_TRACE).join(F.broadcast(keys), S.ID, "left_semi").orderBy(
        S.ID, F.col(S.ADMISSION).asc_nulls_last()
    )


def raw_vs_clean(target: DataFrame) -> DataFrame:
    return target.agg(
        F.sum("readmitted_30d_raw").cast("bigint").alias("raw_readmissions"),
        F.sum("readmitted_30d_clean").cast("bigint").alias("clean_readmissions"),
        F.count(F.lit(1)).alias("total_episodes"),
    ).select(
        "*",
        percent2(F.col("raw_readmissions"), F.col("total_episodes")).alias("raw_rate"),
        percent2(F.col("clean_readmissions"), F.col("total_episodes")).alias("clean_rate"),
    )


def excluded_reasons(target: DataFrame, reasons: tuple[str, ...] = V.REPORTED_REASONS) -> DataFrame:
    return (
        target.filter(F.col("motivoalta").isin(*reasons))
        .groupBy("motivoalta")
        .agg(
            F.count(F.lit(1)).alias("episodes"),
            F.sum("readmitted_30d_raw").cast("bigint").alias("raw_readmissions"),
            F.sum("readmitted_30d_clean").cast("bigint").alias("clean_readmissions"),
        )
        .orderBy(F.col("episodes").desc(), "motivoalta")
    )


def zero_gap_by_reason(target: DataFrame) -> DataFrame:
    return count_by(target.filter(F.col(S.DAYS_NEXT) == 0), ["motivoalta"], "episodes").orderBy(
        F.col("episodes").desc(), F.col("motivoalta").asc_nulls_last()
    )


def zero_day_hospitals(raw: DataFrame, target: DataFrame, k: int = 20) -> DataFrame:
    """Hospitals of subjects that came back on the day of discharge.

    Raw rows are counted per (subject, hospital) and subjects made distinct
    before the semi join, so a subject with very many rows joins with as many
    rows as it has hospitals.
    """
    back = target.filter(F.col(S.DAYS_NEXT) == 0).select(S.ID).distinct()
    counts = count_by(raw, [S.ID, "executante"], "n").join(back, S.ID, "left_semi")
    hospitals = counts.groupBy("executante").agg(F.sum("n").alias("episodes"))
    return top_k(hospitals, k, F.col("episodes").desc(), F.col("executante").asc_nulls_last())


def consistency(episodes: DataFrame, target: DataFrame, cfg: EpisodeConfig = EpisodeConfig()) -> DataFrame:
    """Row counts of both tables, rule violations, and rows beyond one per (subject, admission time)."""
    counts = target.agg(
        F.count(F.lit(1)).alias("target_episodes"),
        count_when((F.col(S.ELIGIBLE) == 0) & F.col(S.LABEL).isNotNull()).alias("ineligible_with_non_null_target"),
        count_when((F.col(S.ELIGIBLE) == 1) & F.col(S.LABEL).isNull()).alias("eligible_with_null_target"),
        count_when((F.col(S.LABEL) == 1) & ~F.col(S.DAYS_NEXT).between(*cfg.recurrence_days)).alias("positives_outside_window"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct(S.ID, S.ADMISSION))).alias("duplicate_episodes"),
    )
    return counts.withColumn("clean_episodes", episodes.agg(F.count(F.lit(1))).scalar())


def label_summary(target: DataFrame) -> DataFrame:
    eligible, label = F.col(S.ELIGIBLE), F.col(S.LABEL)
    return target.agg(
        F.count(F.lit(1)).alias("total_episodes"),
        count_when(eligible == 1).alias("eligible_episodes"),
        count_when(eligible == 0).alias("ineligible_episodes"),
        count_when(label == 1).alias("unplanned_readmissions"),
        count_when(label == 0).alias("episodes_without_unplanned_readmission"),
        percent2(count_when(label == 1), count_when(eligible == 1)).alias("unplanned_readmission_rate"),
    )


def general_vs_unplanned(target: DataFrame, cfg: EpisodeConfig = EpisodeConfig()) -> DataFrame:
    general = count_when(is_candidate(cfg))
    other = count_when(is_candidate(cfg) & (F.col(S.LABEL) == 0))
    return target.agg(
        general.alias("general_readmissions_2_30d"),
        count_when(F.col(S.LABEL) == 1).alias("unplanned_readmissions_2_30d"),
        other.alias("readmissions_not_classified_as_unplanned"),
        percent2(other, general).alias("excluded_from_general_readmissions_percentage"),
    )


def ineligible_reasons(target: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("motivoalta").isin(*V.INELIGIBLE_REASONS), F.col("motivoalta"))
        .when(F.col(S.DISCHARGE).isNull(), V.MISSING_DISCHARGE_REASON)
        .otherwise(V.OTHER_REASON)
    )
    rows = target.filter(F.col(S.ELIGIBLE) == 0)
    return count_by(rows, [reason.alias("reason")], "episodes").orderBy(F.col("episodes").desc(), "reason")


def interval_distribution(target: DataFrame) -> DataFrame:
    return histogram(target.filter(F.col(S.LABEL) == 1), S.DAYS_NEXT, "unplanned_readmissions")


def trace_raw(raw: DataFrame, prefix: str) -> DataFrame:
    return (
        raw.filter(F.col(S.ID).startswith(prefix))
        .select(
            S.ID, request_date(raw).alias(S.REQUEST_DATE), "datahorasolicitacao", S.ADMISSION_TEXT, S.DISCHARGE_TEXT, "situacao",
            "executante", "municipioexecutante", "especialidade", "tipoleito", "carater", "codigocid", "motivoalta",
        )
        .orderBy(F.col("datahorasolicitacao").asc_nulls_last(), F.col(S.REQUEST_DATE).asc_nulls_last())
    )


def trace_episodes(target: DataFrame, prefix: str) -> DataFrame:
    return (
        target.filter(F.col(S.ID).startswith(prefix))
        .select(
            S.ID, S.ADMISSION_TEXT, S.DISCHARGE_TEXT, "last_update", S.ADMISSION, S.DISCHARGE,
            days_between(S.ADMISSION, S.DISCHARGE).alias("length_of_stay_days"),
            "executante", "especialidade", "codigocid", "motivoalta",
        )
        .orderBy(F.col(S.ADMISSION).asc_nulls_last())
    )


def top_groups(features: DataFrame, group: str, k: int = 20) -> DataFrame:
    counts = count_by(features, [group], "episodes")
    return top_k(counts, k, F.col("episodes").desc(), F.col(group).asc_nulls_last())


def feature_ranges(features: DataFrame) -> DataFrame:
    los = F.col("length_of_stay_days")
    return features.agg(
        F.min(los).alias("min_length_of_stay"),
        F.max(los).alias("max_length_of_stay"),
        F.avg(los).alias("avg_length_of_stay"),
    )


def history_histogram(features: DataFrame, k: int = 20) -> DataFrame:
    counts = count_by(features, ["previous_hospitalizations"], "episodes")
    return top_k(counts, k, F.col("previous_hospitalizations").asc_nulls_last())
