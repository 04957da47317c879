"""Was the next admission planned? Reports over recurrences joined to their next episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from episodica import schema as S
from episodica.functions import vocabulary as V
from episodica.functions.numeric import count_when, percent2
from episodica.functions.text import blank_to_null, contains_any, planning_class, specialty_group, upper_or_empty
from episodica.operators.reports import count_by, random_sample, share_of_total, share_within
from episodica.sources.contracts import column_set, optional_columns, require_columns

# Source columns and the names that the joined report gives them.
_INDEX_COLUMNS = {
    S.DISCHARGE: "index_discharge_ts",
    S.DAYS_NEXT: S.DAYS_NEXT,
    S.ELIGIBLE: S.ELIGIBLE,
    "carater": "index_carater",
    "especialidade": "index_especialidade",
    "codigocid": "index_codigocid",
    "motivoalta": "index_motivoalta",
    "tipoleito": "index_tipoleito",
}
_NEXT_COLUMNS = {
    S.ADMISSION: "matched_next_admission_ts",
    "carater": "next_carater",
    "especialidade": "next_especialidade",
    "codigocid": "next_codigocid",
    "motivoalta": "next_motivoalta",
    "tipoleito": "next_tipoleito",
    "executante": "next_executante",
    "municipioexecutante": "next_municipioexecutante",
}


def enrich_next(target: DataFrame, episodes: DataFrame) -> DataFrame:
    """Recurrences with the attributes of the next episode, matched on (subject, admission time).

    Optional columns take part only where the tables have them.
    """
    require_columns(target, S.ID, S.ADMISSION, "next_admission_ts", "readmitted_30d_clean", table="target")
    require_columns(episodes, S.ID, S.ADMISSION, "carater", "especialidade", "codigocid", table="episodes")
    index = target.filter(F.col("readmitted_30d_clean") == 1).select(
        S.ID,
        F.col(S.ADMISSION).alias("index_admission_ts"),
        "next_admission_ts",
        "readmitted_30d_clean",
        *optional_columns(target, _INDEX_COLUMNS),
    )
    following = episodes.select(F.col(S.ID).alias("__id"), *optional_columns(episodes, _NEXT_COLUMNS))
    on = (F.col(S.ID) == F.col("__id")) & (F.col("next_admission_ts") == F.col("matched_next_admission_ts"))
    return index.join(following, on, "left").drop("__id")


def _stated(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(V.NOT_STATED))


def join_coverage(enriched: DataFrame) -> DataFrame:
    matched = count_when(F.col("matched_next_admission_ts").isNotNull())
    return enriched.agg(
        F.count(F.lit(1)).alias("total_readmissions"),
        matched.alias("matched_readmissions"),
        count_when(F.col("matched_next_admission_ts").isNull()).alias("unmatched_readmissions"),
        percent2(matched, F.count(F.lit(1))).alias("match_percentage"),
    )


def _by_count(df: DataFrame, count: str, name: str) -> DataFrame:
    return df.orderBy(F.col(count).desc(), F.col(name))


def next_character(enriched: DataFrame) -> DataFrame:
    keys = [_stated("next_carater").alias("next_carater")]
    return _by_count(share_of_total(enriched, keys, "readmissions"), "readmissions", "next_carater")


def planning_proxy(enriched: DataFrame) -> DataFrame:
    """A blank character is undetermined, as is one without any known fragment."""
    known = blank_to_null(F.col("next_carater"))
    keys = [planning_class(known).alias("planning_classification")]
    return _by_count(share_of_total(enriched, keys, "readmissions"), "readmissions", "planning_classification")


def specialty_by_character(enriched: DataFrame) -> DataFrame:
    shares = share_within(
        enriched,
        _stated("next_carater"),
        _stated("next_especialidade"),
        ("next_carater", "next_especialidade"),
        "readmissions",
        "percentage_within_character",
    )
    return shares.orderBy("next_carater", F.col("readmissions").desc(), "next_especialidade")


def routine_specialties(enriched: DataFrame) -> DataFrame:
    shares = share_within(
        enriched,
        specialty_group("next_especialidade"),
        _stated("next_carater"),
        ("specialty_group", "next_carater"),
        "readmissions",
        "percentage_within_group",
    )
    return shares.orderBy("specialty_group", F.col("readmissions").desc(), "next_carater")


def _specialties_of(enriched: DataFrame, fragments: tuple[str, ...], count: str) -> DataFrame:
    rows = enriched.filter(contains_any(upper_or_empty("next_carater"), fragments))
    keys = [_stated("next_especialidade").alias("next_especialidade")]
    return _by_count(share_of_total(rows, keys, count), count, "next_especialidade")


def elective_specialties(enriched: DataFrame) -> DataFrame:
    return _specialties_of(enriched, V.ELECTIVE_FRAGMENTS, "elective_readmissions")


def urgent_specialties(enriched: DataFrame) -> DataFrame:
    return _specialties_of(enriched, V.URGENT_FRAGMENTS, "urgent_readmissions")


def icd_by_character(enriched: DataFrame) -> DataFrame:
    keys = [_stated("next_carater").alias("next_carater"), _stated("next_codigocid").alias("next_codigocid")]
    return count_by(enriched, keys, "readmissions").orderBy(
        "next_carater", F.col("readmissions").desc(), "next_codigocid"
    )


def rate_comparison(target: DataFrame, enriched: DataFrame) -> DataFrame:
    """General rate and the rate of urgent recurrences over one denominator; no row when there is no recurrence.

    The denominator is two scalar subqueries over one pruned scan.
    """
    if S.ELIGIBLE in column_set(target):
        target = target.filter(F.col(S.ELIGIBLE) == 1)
        enriched = enriched.filter(F.col(S.ELIGIBLE) == 1)
    kind = planning_class("next_carater")
    counts = enriched.agg(
        F.count(F.lit(1)).alias("n"),
        count_when(kind == V.PLANNED).alias("potentially_planned_readmissions"),
        count_when(kind == V.UNPLANNED).alias("potentially_unplanned_readmissions"),
        count_when(kind == V.UNDETERMINED).alias("indeterminate_readmissions"),
    ).filter(F.col("n") > 0)
    base = counts.select(
        target.agg(F.count(F.lit(1))).scalar().alias("eligible_episodes"),
        target.agg(F.sum("readmitted_30d_clean").cast("bigint")).scalar().alias("all_readmissions"),
        "potentially_planned_readmissions",
        "potentially_unplanned_readmissions",
        "indeterminate_readmissions",
    )
    return base.select(
        "*",
        percent2(F.col("all_readmissions"), F.col("eligible_episodes")).alias("general_readmission_rate"),
        percent2(F.col("potentially_unplanned_readmissions"), F.col("eligible_episodes")).alias(
            "conservative_unplanned_rate"
        ),
    )


def review_sample(enriched: DataFrame, n: int = 300, seed: int = 0) -> DataFrame:
    rows = enriched.withColumn("exploratory_classification", planning_class("next_carater"))
    return random_sample(rows, n, [S.ID, "index_admission_ts"], seed)
