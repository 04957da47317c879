"""Date and stay quality of the target."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from episodica import schema as S
from episodica.functions.buckets import audit_stay_bucket, audit_stay_rank
from episodica.functions.numeric import count_when, percent2, round2
from episodica.functions.temporal import days_between
from episodica.operators.reports import count_by, top_k

STAY = "length_of_stay_days"


def stay() -> Column:
    return days_between(S.ADMISSION, S.DISCHARGE)


def with_stay(target: DataFrame) -> DataFrame:
    return target.withColumn(STAY, stay())


def _stay_over(days: int, name: str | None = None) -> Column:
    return count_when(F.col(STAY) > days).alias(name or f"los_over_{days}_days")


def date_quality(target: DataFrame) -> DataFrame:
    los = F.col(STAY)
    return with_stay(target).agg(
        F.count(F.lit(1)).alias("total_episodes"),
        count_when(F.col(S.ADMISSION).isNull()).alias("missing_admission"),
        count_when(F.col(S.DISCHARGE).isNull()).alias("missing_discharge"),
        count_when(F.col(S.DISCHARGE) < F.col(S.ADMISSION)).alias("negative_los"),
        count_when(los == 0).alias("zero_day_los"),
        *[_stay_over(d) for d in (30, 90, 180, 365, 1000)],
        F.min(los).alias("minimum_los"),
        F.max(los).alias("maximum_los"),
        round2(F.avg(los)).alias("average_los"),
    )


def year_ranges(target: DataFrame) -> DataFrame:
    admission, discharge = F.col(S.ADMISSION), F.col(S.DISCHARGE)
    return target.agg(
        F.min(admission).alias("earliest_admission"),
        F.max(admission).alias("latest_admission"),
        F.min(discharge).alias("earliest_discharge"),
        F.max(discharge).alias("latest_discharge"),
        F.min(F.year(admission)).cast("bigint").alias("minimum_admission_year"),
        F.max(F.year(admission)).cast("bigint").alias("maximum_admission_year"),
        F.min(F.year(discharge)).cast("bigint").alias("minimum_discharge_year"),
        F.max(F.year(discharge)).cast("bigint").alias("maximum_discharge_year"),
    )


def out_of_range(
    target: DataFrame,
    first: dt.datetime = dt.datetime(2023, 1, 1),
    end: dt.datetime = dt.datetime(2027, 1, 1),
) -> DataFrame:
    """Episodes with a time before ``first`` or from ``end`` on."""
    low, high = (F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in (first, end))
    admission, discharge = F.col(S.ADMISSION), F.col(S.DISCHARGE)
    outside = (admission < low) | (admission >= high) | (discharge < low) | (discharge >= high)
    return (
        target.filter(outside)
        .select(
            S.ID, S.ADMISSION, S.DISCHARGE, stay().alias(STAY),
            "executante", "especialidade", "tipoleito", "codigocid", "motivoalta",
        )
        .orderBy(F.col(S.ADMISSION).asc_nulls_last(), F.col(S.DISCHARGE).asc_nulls_last())
    )


def _stayed(target: DataFrame) -> DataFrame:
    return with_stay(target.filter(F.col(S.ADMISSION).isNotNull() & F.col(S.DISCHARGE).isNotNull()))


def longest_stays(target: DataFrame, k: int = 100) -> DataFrame:
    rows = _stayed(target).select(
        S.ID, S.ADMISSION, S.DISCHARGE, STAY, "executante", "municipioexecutante",
        "especialidade", "tipoleito", "carater", "codigocid", "motivoalta",
    )
    return top_k(rows, k, F.col(STAY).desc(), F.col(S.ID), F.col(S.ADMISSION))


def long_stays_by(target: DataFrame, group: str) -> DataFrame:
    """Groups with a stay over 90 days; ``executante`` for hospitals, ``especialidade`` for specialties."""
    return (
        _stayed(target)
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("total_episodes"),
            *[_stay_over(d) for d in (90, 180, 365)],
            round2(F.avg(STAY)).alias("average_los"),
            F.max(STAY).alias("maximum_los"),
        )
        .filter(F.col("los_over_90_days") > 0)
        .orderBy(F.col("los_over_365_days").desc(), F.col("los_over_90_days").desc(), F.col(group))
    )


def stay_distribution(target: DataFrame) -> DataFrame:
    bucket = audit_stay_bucket(stay(), F.col(S.DISCHARGE))
    return count_by(target, [bucket.alias("los_bucket")], "episodes").orderBy(audit_stay_rank(F.col("los_bucket")))


def _zero_day(target: DataFrame) -> DataFrame:
    return target.filter(F.col(S.DISCHARGE).isNotNull() & (stay() == 0))


def zero_day_summary(target: DataFrame) -> DataFrame:
    everything = target.agg(F.count(F.lit(1))).scalar()
    return (
        _zero_day(target)
        .agg(F.count(F.lit(1)).alias("zero_day_episodes"), F.count_distinct(S.ID).alias("affected_patients"))
        .withColumn("percentage_of_episodes", percent2(F.col("zero_day_episodes"), everything))
    )


def zero_day_by(target: DataFrame, group: str, k: int = 30) -> DataFrame:
    counts = count_by(_zero_day(target), [group], "zero_day_episodes")
    return top_k(counts, k, F.col("zero_day_episodes").desc(), F.col(group).asc_nulls_last())


def year_errors(target: DataFrame, years: int = 2) -> DataFrame:
    """Admission and discharge years that lie ``years`` or more apart."""
    apart = F.abs(F.year(S.DISCHARGE) - F.year(S.ADMISSION)) >= years
    return (
        target.filter(apart)
        .select(
            S.ID, S.ADMISSION, S.DISCHARGE,
            F.year(S.ADMISSION).cast("bigint").alias("admission_year"),
            F.year(S.DISCHARGE).cast("bigint").alias("discharge_year"),
            stay().alias(STAY), "executante", "especialidade", "codigocid", "motivoalta",
        )
        .orderBy(F.col(STAY).desc())
    )


def extreme_stays(target: DataFrame, days: int = 365) -> DataFrame:
    return (
        target.filter(stay() > days)
        .select(
            S.ID, S.ADMISSION, S.DISCHARGE, "next_admission_ts", stay().alias(STAY), S.DAYS_NEXT,
            "executante", "especialidade", "codigocid", "motivoalta", "readmitted_30d_clean",
        )
        .orderBy(F.col(STAY).desc())
    )
