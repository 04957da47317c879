"""Consecutive episodes of a subject that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from episodica import schema as S
from episodica.functions import vocabulary as V
from episodica.functions.buckets import overlap_bucket
from episodica.functions.numeric import count_when
from episodica.functions.temporal import days_between, hours_between
from episodica.operators.heavy import HeavyKeys, history_order
from episodica.operators.nextevent import lead_row
from episodica.operators.reports import count_by

# Source columns and the names that the report of following rows gives them.
LEAD_COLUMNS = {
    S.ADMISSION: "next_admission_ts",
    S.DISCHARGE: "next_discharge_ts",
    "executante": "next_executante",
    "municipioexecutante": "next_municipioexecutante",
    "especialidade": "next_especialidade",
    "tipoleito": "next_tipoleito",
    "codigocid": "next_codigocid",
    "motivoalta": "next_motivoalta",
}

_OWN = (
    S.ID, S.ADMISSION_TEXT, S.ADMISSION, S.DISCHARGE, "executante", "municipioexecutante",
    "especialidade", "tipoleito", "carater", "codigocid", "motivoalta",
)


def lead_next(target: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    """Every episode beside the subject's next one by admission, overlapping or not."""
    return lead_row(
        target.select(*_OWN),
        key=S.ID,
        order=history_order(S.ADMISSION, S.ADMISSION_TEXT),
        columns=LEAD_COLUMNS,
        heavy=heavy,
    )


def _overlapping(target: DataFrame, heavy: HeavyKeys | None) -> DataFrame:
    return (
        lead_next(target, heavy)
        .filter(F.col("next_admission_ts") < F.col(S.DISCHARGE))
        .withColumn("overlap_days", days_between("next_admission_ts", S.DISCHARGE))
        .withColumn("overlap_hours", hours_between("next_admission_ts", S.DISCHARGE))
    )


def overlaps(target: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    def flag(condition):
        return F.when(condition, 1).otherwise(0)

    return (
        _overlapping(target, heavy)
        .select(
            S.ID, S.ADMISSION, S.DISCHARGE, "next_admission_ts", "next_discharge_ts",
            "overlap_days", "overlap_hours",
            "executante", "next_executante", "municipioexecutante", "next_municipioexecutante",
            "especialidade", "next_especialidade", "tipoleito", "next_tipoleito",
            "codigocid", "next_codigocid", "motivoalta", "next_motivoalta",
            flag(F.col("executante") == F.col("next_executante")).alias("same_hospital"),
            flag(F.col("especialidade") == F.col("next_especialidade")).alias("same_specialty"),
            flag(F.col("motivoalta") == V.TRANSFER).alias("transfer_discharge"),
        )
        .orderBy(F.col("overlap_hours").desc(), S.ID, S.ADMISSION)
    )


def overlap_summary(target: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    """Counts; a missing hospital or specialty is neither same nor different."""
    return _overlapping(target, heavy).agg(
        F.count(F.lit(1)).alias("overlapping_episodes"),
        F.count_distinct(S.ID).alias("affected_patients"),
        count_when(F.col("executante") == F.col("next_executante")).alias("same_hospital"),
        count_when(F.col("executante") != F.col("next_executante")).alias("different_hospital"),
        count_when(F.col("especialidade") == F.col("next_especialidade")).alias("same_specialty"),
        count_when(F.col("motivoalta") == V.TRANSFER).alias("transfer_discharge"),
    )


def overlap_buckets(target: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    bucket = overlap_bucket(F.col("overlap_hours"), F.col("overlap_days")).alias("overlap_bucket")
    return count_by(_overlapping(target, heavy), [bucket], "episodes").orderBy(
        F.col("episodes").desc(), F.col("overlap_bucket")
    )


def overlap_count(target: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    return _overlapping(target, heavy).agg(F.count(F.lit(1)).alias("overlapping_episodes"))
