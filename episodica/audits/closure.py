"""Administrative closures in the raw rows and the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from episodica import schema as S
from episodica.functions import vocabulary as V
from episodica.functions.numeric import count_when
from episodica.operators.episodes import request_date
from episodica.operators.reports import count_by, top_k


def _closed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("motivoalta") == V.ADMINISTRATIVE_CLOSURE)


def closure_status(raw: DataFrame) -> DataFrame:
    return count_by(_closed(raw), ["motivoalta", "situacao"], "episodes").orderBy(
        F.col("episodes").desc(), F.col("situacao").asc_nulls_last()
    )


def closure_hospital(raw: DataFrame) -> DataFrame:
    return count_by(_closed(raw), ["executante"], "episodes").orderBy(
        F.col("episodes").desc(), F.col("executante").asc_nulls_last()
    )


def closure_dates(raw: DataFrame) -> DataFrame:
    when = request_date(raw)
    return _closed(raw).agg(
        F.min(when).alias("min_request_date"),
        F.max(when).alias("max_request_date"),
        F.count(F.lit(1)).alias("episodes"),
    )


def closure_next(target: DataFrame) -> DataFrame:
    gap = F.col(S.DAYS_NEXT)
    return _closed(target).agg(
        F.count(F.lit(1)).alias("total_closures"),
        count_when(gap.between(0, 30)).alias("next_admission_0_30d"),
        count_when(gap.between(2, 30)).alias("next_admission_2_30d"),
    )


def closure_sample(raw: DataFrame, k: int = 30) -> DataFrame:
    rows = _closed(raw).select(
        S.ID, request_date(raw).alias(S.REQUEST_DATE), "datahorasolicitacao", S.ADMISSION_TEXT, S.DISCHARGE_TEXT, "situacao",
        "executante", "especialidade", "tipoleito", "carater", "codigocid", "motivoalta",
    )
    # All columns break ties, so equal request dates give the same rows each time.
    order = [S.REQUEST_DATE, *[c for c in rows.columns if c != S.REQUEST_DATE]]
    return top_k(rows, k, *[F.col(c).asc_nulls_last() for c in order])
