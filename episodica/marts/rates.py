"""Rate, trend, top-k and cross tables over the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from episodica import schema as S
from episodica.functions import vocabulary as V
from episodica.functions.numeric import percent
from episodica.operators.reports import count_by, top_k
from episodica.sources.contracts import require_columns

PERCENTILE = 0.99


def _rated(df: DataFrame, *keys: str) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("episodes"), F.sum(S.LABEL).cast("bigint").alias("readmissions"))
        .withColumn("rate", percent(F.col("readmissions"), F.col("episodes")))
    )


def rate_table(df: DataFrame, group: str, min_episodes: int = 0) -> DataFrame:
    """Episodes, positives and rate per group. A missing text is its own group; other types keep NULL."""
    require_columns(df, group, S.LABEL, table="features")
    if isinstance(df.schema[group].dataType, StringType):
        df = df.withColumn(group, F.coalesce(F.col(group), F.lit(V.NOT_INFORMED)))
    return _rated(df, group).filter(F.col("episodes") >= min_episodes)


def _top_rates(df: DataFrame, group: str, min_episodes: int, top_n: int) -> DataFrame:
    return top_k(rate_table(df, group, min_episodes), top_n, F.col("rate").desc(), F.col(group))


def specialty_rate(df: DataFrame, min_episodes: int = 100, top_n: int = 20) -> DataFrame:
    return _top_rates(df, "especialidade", min_episodes, top_n)


def hospital_rate(df: DataFrame, min_episodes: int = 100, top_n: int = 20) -> DataFrame:
    return _top_rates(df, "executante", min_episodes, top_n)


def monthly_trend(df: DataFrame) -> DataFrame:
    return rate_table(df, "admission_month").orderBy(F.col("admission_month").asc_nulls_last())


def quarterly_trend(df: DataFrame) -> DataFrame:
    """Rate per year and quarter; rows without either are left out."""
    known = df.filter(F.col("admission_year").isNotNull() & F.col("admission_quarter").isNotNull())
    label = F.concat(F.col("admission_year").cast("string"), F.lit(" Q"), F.col("admission_quarter").cast("string"))
    return (
        _rated(known, "admission_year", "admission_quarter")
        .withColumn("quarter", label)
        .orderBy("admission_year", "admission_quarter")
    )


def overall_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.avg(S.LABEL) * 100, F.lit(0.0)).alias("overall_rate"))


def _mean(df: DataFrame, column: str, absent: Column) -> Column:
    return F.avg(column) if column in df.columns else absent


def kpis(df: DataFrame) -> DataFrame:
    """Headline numbers in one pass; a column the table lacks counts as 0."""
    require_columns(df, S.LABEL, table="features")
    total, positives = F.count(F.lit(1)), F.coalesce(F.sum(S.LABEL), F.lit(0)).cast("bigint")
    zero = F.lit(0.0)
    return df.agg(
        total.alias("total_episodes"),
        positives.alias("unplanned_readmissions"),
        positives.alias("readmissions"),
        F.coalesce(percent(positives, total), zero).alias("rate"),
        _mean(df, "length_of_stay_days", zero).alias("avg_los"),
        _mean(df, "previous_hospitalizations", zero).alias("avg_previous_hospitalizations"),
        _mean(df, "admissions_last_365d", zero).alias("avg_admissions_last365"),
    )


def kpis_patients(df: DataFrame) -> DataFrame:
    """Episodes, subjects and subjects with a positive.

    Rows are reduced to one per subject first, so both subject counts come from
    one shuffle instead of two distinct aggregates over expanded rows.
    """
    require_columns(df, S.LABEL, S.ID, table="features")
    measures = (
        "length_of_stay_days", "previous_hospitalizations", "previous_unplanned_readmissions", "admissions_last_365d",
    )
    per_subject = df.groupBy(S.ID).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.sum(S.LABEL).cast("bigint").alias("positives"),
        *[F.sum(c).alias(f"sum_{c}") for c in measures],
        *[F.count(c).alias(f"n_{c}") for c in measures],
    )

    def mean(c: str) -> Column:
        return F.sum(f"sum_{c}").cast("double") / F.nullif(F.sum(f"n_{c}").cast("double"), F.lit(0.0))

    total, positives = F.coalesce(F.sum("episodes"), F.lit(0)), F.coalesce(F.sum("positives"), F.lit(0))
    return per_subject.agg(
        total.cast("bigint").alias("total_episodes"),
        positives.cast("bigint").alias("unplanned_readmissions"),
        F.coalesce(percent(positives, total), F.lit(0.0)).alias("rate"),
        F.count(S.ID).alias("unique_patients"),
        F.count_if((F.col("positives") > 0) & F.col(S.ID).isNotNull()).alias("readmitted_patients"),
        mean("length_of_stay_days").alias("avg_los"),
        mean("previous_hospitalizations").alias("avg_previous_hospitalizations"),
        mean("previous_unplanned_readmissions").alias("avg_previous_unplanned"),
        mean("admissions_last_365d").alias("avg_admissions_last365"),
    )


def outcome(label: str | Column) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    chain = F
    for value, text in V.OUTCOME_LABELS.items():
        chain = chain.when(label == value, text)
    return chain


def los_distribution(df: DataFrame, max_bins: int = 50) -> DataFrame:
    """Histogram of stays up to the 99th percentile, by outcome, in equal whole-day bins.

    Stays are counted per (stay, outcome) first; percentile and bins come from
    those counts, so the exact percentile never holds rows.
    """
    require_columns(df, "length_of_stay_days", S.LABEL, table="features")
    los = F.col("length_of_stay_days").cast("bigint")
    counts = (
        df.filter(F.col("length_of_stay_days") >= 0)
        .groupBy(los.alias("los"), F.col(S.LABEL).alias("label"))
        .agg(F.count(F.lit(1)).alias("episodes"))
    )
    cut = counts.agg(F.percentile("los", F.lit(PERCENTILE), F.col("episodes"))).scalar()
    width = F.greatest(F.lit(1), F.ceil((F.floor(cut) + 1) / F.lit(max_bins))).cast("bigint")
    kept = counts.filter(F.col("los") <= cut).withColumn("width", width)
    start = (F.floor(F.col("los") / F.col("width")) * F.col("width")).cast("bigint")
    return (
        kept.groupBy(start.alias("bin_start"), F.col("width").alias("bin_width"), outcome("label").alias("status"))
        .agg(F.sum("episodes").cast("bigint").alias("episodes"))
        .orderBy("bin_start", "status")
    )


def los_by_outcome(df: DataFrame) -> DataFrame:
    require_columns(df, "length_of_stay_days", S.LABEL, table="features")
    return (
        df.groupBy(S.LABEL)
        .agg(F.avg("length_of_stay_days").alias("length_of_stay_days"))
        .withColumn("status", outcome(S.LABEL))
        .orderBy(S.LABEL)
    )


def top_icd(df: DataFrame, top_n: int = 20) -> DataFrame:
    require_columns(df, "codigocid", S.LABEL, table="features")
    rows = df.filter((F.col(S.LABEL) == 1) & F.col("codigocid").isNotNull())
    counts = count_by(rows, ["codigocid"], "unplanned_readmissions")
    return top_k(counts, top_n, F.col("unplanned_readmissions").desc(), F.col("codigocid"))


def discharge_reason_rate(df: DataFrame, min_episodes: int = 100) -> DataFrame:
    return rate_table(df, "motivoalta", min_episodes).orderBy("rate", "motivoalta")


def discharge_reason_counts(df: DataFrame) -> DataFrame:
    reason = F.coalesce(F.col("motivoalta"), F.lit(V.NOT_INFORMED)).alias("motivoalta")
    return count_by(df, [reason], "episodes").orderBy("episodes", "motivoalta")


def rate_by_history(df: DataFrame, k: int = 30) -> DataFrame:
    return top_k(
        rate_table(df, "previous_hospitalizations"), k, F.col("previous_hospitalizations").asc_nulls_last()
    )


def _largest(df: DataFrame, group: str, k: int) -> DataFrame:
    counts = count_by(df.filter(F.col(group).isNotNull()), [group], "n")
    return top_k(counts, k, F.col("n").desc(), F.col(group)).select(group)


def hospital_specialty_rates(df: DataFrame, min_episodes: int = 100, top: int = 10) -> DataFrame:
    """Rates of the busiest hospitals x busiest specialties, in long form.

    Rows are counted per pair first; only the counts meet the two top-k key
    sets, each at most ``top`` rows.
    """
    require_columns(df, "executante", "especialidade", S.LABEL, table="features")
    pairs = df.groupBy("executante", "especialidade").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum(S.LABEL).cast("bigint").alias("readmissions")
    )
    return (
        pairs.filter(F.col("episodes") >= min_episodes)
        .join(F.broadcast(_largest(df, "executante", top)), "executante", "left_semi")
        .join(F.broadcast(_largest(df, "especialidade", top)), "especialidade", "left_semi")
        .select(
            "executante", "especialidade", "episodes", "readmissions",
            percent(F.col("readmissions"), F.col("episodes")).alias("rate"),
        )
    )


def hospital_specialty_heatmap(df: DataFrame, min_episodes: int = 100, top: int = 10) -> DataFrame:
    """The same rates pivoted: one row per hospital, one column per specialty (at most ``top``)."""
    rates = hospital_specialty_rates(df, min_episodes, top)
    specialties = sorted(r[0] for r in rates.select("especialidade").distinct().limit(top).collect())
    return rates.groupBy("executante").pivot("especialidade", specialties or None).agg(F.max("rate")).orderBy("executante")
