"""One aggregate over the feature table from which the marts of a report are read.

All grouping sets are counted in one scan: a row adds to its group in each of them, tasks aggregate before anything is
shuffled, and what is shuffled and stored follows from the number of groups. The marts then read a few thousand stored
groups each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from episodica import schema as S
from episodica.functions import vocabulary as V
from episodica.functions.numeric import percent
from episodica.marts.filters import FilterSpec, apply_filters
from episodica.operators.reports import top_k
from episodica.sources.contracts import require_columns
from episodica.sources.stages import stage_root

GROUPINGS: dict[str, tuple[str, ...]] = {
    "all": (),
    "specialty": ("especialidade",),
    "hospital": ("executante",),
    "reason": ("motivoalta",),
    "pair": ("executante", "especialidade"),
    "icd": ("codigocid",),
    "month": ("admission_month",),
    "quarter": ("admission_year", "admission_quarter"),
    "history": ("previous_hospitalizations",),
}
KEYS = tuple(dict.fromkeys(k for keys in GROUPINGS.values() for k in keys))
MEASURES = ("length_of_stay_days", "previous_hospitalizations", "admissions_last_365d")


def rate_cube(df: DataFrame) -> DataFrame:
    """Rows (grouping, keys, episodes, readmissions, sum and number of every measure), computed in one scan."""
    require_columns(df, *KEYS, S.LABEL, *MEASURES, table="features")
    # A measure may be a key as well; Spark sets keys to NULL in the sets that leave them out, so measures are copies.
    rows = df.select(*KEYS, F.col(S.LABEL).alias("__label"), *[F.col(m).alias(f"__{m}") for m in MEASURES])
    counted = rows.groupingSets([[F.col(k) for k in keys] for keys in GROUPINGS.values()], *KEYS).agg(
        F.grouping_id(*KEYS).alias("__set"),
        F.count(F.lit(1)).alias("episodes"),
        F.sum("__label").cast("bigint").alias("readmissions"),
        *[F.sum(f"__{m}").cast("double").alias(f"sum_{m}") for m in MEASURES],
        *[F.count(f"__{m}").alias(f"n_{m}") for m in MEASURES],
    )
    numbers = {name: sum(1 << i for i, k in enumerate(reversed(KEYS)) if k not in keys) for name, keys in GROUPINGS.items()}
    name = F
    for grouping, number in numbers.items():
        name = name.when(F.col("__set") == number, grouping)
    return counted.withColumn("grouping", name).drop("__set")


class Cube:
    """A stored cube and the marts read from it."""

    def __init__(self, groups: DataFrame) -> None:
        self.groups = groups

    @classmethod
    def of(cls, df: DataFrame) -> Cube:
        path = f"{stage_root(df.sparkSession)}/cubes/{uuid.uuid4().hex}"
        rate_cube(df).write.parquet(path)
        return cls(df.sparkSession.read.parquet(path))

    def _groups(self, grouping: str) -> DataFrame:
        return self.groups.filter(F.col("grouping") == grouping).select(*GROUPINGS[grouping], "episodes", "readmissions")

    def rates(self, grouping: str, min_episodes: int = 0) -> DataFrame:
        """Episodes, positives and rate per group; a missing text is counted as not informed."""
        groups = self._groups(grouping)
        texts = [k for k in GROUPINGS[grouping] if dict(groups.dtypes)[k] == "string"]
        groups = groups.withColumns({k: F.coalesce(F.col(k), F.lit(V.NOT_INFORMED)) for k in texts})
        summed = groups.groupBy(*GROUPINGS[grouping]).agg(F.sum("episodes").alias("episodes"), F.sum("readmissions").alias("readmissions"))
        rate = percent(F.col("readmissions"), F.col("episodes")).alias("rate")
        return summed.select("*", rate).filter(F.col("episodes") >= min_episodes)

    def top_rates(self, grouping: str, min_episodes: int, top_n: int) -> DataFrame:
        return top_k(self.rates(grouping, min_episodes), top_n, F.col("rate").desc(), *[F.col(k) for k in GROUPINGS[grouping]])

    def kpis(self) -> DataFrame:
        zero = F.lit(0.0)

        def mean(measure: str) -> Column:
            return F.sum(f"sum_{measure}") / F.nullif(F.sum(f"n_{measure}").cast("double"), zero)

        total, positives = (F.coalesce(F.sum(c), F.lit(0)).cast("bigint") for c in ("episodes", "readmissions"))
        return self.groups.filter(F.col("grouping") == "all").agg(
            total.alias("total_episodes"),
            positives.alias("unplanned_readmissions"),
            positives.alias("readmissions"),
            F.coalesce(percent(positives, total), zero).alias("rate"),
            mean("length_of_stay_days").alias("avg_los"),
            mean("previous_hospitalizations").alias("avg_previous_hospitalizations"),
            mean("admissions_last_365d").alias("avg_admissions_last365"),
        )

    def top_icd(self, top_n: int = 20) -> DataFrame:
        counts = self._groups("icd").filter(F.col("codigocid").isNotNull() & (F.col("readmissions") > 0))
        counts = counts.select("codigocid", F.col("readmissions").alias("unplanned_readmissions"))
        return top_k(counts, top_n, F.col("unplanned_readmissions").desc(), F.col("codigocid"))

    def monthly_trend(self) -> DataFrame:
        return self.rates("month").orderBy(F.col("admission_month").asc_nulls_last())

    def quarterly_trend(self) -> DataFrame:
        known = self.rates("quarter").filter(F.col("admission_year").isNotNull() & F.col("admission_quarter").isNotNull())
        label = F.concat(F.col("admission_year").cast("string"), F.lit(" Q"), F.col("admission_quarter").cast("string"))
        return known.withColumn("quarter", label).orderBy("admission_year", "admission_quarter")

    def reason_rates(self, min_episodes: int = 100) -> DataFrame:
        return self.rates("reason", min_episodes).orderBy("rate", "motivoalta")

    def _largest(self, grouping: str, k: int) -> DataFrame:
        (key,) = GROUPINGS[grouping]
        groups = self._groups(grouping).filter(F.col(key).isNotNull())
        return top_k(groups, k, F.col("episodes").desc(), F.col(key)).select(key)

    def hospital_specialty_rates(self, min_episodes: int = 100, top: int = 10) -> DataFrame:
        """Rates of the busiest hospitals x busiest specialties, in long form; both key lists hold at most ``top`` rows."""
        return (
            self._groups("pair")
            .filter(F.col("episodes") >= min_episodes)
            .join(F.broadcast(self._largest("hospital", top)), "executante", "left_semi")
            .join(F.broadcast(self._largest("specialty", top)), "especialidade", "left_semi")
            .select(
                "executante", "especialidade", "episodes", "readmissions",
                percent(F.col("readmissions"), F.col("episodes")).alias("rate"),
            )
        )

    def heatmap(self, min_episodes: int = 100, top: int = 10) -> DataFrame:
        """The same rates pivoted: one row per hospital, one column per specialty (at most ``top``)."""
        rates = self.hospital_specialty_rates(min_episodes, top)
        specialties = sorted(r[0] for r in rates.select("especialidade").distinct().limit(top).collect())
        return rates.groupBy("executante").pivot("especialidade", specialties or None).agg(F.max("rate")).orderBy("executante")


def filtered_marts(features: DataFrame, spec: FilterSpec = FilterSpec()) -> dict[str, DataFrame]:
    """The marts over the rows that meet the filters, all read from one cube; ``min_episodes`` and ``top_n`` drive them."""
    cube = Cube.of(apply_filters(features, spec))
    return {
        "kpis": cube.kpis(),
        "specialty_rate": cube.top_rates("specialty", spec.min_episodes, spec.top_n),
        "hospital_rate": cube.top_rates("hospital", spec.min_episodes, spec.top_n),
        "discharge_reason_rate": cube.reason_rates(spec.min_episodes),
        "hospital_specialty_rates": cube.hospital_specialty_rates(spec.min_episodes),
        "top_icd": cube.top_icd(spec.top_n),
        "monthly_trend": cube.monthly_trend(),
        "quarterly_trend": cube.quarterly_trend(),
    }
