"""Column statistics from mergeable sketches, kept per part of a table.

A part (a day of rows, a folder, a load) is read once and leaves one row per column: exact counts, a distinct-count sketch
and a quantile sketch of numbers or text lengths. A catalog merges the rows of all parts, so a new part costs its own scan
and nothing of the old ones, and what is shuffled follows from the number of columns and tasks, not of rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodica.sources.extracts import path_exists

#: Base-2 logarithm of the registers of a distinct sketch, and the relative standard error of its estimate.
LG_REGISTERS = 14
DISTINCT_ERROR = 1.04 / 2 ** (LG_REGISTERS / 2)
#: Size of a quantile sketch, and the rank error that its answers keep with a probability of 99 percent.
QUANTILE_SIZE = 200
RANK_ERROR = 0.0165
QUANTILES = {"least": 0.0, "median": 0.5, "p99": 0.99, "greatest": 1.0}

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def column_sketches(df: DataFrame, table: str) -> DataFrame:
    """One row per column of one part of a table, in one pass."""
    states, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, (name, kind) in enumerate(df.dtypes):
        column = F.col(f"`{name}`")
        number = kind in _NUMBERS or kind.startswith("decimal")
        measure = column.cast("double") if number else F.char_length(column.cast("string")).cast("double")
        states += [
            F.count(column).alias(f"n{i}"),
            F.hll_sketch_agg(column.cast("string"), LG_REGISTERS).alias(f"d{i}"),
            F.kll_sketch_agg_double(F.when(~F.isnan(measure), measure), QUANTILE_SIZE).alias(f"q{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"), F.lit(kind).alias("column_type"), F.col("rows"),
                (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct_sketch"), F.col(f"q{i}").alias("measure_sketch"),
            )
        )
    return df.agg(*states).select(F.lit(table).alias("table_name"), F.inline(F.array(*rows)))


def merged_catalog(sketches: DataFrame) -> DataFrame:
    """One row per column over all parts: rows, nulls, estimated distinct values, quantiles of numbers or text lengths."""
    merged = sketches.groupBy("table_name", "column_name", "column_type").agg(
        F.sum("rows").cast("bigint").alias("rows"),
        F.sum("nulls").cast("bigint").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_estimate"),
        F.kll_merge_agg_double("measure_sketch").alias("__q"),
    )
    some = F.kll_sketch_get_n_double("__q") > 0
    quantiles = [F.when(some, F.kll_sketch_get_quantile_double("__q", F.lit(q))).alias(n) for n, q in QUANTILES.items()]
    return merged.select("*", *quantiles).drop("__q")


class SketchStore:
    """Sketches of parts under one folder; a part added again replaces what it held."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, part: str, tables: Mapping[str, DataFrame]) -> None:
        made = [column_sketches(df, name) for name, df in tables.items()]
        reduce(DataFrame.unionByName, made).write.mode("overwrite").parquet(f"{self.folder}/part={part}")

    def catalog(self) -> DataFrame:
        if not path_exists(self.spark, self.folder):
            raise FileNotFoundError(self.folder)
        return merged_catalog(self.spark.read.parquet(self.folder))
