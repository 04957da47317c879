"""Subjects with very many rows.

A window partitioned by subject puts one subject in one task. Subjects above a row threshold are therefore handled
apart: their rows, laid in the order that the window needs, are cut into slices of about equal depth. The cuts follow the
whole order, down to the text that breaks ties, so a burst on one day or at one instant is cut like any other stretch.
Every (subject, slice) is worked on by itself, and a small summary per slice carries state across the cuts.

The cut rows are stored, so a lost and recomputed task sees the same cuts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from episodica.sources.stages import stage_root

# More heavy subjects or slices than this are matched with a shuffle join instead of a broadcast.
MAX_BROADCAST_KEYS = 100_000
MAX_COLLECTED_KEYS = 10_000

# The most rows of a slice. Cuts come from a sample, so slices are planned at half of it.
ROWS_PER_SLICE = 2_000_000

SLICE = "__slice"


@dataclass(frozen=True)
class HeavyKeys:
    """The heavy subjects, their number, and how deep their slices may be."""

    keys: DataFrame
    count: int
    rows_per_slice: int = ROWS_PER_SLICE

    def _side(self, key: str) -> DataFrame:
        side = self.keys.select(F.col(key).alias("__heavy"))
        return F.broadcast(side) if self.count <= MAX_BROADCAST_KEYS else side

    def only(self, df: DataFrame, key: str) -> DataFrame:
        return df.join(self._side(key), F.col(key).eqNullSafe(F.col("__heavy")), "left_semi")

    def without(self, df: DataFrame, key: str) -> DataFrame:
        return df.join(self._side(key), F.col(key).eqNullSafe(F.col("__heavy")), "left_anti")


def find_heavy_keys(
    parts: DataFrame | Sequence[DataFrame], key: str, heavy_rows: int, rows_per_slice: int = ROWS_PER_SLICE
) -> HeavyKeys | None:
    """Subjects with more than ``heavy_rows`` rows in all parts together, or None when there is none.

    The parts are the tables whose rows share the subject's timeline. Reads the key column only, and nothing but row
    counts when all tables together are below the threshold.
    """
    parts = [parts] if isinstance(parts, DataFrame) else list(parts)
    if sum(p.count() for p in parts) <= heavy_rows:
        return None
    rows = parts[0].select(key)
    for more in parts[1:]:
        rows = rows.unionAll(more.select(key))
    busy = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy_rows)
    few = busy.limit(MAX_COLLECTED_KEYS + 1).collect()
    if not few:
        return None
    if len(few) > MAX_COLLECTED_KEYS:
        return HeavyKeys(busy.select(key), busy.count(), rows_per_slice)
    # A short list is kept on the driver, so that later plans do not count the tables again.
    keys = rows.sparkSession.createDataFrame([(r[key],) for r in few], busy.select(key).schema)
    return HeavyKeys(keys, len(few), rows_per_slice)


@dataclass(frozen=True)
class Slices:
    """Stored rows of heavy subjects with the number of their slice; numbers grow along the order within a subject."""

    rows: DataFrame
    key: str
    small: bool

    def window(self, *order: Column) -> WindowSpec:
        return Window.partitionBy(self.key, SLICE).orderBy(*order)

    def along(self) -> WindowSpec:
        """The slices of a subject, in order: a window over summaries."""
        return Window.partitionBy(self.key).orderBy(SLICE)

    def earlier(self) -> WindowSpec:
        """The slices of a subject before one."""
        return self.along().rowsBetween(Window.unboundedPreceding, -1)

    def with_state(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        """Rows beside the state of their slice; there are no more states than slices."""
        names = {self.key: "__state_key", SLICE: "__state_slice"}
        side = state.withColumnsRenamed(names)
        side = F.broadcast(side) if self.small else side
        on = (F.col(self.key) == F.col("__state_key")) & (F.col(SLICE) == F.col("__state_slice"))
        return rows.join(side, on, "left").drop("__state_key", "__state_slice")


def cut(rows: DataFrame, key: str, order: Sequence[Column], heavy: HeavyKeys) -> Slices:
    """Cut the rows of heavy subjects into slices along (key, order). The key column must not be NULL.

    Order should tell rows apart as far as it can: rows that are equal in it are never cut.
    """
    spark = rows.sparkSession
    n = max(1, math.ceil(2 * rows.count() / heavy.rows_per_slice))
    path = f"{stage_root(spark)}/slices/{uuid.uuid4().hex}"
    # A range partition is one stretch of the whole order, so its number can number the slice.
    placed = rows.repartitionByRange(n, F.col(key), *order).withColumn(SLICE, F.spark_partition_id())
    placed.write.parquet(path)
    return Slices(spark.read.schema(placed.schema).parquet(path), key, n + heavy.count <= MAX_BROADCAST_KEYS)


def null_safe_key(key: str) -> Column:
    """The key as a one-field struct: never NULL itself, so a plain equi-join and a window group NULL keys alike."""
    return F.struct(key)


def history_order(ts: str, text: str) -> list[Column]:
    """Total order of a subject's rows: by time, rows without a time last and by digest of their text."""
    return [
        F.col(ts).asc_nulls_last(),
        F.when(F.col(ts).isNull(), F.md5(F.col(text))).asc(),
        F.col(text).asc_nulls_last(),
    ]
