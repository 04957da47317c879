"""Report building blocks: shares, top-k, histograms and reproducible samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from episodica.functions.numeric import percent2


def count_by(df: DataFrame, keys: Sequence[Column | str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def share_of_total(df: DataFrame, keys: Sequence[Column | str], count: str, share: str = "percentage") -> DataFrame:
    """Groups with their count and their percentage of all rows.

    The total is a one-row aggregate over the counts, not a window over all
    groups, so the groups never meet in one task and the shuffle is shared.
    """
    counts = count_by(df, keys, count)
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(share, percent2(F.col(count), total))


def share_within(
    df: DataFrame, group: Column, member: Column, names: tuple[str, str], count: str, share: str
) -> DataFrame:
    """Counts per (group, member) and the percentage inside the group, over the aggregated rows."""
    counts = count_by(df, [group.alias(names[0]), member.alias(names[1])], count)
    whole = F.sum(count).over(Window.partitionBy(names[0]))
    return counts.withColumn(share, percent2(F.col(count), whole))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows; the order must be total for the same rows each time."""
    return df.orderBy(*order).limit(k)


def histogram(df: DataFrame, column: str, count: str = "episodes") -> DataFrame:
    return count_by(df, [column], count).orderBy(F.col(column).asc_nulls_last())


def random_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """n rows in an order drawn from a digest of their keys; the same seed gives the same rows."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(draw, *keys).limit(n)


def prefix_lookup(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text starts with the prefix; pushed to the scan."""
    return df.filter(F.col(column).startswith(prefix))
