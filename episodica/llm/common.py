"""What the corpus operators share: row keys, scratch tables and connected components.

Every operator reads only the columns it names, so extra columns cannot clash with its own. A document is known by
``ROW_KEY``: its doc_id (null sorts first, as the smallest long) and a hash of its text. Repeated rows therefore share one
key and one result, and two different texts under one doc_id stay apart.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodica.sources.stages import stage_root

NULL_ID = -(2**63)
ROW_KEY = ["did", "rk"]


def ship_code(spark: SparkSession) -> None:
    """Let Python workers find this package where it is used from its source folder; on a cluster use --py-files."""
    here = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, here])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64(F.col(text_col)).alias("rk"),
    ]


def id_of(did: Column) -> Column:
    """The doc_id behind a row key."""
    return F.when(did != NULL_ID, did)


def vocabulary_file(name: str) -> str:
    """Path of a public vocabulary file; TOKENIZERS_DIR names another folder."""
    return f"{os.environ.get('TOKENIZERS_DIR', '/opt/tokenizers')}/{name}"


class Shared:
    """A broadcast value with a key, under which workers keep what they make of it."""

    def __init__(self, spark: SparkSession, value) -> None:
        ship_code(spark)
        self._broadcast = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    def release(self) -> None:
        """Give the memory of the executors back; the value is sent again if a task still asks for it."""
        self._broadcast.unpersist()

    @property
    def value(self):
        return self._broadcast.value


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch with at most so many bytes of text, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def per_key(rows: DataFrame, keys: list[str], *measures: Column) -> DataFrame:
    """Group and aggregate, for a join back to the rows.

    Keys are grouped as one struct and unpacked after, so the join gets exchanges of its own on both sides: a hot key is
    reduced before the first shuffle, and AQE may split its rows in the join. Grouped by the plain keys, aggregate and join
    would share one stage, which cannot be split.
    """
    packed = rows.groupBy(F.struct(*keys).alias("__key")).agg(*measures)
    return packed.select("__key.*", *[c for c in packed.columns if c != "__key"])


class Scratch:
    """Tables of one run in the shared folder: each cuts the lineage, so a lost executor costs one step."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship_code(spark)  # operators that keep tables start workers too
        self.spark = spark
        self.folder = f"{stage_root(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.folder}/{self._n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (v, c), c the smallest vertex reachable from v.

    Each round takes the smallest label among neighbours and then the label of that label, so a path of n vertices needs
    about log n rounds. Only (vertex, label) pairs move; nothing but one count per round reaches the driver.
    """
    both = scratch.table(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.table(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("c")))
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("c").alias("m"))
        hooked = labels.join(near, labels.v == near.a).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("v").alias("u"), F.col("c").alias("top"))
        moved = scratch.table(
            hooked.join(up, hooked.c == up.u, "left").select("v", "old", F.least("c", F.coalesce("top", "c")).alias("c"))
        )
        labels = moved.select("v", "c")
        if moved.filter("c <> old").isEmpty():
            return labels
