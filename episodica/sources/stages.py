"""Stage tables: written once as Parquet, read back with pruning and a short lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}

#: Repeated texts take a few bytes in Parquet and hundreds in memory, so a scan task is bounded by rows: a file holds at
#: most so many, and Spark counts every file as 4 MB more than it has when it packs files into tasks.
ROWS_PER_FILE = 100_000


def stage_root(spark: SparkSession) -> str:
    """Shared folder the cluster names in spark.checkpoint.dir; a new temporary one where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if shared:
        return f"{shared.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="episodica-")
    return _local_roots[app]


class StageStore:
    """Named stage tables of one run under one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._done: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage table, built and written on first use."""
        if name not in self._done:
            build().write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(self.path(name))
            self._done.add(name)
        return self.spark.read.parquet(self.path(name))
