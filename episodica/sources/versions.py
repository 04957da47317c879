"""Tables of one folder that change together: versions are written apart, and one small append makes a version current.

A build writes all its tables under a new version folder. Only when the last one is complete does a row in the pointer
table name the version. A build that ends early leaves the pointer, and with it the tables of the build before, as they
were; readers keep the version they opened, whatever is committed meanwhile.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodica.sources.extracts import path_exists, require_path

POINTER = "versions"


@dataclass(frozen=True)
class Version:
    """One version of the tables; its folder does not change after the commit."""

    spark: SparkSession
    number: int
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(require_path(self.spark, f"{self.folder}/{name}"))

    def has(self, name: str) -> bool:
        return path_exists(self.spark, f"{self.folder}/{name}")


class VersionedTables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _committed(self) -> list[tuple[int, str]]:
        """Numbers and folders of committed versions, newest first; one row per commit that was not pruned."""
        pointer = f"{self.folder}/{POINTER}"
        if not path_exists(self.spark, pointer):
            return []
        rows = self.spark.read.schema("number long, name string").parquet(pointer).collect()
        return sorted(((r["number"], r["name"]) for r in rows), reverse=True)

    def current(self) -> Version | None:
        """The newest committed version."""
        found = self._committed()
        return Version(self.spark, found[0][0], f"{self.folder}/{found[0][1]}") if found else None

    def begin(self) -> Version:
        """A new version to write to. Its folder is its own, also beside a build that failed or runs at the same time."""
        before = self.current()
        number = before.number + 1 if before else 1
        return Version(self.spark, number, f"{self.folder}/v{number:06d}-{uuid.uuid4().hex[:8]}")

    def commit(self, version: Version) -> None:
        """Make a completely written version the current one."""
        name = version.folder.rsplit("/", 1)[1]
        row = self.spark.range(1).select(F.lit(version.number).cast("long").alias("number"), F.lit(name).alias("name"))
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/{POINTER}")

    def prune(self, keep: int = 2) -> list[str]:
        """Delete all but the newest versions, and what builds that failed have left; returns the names of the deleted.

        Readers of a deleted version fail, so ``keep`` should cover the longest reader. Not to be run beside a build.
        """
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        kept = {name for _, name in self._committed()[:keep]}
        found = [s.getPath() for s in files.listStatus(hadoop) if s.isDirectory()]
        old = [p for p in found if p.getName().startswith("v0") and p.getName() not in kept]
        for path in old:
            files.delete(path, True)
        return sorted(p.getName() for p in old)


def open_tables(spark: SparkSession, folder: str) -> Version:
    """The current version of a folder, or the folder itself where its tables lie in it directly."""
    return VersionedTables(spark, folder).current() or Version(spark, 0, require_path(spark, folder.rstrip("/")))
