"""Spark session with the settings the jobs are written for."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins on (subject, time) may reuse a partitioning on subject alone.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


# Shuffle partitions are planned at this size; AQE merges small ones at run time.
PARTITION_BYTES = 128 * 1024 * 1024


def sized_for(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings that follow from the size of the input and of the cluster."""
    partitions = max(2 * cores, math.ceil(input_bytes / PARTITION_BYTES))
    return {"spark.sql.shuffle.partitions": str(partitions)}


def build_session(app_name: str = "episodica", master: str | None = None, **conf: str) -> SparkSession:
    """Create or fetch a session. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
