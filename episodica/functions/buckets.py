"""Bucket labels for stays and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from episodica.functions import vocabulary as V


def stay_bucket(days: str | Column) -> Column:
    """Five stay labels. A NULL stay falls to the open bucket, a negative one to the first."""
    days = F.col(days) if isinstance(days, str) else days
    chain = F
    for upper, label in V.STAY_BUCKETS:
        chain = chain.when(days <= upper, label)
    return chain.otherwise(V.STAY_BUCKET_OPEN)


def audit_stay_bucket(days: Column, discharge: Column) -> Column:
    chain = F.when(discharge.isNull(), V.AUDIT_STAY_MISSING)
    for upper, label in V.AUDIT_STAY_BUCKETS:
        chain = chain.when(days <= upper, label)
    return chain.otherwise(V.AUDIT_STAY_OPEN)


def audit_stay_rank(bucket: Column) -> Column:
    labels = [label for _, label in V.AUDIT_STAY_BUCKETS] + [V.AUDIT_STAY_OPEN, V.AUDIT_STAY_MISSING]
    return F.array_position(F.array(*[F.lit(label) for label in labels]), bucket)


def overlap_bucket(hours: Column, days: Column) -> Column:
    chain = F
    for upper, label in V.OVERLAP_HOUR_BUCKETS:
        chain = chain.when(hours <= upper, label)
    for upper, label in V.OVERLAP_DAY_BUCKETS:
        chain = chain.when(days <= upper, label)
    return chain.otherwise(V.OVERLAP_OPEN)
