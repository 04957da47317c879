"""Schema contracts, checked without running a job."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def column_set(df: DataFrame) -> set[str]:
    return set(df.columns)


def missing_columns(df: DataFrame, *names: str) -> list[str]:
    return sorted(set(names) - column_set(df))


def require_columns(df: DataFrame, *names: str, table: str = "table") -> DataFrame:
    """The same DataFrame, or ValueError listing what is missing."""
    missing = missing_columns(df, *names)
    if missing:
        raise ValueError(f"Columns missing in {table}: {missing}")
    return df


def optional_columns(df: DataFrame, names: Mapping[str, str]) -> list[Column]:
    """Existing columns under their new names; absent ones are left out."""
    present = column_set(df)
    return [F.col(source).alias(name) for source, name in names.items() if source in present]
