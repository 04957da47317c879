"""Type-safe feature table for the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from episodica import schema as S
from episodica.functions.numeric import to_number
from episodica.sources.contracts import require_columns


def clean_features(df: DataFrame) -> DataFrame:
    """Coerce numbers (comma decimals accepted), label and times; counts and label default to 0.

    Columns that already have the right type are passed on as they are.
    """
    require_columns(df, S.LABEL)
    types = {f.name: f.dataType for f in df.schema}
    changes = {}
    for name in (*S.FEATURE_NUMBERS, S.LABEL):
        if name not in types:
            continue
        value = F.col(name) if isinstance(types[name], NumericType) else to_number(name)
        if name in S.FEATURE_COUNTS:
            value = F.coalesce(value, F.lit(0)).cast("bigint")
        elif name == S.LABEL:
            # Like the numbers, a text label is read; unlike them a comma is no decimal sign here.
            text = isinstance(types[name], StringType)
            value = F.coalesce(F.col(name).try_cast("double") if text else F.col(name), F.lit(0)).cast("int")
        changes[name] = value
    for name in S.FEATURE_TIMES:
        if name in types:
            changes[name] = F.col(name).try_cast("timestamp_ntz")
    return df.withColumns(changes)
