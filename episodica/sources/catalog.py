"""Catalog of tables: counts, schema, column statistics, shared keys."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from episodica import schema as S
from episodica.operators.episodes import has_admission


#: Texts beyond this length are counted by digest.
LONG_CHARS = 40


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union(
        [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    )


#: SQL names of the types that tables have.
_SQL_TYPES = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE",
    "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
    "binary": "BLOB", "array<float>": "FLOAT[]", "array<double>": "DOUBLE[]",
}


def describe_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every column of every table with its SQL type and its number of values; one pass per table."""
    parts = []
    for table, df in tables.items():
        counts = df.agg(*[F.count(F.col(f"`{name}`")).alias(f"n{i}") for i, name in enumerate(df.columns)])
        rows = F.array(
            *[
                F.struct(
                    F.lit(name).alias("column_name"), F.lit(_SQL_TYPES.get(kind, kind.upper())).alias("column_type"),
                    F.col(f"n{i}").alias("non_null"),
                )
                for i, (name, kind) in enumerate(df.dtypes)
            ]
        )
        parts.append(counts.select(F.lit(table).alias("table_name"), F.inline(rows)))
    return _union(parts)


def _fingerprints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows and the sums of two row hashes. They do not depend on row order and add up over tasks.

    A hash passes NULLs by, so each value is followed by whether it is NULL.
    """
    parts = []
    for name, df in tables.items():
        fields = [f for c in df.columns for f in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
        sums = [F.sum(F.xxhash64(F.lit(seed), *fields).cast("decimal(20,0)")).alias(f"h{seed}") for seed in (1, 2)]
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), *sums).select(F.lit(name).alias("table_name"), "*"))
    return _union(parts)


def _differing_rows(df: DataFrame, copy: DataFrame) -> DataFrame:
    sides = df.withColumn("__side", F.lit(1)).unionByName(copy.withColumn("__side", F.lit(-1)))
    kinds = sides.groupBy(*df.columns).agg(F.sum("__side").alias("surplus"))
    return kinds.agg(F.coalesce(F.sum(F.abs("surplus")), F.lit(0)).alias("differing_rows"))


def compare_tables(tables: Mapping[str, DataFrame], copies: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table, and how many rows, counted with repetition, one side has and the other lacks.

    Sides are compared by fingerprint first, which moves no rows; only tables whose fingerprints differ are compared row
    by row. One fingerprint per table and side reaches the driver.
    """
    ours = {r["table_name"]: r for r in _fingerprints(tables).collect()}
    theirs = {r["table_name"]: r for r in _fingerprints({n: copies[n] for n in tables}).collect()}
    parts = []
    for name, df in tables.items():
        if ours[name] == theirs[name]:
            found = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("differing_rows"))
        else:
            found = _differing_rows(df, copies[name])
        rows = F.lit(ours[name]["rows"]).cast("bigint").alias("rows")
        parts.append(found.select(F.lit(name).alias("table_name"), rows, "differing_rows"))
    return _union(parts)


def sample_rows(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """First n rows; in a fixed order when one is given."""
    return (df.orderBy(*order) if order else df).limit(n)


def as_text(name: str, kind: str) -> Column:
    """A value as text that other engines write alike: numbers with six decimals, times to the second."""
    column = F.col(f"`{name}`")
    if kind in ("float", "double"):
        return column.cast("decimal(38,6)").cast("string")
    if kind.startswith("timestamp"):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    return column.cast("string")


def sample_tables(tables: Mapping[str, DataFrame], n: int = 5) -> DataFrame:
    """The first n rows of every table, ordered by all its columns: table_name, row (from 1), column_name, value (text)."""
    parts = []
    for table, df in tables.items():
        order = [F.col(f"`{c}`").asc_nulls_first() for c in df.columns]
        values = F.array(*[F.struct(F.lit(c).alias("column_name"), as_text(c, kind).alias("value")) for c, kind in df.dtypes])
        few = sample_rows(df, n, order)
        numbered = few.withColumn("row", F.row_number().over(Window.orderBy(*order)))
        parts.append(numbered.select(F.lit(table).alias("table_name"), "row", F.inline(values)))
    return _union(parts)


def column_statistics(df: DataFrame, table: str, approximate: bool = False) -> DataFrame:
    """Type, rows, NULLs and distinct values of every column in one pass.

    Rows are unpivoted and counted per (column, value) map-side first, so a
    frequent value costs one row per task. A long value takes part as its
    128-bit digest.
    """

    def short(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string")
        return F.when(F.char_length(value) <= LONG_CHARS, value).otherwise(F.concat(F.lit("digest "), F.md5(value)))

    pairs = F.array(
        *[F.struct(F.lit(i).alias("position"), short(name).alias("value")) for i, name in enumerate(df.columns)]
    )
    values = df.select(F.inline(pairs))
    if approximate:
        per_column = values.groupBy("position").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("value").isNull()).alias("nulls"),
            F.approx_count_distinct("value").alias("distinct_values"),
        )
    else:
        counted = values.groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))
        per_column = counted.groupBy("position").agg(
            F.sum("n").cast("bigint").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("nulls"),
            F.count("value").alias("distinct_values"),
        )

    def at_position(texts: list[str]):
        return F.get(F.array(*[F.lit(t) for t in texts]), F.col("position"))

    return per_column.select(
        F.lit(table).alias("table_name"),
        at_position(df.columns).alias("column_name"),
        at_position([kind for _, kind in df.dtypes]).alias("column_type"),
        "rows",
        "nulls",
        "distinct_values",
    )


def data_catalog(tables: Mapping[str, DataFrame], approximate: bool = False) -> DataFrame:
    return _union([column_statistics(df, name, approximate) for name, df in tables.items()])


def key_overlap_pairs(tables: Mapping[str, DataFrame], key: str = S.ID) -> DataFrame:
    """Distinct keys shared by every pair of tables.

    One pass: each key gets a bit mask of the tables that hold it, masks are
    counted, and pairs are read off the few masks. Duplicate keys meet in the
    map-side half of the aggregate.
    """
    names = list(tables)
    tagged = _union(
        [df.filter(F.col(key).isNotNull()).select(key, F.lit(1 << i).alias("bit")) for i, df in enumerate(tables.values())]
    )
    masks = (
        tagged.groupBy(key).agg(F.bit_or("bit").alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("keys"))
    )
    pairs = list(combinations(range(len(names)), 2))
    shared = masks.agg(
        *[
            F.coalesce(
                F.sum(F.when(F.col("mask").bitwiseAND((1 << a) | (1 << b)) == ((1 << a) | (1 << b)), F.col("keys"))),
                F.lit(0),
            ).alias(f"p{a}_{b}")
            for a, b in pairs
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(names[a]).alias("table_a"),
                F.lit(names[b]).alias("table_b"),
                F.col(f"p{a}_{b}").cast("bigint").alias("shared_keys"),
            )
            for a, b in pairs
        ]
    )
    return shared.select(F.inline(rows))


def distinct_grain_check(raw: DataFrame) -> DataFrame:
    """Rows against distinct subjects' keys at three grains; a NULL counts as an empty text.

    Rows are first reduced to distinct (subject, admission, request) triples, then the triples to distinct pairs of
    either kind, each with the number of triples below it. Every step is one plain aggregate over typed columns.
    """

    def value(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)

    triples = (
        raw.filter(has_admission())
        .select(value(S.ID), value(S.ADMISSION_TEXT), value(S.REQUEST_DATE))
        .groupBy(S.ID, S.ADMISSION_TEXT, S.REQUEST_DATE)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    admissions = triples.groupBy(S.ID, S.ADMISSION_TEXT).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("triples"))
    requests = triples.groupBy(S.ID, S.REQUEST_DATE).agg(F.count(F.lit(1)).alias("triples"))
    return admissions.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count(F.lit(1)).alias("by_patient_admission"),
        F.coalesce(F.sum("triples"), F.lit(0)).cast("bigint").alias("by_patient_request_admission"),
    ).select(
        "total_rows",
        "by_patient_admission",
        requests.agg(F.count(F.lit(1))).scalar().alias("by_patient_request_date"),
        "by_patient_request_admission",
    )
