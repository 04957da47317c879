"""What a delimited file is like: its separator, from a sample, and the types of its columns, from all rows."""

from __future__ import annotations

import csv
import logging
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodica.functions.temporal import parse_time

log = logging.getLogger(__name__)

SEPARATORS = (",", ";", "\t", "|")
#: The sample that reaches the driver: so many lines of the first file, and so many characters of each.
SAMPLE_LINES, SAMPLE_CHARS = 500, 20_000


def agreement(lines: list[str], sep: str) -> tuple[float, int]:
    """Share of records with the commonest number of fields, and that number; (0, 1) if nothing is separated."""
    counts = Counter(len(r) for r in csv.reader(lines, delimiter=sep) if r)
    if not counts:
        return 0.0, 1
    fields, n = max(counts.items(), key=lambda c: (c[1], c[0]))
    return (n / sum(counts.values()), fields) if fields > 1 else (0.0, 1)


def detect_separator(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The separator under which the most records agree on their number of fields; a comma where nothing is separated.

    Ties go to the separator that makes more fields. Whether all rows agree is for the read to count.
    """
    read = spark.read.option("encoding", encoding)
    rows = read.text(path).select(F.substring("value", 1, SAMPLE_CHARS).alias("line")).limit(SAMPLE_LINES).collect()
    lines = [r.line.rstrip("\r") + "\n" for r in rows if len(r.line) < SAMPLE_CHARS]
    scores = {sep: agreement(lines, sep) for sep in SEPARATORS}
    best = max(SEPARATORS, key=lambda sep: scores[sep])
    if scores[best][0] < 1.0:
        log.warning("%s: %.0f of 100 sampled records agree on %d fields", path, 100 * scores[best][0], scores[best][1])
    return best if scores[best][1] > 1 else SEPARATORS[0]


def _readers() -> dict[str, object]:
    """Kinds from narrow to wide, each with the value of a text or NULL if it is not of that kind.

    Digits with leading zeros are codes, not numbers.
    """

    def number(text: Column, pattern: str, kind: str) -> Column:
        return F.when(text.rlike(pattern), text.try_cast(kind))

    return {
        "bigint": lambda text: number(text, r"^[+-]?(0|[1-9][0-9]*)$", "bigint"),
        "double": lambda text: number(text, r"^[+-]?(0|[1-9][0-9]*)?(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "double"),
        "boolean": lambda text: F.when(F.lower(text).isin("true", "false"), text.try_cast("boolean")),
        "timestamp_ntz": parse_time,
    }


def type_report(df: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row per text column: column_name, kind, n_values, n_misfits (values that the kind cannot hold).

    All rows count, in one pass. The first kind whose misfits are at most ``tolerance`` of the values is taken, else
    string; a column without values is string.
    """
    readers = _readers()
    names = [name for name, kind in df.dtypes if kind == "string"]
    counts = []
    for i, name in enumerate(names):
        text = F.col(f"`{name}`")
        counts.append(F.count(text).alias(f"n{i}"))
        counts += [F.count_if(text.isNotNull() & read(text).isNull()).alias(f"m{i}_{kind}") for kind, read in readers.items()]
    rows = []
    for i, name in enumerate(names):
        n = F.col(f"n{i}")
        chosen = F.struct(F.lit("string").alias("kind"), F.lit(0).cast("bigint").alias("n_misfits"))
        for kind in reversed(readers):
            misfits = F.col(f"m{i}_{kind}")
            fitting = F.struct(F.lit(kind).alias("kind"), misfits.alias("n_misfits"))
            chosen = F.when((n > 0) & (misfits <= n * F.lit(tolerance)), fitting).otherwise(chosen)
        rows.append(F.struct(F.lit(name).alias("column_name"), chosen["kind"].alias("kind"), n.alias("n_values"), chosen["n_misfits"].alias("n_misfits")))
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def typed(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Text columns as the given kinds; values that do not fit become NULL, as the report counts them."""
    readers = _readers()
    return df.select(
        *[readers[kinds[c]](F.col(f"`{c}`")).alias(c) if kinds.get(c, "string") != "string" else F.col(f"`{c}`") for c in df.columns]
    )


def kinds_of(report: DataFrame) -> dict[str, str]:
    """The kinds of a report; one row per column of a table reaches the driver."""
    return {r["column_name"]: r["kind"] for r in report.collect()}
