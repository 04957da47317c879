"""CSV extracts in, Parquet tables and CSV reports out."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from episodica import schema as S
from episodica.functions import vocabulary as V
from episodica.sources.dialect import detect_separator, type_report
from episodica.sources.records import records

log = logging.getLogger(__name__)

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class CsvSpec:
    """One extract: file, the columns the jobs need, separator (found from a sample if None) and encoding."""

    path: str
    schema: T.StructType | None = None
    sep: str | None = None
    encoding: str = "UTF-8"


def standard_specs(folder: str, sep: str | None = None) -> dict[str, CsvSpec]:
    return {
        name: CsvSpec(f"{folder.rstrip('/')}/{file}", S.RAW_SCHEMAS[name], sep)
        for name, file in V.EXTRACT_FILES.items()
    }


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds the path, local or remote; reads nothing."""
    try:
        spark.read.text(path).schema
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def require_path(spark: SparkSession, path: str) -> str:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return path


def with_separator(spark: SparkSession, spec: CsvSpec) -> CsvSpec:
    return spec if spec.sep else replace(spec, sep=detect_separator(spark, spec.path, spec.encoding))


def _header(spark: SparkSession, spec: CsvSpec) -> list[str]:
    return spark.read.csv(
        spec.path, header=True, sep=spec.sep, encoding=spec.encoding, inferSchema=False, escape='"'
    ).columns


def has_line_breaks_in_quotes(spark: SparkSession, spec: CsvSpec) -> bool:
    """Whether any line of the file has an odd number of quotes; one split scan that stops at the first."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return not spark.read.text(spec.path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, spec: CsvSpec) -> DataFrame:
    """All columns of the file as text, with malformed rows kept in ``_corrupt_record``.

    Quotes in a field are doubled, a backslash is a character like any other, and an empty field is NULL, quoted or not.
    An extract with line breaks within quotes is put together to records first (``records``), so its files stay split;
    only other encodings than UTF-8 need whole files per task then. The header gives the columns of the file, so columns
    the jobs do not name are kept too; named columns that the file lacks are reported.
    """
    spec = with_separator(spark, spec)
    names = _header(spark, spec)
    if spec.schema is not None:
        lacking = [n for n in spec.schema.fieldNames() if n not in names]
        if lacking:
            raise ValueError(f"Columns missing in {spec.path}: {lacking}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    broken = has_line_breaks_in_quotes(spark, spec)
    options = {
        "sep": spec.sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"',
        "nullValue": "", "emptyValue": "", "multiLine": str(broken).lower(),
    }
    if broken and spec.encoding.upper().replace("-", "") == "UTF8":
        kinds = ", ".join("`{}` string".format(n.replace("`", "``")) for n in schema.fieldNames())
        return records(spark, spec.path, spec.sep).select(F.from_csv("record", kinds, options).alias("row")).select("row.*")
    if broken:
        log.warning("Line breaks in quoted fields of a file that is not UTF-8, each file is one task: %s", spec.path)
    # Whole rows are parsed whatever columns a query takes, or a row's length would depend on the query.
    options |= {"columnPruning": "false", "header": "true", "encoding": spec.encoding, "enforceSchema": "false"}
    return spark.read.options(**options).csv(spec.path, schema=schema)


def good_rows(df: DataFrame) -> DataFrame:
    """Rows with as many fields as the header.

    The second condition always holds. It keeps a data column in the scan, as
    Spark refuses a CSV query, such as a count, that needs the corrupt-record
    column alone.
    """
    first = next(c for c in df.columns if c != CORRUPT)
    whole = F.col(CORRUPT).isNull() & (F.coalesce(F.length(F.col(f"`{first}`")), F.lit(0)) >= 0)
    return df.filter(whole).drop(CORRUPT)


def quarantine(df: DataFrame) -> DataFrame:
    """The text of rows with too few or too many fields."""
    return df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def ingest_csv(spark: SparkSession, specs: Mapping[str, CsvSpec]) -> dict[str, DataFrame]:
    """Good rows of every extract that exists; a missing file is logged and skipped."""
    tables = {}
    for name, spec in specs.items():
        if not path_exists(spark, spec.path):
            log.warning("File not found: %s", spec.path)
            continue
        tables[name] = good_rows(read_csv(spark, spec))
    return tables


def quarantine_counts(spark: SparkSession, specs: Mapping[str, CsvSpec]) -> DataFrame:
    """Good and malformed rows per extract, one pass each."""
    counts = []
    for name, spec in specs.items():
        if not path_exists(spark, spec.path):
            continue
        df = read_csv(spark, spec)
        # The first column takes part for the reason given in good_rows.
        marked = df.select(F.col(f"`{df.columns[0]}`").alias("first"), CORRUPT)
        counts.append(
            marked.agg(
                F.count_if(F.col(CORRUPT).isNull()).alias("good_rows"),
                F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed_rows"),
                F.count(F.struct("first")).alias("rows"),
            ).select(F.lit(name).alias("table_name"), "good_rows", "malformed_rows", "rows")
        )
    if not counts:
        raise FileNotFoundError("no extract found")
    return reduce(DataFrame.unionByName, counts)


def write_quarantine(spark: SparkSession, specs: Mapping[str, CsvSpec], out_dir: str) -> None:
    """Malformed rows of every extract as text, beside the tables, with their number in the log."""
    for name, spec in specs.items():
        if not path_exists(spark, spec.path):
            continue
        # The first column takes part for the reason given in good_rows.
        df = read_csv(spark, spec)
        bad = df.filter(F.col(CORRUPT).isNotNull() & (F.coalesce(F.length(F.col(f"`{df.columns[0]}`")), F.lit(0)) >= 0))
        path = f"{out_dir.rstrip('/')}/{name}"
        bad.select(CORRUPT).write.mode("overwrite").parquet(path)
        log.info("%s: %d malformed rows", name, spark.read.parquet(path).count())


def type_reports(tables: Mapping[str, DataFrame], tolerance: float = 0.0) -> DataFrame:
    """The kinds that the text columns of all tables can hold, with the values that do not fit; one pass per table."""
    return reduce(
        DataFrame.unionByName,
        [type_report(df, tolerance).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()],
    )


def write_tables(tables: Mapping[str, DataFrame], out_dir: str) -> dict[str, str]:
    """One Parquet folder per table, replacing what is there."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{out_dir.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def read_tables(spark: SparkSession, out_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{out_dir.rstrip('/')}/{name}") for name in names}


def write_report(df: DataFrame, path: str) -> None:
    """CSV with header. Files stay as the job's tasks wrote them; a report of any size is never pulled together."""
    df.write.mode("overwrite").option("header", True).csv(path)
