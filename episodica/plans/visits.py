"""Raw visits and billing derived from the star-schema test tables.

Every lineitem is one raw row of a visit; the subject is the customer and the
admission comes from the order. All rules are integer arithmetic on keys, so
the same rows can be derived by any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodica import schema as S
from episodica.functions import vocabulary as V
from episodica.functions.temporal import add_years, day_first

# Fixed values of the derivation.
CHARACTERS = ("URGENCIA", "Urgência", "ELETIVO", "EMERGENCIA", "TRANSFERENCIA", None)
ICD_CODES = ("I21.0", "O80", "J15-9", "Z51", "O45", "N39.0", "C50", "K35")
PROCEDURES = (
    "PNEUMONIA BACTERIANA",
    "PARTO NORMAL",
    "QUIMIOTERAPIA",
    "TRANSPLANTE DE RIM",
    "ACOMPANHAMENTO POS-TRANSPLANTE DE RIM",
    "HEMODIÁLISE",
    "COLECISTECTOMIA",
    "  ",
    None,
)
SEXES = ("F", "M", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str | None, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def _div(column: str, n: int) -> Column:
    return F.floor(F.col(column) / n)


def _base_time() -> Column:
    hours = (F.col("o_orderkey") % 24).cast("int")
    date = F.col("o_orderdate").cast("timestamp_ntz")
    return add_years(date, 24) + F.make_dt_interval(F.lit(0), hours)


def _shifted(ts: Column) -> tuple[Column, Column]:
    """Whether a visit's admission year is typed wrongly, and the time as typed."""
    key = F.col("o_orderkey")
    by_20 = (key % 101 == 0) & (F.year(ts) == 2024)
    by_10 = (key % 103 == 0) & (F.year(ts) == 2023)
    return by_20 | by_10, F.when(by_20, add_years(ts, -20)).when(by_10, add_years(ts, -10)).otherwise(ts)


def _admission_text(shifted: Column, iso: str) -> Column:
    key = F.col("o_orderkey")
    return (
        F.when(key % 50 == 0, V.ADMISSION_SENTINEL)
        .when(shifted, day_first(iso))
        .when(key % 211 == 0, "INVALIDA")
        .otherwise(day_first(iso))
    )


def _discharge_time(ts: Column) -> Column:
    part = F.col("l_partkey")
    stay = F.make_dt_interval((part % 13).cast("int"), (F.col("l_suppkey") % 24).cast("int"))
    return F.when(part % 997 == 0, ts + F.make_dt_interval(F.lit(400))).otherwise(ts + stay)


def _discharge_text(iso: str) -> Column:
    part = F.col("l_partkey")
    return F.when(part % 29 == 0, V.DISCHARGE_SENTINEL).when(part % 31 == 0, "").otherwise(day_first(iso))


def _stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all rows of an order share, with its time as text, once per order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("residence"))
    rows = (
        orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, "c_nationkey")
        .withColumn("ts0", _base_time())
    )
    shifted, typed = _shifted(F.col("ts0"))
    rows = rows.withColumns({"__shifted": shifted, "__typed": typed.cast("string")})
    text = _admission_text(F.col("__shifted"), "__typed")
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "residence", "ts0", text.alias("admission"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw admission rows, one per lineitem."""
    key = F.col("o_orderkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("provider_city"))
    rows = (
        # Lookups come first, while rows are slim, and one by one: the size of a join of two small tables is guessed as
        # their product, which would move all rows.
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, "s_nationkey")
        # The two large tables meet by shuffle at any size, which also spreads a small single-file input.
        .join(_stays(spark, sf_dir).hint("merge"), F.col("l_orderkey") == key)
        .withColumn("__discharge", _discharge_time(F.col("ts0")).cast("string"))
    )
    ts0 = F.col("ts0")
    reason = (
        F.when(key % 11 == 0, V.DEATH)
        .when(key % 13 == 0, V.TRANSFER)
        .when(key % 17 == 0, F.lit(None))
        .when(key % 5 == 0, V.ADMINISTRATIVE_CLOSURE)
        .otherwise("Alta")
    )
    request = F.date_sub(ts0.cast("date"), F.col("l_linenumber"))
    return rows.select(
        F.col("o_custkey").cast("string").alias(S.ID),
        request.alias(S.REQUEST_DATE),
        (ts0 - F.make_dt_interval(F.col("l_linenumber").cast("int"))).alias("datahorasolicitacao"),
        F.col("admission").alias(S.ADMISSION_TEXT),
        _discharge_text("__discharge").alias(S.DISCHARGE_TEXT),
        F.col("o_orderstatus").alias("situacao"),
        _pick(SEXES, F.col("o_custkey") % 3).alias("sexo"),
        F.col("residence").alias("municipiosolicitante"),
        F.col("residence").alias("municipioresidencia"),
        F.col("provider_city").alias("municipioexecutante"),
        F.col("s_name").alias("executante"),
        F.col("p_type").alias("especialidade"),
        F.col("l_returnflag").alias("tipoleito"),
        _pick(CHARACTERS, _div("o_orderkey", 3) % 6).alias("carater"),
        _pick(ICD_CODES, key % 8).alias("codigocid"),
        reason.alias("motivoalta"),
        _pick(PROCEDURES, _div("o_orderkey", 8) % 9).alias("procedimentosolicitado"),
    )


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing rows: one per order that is not open and has lineitems."""
    key = F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "O").join(lines, "o_orderkey", "left_semi")
    nothing = F.lit(None).cast("string")
    return orders.select(
        F.col("o_custkey").cast("string").alias(S.ID),
        _base_time().alias(S.ADMISSION_TEXT),
        F.when(key % 37 == 0, "SEPSE").otherwise("CONSULTA").alias("procedimentosolicitado"),
        F.when(key % 41 == 0, "REABILITACAO").alias("procprincipalsolicitado"),
        nothing.alias("procprincipalautorizado"),
        nothing.alias("procedimentosolicitadoeletiva"),
    )


# Given tables in the role of extracts, and which of their columns is the subject.
EXTRACT_TABLES = {
    "appointments": ("customer", "c_custkey"),
    "regulated_exams": ("orders", "o_custkey"),
    "non_regulated_exams": ("events", "user_id"),
    "requests": ("labels", "doc_id"),
}


def extracts(spark: SparkSession, sf_dir: str, hospitalizations: DataFrame, billing_rows: DataFrame) -> dict[str, DataFrame]:
    """Six whole tables that share a subject id, in the role of the six extracts; the id comes first, as text."""

    def with_subject(name: str, column: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return df.select(F.col(column).cast("string").alias(S.ID), *[c for c in df.columns if c != column])

    given = {role: with_subject(*source) for role, source in EXTRACT_TABLES.items()}
    return {**given, "hospitalizations": hospitalizations, "billing": billing_rows}
