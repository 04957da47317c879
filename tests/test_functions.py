from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from episodica.functions.buckets import stay_bucket
from episodica.functions.numeric import percent2, round2, to_number
from episodica.functions.temporal import (
    days_between,
    format_day_first,
    hours_between,
    month_start,
    parse_day_first,
    weekday_sunday0,
)
from episodica.functions.text import blank_to_null, planning_class, specialty_group, without_accents

TIMES = [
    (" 1/2/2024 3:04:05 ", dt.datetime(2024, 2, 1, 3, 4, 5)),
    ("01/02/2024 03:04:05", dt.datetime(2024, 2, 1, 3, 4, 5)),
    ("01/02/2024  03:04:05", dt.datetime(2024, 2, 1, 3, 4, 5)),
    ("29/02/2024 00:00:00", dt.datetime(2024, 2, 29)),
    ("5/6/24 01:02:03", dt.datetime(24, 6, 5, 1, 2, 3)),
    ("5/6/4 01:02:03", dt.datetime(4, 6, 5, 1, 2, 3)),
    ("30/02/2024 00:00:00", None),
    ("01/02/2024", None),
    ("01/02/2024 24:00:00", None),
    ("01/02/2024 03:04:60", None),
    ("01/02/2024 03:04:05.5", None),
    ("2024-02-01 03:04:05", None),
    ("001/02/2024 03:04:05", None),
    ("INVALIDA", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
def test_parse_day_first(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "i int, t string")
        found = {r.i: r.v for r in df.select("i", parse_day_first("t").cast("string").alias("v")).collect()}
        # Inside a clock-change gap of the zone as well.
        gap = spark.createDataFrame([("04/11/2018 00:30:00",)], "t string")
        assert gap.select(parse_day_first("t").cast("string")).head()[0] == "2018-11-04 00:30:00"
        assert gap.select(format_day_first(parse_day_first("t"))).head()[0] == "04/11/2018 00:30:00"
        assert gap.select(month_start(parse_day_first("t")).cast("string")).head()[0] == "2018-11-01 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    expected = {i: None if v is None else v.isoformat(sep=" ").zfill(19) for i, (_, v) in enumerate(TIMES)}
    assert found == expected


def one(spark, expr, **values):
    types = ", ".join(f"{n} {t}" for n, (_, t) in values.items())
    row = tuple(v for v, _ in values.values())
    return spark.createDataFrame([row], types).select(expr.alias("x")).head()["x"]


def test_gaps_count_marks_crossed(spark):
    a, b = dt.datetime(2024, 1, 1, 23, 59), dt.datetime(2024, 1, 2, 0, 1)
    assert one(spark, days_between("a", "b"), a=(a, "timestamp_ntz"), b=(b, "timestamp_ntz")) == 1
    a, b = dt.datetime(2024, 1, 1, 1, 59), dt.datetime(2024, 1, 1, 2, 1)
    assert one(spark, hours_between("a", "b"), a=(a, "timestamp_ntz"), b=(b, "timestamp_ntz")) == 1


def test_sunday_is_zero(spark):
    assert one(spark, weekday_sunday0("a"), a=(dt.datetime(2024, 1, 7), "timestamp_ntz")) == 0
    assert one(spark, weekday_sunday0("a"), a=(dt.datetime(2024, 1, 6), "timestamp_ntz")) == 6


def test_rounding_and_percent(spark):
    assert one(spark, round2("x"), x=(1.005, "double")) == 1.0
    assert one(spark, round2("x"), x=(2.675, "double")) == 2.68
    assert one(spark, percent2(F.col("x"), F.col("y")), x=(1, "bigint"), y=(3, "bigint")) == 33.33
    assert one(spark, percent2(F.col("x"), F.col("y")), x=(1, "bigint"), y=(0, "bigint")) is None


def test_numbers_from_text(spark):
    assert one(spark, to_number("x"), x=("3,5", "string")) == 3.5
    assert one(spark, to_number("x"), x=("x", "string")) is None


def test_stay_buckets(spark):
    days = [-3, 0, 1, 2, 3, 4, 7, 8, 14, 15, None]
    df = spark.createDataFrame([(d,) for d in days], "d bigint").select(stay_bucket("d").alias("b"))
    assert [r.b for r in df.collect()] == [
        "0-1 days", "0-1 days", "0-1 days", "2-3 days", "2-3 days", "4-7 days", "4-7 days",
        "8-14 days", "8-14 days", "15+ days", "15+ days",
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Eletivo", "Potencialmente planejada"),
        ("URGENCIA ELETIVA", "Potencialmente planejada"),
        ("Urgencia", "Potencialmente não planejada"),
        ("Urgência", "Indeterminada"),
        ("", "Indeterminada"),
        (None, "Indeterminada"),
    ],
)
def test_planning_class(spark, text, expected):
    assert one(spark, planning_class("x"), x=(text, "string")) == expected


def test_text_helpers(spark):
    assert one(spark, blank_to_null(F.col("x")), x=("   ", "string")) is None
    assert one(spark, specialty_group("x"), x=("Oncologia clínica", "string")) == "Oncologia ou hematologia"
    assert one(spark, specialty_group("x"), x=(None, "string")) == "Outras especialidades"
    assert one(spark, without_accents(F.upper("x")), x=("Urgência", "string")) == "URGENCIA"
