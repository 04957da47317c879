"""What bounds the shared stages on large tables: rows moved, rows per scan task, work done once."""

from __future__ import annotations

import datetime as dt
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from episodica import schema as S
from episodica.operators.signals import raw_procedure_rows
from episodica.operators.target import build_target
from episodica.plans import registry, visits as source
from episodica.plans.workspace import Workspace
from episodica.sources import catalog, stages
from episodica.sources.records import records


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@pytest.fixture()
def star(spark, tmp_path):
    """Two orders of one customer, in a folder of small tables."""
    day = dt.datetime(1999, 3, 1)
    tables = {
        "nation": ("n_nationkey int, n_name string", [(0, "A"), (1, "B")]),
        "customer": ("c_custkey bigint, c_nationkey int", [(7, 0)]),
        "supplier": ("s_suppkey bigint, s_name string, s_nationkey int", [(3, "House", 1)]),
        "part": ("p_partkey bigint, p_type string", [(4, "ECONOMY"), (29, "PROMO"), (31, "PROMO"), (997, "LARGE")]),
        "orders": (
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp",
            [(1, 7, "F", day), (50, 7, "O", day), (103, 7, "F", day), (211, 7, "F", day), (5, 7, "F", None)],
        ),
        "lineitem": (
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string",
            [(1, 4, 3, 1, "N"), (1, 29, 3, 2, "N"), (1, 31, 3, 3, "N"), (50, 997, 3, 1, "R"), (103, 4, 3, 1, "N"), (211, 4, 3, 1, "N"), (5, 4, 3, 1, "N")],
        ),
    }
    for name, (types, rows) in tables.items():
        spark.createDataFrame(rows, types).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_visits_keep_their_texts(spark, star):
    rows = source.visits(spark, star).collect()
    texts = sorted((r[S.ADMISSION_TEXT] or "", r[S.DISCHARGE_TEXT] or "") for r in rows)
    assert texts == sorted(
        [
            ("01/03/2023 01:00:00", "05/03/2023 04:00:00"),
            ("01/03/2023 01:00:00", "SEM DATAHORAALTA"),
            ("01/03/2023 01:00:00", ""),
            ("SEM DATAHORA INTERNAÇÃO", "04/04/2024 02:00:00"),
            ("01/03/2013 07:00:00", "05/03/2023 10:00:00"),
            ("INVALIDA", "05/03/2023 22:00:00"),
            ("", ""),
        ]
    )
    assert {(r["municipioresidencia"], r["municipioexecutante"]) for r in rows} == {("A", "B")}


def test_visits_move_rows_once_when_lookups_are_small(spark, star):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        text = plan(source.visits(spark, star))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.count("Exchange hashpartitioning") == 2 and text.count("SortMergeJoin") == 1


def test_a_stage_file_holds_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "ROWS_PER_FILE", 10)
    kept = stages.StageStore(spark, str(tmp_path)).get("numbers", lambda: spark.range(0, 95, 1, 1))
    assert kept.count() == 95 and len(kept.inputFiles()) == 10


def test_copies_of_a_procedure_meet_before_times_are_read(make):
    row = {S.ID: "a", S.ADMISSION_TEXT: "01/01/2024 00:00:00", "procedimentosolicitado": "SEPSE"}
    found = raw_procedure_rows(make.raw(row, row, {**row, "procedimentosolicitado": None})).collect()
    assert sorted((r["procedure"] or "") for r in found) == ["", "SEPSE"]


def test_labels_by_key_compute_the_base_once(make):
    episodes = make.episodes(("a", "2024-01-01", "2024-01-02"), ("a", "2024-01-08", None))
    plans = [plan(build_target(episodes, make.raw(), make.billing(), labels_by_key=by_key)) for by_key in (False, True)]
    assert plans[0].count("Join") == plans[1].count("Join")


def test_labels_by_key_match_nothing_without_a_key(make):
    episodes = make.episodes(
        (None, "2024-01-01", "2024-01-02"), ("a", None, "2024-01-02"), ("a", "2024-01-08", None, {"carater": "URGENCIA"}),
        ("b", "2024-01-01", "2024-01-02", {"text": "x"}), ("b", "2024-01-01", "2024-01-02", {"text": "y"}),
        ("b", "2024-01-08", "2024-01-09", {"carater": "URGENCIA"}),
    )
    rows = build_target(episodes, make.raw(), make.billing(), labels_by_key=True).collect()
    found = sorted((r[S.ID] or "", r[S.ADMISSION_TEXT], -1 if r[S.LABEL] is None else r[S.LABEL]) for r in rows)
    # Two twins with two candidates of their key are four rows, as the invariants report.
    assert found == [
        ("", "2024-01-01", 0), ("a", "2024-01-08", -1), ("a", "none", 0), ("b", "2024-01-08", 0),
        ("b", "x", 1), ("b", "x", 1), ("b", "y", 1), ("b", "y", 1),
    ]


def test_lines_are_not_moved_for_the_state_of_their_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a\nb"\n2,c\n')
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = records(spark, str(tmp_path), ",")
        assert "SortMergeJoin" not in plan(found)
        assert sorted(r[0] for r in found.collect()) == ['1,"a\nb"', "2,c"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_the_extract_of_ingest_csv_is_compressed_and_whole(spark, star):
    w = Workspace(spark, star)
    found = registry.REGISTRY["ingest_csv"](w)
    files = [f for f in spark.read.text(f"{w.store.folder}/csv/hospitalizations").inputFiles()]
    assert files and all(f.endswith(".csv.gz") for f in files)
    assert found.count() == 7 and {r["situacao"] for r in found.collect()} == {'say "hi", now\nline', "a\\"}


def test_the_extracts_of_ingest_all_are_compressed_and_whole(spark, star, monkeypatch):
    monkeypatch.setattr(registry, "CSV_ROWS_PER_FILE", 2)
    day = dt.datetime(2024, 1, 1, 10)
    props = ['{"k": 1, "l": 2}', 'two\nlines "x"', "a\tb;c|d", "a\\", "", None, " x "]
    events = [(i, day, 7 if i else None, "view", i / 3, text) for i, text in enumerate(props)]
    types = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(events, types).coalesce(1).write.parquet(f"{star}/events.parquet")
    labels = [(1, 1, 0), (2, None, 1), (2, None, 1), (None, 0, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{star}/labels.parquet")
    w = Workspace(spark, star)
    found = registry.REGISTRY["ingest_all"](w)
    for name in w.extracts:
        files = spark.read.text(f"{w.store.folder}/csv/all/{name}").inputFiles()
        assert files and all(f.endswith(".csv.gz") for f in files)
        # Rows, the header and the line break of one field.
        assert all(spark.read.text(f).count() <= 4 for f in files)
    texts = {
        name: df.select(*[F.nullif(catalog.as_text(c, kind), F.lit("")).alias(c) for c, kind in df.dtypes])
        for name, df in w.extracts.items()
    }
    expected = catalog.data_catalog(texts).drop("column_type")
    assert found.columns == expected.columns and sorted(found.collect()) == sorted(expected.collect())
