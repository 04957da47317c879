from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from episodica import schema as S
from episodica.functions import vocabulary as V
from episodica.operators.episodes import collapse_episodes
from episodica.operators.signals import billing_time, unparsed_billing_times
from episodica.plans import build
from episodica.plans.build import build_from_csv, build_from_tables
from episodica.plans.report import write_reports
from episodica.sources import catalog, sketches
from episodica.sources.contracts import missing_columns, optional_columns, require_columns
from episodica.sources.dialect import detect_separator, kinds_of, type_report, typed
from episodica.sources.extracts import (
    CsvSpec,
    ingest_csv,
    quarantine,
    quarantine_counts,
    read_csv,
    read_tables,
    require_path,
    standard_specs,
    write_report,
    write_tables,
)
from episodica.sources.stages import StageStore, stage_root
from episodica.sources.versions import VersionedTables, open_tables


def csv_file(folder, text, name="t.csv"):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_short_and_long_rows_go_to_quarantine(spark, tmp_path):
    path = csv_file(tmp_path, 'identificador,a,b\n1,x,y\n2,x\n3,x,y,z\n4,"",\n')
    spec = CsvSpec(path, S._strings("identificador"))
    table = ingest_csv(spark, {"t": spec})["t"]
    assert table.columns == ["identificador", "a", "b"]
    assert sorted(tuple(r) for r in table.collect()) == [("1", "x", "y"), ("4", None, None)]
    assert table.count() == 2 and table.select("b").filter("b = 'y'").count() == 1
    assert sorted(r[0] for r in quarantine(read_csv(spark, spec).cache()).collect()) == ["2,x", "3,x,y,z"]
    counts = quarantine_counts(spark, {"t": spec}).head()
    assert (counts["good_rows"], counts["malformed_rows"], counts["rows"]) == (2, 2, 4)


ROWS = [
    ('1,"comma ""x"", tail"', "1", 'comma "x", tail'),
    ('2,"say ""hi"" now"', "2", 'say "hi" now'),
    ('3,"a\\"', "3", "a\\"),
    ('4,""', "4", None),
    ("5, spaced ", "5", " spaced "),
    ('6,"line\nbreak"', "6", "line\nbreak"),
]


@pytest.mark.parametrize("rows", (ROWS, ROWS[:-1]))
def test_quotes_backslashes_and_line_breaks_are_read_whole(spark, tmp_path, rows):
    """A file that Spark did not write; with and without the row that needs whole files."""
    path = csv_file(tmp_path, "identificador,a\n" + "\n".join(r[0] for r in rows) + "\nshort\n")
    spec = CsvSpec(path, S._strings("identificador"))
    table = ingest_csv(spark, {"t": spec})["t"]
    assert sorted(tuple(r) for r in table.collect()) == [r[1:] for r in rows]
    assert [r[0].strip() for r in quarantine(read_csv(spark, spec).cache()).collect()] == ["short"]


def broken_rows(seed, n=150):
    """Rows whose fields hold line breaks, quotes, separators and stray quotes, and their lines in a file."""
    draw, rows, lines = random.Random(seed), [], []
    for i in range(n):
        fields = [draw.choice(["x", "", "a b", 'he said "hi"', "l1\nl2", 'l1\n\nl3,"', ",", '"', "\n", "z" * 40, "a\\", 'q\n"\n"w']) for _ in range(2)]
        quoted = ['"' + f.replace('"', '""') + '"' if draw.random() < 0.3 or set(f) & set(',"\n') else f for f in fields]
        rows.append((f"{seed}-{i}", *[f or None for f in fields]))
        lines.append(",".join([f"{seed}-{i}", *quoted]))
    # A quote that does not open a field is a character.
    rows.append((f"{seed}-s", '5" pipe', '6"'))
    return rows, [*lines, f'{seed}-s,5" pipe,6"']


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_records_cut_by_splits_are_read_whole(spark, tmp_path, ending):
    """Files in splits of 150 bytes: cuts fall into quoted fields, between the quotes of a pair and on line breaks."""
    expected = []
    for seed in range(3):
        rows, lines = broken_rows(seed)
        expected += rows
        with open(tmp_path / f"p{seed}.csv", "w", newline="", encoding="utf-8") as file:
            file.write(ending.join(["identificador,a,b", *lines]) + ending)
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, "150")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
        table = ingest_csv(spark, {"t": CsvSpec(str(tmp_path), S._strings("identificador"))})["t"]
        found = [tuple(r) for r in table.collect()]
    finally:
        spark.conf.set(name, before)
    assert sorted(found) == sorted(expected)
    if ending == "\n":
        whole = spark.read.csv(
            str(tmp_path), schema="k string, a string, b string", header=True, quote='"', escape='"', nullValue="", emptyValue="", multiLine=True
        )
        assert sorted(tuple(r) for r in whole.collect()) == sorted(found)


def test_an_open_quote_at_the_end_and_files_without_rows(spark, tmp_path):
    csv_file(tmp_path, 'identificador,a\n1,"x\n2,y\n', "a.csv")
    csv_file(tmp_path, "identificador,a\n", "b.csv")
    csv_file(tmp_path, 'identificador,a\n3,"u\nv"\n\n4,w', "c.csv")
    table = ingest_csv(spark, {"t": CsvSpec(str(tmp_path))})["t"]
    assert {("3", "u\nv"), ("4", "w")} <= {tuple(r) for r in table.collect()}


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_the_separator_is_found(spark, tmp_path, sep):
    other = ";" if sep == "," else ","
    lines = [f"identificador{sep}a{sep}b"] + [f'{i}{sep}"one{other} two{sep}\nthree"{sep}{i}{other}5' for i in range(30)] + ["short"]
    path = csv_file(tmp_path, "\n".join(lines) + "\n")
    assert detect_separator(spark, path) == sep
    table = ingest_csv(spark, {"t": CsvSpec(path)})["t"]
    assert table.count() == 30 and table.first()["a"] == f"one{other} two{sep}\nthree"
    assert detect_separator(spark, csv_file(tmp_path, "identificador\n1\n2\n", "one.csv")) == ","
    assert detect_separator(spark, csv_file(tmp_path, "", "none.csv")) == ","


def test_types_follow_all_rows(spark):
    rows = [("1", "1.5", "01/02/2024 10:00:00", "007", "true", "x", None)] * 30 + [("-2", "2e3", "2024-03-05", "12", "False", "", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string")
    report = {r["column_name"]: (r["kind"], r["n_values"], r["n_misfits"]) for r in type_report(df).collect()}
    assert report == {
        "a": ("bigint", 31, 0), "b": ("double", 31, 0), "c": ("timestamp_ntz", 31, 0), "d": ("string", 31, 0),
        "e": ("boolean", 31, 0), "f": ("string", 31, 0), "g": ("string", 0, 0),
    }
    odd = df.union(spark.createDataFrame([("n/a", "?", "?", "?", "?", "?", None)], df.schema))
    assert type_report(odd).filter("column_name = 'a'").head()["kind"] == "string"
    kinds = {r["column_name"]: (r["kind"], r["n_misfits"]) for r in type_report(odd, tolerance=0.05).collect()}
    assert kinds["a"] == ("bigint", 1) and kinds["b"] == ("double", 1)
    made = typed(odd, kinds_of(type_report(odd, tolerance=0.05)))
    assert dict(made.dtypes)["a"] == "bigint" and made.filter("a IS NULL").count() == 1 and made.agg(F.sum("a")).head()[0] == 28


@pytest.mark.parametrize("seps", [",,,", ";\t|"])
def test_the_build_needs_no_separator(spark, tmp_path, seps):
    names, bill = S.RAW_SCHEMAS["hospitalizations"].fieldNames(), S.RAW_SCHEMAS["billing"].fieldNames()
    rows = [
        {S.ID: "p", S.ADMISSION_TEXT: "01/01/2024 10:00:00", S.DISCHARGE_TEXT: "02/01/2024 10:00:00", "motivoalta": "Alta"},
        {S.ID: "p", S.ADMISSION_TEXT: "07/01/2024 10:00:00", S.DISCHARGE_TEXT: "", "carater": "URGENCIA"},
    ]
    csv_file(tmp_path, "\n".join([seps[0].join(names)] + [seps[0].join(r.get(n, "") for n in names) for r in rows]), V.EXTRACT_FILES["hospitalizations"])
    csv_file(tmp_path, seps[1].join(bill) + "\n" + seps[1].join(["p", "07/01/2024 10:00:00", "X", "", "", ""]), V.EXTRACT_FILES["billing"])
    csv_file(tmp_path, f"identificador{seps[2]}other\np{seps[2]}1\n", V.EXTRACT_FILES["requests"])
    built = build_from_csv(spark, str(tmp_path), str(tmp_path / "out"))
    assert [tuple(r) for r in built.features.select(S.LABEL, "length_of_stay_days").collect()] == [(1, 1)]
    types = {(r["table_name"], r["column_name"]): r["kind"] for r in open_tables(spark, str(tmp_path / "out")).table("types").collect()}
    assert types["requests", "other"] == "bigint" and types["hospitalizations", S.ADMISSION_TEXT] == "timestamp_ntz"


def test_request_dates_and_billing_times_of_an_extract(spark, make):
    rows = make.raw(
        {S.ID: "p", S.ADMISSION_TEXT: "01/01/2024 10:00:00", S.REQUEST_DATE: "31/01/2024"},
        {S.ID: "p", S.ADMISSION_TEXT: "01/01/2024 10:00:00", S.REQUEST_DATE: "01/12/2024"},
        {S.ID: "q", S.ADMISSION_TEXT: "01/01/2024 10:00:00", S.REQUEST_DATE: "2024-03-05"},
        {S.ID: "r", S.ADMISSION_TEXT: "01/01/2024 10:00:00", S.REQUEST_DATE: "soon"},
    )
    rows = rows.withColumn(S.REQUEST_DATE, F.col(S.REQUEST_DATE).cast("string"))
    found = {r[S.ID]: r["last_update"] and str(r["last_update"]) for r in collapse_episodes(rows).collect()}
    assert found == {"p": "2024-12-01", "q": "2024-03-05", "r": None}
    billing = make.billing(*[{S.ID: "p", S.ADMISSION_TEXT: t} for t in ("07/01/2024 10:00:00", "2024-01-07 10:00:00", "?", None)])
    times = [r[0] and str(r[0]) for r in billing.select(billing_time(billing)).collect()]
    assert times == ["2024-01-07 10:00:00"] * 2 + [None] * 2
    assert unparsed_billing_times(billing).head()[0] == 1


def test_missing_file_is_skipped_and_missing_column_raises(spark, tmp_path):
    path = csv_file(tmp_path, "identificador,a\n1,x\n")
    specs = {"there": CsvSpec(path), "gone": CsvSpec(str(tmp_path / "gone.csv"))}
    assert set(ingest_csv(spark, specs)) == {"there"}
    with pytest.raises(ValueError, match="b"):
        ingest_csv(spark, {"t": CsvSpec(path, S._strings("identificador", "b"))})
    with pytest.raises(FileNotFoundError):
        require_path(spark, str(tmp_path / "gone.csv"))
    assert require_path(spark, path) == path


def test_build_from_csv(spark, tmp_path):
    names = S.RAW_SCHEMAS["hospitalizations"].fieldNames()
    rows = [
        {S.ID: "p", S.ADMISSION_TEXT: "01/01/2024 10:00:00", S.DISCHARGE_TEXT: "02/01/2024 10:00:00", "motivoalta": "Alta"},
        {S.ID: "p", S.ADMISSION_TEXT: "07/01/2024 10:00:00", S.DISCHARGE_TEXT: "", "carater": "URGENCIA"},
    ]
    lines = [",".join(names)] + [",".join(r.get(n, "") for n in names) for r in rows] + ["short,row"]
    csv_file(tmp_path, "\n".join(lines) + "\n", V.EXTRACT_FILES["hospitalizations"])
    bill = S.RAW_SCHEMAS["billing"].fieldNames()
    csv_file(tmp_path, ",".join(bill) + "\np,07/01/2024 10:00:00,X,,,\n", V.EXTRACT_FILES["billing"])
    csv_file(tmp_path, "identificador,other\np,1\n", V.EXTRACT_FILES["requests"])
    built = build_from_csv(spark, str(tmp_path), str(tmp_path / "out"))
    assert set(built.raw) == {"hospitalizations", "billing", "requests"}
    assert built.raw["hospitalizations"].count() == 2
    assert [tuple(r) for r in built.features.select(S.LABEL, "length_of_stay_days").collect()] == [(1, 1)]
    assert open_tables(spark, str(tmp_path / "out")).table("hospitalization_target").count() == 2
    assert open_tables(spark, str(tmp_path / "out")).table("quarantine/hospitalizations").collect()[0][0] == "short,row"
    names = ["aud_episode_counts", "aud_closure_dates", "data_catalog", "mart_kpis"]
    assert write_reports(spark, str(tmp_path / "out"), str(tmp_path / "reports"), names) == names
    back = spark.read.csv(str(tmp_path / "reports/data_catalog"), header=True)
    assert {r["table_name"] for r in back.collect()} == {"hospitalizations", "billing", "requests"}
    with pytest.raises(FileNotFoundError):
        write_reports(spark, str(tmp_path / "nothing"), str(tmp_path / "reports"))
    # A second run replaces the tables.
    build_from_csv(spark, str(tmp_path), str(tmp_path / "out"))
    assert open_tables(spark, str(tmp_path / "out")).table("ml_features").count() == 1


def test_build_needs_both_tables(spark, tmp_path):
    csv_file(tmp_path, "identificador\n1\n", V.EXTRACT_FILES["requests"])
    with pytest.raises(FileNotFoundError):
        build_from_csv(spark, str(tmp_path), str(tmp_path / "out"))
    assert len(standard_specs("x")) == 6


def test_parquet_roundtrip_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "Óbito", None), (2, None, 2.5)], "a int, b string, c double")
    write_tables({"t": df}, str(tmp_path))
    back = read_tables(spark, str(tmp_path), ["t"])["t"]
    assert back.schema == df.schema and sorted(map(tuple, back.collect()))[0][1] == "Óbito"
    write_report(df.orderBy("a"), str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 2


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert missing_columns(df, "a", "z", "c") == ["c", "z"]
    with pytest.raises(ValueError, match="Columns missing in x: \\['z'\\]"):
        require_columns(df, "a", "z", table="x")
    assert df.select(*optional_columns(df, {"a": "A", "z": "Z"})).columns == ["A"]


def test_stage_store_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    store = StageStore(spark, str(tmp_path))
    assert store.get("s", build).count() == 3 and store.get("s", build).count() == 3
    assert len(calls) == 1
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = stage_root(spark)
    assert root.startswith(shared) if shared else "episodica-" in root
    assert stage_root(spark) == root


def test_column_statistics(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (2, "x"), (None, None)], "a int, b string")
    for approximate in (False, True):
        found = {r.column_name: tuple(r)[1:] for r in catalog.column_statistics(df, "t", approximate).collect()}
        assert found == {"a": ("a", "int", 4, 1, 2), "b": ("b", "string", 4, 2, 1)}


def test_a_build_that_fails_leaves_the_tables_before(spark, make, tmp_path, monkeypatch):
    def rows(n):
        return make.raw(*[{S.ID: f"p{i}", S.ADMISSION_TEXT: "01/01/2024 10:00:00", S.DISCHARGE_TEXT: "02/01/2024 10:00:00", "motivoalta": "Alta"} for i in range(n)])

    def killed(*_):
        raise RuntimeError("killed")

    out = str(tmp_path / "out")
    build_from_tables(spark, rows(2), make.billing(), out)
    opened = open_tables(spark, out)
    with monkeypatch.context() as patch:
        patch.setattr(build, "build_target", killed)
        with pytest.raises(RuntimeError, match="killed"):
            build_from_tables(spark, rows(3), make.billing(), out)
    again = open_tables(spark, out)
    assert again == opened and again.table("hospitalization_target").count() == 2 and again.table("ml_features").count() == 2
    build_from_tables(spark, rows(4), make.billing(), out)
    assert opened.table("ml_features").count() == 2 and open_tables(spark, out).table("ml_features").count() == 4
    # The folder of the failed build goes, the last two versions stay.
    assert len(VersionedTables(spark, out).prune(keep=2)) == 1 and opened.table("ml_features").count() == 2
    assert len(VersionedTables(spark, out).prune(keep=1)) == 1 and open_tables(spark, out).number == 2
    with pytest.raises(FileNotFoundError):
        opened.table("ml_features")


def test_key_overlap_equals_sets(spark):
    held = {"x": ["1", "1", "2", None], "y": ["2", "3"], "z": ["2", "1", None]}
    tables = {n: spark.createDataFrame([(k,) for k in ks], f"{S.ID} string") for n, ks in held.items()}
    found = {(r.table_a, r.table_b): r.shared_keys for r in catalog.key_overlap_pairs(tables).collect()}
    assert found == {("x", "y"): 1, ("x", "z"): 2, ("y", "z"): 1}


def test_grain_check_with_missing_values(spark, make):
    rows = [
        {S.ID: "a", S.ADMISSION_TEXT: "t1", S.REQUEST_DATE: "d1"},
        {S.ID: "a", S.ADMISSION_TEXT: "t1", S.REQUEST_DATE: "d1"},
        {S.ID: "a", S.ADMISSION_TEXT: "t1", S.REQUEST_DATE: None},
        {S.ID: "a", S.ADMISSION_TEXT: "t2", S.REQUEST_DATE: "d1"},
        {S.ID: "a", S.ADMISSION_TEXT: V.ADMISSION_SENTINEL, S.REQUEST_DATE: "d1"},
    ]
    found = catalog.distinct_grain_check(make.raw(*rows))
    assert tuple(found.head()) == (4, 2, 2, 3)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert tuple(catalog.distinct_grain_check(make.raw()).head()) == (0, 0, 0, 0)


def test_comparison_finds_one_swapped_duplicate(spark):
    rows = [(i % 5, None if i % 3 else f"v{i % 4}", float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    swapped = [*rows[:-1], rows[0]]
    copies = {
        "same": (rows[::-1], 0), "swapped": (swapped, 2), "shorter": (rows[1:], 1),
        "moved": ([(a, b, c) if i else (None, b, c) for i, (a, b, c) in enumerate(rows)], 2),
    }
    assert rows[-1] != rows[0]
    tables = {name: df for name in copies}
    compared = catalog.compare_tables(tables, {n: spark.createDataFrame(r, df.schema) for n, (r, _) in copies.items()})
    assert {r["table_name"]: (r["rows"], r["differing_rows"]) for r in compared.collect()} == {n: (60, d) for n, (_, d) in copies.items()}
    # NULLs in different columns are different rows, although a hash passes NULLs by.
    left, right = (spark.createDataFrame([r], "a string, b string") for r in (("x", None), (None, "x")))
    assert catalog.compare_tables({"t": left}, {"t": right}).head()["differing_rows"] == 2


def test_fingerprints_move_no_rows(spark):
    df = spark.range(1000).withColumn("b", F.col("id").cast("string"))
    plan = catalog._fingerprints({"t": df})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("Exchange") == 1


def test_long_values_are_counted_by_digest(spark):
    long = "x" * 1000
    df = spark.createDataFrame([(long + str(i % 7), "short") for i in range(50)] + [(None, None)], "a string, b string")
    found = {r["column_name"]: tuple(r)[3:] for r in catalog.column_statistics(df, "t").collect()}
    assert found == {"a": (51, 1, 7), "b": (51, 1, 1)}


def test_sketches_of_parts_merge(spark, tmp_path):
    store = sketches.SketchStore(spark, str(tmp_path / "sketches"))
    df = spark.range(20000).select(
        (F.col("id") % 5000).alias("n"), F.concat(F.lit("k"), F.col("id") % 300).alias("k"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("x"),
    )
    for part in range(3):
        store.add(str(part), {"t": df.filter(F.col("n") % 3 == part)})
    # A part that is loaded again replaces what it held.
    store.add("2", {"t": df.filter(F.col("n") % 3 == 2)})
    found = {r["column_name"]: r for r in store.catalog().collect()}
    assert {c: (r["rows"], r["nulls"]) for c, r in found.items()} == {"n": (20000, 0), "k": (20000, 0), "none": (20000, 20000), "x": (20000, 5000)}
    for column, exact in (("n", 5000), ("k", 300), ("none", 0), ("x", 15000)):
        assert abs(found[column]["distinct_estimate"] - exact) <= 4 * sketches.DISTINCT_ERROR * exact
    assert found["n"]["least"] == 0 and found["n"]["greatest"] == 4999 and abs(found["n"]["median"] - 2500) <= 3 * sketches.RANK_ERROR * 5000
    assert found["none"]["median"] is None and found["k"]["greatest"] == 4 and found["x"]["least"] == 1
    plan = sketches.column_sketches(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    with pytest.raises(FileNotFoundError):
        sketches.SketchStore(spark, str(tmp_path / "other")).catalog()


def test_samples_of_all_tables(spark):
    tables = {
        "t": spark.createDataFrame([(3, 1.5), (1, None), (2, 2.0)], "a int, b double"),
        "u": spark.createDataFrame([], "c timestamp_ntz"),
    }
    found = [tuple(r) for r in catalog.sample_tables(tables, 2).collect()]
    assert sorted(found, key=str) == [("t", 1, "a", "1"), ("t", 1, "b", None), ("t", 2, "a", "2"), ("t", 2, "b", "2.000000")]


def test_schema_and_sample(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "a int")
    assert [tuple(r) for r in catalog.describe_tables({"t": df}).collect()] == [("t", "a", "INTEGER", 3)]
    assert [r.a for r in catalog.sample_rows(df, 2, ["a"]).collect()] == [1, 2]
    assert catalog.row_counts({"t": df}).head().asDict() == {"table_name": "t", "rows": 3}
    assert df.filter(F.col("a") > 5).count() == 0
