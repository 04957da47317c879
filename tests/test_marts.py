from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from episodica import schema as S
from episodica.audits import closure, episodes as ep, planning
from episodica.marts import cube, filters, rates
from episodica.marts.clean import clean_features
from episodica.marts.filters import FilterSpec
from episodica.operators import reports

TYPES = (
    f"{S.ID} string, sexo string, municipiosolicitante string, municipioexecutante string, executante string, "
    "especialidade string, tipoleito string, carater string, motivoalta string, codigocid string, "
    f"{S.DISCHARGE} timestamp_ntz, admission_month timestamp_ntz, "
    "admission_year bigint, admission_quarter bigint, admission_weekday bigint, length_of_stay_days bigint, "
    "previous_hospitalizations bigint, previous_unplanned_readmissions bigint, admissions_last_365d bigint, "
    f"{S.LABEL} int"
)
NAMES = [t.strip().split(" ")[0] for t in TYPES.split(",")]


def feature_table(spark, *rows):
    base = {
        S.ID: "p", "sexo": "F", "executante": "H", "especialidade": "E", "motivoalta": "Alta",
        S.DISCHARGE: dt.datetime(2024, 1, 2), "admission_year": 2024, "admission_quarter": 1, "admission_weekday": 1,
        "length_of_stay_days": 5, "previous_hospitalizations": 0, "previous_unplanned_readmissions": 0,
        "admissions_last_365d": 0, S.LABEL: 0,
    }
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in NAMES) for r in rows], TYPES)


def ids(df):
    return sorted(r[S.ID] for r in df.collect())


def test_filters(spark):
    df = feature_table(
        spark,
        {S.ID: "a"},
        {S.ID: "b", "sexo": "M", S.LABEL: 1},
        {S.ID: "c", "length_of_stay_days": None},
        {S.ID: "d", "length_of_stay_days": 61},
        {S.ID: "e", "admission_year": None, "admission_quarter": None, "admission_weekday": None},
        {S.ID: "f", S.DISCHARGE: None, "previous_hospitalizations": 4},
    )
    assert ids(filters.apply_filters(df)) == ["a", "b", "c", "f"]
    assert ids(filters.apply_filters(df, FilterSpec(max_stay=100))) == ["a", "b", "c", "d", "f"]
    assert ids(filters.apply_filters(df, FilterSpec(sex=("M",)))) == ["b"]
    assert ids(filters.apply_filters(df, FilterSpec(years=()))) == ["a", "b", "c", "f"]
    assert ids(filters.apply_filters(df, FilterSpec(years=(), quarters=(), weekdays=()))) == ["a", "b", "c", "e", "f"]
    assert ids(filters.apply_filters(df, FilterSpec(years=(2020,)))) == []
    assert ids(filters.apply_filters(df, FilterSpec(readmitted_only=True))) == ["b"]
    assert ids(filters.apply_filters(df, FilterSpec(missing_discharge_only=True))) == ["f"]
    assert ids(filters.apply_filters(df, FilterSpec(max_previous_hospitalizations=3))) == ["a", "b", "c"]
    dateless = df.filter("identificador = 'e'")
    assert ids(filters.apply_filters(dateless)) == ["e"]


def test_filter_options_and_maxima(spark):
    df = feature_table(spark, {"sexo": "M", "previous_hospitalizations": 7}, {"sexo": None}, {"sexo": "F"})
    options = [(r.field, r.value) for r in filters.filter_options(df).collect() if r.field == "sex"]
    assert options == [("sex", "F"), ("sex", "M")]
    maxima = filters.filter_maxima(df).head()
    assert (maxima["max_stay"], maxima["max_previous_hospitalizations"]) == (5, 7)


def test_clean_features_coerces(spark):
    df = spark.createDataFrame(
        [("3,5", "2", None, "1", "2024-01-02 03:04:05"), ("x", None, 4, "bad", "nonsense")],
        "length_of_stay_days string, previous_hospitalizations string, admissions_last_30d int, "
        f"{S.LABEL} string, admission_ts string",
    )
    first, second = clean_features(df).collect()
    assert tuple(first) == (3.5, 2, 0, 1, dt.datetime(2024, 1, 2, 3, 4, 5))
    assert tuple(second) == (None, 0, 4, 0, None)
    with pytest.raises(ValueError, match=S.LABEL):
        clean_features(df.drop(S.LABEL))


def test_rate_tables(spark):
    df = feature_table(
        spark,
        {"motivoalta": None, S.LABEL: 1},
        {"motivoalta": None},
        {"motivoalta": "Alta"},
        {"motivoalta": "Alta", "admission_month": dt.datetime(2024, 1, 1)},
    )
    found = {r.motivoalta: (r.episodes, r.readmissions, r.rate) for r in rates.rate_table(df, "motivoalta").collect()}
    assert found == {"Not informed": (2, 1, 50.0), "Alta": (2, 0, 0.0)}
    assert rates.rate_table(df, "motivoalta", 3).count() == 0
    assert [r.admission_month for r in rates.monthly_trend(df).collect()] == [dt.datetime(2024, 1, 1), None]
    assert rates.quarterly_trend(df).head()["quarter"] == "2024 Q1"
    with pytest.raises(ValueError):
        rates.rate_table(df, "absent")


def test_kpis_of_an_empty_table(spark):
    empty = feature_table(spark)
    assert rates.overall_rate(empty).head()[0] == 0.0
    row = rates.kpis(empty).head()
    assert (row["total_episodes"], row["unplanned_readmissions"], row["rate"], row["avg_los"]) == (0, 0, 0.0, None)
    row = rates.kpis_patients(empty).head()
    assert (row["total_episodes"], row["unique_patients"], row["readmitted_patients"], row["rate"]) == (0, 0, 0, 0.0)
    assert rates.kpis(empty.drop("length_of_stay_days")).head()["avg_los"] == 0.0


def test_kpis_count_subjects(spark):
    df = feature_table(
        spark, {S.ID: "a", S.LABEL: 1}, {S.ID: "a", S.LABEL: 1}, {S.ID: "b", "length_of_stay_days": None}, {S.ID: None, S.LABEL: 1}
    )
    row = rates.kpis_patients(df).head()
    assert (row["unique_patients"], row["readmitted_patients"], row["avg_los"]) == (2, 1, 5.0)


def test_los_distribution_cuts_at_the_percentile(spark):
    df = feature_table(spark, *[{"length_of_stay_days": d} for d in [*range(100), 1000, -1, None]])
    rows = rates.los_distribution(df).collect()
    # 101 valid stays: the 99th percentile is 99, so 1000 is cut.
    assert sum(r.episodes for r in rows) == 100
    assert {r.bin_width for r in rows} == {2} and len(rows) == 50
    assert all(r.status == "No unplanned readmission" for r in rows)


def test_heatmap_pivots_the_busiest(spark):
    df = feature_table(
        spark,
        *[{"executante": f"H{h:02d}", "especialidade": f"E{e}", S.LABEL: int(h == e)} for h in range(12) for e in range(3) for _ in range(2)],
        {"executante": None},
    )
    wide = rates.hospital_specialty_heatmap(df, 2)
    assert wide.columns == ["executante", "E0", "E1", "E2"] and wide.count() == 10
    assert wide.filter("executante = 'H01'").head()["E1"] == 100.0
    assert rates.hospital_specialty_heatmap(df, 3).count() == 0


def test_shares(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, m int")
    found = {r.g: r.percentage for r in reports.share_of_total(df, ["g"], "n").collect()}
    assert found == {"a": 66.67, "b": 33.33}
    assert reports.share_of_total(df.limit(0), ["g"], "n").count() == 0
    inner = reports.share_within(df, F.col("g"), F.col("m"), ("g", "m"), "n", "p")
    assert {(r.g, r.m): r.p for r in inner.collect()} == {("a", 1): 50.0, ("a", 2): 50.0, ("b", 1): 100.0}


def test_samples_repeat_with_the_seed(spark):
    df = spark.range(100)
    first = [r.id for r in reports.random_sample(df, 5, ["id"], 1).collect()]
    assert first == [r.id for r in reports.random_sample(df.repartition(7), 5, ["id"], 1).collect()]
    assert first != [r.id for r in reports.random_sample(df, 5, ["id"], 2).collect()]


def enriched(spark, *characters):
    return spark.createDataFrame(
        [("p", 1, c, 1) for c in characters],
        f"{S.ID} string, readmitted_30d_clean int, next_carater string, {S.ELIGIBLE} int",
    )


def test_rate_comparison_needs_a_recurrence(spark):
    target = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], f"{S.ELIGIBLE} int, readmitted_30d_clean int")
    row = planning.rate_comparison(target, enriched(spark, "URGENCIA", "ELETIVO", None)).head()
    assert tuple(row) == (2, 1, 1, 1, 1, 50.0, 50.0)
    assert planning.rate_comparison(target, enriched(spark)).count() == 0


def test_planning_proxy_takes_blank_as_undetermined(spark):
    found = {r[0]: r[1] for r in planning.planning_proxy(enriched(spark, " ", None, "Eletivo", "URGENCIA")).collect()}
    assert found == {"Indeterminada": 2, "Potencialmente planejada": 1, "Potencialmente não planejada": 1}


def test_enrich_next_contract_and_optional_columns(spark, make):
    episodes = make.episodes(("a", "2024-01-05 00:00:00", None, {"carater": "URGENCIA"}))
    target = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5), 1), ("a", dt.datetime(2024, 1, 1), None, 0)],
        f"{S.ID} string, {S.ADMISSION} timestamp_ntz, next_admission_ts timestamp_ntz, readmitted_30d_clean int",
    )
    rows = planning.enrich_next(target, episodes)
    assert "index_carater" not in rows.columns and rows.count() == 1
    assert rows.head()["next_carater"] == "URGENCIA"
    with pytest.raises(ValueError, match="next_admission_ts"):
        planning.enrich_next(target.drop("next_admission_ts"), episodes)
    with pytest.raises(ValueError, match="carater"):
        planning.enrich_next(target, episodes.drop("carater"))


def test_zero_day_hospitals_counts_raw_rows(spark, make):
    raw = make.raw(
        {S.ID: "a", "executante": "H1"}, {S.ID: "a", "executante": "H1"}, {S.ID: "a", "executante": "H2"}, {S.ID: "b", "executante": "H1"}
    )
    target = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1)], f"{S.ID} string, {S.DAYS_NEXT} bigint")
    assert [tuple(r) for r in ep.zero_day_hospitals(raw, target).collect()] == [("H1", 2), ("H2", 1)]


def test_closures(spark, make):
    raw = make.raw({S.ID: "a", "motivoalta": "Encerramento administrativo", "situacao": "X"}, {S.ID: "b", "motivoalta": "Alta"})
    assert [tuple(r) for r in closure.closure_status(raw).collect()] == [("Encerramento administrativo", "X", 1)]
    assert closure.closure_sample(raw).count() == 1


def test_marts_from_the_cube_equal_those_from_rows(spark):
    rows = [
        {
            S.ID: f"p{i % 9}", "executante": [None, "H1", "H2", "H3"][i % 4], "especialidade": [None, "Não informado", "E1", "E2", "E3"][i % 5],
            "motivoalta": [None, "Alta", "Óbito"][i % 3], "codigocid": [None, "I21", "J15"][(i // 2) % 3], S.LABEL: int(i % 7 == 0),
            "admission_month": dt.datetime(2024, 1 + i % 3, 1) if i % 11 else None, "admission_year": 2024 if i % 6 else None,
            "admission_quarter": 1 + i % 2, "length_of_stay_days": i % 13 if i % 10 else None, "previous_hospitalizations": i % 4,
            "admissions_last_365d": i % 3,
        }
        for i in range(240)
    ]
    df = feature_table(spark, *rows)
    made = cube.Cube.of(df)

    def same(a, b):
        assert a.columns == b.columns and [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]

    same(made.kpis(), rates.kpis(df))
    same(made.top_rates("specialty", 5, 3), rates.specialty_rate(df, 5, 3))
    same(made.top_rates("hospital", 5, 3), rates.hospital_rate(df, 5, 3))
    same(made.reason_rates(5), rates.discharge_reason_rate(df, 5))
    same(made.monthly_trend(), rates.monthly_trend(df))
    same(made.quarterly_trend(), rates.quarterly_trend(df))
    same(made.top_icd(2), rates.top_icd(df, 2))
    same(made.heatmap(3, 2), rates.hospital_specialty_heatmap(df, 3, 2))
    assert sorted(map(tuple, made.hospital_specialty_rates(3).collect())) == sorted(map(tuple, rates.hospital_specialty_rates(df, 3).collect()))
    plan = cube.rate_cube(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") == 1 and plan.count("Expand") == 1
    empty = cube.filtered_marts(df.filter("false"))
    assert empty["kpis"].head()["total_episodes"] == 0 and empty["top_icd"].count() == 0
