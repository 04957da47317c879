from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from episodica import schema as S
from episodica.audits import overlaps
from episodica.operators.features import build_features, check_features, history
from episodica.operators.heavy import SLICE, cut, find_heavy_keys, history_order
from tests.test_target import random_episodes


def with_labels(episodes):
    eligible = F.when(F.col(S.DISCHARGE).isNull(), 0).otherwise(1)
    label = F.when(eligible == 1, (F.length(S.ADMISSION_TEXT) + F.ascii(F.substring(S.ADMISSION_TEXT, -1, 1))) % 2)
    return episodes.withColumn(S.ELIGIBLE, eligible).withColumn(S.LABEL, label.cast("int"))


def brute_force_history(rows):
    import hashlib

    def order(r):
        at, text = r[S.ADMISSION], r[S.ADMISSION_TEXT]
        return (at is None, at or dt.datetime.min, "" if at else hashlib.md5(text.encode()).hexdigest(), text)

    found = {}
    for key in {r[S.ID] for r in rows}:
        mine = sorted((r for r in rows if r[S.ID] == key), key=order)
        for i, r in enumerate(mine):
            at = r[S.ADMISSION]

            def last(days):
                if at is None:
                    return sum(m[S.ADMISSION] is None for m in mine)
                return sum(
                    m[S.ADMISSION] is not None and at - dt.timedelta(days=days) <= m[S.ADMISSION] < at for m in mine
                )

            previous = mine[i - 1][S.DISCHARGE] if i else None
            found[r[S.ADMISSION_TEXT]] = (
                i, previous, sum(m[S.LABEL] or 0 for m in mine[:i]), last(30), last(90), last(365)
            )
    return found


NAMES = (
    "previous_hospitalizations", "previous_discharge_ts", "previous_unplanned_readmissions",
    "admissions_last_30d", "admissions_last_90d", "admissions_last_365d",
)


@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_brute_force_plain_and_split(spark, make, seed):
    target = with_labels(random_episodes(make, seed)).cache()
    expected = brute_force_history(target.collect())
    for heavy in (None, find_heavy_keys(target, S.ID, 60, 30), find_heavy_keys(target, S.ID, 5, 7)):
        found = {r[S.ADMISSION_TEXT]: tuple(r[n] for n in NAMES) for r in history(target, heavy=heavy).collect()}
        assert found == expected


def test_lead_equals_brute_force_plain_and_split(spark, make):
    target = with_labels(random_episodes(make, 5)).cache()
    plain = {r[S.ADMISSION_TEXT]: r for r in overlaps.lead_next(target).collect()}
    for rows in (60, 5):
        split = {r[S.ADMISSION_TEXT]: r for r in overlaps.lead_next(target, find_heavy_keys(target, S.ID, rows, 20)).collect()}
        assert split == plain
    counts = brute_force_history(target.collect())
    by_place = {}
    for r in plain.values():
        by_place[(r[S.ID], counts[r[S.ADMISSION_TEXT]][0])] = r
    for (key, place), r in by_place.items():
        following = by_place.get((key, place + 1))
        assert r["next_admission_ts"] == (following[S.ADMISSION] if following else None)
        assert r["next_executante"] == (following["executante"] if following else None)


def test_missing_subject_can_be_heavy(spark, make):
    target = with_labels(random_episodes(make, 6)).withColumn(S.ID, F.when(F.col(S.ID) != "hot", F.col(S.ID))).cache()
    heavy = find_heavy_keys(target, S.ID, 60, 40)
    expected = brute_force_history(target.collect())
    found = {r[S.ADMISSION_TEXT]: tuple(r[n] for n in NAMES) for r in history(target, heavy=heavy).collect()}
    assert found == expected
    plain = {r[S.ADMISSION_TEXT]: r for r in overlaps.lead_next(target).collect()}
    assert plain == {r[S.ADMISSION_TEXT]: r for r in overlaps.lead_next(target, heavy).collect()}


def burst(make, labels=True):
    """One subject: a whole history on one day, many admissions and discharges at one instant, a year 0024, no times."""
    draw, rows = random.Random(9), []
    for i in range(300):
        at = dt.datetime(2024, 5, 5) + dt.timedelta(seconds=draw.randrange(40) * 60)
        if i % 4 == 0:
            at = dt.datetime(2024, 5, 5, 0, 20)
        out = at + dt.timedelta(minutes=draw.choice([-3, 0, 0, 5, 9]))
        if i % 7 == 0:
            out = dt.datetime(2024, 5, 5, 0, 20)
        rows.append(("hot", at.isoformat(sep=" "), out.isoformat(sep=" "), {"text": f"t{i:04d}", "executante": f"H{i}"}))
    rows.append(("hot", "0024-05-05 00:00:00", "2024-05-05 00:05:00", {"text": "odd", "executante": "Hodd"}))
    # Exactly 30, 90 and 365 days after the burst: admissions leave the frames at the instant of others.
    for days in (30, 90, 365):
        for i in range(20):
            at = dt.datetime(2024, 5, 5, 0, 20) + dt.timedelta(days=days)
            rows.append(("hot", at.isoformat(sep=" "), None, {"text": f"d{days}-{i}", "executante": f"D{i}"}))
    rows += [("hot", None, "2024-05-05 00:10:00", {"text": f"n{i}"}) for i in range(40)]
    rows += [(f"light{i}", "2024-05-05 00:00:00", "2024-05-05 00:10:00", {"text": f"l{i}"}) for i in range(20)]
    return make.episodes(*rows)


@pytest.mark.parametrize("rows_per_slice", [10, 60])
def test_history_of_a_burst_at_one_instant(spark, make, rows_per_slice):
    target = with_labels(burst(make)).cache()
    expected = brute_force_history(target.collect())
    for heavy in (None, find_heavy_keys(target, S.ID, 100, rows_per_slice)):
        found = {r[S.ADMISSION_TEXT]: tuple(r[n] for n in NAMES) for r in history(target, heavy=heavy).collect()}
        assert found == expected


def test_slices_of_a_burst_stay_small(spark, make):
    target = burst(make)
    heavy = find_heavy_keys(target, S.ID, 100, 60)
    slices = cut(heavy.only(target, S.ID), S.ID, history_order(S.ADMISSION, S.ADMISSION_TEXT), heavy)
    sizes = [r["count"] for r in slices.rows.groupBy(S.ID, SLICE).count().collect()]
    assert sum(sizes) == 401 and max(sizes) <= 60 and len(sizes) >= 7


def test_history_does_not_slide_over_frames(spark, make):
    """The frames of the sweep start at the beginning, so their cost is linear in a subject's rows."""
    target = with_labels(random_episodes(make, 1))
    plan = history(target)._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "-30" not in plan.split("RangeFrame")[1][:40]


def test_history_plan_sorts_once(spark, make):
    target = with_labels(random_episodes(make, 1))
    plan = build_features(target)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_split_plan_keeps_heavy_subject_out_of_one_window(spark, make):
    target = with_labels(random_episodes(make, 1))
    heavy = find_heavy_keys(target, S.ID, 60, 40)
    plan = build_features(target, heavy=heavy)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_edges_of_the_windows(spark, make):
    target = with_labels(
        make.episodes(
            ("a", "2024-01-01 00:00:00", "2024-01-03 00:00:00", {"text": "1"}),
            ("a", "2024-01-31 00:00:00", "2024-01-30 00:00:00", {"text": "2"}),
            ("a", "2024-01-31 00:00:00", "2024-02-20 00:00:00", {"text": "3"}),
            ("a", None, "2024-03-01 00:00:00", {"text": "4"}),
        )
    )
    rows = {(r[S.ADMISSION], r[S.DISCHARGE]): r for r in build_features(target).collect()}
    first, second, third, lost = (rows[k] for k in sorted(rows, key=lambda k: (k[0] is None, k)))
    assert first["admissions_last_30d"] == 0
    # Exactly 30 days apart counts; two admissions at one instant do not count each other.
    assert second["admissions_last_30d"] == 1 and third["admissions_last_30d"] == 1
    assert second["length_of_stay_days"] == -1 and second["los_bucket"] == "0-1 days"
    assert third["days_since_previous_hospitalization"] == 1
    assert lost["previous_hospitalizations"] == 3 and lost["los_bucket"] == "15+ days"
    assert lost["admission_month"] is None and lost["admissions_last_365d"] == 1
    assert first["admission_weekday"] == 1 and first["admission_month"] == dt.datetime(2024, 1, 1)


def test_history_is_computed_before_the_eligibility_filter(spark, make):
    target = with_labels(
        make.episodes(("a", "2024-01-01 00:00:00", None), ("a", "2024-01-10 00:00:00", "2024-01-11 00:00:00"))
    )
    features = build_features(target)
    row = features.head()
    assert features.count() == 1 and row["previous_hospitalizations"] == 1 and row["admissions_last_30d"] == 1
    check_features(target, features)
    with pytest.raises(ValueError):
        check_features(target, features.limit(0))
