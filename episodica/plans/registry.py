"""Every registered query, by key, over the stage tables of one input folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodica import schema as S
from episodica.audits import closure, dates, episodes as ep, overlaps, planning
from episodica.functions import vocabulary as V
from episodica.functions.temporal import days_between, month_start, parse_day_first, weekday_sunday0
from episodica.functions.buckets import stay_bucket
from episodica.marts import cube, filters, rates
from episodica.operators import features as feat, reports, signals, target as tgt
from episodica.operators.episodes import collapse_episodes, parse_discharge, with_admission_time
from episodica.operators.heavy import HeavyKeys, find_heavy_keys
from episodica.plans.visits import table
from episodica.plans.workspace import Workspace, workspace
from episodica.sources import catalog, extracts, sketches

Query = Callable[[Workspace], DataFrame]

# Subjects above this many rows go through the sliced path in the *_split queries.
SPLIT_ROWS = 9
SPLIT_SLICE = 50_000
# Report thresholds: smaller than the defaults, so that small inputs fill the tables.
MIN_EPISODES = 20
HEATMAP_MIN_EPISODES = 1

#: Extracts written as text have at most so many rows in a file: about 60 MB of text for the longest rows.
CSV_ROWS_PER_FILE = 200_000

KEY = (S.ID, S.ADMISSION_TEXT)
# Given tables whose columns describe_schema lists.
DESCRIBED = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def _split(w: Workspace) -> HeavyKeys | None:
    return find_heavy_keys(w.episodes, S.ID, SPLIT_ROWS, SPLIT_SLICE)


def _ingest_csv(w: Workspace) -> DataFrame:
    folder = f"{w.store.folder}/csv/hospitalizations"
    text = w.visits.select(*[F.col(c).cast("string") for c in S.RAW_SCHEMAS["hospitalizations"].fieldNames()])
    # Texts that a careless reader cuts or drops: quotes, separator, line break, backslash, nothing.
    status = F.when(F.col("situacao") == "F", F.lit('say "hi", now\nline')).when(F.col("situacao") == "O", F.lit("a\\"))
    text = text.withColumn("situacao", status.otherwise(F.lit("")))
    # Compressed, as texts repeat; a compressed file is one split, so its rows are bounded.
    text.write.mode("overwrite").option("maxRecordsPerFile", CSV_ROWS_PER_FILE).csv(
        folder, header=True, quote='"', escape='"', compression="gzip", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    spec = extracts.CsvSpec(folder, S.RAW_SCHEMAS["hospitalizations"])
    return extracts.ingest_csv(w.spark, {"hospitalizations": spec})["hospitalizations"]


def _parquet_roundtrip(w: Workspace) -> DataFrame:
    folder = f"{w.store.folder}/exported"
    extracts.write_tables(w.extracts, folder)
    back = extracts.read_tables(w.spark, folder, list(w.extracts))
    return catalog.compare_tables(w.extracts, back)


def _ingest_all(w: Workspace) -> DataFrame:
    """The six extracts written with different separators, found again on reading, and the catalog of what was read."""
    folder = f"{w.store.folder}/csv/all"
    for (name, df), sep in zip(w.extracts.items(), (",", ";", "\t", "|", ",", ";"), strict=True):
        text = df.select(*[catalog.as_text(c, kind).alias(c) for c, kind in df.dtypes])
        # Compressed, as texts repeat, at the level that costs the least time; a compressed file is one split.
        text.write.mode("overwrite").option("maxRecordsPerFile", CSV_ROWS_PER_FILE).option("zlib.compress.level", "BEST_SPEED").csv(
            f"{folder}/{name}", header=True, sep=sep, quote='"', escape='"', compression="gzip",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    specs = {name: extracts.CsvSpec(f"{folder}/{name}") for name in w.extracts}
    return catalog.data_catalog(extracts.ingest_csv(w.spark, specs)).drop("column_type")


def _sketched_catalog(w: Workspace) -> DataFrame:
    """Sketches of the extracts in three parts, merged, beside the exact counts: is each estimate within four errors?"""
    store = sketches.SketchStore(w.spark, f"{w.store.folder}/sketches")
    for part in range(3):
        own = F.pmod(F.xxhash64(S.ID), F.lit(3)) == part
        store.add(str(part), {name: df.filter(own) for name, df in w.extracts.items()})
    exact = catalog.data_catalog(w.extracts).select("table_name", "column_name", "distinct_values")
    off = F.abs(F.col("distinct_estimate") - F.col("distinct_values"))
    within = off <= F.ceil(F.col("distinct_values") * 4 * sketches.DISTINCT_ERROR)
    return store.catalog().join(F.broadcast(exact), ["table_name", "column_name"]).select(
        "table_name", "column_name", "rows", "nulls", within.alias("estimate_holds")
    )


def _candidates(w: Workspace) -> DataFrame:
    rows = tgt.with_next(w.episodes, w.visits, w.billing, w.cfg, w.heavy_next).filter(tgt.is_candidate(w.cfg))
    return rows.select(
        *KEY,
        S.ADMISSION,
        F.upper(F.coalesce("next_carater", F.lit(""))).alias("admission_character"),
        signals.normalised_icd("next_codigocid").alias("cid"),
        *signals.FLAGS,
    )


def _signal(w: Workspace, name: str, value: Callable[[DataFrame], Column]) -> DataFrame:
    rows = _candidates(w)
    return rows.select(*KEY, value(rows).alias(name))


def _classified(w: Workspace) -> DataFrame:
    rows = _candidates(w)
    return rows.select(
        *KEY, signals.unplanned(F.col("admission_character"), F.col("cid"), w.cfg).alias(S.LABEL)
    )


def _history(w: Workspace, *columns: str) -> DataFrame:
    return feat.history(w.target, w.heavy_history).select(*KEY, *columns)


def _enriched(w: Workspace) -> DataFrame:
    return planning.enrich_next(w.target, w.episodes)


def _gap_rows(w: Workspace) -> DataFrame:
    rows = tgt.next_episode(w.episodes, heavy=w.heavy_next)
    return rows.select(*KEY, tgt.days_until_next().alias(S.DAYS_NEXT))


def _filtered(w: Workspace) -> DataFrame:
    spec = filters.FilterSpec(
        sex=("F",), specialty=("ECONOMY", "PROMO", "STANDARD"), years=(2020, 2022, 2024), max_stay=10,
        max_admissions_last_365d=3,
    )
    return filters.apply_filters(w.clean, spec)


OPERATORS: dict[str, Query] = {
    # sources and catalog
    "ingest_csv": _ingest_csv,
    "ingest_all": _ingest_all,
    "parquet_roundtrip": _parquet_roundtrip,
    "row_counts": lambda w: catalog.row_counts(
        {**w.extracts, "hospitalization_episodes_clean": w.episodes, "hospitalization_target": w.target, "ml_features": w.features}
    ),
    "describe_schema": lambda w: catalog.describe_tables({n: table(w.spark, w.sf_dir, n) for n in DESCRIBED}),
    "sample_rows": lambda w: catalog.sample_tables(w.extracts, 5),
    "data_catalog": lambda w: catalog.data_catalog(w.extracts),
    "data_catalog_sketch": _sketched_catalog,
    # episodes and target
    "collapse_episodes": lambda w: collapse_episodes(w.visits, w.cfg),
    "parse_admission": lambda w: w.episodes.select(*KEY, parse_day_first(S.ADMISSION_TEXT).alias("parsed_admission_ts")),
    "correct_admission": lambda w: with_admission_time(w.episodes.select(*KEY), w.cfg),
    "parse_discharge": lambda w: w.episodes.select(*KEY, S.DISCHARGE_TEXT, parse_discharge(S.DISCHARGE_TEXT).alias(S.DISCHARGE)),
    "next_episode": lambda w: tgt.next_episode(w.episodes, heavy=w.heavy_next).select(
        *KEY, S.ADMISSION, S.DISCHARGE, "next_admission_ts", *tgt.NEXT_COLUMNS.values()
    ),
    "next_episode_split": lambda w: tgt.next_episode(w.episodes, heavy=_split(w)).select(
        *KEY, S.ADMISSION, S.DISCHARGE, "next_admission_ts", *tgt.NEXT_COLUMNS.values()
    ),
    "days_until_next": _gap_rows,
    "eligibility": lambda w: w.episodes.select(*KEY, tgt.eligible(w.cfg).alias(S.ELIGIBLE)),
    "raw_procedures": lambda w: signals.procedure_texts(signals.raw_procedure_rows(w.visits, w.cfg)),
    "billing_procedures": lambda w: signals.procedure_texts(signals.billing_procedure_rows(w.billing)),
    "candidates": lambda w: _candidates(w).select(*KEY, S.ADMISSION, "admission_character", "cid"),
    "acute_icd_signal": lambda w: _signal(w, "acute_cid_signal", lambda d: signals.acute_icd(F.col("cid")).cast("int")),
    "acute_procedure_signal": lambda w: _signal(w, "acute_procedure_signal", lambda d: F.col("acute_procedure")),
    "classify_unplanned": _classified,
    "build_target": lambda w: w.build_target(),
    "build_target_split": lambda w: tgt.build_target(w.episodes, w.visits, w.billing, w.cfg, _split(w), True),
    "target_invariants": lambda w: tgt.target_invariants(w.episodes, w.target, w.cfg),
    "target_summary": lambda w: tgt.target_summary(w.target),
    "build_features": lambda w: w.build_features(),
    "build_features_split": lambda w: feat.build_features(w.target, w.cfg, _split(w)),
    "feature_invariants": lambda w: feat.feature_invariants(w.target, w.features),
    "feature_summary": lambda w: feat.feature_summary(w.features),
    # windows
    "previous_hospitalizations": lambda w: _history(w, "previous_hospitalizations"),
    "days_since_previous": lambda w: feat.history(w.target, w.heavy_history).select(
        *KEY, days_between("previous_discharge_ts", S.ADMISSION).alias("days_since_previous_hospitalization")
    ),
    "previous_unplanned": lambda w: _history(w, "previous_unplanned_readmissions"),
    "admissions_last_30d": lambda w: _history(w, "admissions_last_30d"),
    "admissions_last_90d": lambda w: _history(w, "admissions_last_90d"),
    "admissions_last_365d": lambda w: _history(w, "admissions_last_365d"),
    "lead_next": lambda w: overlaps.lead_next(w.target, w.heavy_next),
    "lead_next_split": lambda w: overlaps.lead_next(w.target, _split(w)),
    "share_of_total": lambda w: reports.share_of_total(w.target, ["especialidade"], "episodes"),
    "share_within_group": lambda w: reports.share_within(
        w.target, F.col("especialidade"), F.col("motivoalta"), ("especialidade", "motivoalta"), "episodes", "percentage"
    ),
    # joins, grains, lookups, samples
    "enrich_next": _enriched,
    "cross_denominator": lambda w: planning.rate_comparison(w.target, _enriched(w)).select(
        "eligible_episodes", "all_readmissions", "potentially_unplanned_readmissions", "conservative_unplanned_rate"
    ),
    "zero_day_hospitals": lambda w: ep.zero_day_hospitals(w.visits, w.target),
    "top_patients_history": lambda w: ep.top_patient_episodes(w.target, 5),
    "key_overlap_pairs": lambda w: catalog.key_overlap_pairs(w.extracts),
    "distinct_grain_check": lambda w: catalog.distinct_grain_check(w.visits),
    "prefix_lookup": lambda w: reports.prefix_lookup(w.target, S.ID, "12").select(*KEY, S.ADMISSION, S.DISCHARGE),
    "random_sample": lambda w: reports.random_sample(w.target.select(*KEY, S.ADMISSION), 50, list(KEY), seed=7),
    # derived columns
    "length_of_stay": lambda w: w.target.select(*KEY, dates.stay().alias(dates.STAY)),
    "calendar_features": lambda w: w.target.select(
        *KEY,
        month_start(S.ADMISSION).alias("admission_month"),
        F.year(S.ADMISSION).cast("bigint").alias("admission_year"),
        F.quarter(S.ADMISSION).cast("bigint").alias("admission_quarter"),
        weekday_sunday0(S.ADMISSION).alias("admission_weekday"),
    ),
    "los_bucket": lambda w: w.target.select(*KEY, stay_bucket(dates.stay()).alias("los_bucket")),
}

AUDITS: dict[str, Query] = {
    "aud_date_quality": lambda w: dates.date_quality(w.target),
    "aud_year_ranges": lambda w: dates.year_ranges(w.target),
    "aud_out_of_range": lambda w: dates.out_of_range(w.target),
    "aud_longest_stays": lambda w: dates.longest_stays(w.target),
    "aud_long_stays_by_hospital": lambda w: dates.long_stays_by(w.target, "executante"),
    "aud_long_stays_by_specialty": lambda w: dates.long_stays_by(w.target, "especialidade"),
    "aud_los_distribution": lambda w: dates.stay_distribution(w.target),
    "aud_zero_day_summary": lambda w: dates.zero_day_summary(w.target),
    "aud_zero_day_by_hospital": lambda w: dates.zero_day_by(w.target, "executante"),
    "aud_zero_day_by_specialty": lambda w: dates.zero_day_by(w.target, "especialidade"),
    "aud_year_errors": lambda w: dates.year_errors(w.target),
    "aud_extreme_los": lambda w: dates.extreme_stays(w.target),
    "aud_overlaps": lambda w: overlaps.overlaps(w.target, w.heavy_next),
    "aud_overlap_summary": lambda w: overlaps.overlap_summary(w.target, w.heavy_next),
    "aud_overlap_buckets": lambda w: overlaps.overlap_buckets(w.target, w.heavy_next),
    "aud_overlap_count": lambda w: overlaps.overlap_count(w.target, w.heavy_next),
    "aud_episode_counts": lambda w: ep.episode_counts(w.target),
    "aud_top_patients": lambda w: ep.top_patients(w.target),
    "aud_duplicates": lambda w: ep.duplicates(w.target),
    "aud_los_quality": lambda w: ep.stay_quality(w.target),
    "aud_short_gaps": lambda w: ep.gap_histogram(w.target, 0, 7),
    "aud_death_then_admission": lambda w: ep.death_then_admission(w.target),
    "aud_transfer_gaps": lambda w: ep.gap_histogram(w.target, 0, 30, V.TRANSFER),
    "aud_target_distribution": lambda w: ep.target_distribution(w.target),
    "aud_rate_by_reason": lambda w: ep.rate_by_reason(w.target),
    "aud_sample_positives": lambda w: ep.sample_positives(w.target),
    "aud_top_patient_episodes": lambda w: ep.top_patient_episodes(w.target),
    "aud_join_coverage": lambda w: planning.join_coverage(_enriched(w)),
    "aud_next_character": lambda w: planning.next_character(_enriched(w)),
    "aud_planning_proxy": lambda w: planning.planning_proxy(_enriched(w)),
    "aud_specialty_by_character": lambda w: planning.specialty_by_character(_enriched(w)),
    "aud_routine_specialties": lambda w: planning.routine_specialties(_enriched(w)),
    "aud_elective_specialties": lambda w: planning.elective_specialties(_enriched(w)),
    "aud_urgent_specialties": lambda w: planning.urgent_specialties(_enriched(w)),
    "aud_icd_by_character": lambda w: planning.icd_by_character(_enriched(w)),
    "aud_rate_comparison": lambda w: planning.rate_comparison(w.target, _enriched(w)),
    "aud_review_sample": lambda w: planning.review_sample(_enriched(w)),
    "aud_target_summary": lambda w: ep.label_summary(w.target),
    "aud_general_vs_unplanned": lambda w: ep.general_vs_unplanned(w.target),
    "aud_consistency": lambda w: ep.consistency(w.episodes, w.target),
    "aud_ineligible_reasons": lambda w: ep.ineligible_reasons(w.target),
    "aud_interval_distribution": lambda w: ep.interval_distribution(w.target),
    "aud_raw_vs_clean": lambda w: ep.raw_vs_clean(w.target),
    "aud_excluded_reasons": lambda w: ep.excluded_reasons(w.target),
    "aud_days_histogram": lambda w: ep.gap_histogram(w.target, 0, 30),
    "aud_zero_gap_by_reason": lambda w: ep.zero_gap_by_reason(w.target),
    "aud_closure_status": lambda w: closure.closure_status(w.visits),
    "aud_closure_hospital": lambda w: closure.closure_hospital(w.visits),
    "aud_closure_dates": lambda w: closure.closure_dates(w.visits),
    "aud_closure_next": lambda w: closure.closure_next(w.target),
    "aud_closure_sample": lambda w: closure.closure_sample(w.visits),
    "aud_patient_raw": lambda w: ep.trace_raw(w.visits, "101"),
    "aud_patient_episodes": lambda w: ep.trace_episodes(w.target, "101"),
    "aud_top_hospitals": lambda w: ep.top_groups(w.features, "executante"),
    "aud_top_residence": lambda w: ep.top_groups(w.features, "municipioresidencia"),
    "aud_feature_ranges": lambda w: ep.feature_ranges(w.features),
    "aud_history_histogram": lambda w: ep.history_histogram(w.features),
}

def _cube_rows(w: Workspace) -> DataFrame:
    """Every group of the cube, its keys as one text."""
    keys = [F.date_format(k, "yyyy-MM-dd") if k == "admission_month" else F.col(k).cast("string") for k in cube.KEYS]
    text = F.concat_ws("|", *[F.coalesce(k, F.lit("")) for k in keys])
    means = [F.round(F.col(f"sum_{m}") / F.nullif(F.col(f"n_{m}").cast("double"), F.lit(0.0)), 6).alias(f"mean_{m}") for m in cube.MEASURES]
    return w.cube.groups.select("grouping", text.alias("keys"), "episodes", "readmissions", *means)


MARTS: dict[str, Query] = {
    "rate_cube": _cube_rows,
    "clean_features": lambda w: w.clean,
    "overall_rate": lambda w: rates.overall_rate(w.clean),
    "kpis": lambda w: rates.kpis(w.clean),
    "kpis_patients": lambda w: rates.kpis_patients(w.clean),
    "filter_options": lambda w: filters.filter_options(w.clean),
    "filter_maxima": lambda w: filters.filter_maxima(w.clean),
    "apply_filters": _filtered,
    "apply_filters_default": lambda w: filters.apply_filters(w.clean),
    "rate_table": lambda w: rates.rate_table(w.clean, "motivoalta"),
    "specialty_rate": lambda w: rates.specialty_rate(w.clean, MIN_EPISODES),
    "hospital_rate": lambda w: rates.hospital_rate(w.clean, MIN_EPISODES),
    "monthly_trend": lambda w: rates.monthly_trend(w.clean),
    "quarterly_trend": lambda w: rates.quarterly_trend(w.clean),
    "los_distribution": lambda w: rates.los_distribution(w.clean),
    "los_by_outcome": lambda w: rates.los_by_outcome(w.clean),
    "top_icd": lambda w: rates.top_icd(w.clean),
    "discharge_reason_rate": lambda w: rates.discharge_reason_rate(w.clean, MIN_EPISODES),
    "discharge_reason_counts": lambda w: rates.discharge_reason_counts(w.clean),
    "hospital_specialty_rates": lambda w: rates.hospital_specialty_rates(w.clean, HEATMAP_MIN_EPISODES),
    "hospital_specialty_heatmap": lambda w: w.cube.heatmap(HEATMAP_MIN_EPISODES),
    "rate_by_history": lambda w: rates.rate_by_history(w.clean),
}

REGISTRY: dict[str, Query] = {**OPERATORS, **AUDITS, **MARTS}


def _bound(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(workspace(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(query) for name, query in REGISTRY.items()}
