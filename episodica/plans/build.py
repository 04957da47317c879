"""The whole build: CSV extracts to raw tables, episodes, target and features."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from episodica import schema as S
from episodica.operators.episodes import clean_episodes, collapse_episodes
from episodica.operators.features import build_features, check_features, history_timeline
from episodica.operators.heavy import find_heavy_keys
from episodica.operators.signals import unparsed_billing_times
from episodica.operators.target import build_target, check_target, has_duplicate_keys, next_timeline
from episodica.schema import EpisodeConfig
from episodica.sources.contracts import require_columns
from episodica.sources.extracts import ingest_csv, require_path, standard_specs, type_reports, write_quarantine, write_tables
from episodica.sources.stages import StageStore
from episodica.sources.versions import Version, VersionedTables

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class BuildResult:
    raw: dict[str, DataFrame]
    episodes: DataFrame
    target: DataFrame
    features: DataFrame


def _build(version: Version, hospitalizations: DataFrame, billing: DataFrame, cfg: EpisodeConfig) -> BuildResult:
    """Every stage is a Parquet table of the version, so a later stage restarts from it and not from the raw rows."""
    spark = version.spark
    require_columns(hospitalizations, *S.RAW_SCHEMAS["hospitalizations"].fieldNames(), table="hospitalizations")
    require_columns(billing, *S.RAW_SCHEMAS["billing"].fieldNames(), table="billing")
    unparsed = unparsed_billing_times(billing).head()["unparsed_times"]
    if unparsed:
        log.warning("billing: %d admission times cannot be read", unparsed)
    store = StageStore(spark, version.folder)
    episodes = store.get(
        "hospitalization_episodes_clean", lambda: clean_episodes(collapse_episodes(hospitalizations, cfg), cfg)
    )
    target = store.get(
        "hospitalization_target",
        lambda: build_target(
            episodes,
            hospitalizations,
            billing,
            cfg,
            find_heavy_keys(next_timeline(episodes, hospitalizations, billing), S.ID, cfg.heavy_rows),
            has_duplicate_keys(episodes),
        ),
    )
    check_target(episodes, target, cfg)
    features = store.get(
        "ml_features",
        lambda: build_features(target, cfg, find_heavy_keys(history_timeline(target), S.ID, cfg.heavy_rows)),
    )
    check_features(target, features)
    return BuildResult({"hospitalizations": hospitalizations, "billing": billing}, episodes, target, features)


def build_from_tables(
    spark: SparkSession,
    hospitalizations: DataFrame,
    billing: DataFrame,
    out_dir: str,
    cfg: EpisodeConfig = EpisodeConfig(),
) -> BuildResult:
    """Episodes, target and features as a new version under ``out_dir``.

    The version becomes current when all its tables are written and checked; an invariant that breaks raises, and the
    version before stays current.
    """
    versions = VersionedTables(spark, out_dir)
    version = versions.begin()
    built = _build(version, hospitalizations, billing, cfg)
    versions.commit(version)
    return built


def build_from_csv(
    spark: SparkSession, raw_dir: str, out_dir: str, cfg: EpisodeConfig = EpisodeConfig(), sep: str | None = None
) -> BuildResult:
    """Read the six extracts, keep them as Parquet, then build from those tables, all as one new version.

    Without ``sep`` every extract's separator is found from a sample of it. What types the columns could have, and how
    many values would not fit, is written to ``types``.
    """
    require_path(spark, raw_dir)
    versions = VersionedTables(spark, out_dir)
    version = versions.begin()
    specs = standard_specs(raw_dir, sep)
    paths = write_tables(ingest_csv(spark, specs), f"{version.folder}/raw")
    write_quarantine(spark, specs, f"{version.folder}/quarantine")
    raw = {name: spark.read.parquet(path) for name, path in paths.items()}
    for name in ("hospitalizations", "billing"):
        if name not in raw:
            raise FileNotFoundError(f"extract needed for the build: {name}")
    type_reports(raw).write.mode("overwrite").parquet(f"{version.folder}/types")
    for name, df in raw.items():
        log.info("%s: %d rows", name, df.count())
    built = _build(version, raw["hospitalizations"], raw["billing"], cfg)
    versions.commit(version)
    return BuildResult(raw, built.episodes, built.target, built.features)
