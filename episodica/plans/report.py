"""The report job: every audit, the catalog and the filtered marts of a built folder, written as CSV."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from episodica import schema as S
from episodica.marts.clean import clean_features
from episodica.marts.cube import filtered_marts
from episodica.marts.filters import FilterSpec
from episodica.operators.heavy import HeavyKeys, find_heavy_keys
from episodica.plans.registry import AUDITS
from episodica.schema import EpisodeConfig
from episodica.sources import catalog
from episodica.sources.extracts import write_report
from episodica.sources.versions import open_tables

log = logging.getLogger(__name__)


class BuiltFolder:
    """The tables that a build wrote, under the names the audits use."""

    def __init__(self, spark: SparkSession, folder: str, cfg: EpisodeConfig = EpisodeConfig()) -> None:
        self.spark, self.cfg = spark, cfg
        # All tables come from the version that is current now.
        self._tables = open_tables(spark, folder)

    def _table(self, name: str) -> DataFrame:
        return self._tables.table(name)

    @property
    def extracts(self) -> dict[str, DataFrame]:
        names = [n for n in S.RAW_SCHEMAS if self._tables.has(f"raw/{n}")]
        return {n: self._table(f"raw/{n}") for n in names}

    @property
    def visits(self) -> DataFrame:
        return self._table("raw/hospitalizations")

    @property
    def billing(self) -> DataFrame:
        return self._table("raw/billing")

    @property
    def episodes(self) -> DataFrame:
        return self._table("hospitalization_episodes_clean")

    @property
    def target(self) -> DataFrame:
        return self._table("hospitalization_target")

    @property
    def features(self) -> DataFrame:
        return self._table("ml_features")

    @cached_property
    def heavy_next(self) -> HeavyKeys | None:
        return find_heavy_keys(self.episodes, S.ID, self.cfg.heavy_rows)


def write_reports(
    spark: SparkSession, built: str, out_dir: str, names: Iterable[str] | None = None, spec: FilterSpec = FilterSpec()
) -> list[str]:
    """Write the named reports (all by default) under ``out_dir``; returns their names. Fails early on a missing folder."""
    folder = BuiltFolder(spark, built)
    tables = {**folder.extracts, "hospitalization_target": folder.target, "ml_features": folder.features}
    for row in catalog.row_counts(tables).collect():
        log.info("%s: %d rows", row["table_name"], row["rows"])
    made = {name: lambda query=query: query(folder) for name, query in AUDITS.items()}
    made["data_catalog"] = lambda: catalog.data_catalog(folder.extracts)
    for name, df in filtered_marts(clean_features(folder.features), spec).items():
        made[f"mart_{name}"] = lambda df=df: df
    chosen = list(made) if names is None else list(names)
    for name in chosen:
        write_report(made[name](), f"{out_dir.rstrip('/')}/{name}")
        log.info("report written: %s", name)
    return chosen
