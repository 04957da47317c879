"""The stage tables of one input folder, built on demand and kept for the session."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from episodica import schema as S
from episodica.marts.clean import clean_features
from episodica.marts.cube import Cube, rate_cube
from episodica.operators.episodes import clean_episodes, collapse_episodes
from episodica.operators.features import build_features, history_timeline
from episodica.operators.heavy import HeavyKeys, find_heavy_keys
from episodica.operators.target import build_target, has_duplicate_keys, next_timeline
from episodica.plans import visits as source
from episodica.schema import EpisodeConfig
from episodica.sources.stages import StageStore, stage_root


class Workspace:
    """Raw rows, episodes, target and features of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: EpisodeConfig = EpisodeConfig()) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.cfg = cfg
        tag = hashlib.sha256(self.sf_dir.encode()).hexdigest()[:12]
        self.store = StageStore(spark, f"{stage_root(spark)}/{tag}")

    def table(self, name: str) -> DataFrame:
        return source.table(self.spark, self.sf_dir, name)

    @property
    def visits(self) -> DataFrame:
        return self.store.get("visits", lambda: source.visits(self.spark, self.sf_dir))

    @property
    def billing(self) -> DataFrame:
        return self.store.get("billing", lambda: source.billing(self.spark, self.sf_dir))

    @property
    def extracts(self) -> dict[str, DataFrame]:
        return source.extracts(self.spark, self.sf_dir, self.visits, self.billing)

    @property
    def episodes(self) -> DataFrame:
        return self.store.get("episodes", lambda: clean_episodes(collapse_episodes(self.visits, self.cfg), self.cfg))

    @cached_property
    def heavy_next(self) -> HeavyKeys | None:
        return find_heavy_keys(next_timeline(self.episodes, self.visits, self.billing), S.ID, self.cfg.heavy_rows)

    @cached_property
    def heavy_history(self) -> HeavyKeys | None:
        return find_heavy_keys(history_timeline(self.episodes), S.ID, self.cfg.heavy_rows)

    @cached_property
    def duplicate_keys(self) -> bool:
        return has_duplicate_keys(self.episodes)

    def build_target(self) -> DataFrame:
        return build_target(
            self.episodes, self.visits, self.billing, self.cfg, self.heavy_next, self.duplicate_keys
        )

    @property
    def target(self) -> DataFrame:
        return self.store.get("target", self.build_target)

    def build_features(self) -> DataFrame:
        return build_features(self.target, self.cfg, self.heavy_history)

    @property
    def features(self) -> DataFrame:
        return self.store.get("features", self.build_features)

    @property
    def clean(self) -> DataFrame:
        return clean_features(self.features)

    @property
    def cube(self) -> Cube:
        return Cube(self.store.get("cube", lambda: rate_cube(self.clean)))


_open: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _open:
        _open[key] = Workspace(spark, sf_dir)
    return _open[key]
