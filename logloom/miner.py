"""One object that keeps a model between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.config import MinerConfig
from logloom.functions import normalize
from logloom.operators import extract as ex
from logloom.operators import match as mt
from logloom.operators import merge as mg
from logloom.operators import mine as mi
from logloom.profiler import NullProfiler, TaskSections
from logloom.scratch import materialize
from logloom.sources import model as md


class TemplateMiner:
    """Learn, mine, look up, extract and merge over one model.

    ``store`` keeps the JSON snapshot: it is loaded at the start and saved
    after runs as ``Snapshots`` decides.  Lines need msg_ids that rise from
    run to run.
    """

    def __init__(self, spark: SparkSession, config: MinerConfig | None = None, store: md.Store | None = None, profiler=None):
        self.spark, self.config = spark, config or MinerConfig()
        self.profiler = profiler or NullProfiler()
        #: Time of folds, look-ups and extraction inside tasks, if the settings ask for profiles.
        self.sections = TaskSections(spark) if self.config.profiling else None
        self.snapshots = md.Snapshots(store, self.config.snapshot_minutes, self.config.snapshot_compress) if store else None
        self.model = md.from_json(spark, store.load() if store else None)
        self.stages: list = []

    def learn(self, lines: DataFrame, min_length: int = 2, insert_param: bool = True) -> normalize.Fusion:
        """Learn which neighbouring constants to fuse, from lines (msg_id, line)."""
        rows = lines.filter("line is not null").select("msg_id", mi.prepared(F.col("line"), self.config.with_(substitutions=(), collapses=())).alias("tokens"))
        fusion = normalize.learn_fusion(rows, min_length, insert_param)
        self.stages = [lambda t: fusion(t, self.config.param)]
        return fusion

    def mine(self, lines: DataFrame) -> DataFrame:
        """Take lines (msg_id, line) in; one result row each."""
        with self.profiler.section("total"):
            mined = materialize(mi.mine(lines, self.config, self.stages, model=self.model, sections=self.sections), "miner-results")
            self.model = materialize(mi.updated(self.model, mined), "miner-model")
            if self.snapshots:
                with self.profiler.section("save_state"):
                    self.snapshots.offer(self.model, not mined.filter("change_type <> 'none'").isEmpty())
        return mined

    def match(self, lines: DataFrame, strategy: str = "never") -> DataFrame:
        return mt.match(lines, self.model, self.config, strategy, self.stages, sections=self.sections)

    def extract(self, rows: DataFrame, exact: bool = True) -> DataFrame:
        return ex.extract(rows, self.config, exact, self.sections)

    def merge(self, strategies=None, by_length: bool = True) -> DataFrame:
        """Merge similar clusters; (old_id, cluster_id) of all clusters."""
        strategies = strategies or [mg.position_diff(self.config.merge_percent, self.config.param)]
        merged, moved = mg.merge(self.model, strategies, by_length)
        moved = materialize(moved, "miner-moved")
        self.model = materialize(merged, "miner-model")
        return moved

    def total_size(self) -> int:
        return self.model.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
