"""Lookup of lines in a trained model, without changing it.

``always`` looks at all clusters of a line's root key, by way of an index: a
cluster without wildcards at some positions can only fit lines with its tokens
there, so it is entered once, under the one of its (position, token) pairs that
fewest clusters of its root key have.  A line asks for the pairs at the positions
in use, and is compared with what it finds; joins and expressions are built in.
Rules that let other tokens pass, and ``never`` and ``fallback`` follow the
prefix tree: model rows and lines are shuffled to the same task by root key,
the model rows sorted first, so each tree is rebuilt from a bounded part of the
model while lines stream past.  Lines are salted, since lookups are read-only,
so a root key that holds a third of all lines is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.config import MinerConfig
from logloom.functions import similarity, tokens
from logloom.profiler import TaskSections
from logloom.scratch import materialize

from . import tree
from .kernel import Rules, Tree
from .mine import SEP, prepared


def _lookup(rules: Rules, strategy: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, Tree(rules)
        for batch in batches:
            ids, found = [], []
            for grp, _, at, joined, size in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if grp != current:
                    current, own = grp, Tree(rules)
                t = joined.split(SEP) if joined else ()
                if size is not None:
                    own.load(at, t, size)
                else:
                    ids.append(at)
                    found.append(own.match(t, strategy))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["msg_id", "cluster_id"])

    return run


def indexed(known: DataFrame, param: str) -> DataFrame:
    """(key, pos, tok, cluster_id, tpl): each cluster (cluster_id, tpl, key) under its rarest constant; pos -1 without any."""
    constants = known.select("cluster_id", "key", F.posexplode("tpl").alias("pos", "tok")).filter(F.col("tok") != param)
    held = constants.groupBy("key", "pos", "tok").agg(F.count(F.lit(1)).alias("held"))
    rarest = constants.join(held, ["key", "pos", "tok"]).groupBy("cluster_id").agg(F.min(F.struct("held", "pos", "tok")).alias("r"))
    entered = known.join(rarest, "cluster_id", "left")
    return entered.select("key", F.coalesce("r.pos", F.lit(-1)).alias("pos"), F.coalesce("r.tok", F.lit("")).alias("tok"), "cluster_id", "tpl")


def met(rows: DataFrame, index: DataFrame, broadcast_clusters: int = 100_000) -> DataFrame:
    """(msg_id, t, cluster_id, tpl): lines (msg_id, t, key) with the clusters that may fit them."""
    index = materialize(index, "match-index")
    few = lambda df: F.broadcast(df) if index.count() <= broadcast_clusters else df
    places = few(index.groupBy("key").agg(F.collect_set("pos").alias("places")))
    asked = rows.join(places, "key").withColumn("pos", F.explode("places"))
    asked = asked.select("msg_id", "t", "key", "pos", F.when(F.col("pos") < 0, F.lit("")).otherwise(F.get("t", F.col("pos"))).alias("tok"))
    return asked.join(few(index), ["key", "pos", "tok"]).select("msg_id", "t", "cluster_id", "tpl")


def match(lines: DataFrame, model: DataFrame, config: MinerConfig | None = None, strategy: str = "never", stages: Sequence = (), salts: int = 8, broadcast_clusters: int = 100_000, sections: TaskSections | None = None) -> DataFrame:
    """(msg_id, cluster_id) for each line (msg_id, line); null where no cluster fits.

    ``model`` has cluster_id, template_tokens and size.  ``always`` broadcasts
    its index up to ``broadcast_clusters`` clusters, else joins it by key, position
    and token; large ones can be split by Spark.
    """
    config = config or MinerConfig()
    if strategy not in ("never", "fallback", "always"):
        raise ValueError("strategy must be never, fallback or always")
    rows = lines.filter("msg_id is not null and line is not null").select(F.col("msg_id").cast("long"), prepared(F.col("line"), config, stages).alias("t"))
    rows = rows.withColumn("key", tokens.root_key(F.col("t"), config.engine, config.param_binning))
    known = model.select("cluster_id", F.col("template_tokens").alias("tpl"), "size", tokens.root_key(F.col("template_tokens"), config.engine, config.param_binning).alias("key"))
    if strategy == "always" and config.engine == "position" and config.diff_ratio is None and config.score is None:
        score = similarity.position(F.col("tpl"), F.col("t"), config.param, True)
        close = met(rows, indexed(known.drop("size"), config.param), broadcast_clusters).withColumn("s", score).filter("s.similarity >= 1.0")
        # Of equal ones the first in a walk through the tree. A line's best is a maximum, so tasks combine what they have before the shuffle.
        walk = tree.nodes(model, config).select("rank", F.posexplode("cluster_ids").alias("nth", "cluster_id"))
        met_first = (-F.col("rank")).alias("rank"), (-F.col("nth")).alias("nth"), "cluster_id"
        best = close.join(walk, "cluster_id").groupBy("msg_id").agg(F.max(F.struct("s.similarity", "s.param_count", *met_first)).alias("b"))
        return rows.select("msg_id").join(best.select("msg_id", "b.cluster_id"), "msg_id", "left")
    salted = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    first = known.select("key", salted, F.lit(0).alias("kind"), F.col("cluster_id").alias("at"), F.array_join("tpl", SEP).alias("joined"), F.col("size").cast("long"))
    then = rows.select("key", F.pmod(F.xxhash64("msg_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("msg_id").alias("at"), F.array_join("t", SEP).alias("joined"), F.lit(None).cast("long").alias("size"))
    both = first.unionByName(then).select(F.concat_ws(SEP, "key", "salt").alias("grp"), "kind", "at", "joined", "size")
    run = _lookup(Rules.of(config), strategy)
    run = sections.timed("lookup", run) if sections else run
    return both.repartition("grp").sortWithinPartitions("grp", "kind", "at").mapInArrow(run, "msg_id long, cluster_id long")
