"""Template mining of ordered lines as a partitioned fold.

Stateless work (preprocessing, masks, tokens, normalizers) is one projection of
built-in expressions.  Then lines are shuffled by root key, sorted by msg_id
within it, and streamed through the fold with one tree at a time in memory.
Ids are numbered afterwards by the first line of each cluster, which gives the
ids that a serial run over all lines gives.

A root key that holds a large part of all lines is dealt further along the
tree's path where that provably changes nothing (``_dealt``), also when a model
is taken up.  Groups that are long still (lines that begin with a date, say) are
folded in blocks at the same time (``blocks``).  With ``max_clusters`` eviction
depends on the order of all lines, so these are one group, folded in blocks.

Null lines give no result row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.config import MinerConfig
from logloom.functions import masking, normalize, tokens
from logloom.profiler import TaskSections
from logloom.scratch import materialize

from . import blocks
from .kernel import CREATED, Rules, Tree

SEP = "\x1f"


def prepared(line: Column, config: MinerConfig, stages: Sequence = ()) -> Column:
    """Tokens of a line after preprocessing, masks and normalizers."""
    if config.preprocessor is not None:
        line = config.preprocessor(line)
    out = tokens.tokenize(masking.mask(line, config.masks, config.mask_prefix, config.mask_suffix), config.extra_delimiters)
    steps = []
    if config.substitutions:
        steps.append(lambda t: normalize.substitute(t, config.substitutions, config.param))
    if config.collapses:
        steps.append(lambda t: normalize.collapse(t, config.collapses, config.param))
    steps += stages
    for step in steps:
        out = step(out)
    # What normalizers return is joined and split again by the miner.
    return tokens.tokenize(F.array_join(out, " "), config.extra_delimiters) if steps else out


def _fold(rules: Rules, base: int = 0):
    """Rows (msg_id, grp, tokens, size) in order of grp, stored clusters first, then msg_id -> a result row per line.

    Rows with a size are stored clusters, msg_id being their id; new clusters
    are numbered from ``base`` on within their group.
    """
    columns = (("msg_id", pa.int64()), ("grp", pa.string()), ("local_id", pa.int64()), ("change_type", pa.string()), ("cluster_size", pa.int64()), ("template_mined", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tree = None, Tree(rules)
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            for msg_id, grp, joined, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if grp != current:
                    current, tree = grp, Tree(rules)
                    tree.counter = base
                if size is not None:
                    tree.load(msg_id, joined.split(SEP) if joined else (), size)
                    continue
                cluster, change = tree.add(joined.split(SEP) if joined else ())
                found = tree.clusters.get(cluster)
                for to, value in zip(out, (msg_id, grp, cluster, change, found[1], " ".join(found[0])), strict=True):
                    to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, columns, strict=True)], [n for n, _ in columns])

    return run


def _path(t: Column, config: MinerConfig) -> Column:
    """The tokens that lead from a root of the tree to a leaf."""
    deepest, n = F.lit(config.depth - 2), F.size(t)
    if config.engine == "jaccard":
        return F.slice(t, F.lit(2), F.greatest(F.lit(1), F.least(deepest, n - 1)) - 1)
    return F.slice(t, F.lit(1), F.greatest(F.lit(0), F.least(deepest, n) - 1))


def _dealt(rows: DataFrame, config: MinerConfig, hot_rows: int, most: int = 2000) -> DataFrame:
    """``rows`` (key, t) with ``grp``: the root key, and for large ones as much of the path as is safe.

    A token on the path owns a tree node of its own, so dealing by it is exact,
    if all lines of the group reach that level, no token there is sent to the
    wildcard node (digits, the wildcard itself), and their number stays below
    ``max_children``.  One aggregation a level proves that; rows of a stored
    model count as well.  Groups of up to ``hot_rows`` rows, or of a share of
    all rows below 1 / ``most``, stay whole.
    """
    path = _path(F.col("t"), config)
    rows = rows.withColumns({"grp": F.col("key"), "open": F.lit(True)})
    for level in range(config.depth - 3):
        step = F.get(path, F.lit(level))
        digit = tokens.has_digit(step) if config.parametrize_numeric_tokens else F.lit(False)
        groups = rows.groupBy("grp", "open").agg(
            F.count(F.lit(1)).alias("rows"),
            F.max(F.coalesce(digit | (step == config.param), F.lit(False))).alias("wild"),
            F.approx_count_distinct(step, 0.01).alias("kinds"),
            F.min(F.size(path)).alias("least"),
        )
        groups = groups.withColumn("share", F.col("rows") / F.expr("sum(rows) over ()"))
        safe = F.col("open") & ~F.col("wild") & (F.col("kinds") < config.max_children * 0.9) & (F.col("least") > level)
        split = [r["grp"] for r in groups.filter(safe & (F.col("rows") > hot_rows) & (F.col("share") >= 1 / most)).select("grp").collect()]
        if not split:
            break
        chosen = F.col("open") & F.col("grp").isin(split)
        rows = rows.select(*[c for c in rows.columns if c not in ("grp", "open")], F.when(chosen, F.concat_ws(SEP, "grp", step)).otherwise(F.col("grp")).alias("grp"), chosen.alias("open"))
    return rows.drop("open")


def _long(rows: DataFrame, block_rows: int) -> DataFrame | None:
    """Groups that are folded in blocks, with their cuts; None if there is none."""
    lines = rows.filter(F.col("size").isNull()).select("grp", "msg_id")
    many = lines.groupBy("grp").agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") > 2 * block_rows).select("grp")
    many = materialize(many, "mine-long")
    if many.isEmpty():
        return None
    return materialize(blocks.long_groups(lines.join(many, "grp"), block_rows), "mine-cuts")


def running(rows: DataFrame, by: Sequence[str], flag: Column, block: int = 65_536) -> DataFrame:
    """``rows`` with ``n``: how many rows up to this one (by msg_id) have the flag.

    Blocks of ids are counted first, so no task orders all rows.
    """
    cut = rows.withColumn("blk", F.floor(F.col("msg_id") / block)).withColumn("flag", flag.cast("long"))
    sums = cut.groupBy(*by, "blk").agg(F.sum("flag").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy(*by).orderBy("blk")) - F.col("s")).drop("s")
    inside = F.sum("flag").over(Window.partitionBy(*by, "blk").orderBy("msg_id").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("inside", inside).join(before, [*by, "blk"]).withColumn("n", F.col("inside") + F.col("before")).drop("blk", "flag", "inside", "before")


def mine(lines: DataFrame, config: MinerConfig | None = None, stages: Sequence = (), instances: int | None = None, hot_rows: int = 20_000, model: DataFrame | None = None, block_rows: int = 20_000, sections: TaskSections | None = None) -> DataFrame:
    """One row per line (msg_id, line): what the miner answers for it.

    ``model`` (cluster_id, template_tokens, size) is taken up where it stands.

    ``instances`` deals lines to that many independent models by
    ``msg_id % instances`` and adds the column ``instance``.

    Root keys of more than ``hot_rows`` lines are dealt along the tree, groups of
    more than twice ``block_rows`` are folded in blocks.  ``sections`` gets the
    time of the folds in tasks.
    """
    config = config or MinerConfig()
    if instances and model is not None:
        raise ValueError("a pool starts from empty models")
    t = prepared(F.col("line"), config, stages)
    rows = lines.filter("msg_id is not null and line is not null").select(F.col("msg_id").cast("long"), t.alias("t"), F.lit(None).cast("long").alias("size"))
    base = held = 0
    if model is not None:
        top = model.agg(F.max("cluster_id"), F.count(F.lit(1))).first()
        base, held = top[0] or 0, top[1]
        rows = rows.union(model.select(F.col("cluster_id").cast("long"), "template_tokens", F.col("size").cast("long")))
    serial = config.max_clusters is not None
    rows = rows.withColumn("key", F.lit("") if serial else tokens.root_key(F.col("t"), config.engine, config.param_binning))
    if instances:
        rows = rows.withColumn("key", F.concat_ws(SEP, F.pmod("msg_id", F.lit(instances)).cast("string"), "key"))
    # Tokens are written once, so that looking at groups does not repeat masks and normalizers.
    rows = rows.withColumn("grp", F.col("key")) if serial else _dealt(materialize(rows, "mine-tokens"), config, hot_rows)
    rows = rows.select("msg_id", "grp", F.array_join("t", SEP).alias("joined"), "size")
    rules, schema = Rules.of(config), "msg_id long, grp string, local_id long, change_type string, cluster_size long, template_mined string"

    timed = sections.timed if sections else lambda _, run: run

    def folded(part: DataFrame) -> DataFrame:
        return part.repartition("grp").sortWithinPartitions("grp", F.col("size").isNull(), "msg_id").mapInArrow(timed("fold", _fold(rules, base)), schema)

    long = _long(rows, block_rows)
    if long is None:
        out = materialize(folded(rows), "mined")
    else:
        inside = rows.join(long.select("grp"), "grp", "left_semi")
        stored = inside.filter(F.col("size").isNotNull()).select(F.col("msg_id").alias("at"), "grp", "joined", "size")
        whole = blocks.fold_long(inside.filter(F.col("size").isNull()).select("msg_id", "grp", "joined"), stored, long, rules, base, timed)
        out = materialize(folded(rows.join(long.select("grp"), "grp", "left_anti").select(*rows.columns)).unionByName(whole), "mined")
    out = out.withColumn("instance", F.pmod("msg_id", F.lit(instances or 1)))
    counted = running(out, ["instance"], F.col("change_type") == CREATED)
    ids = counted.filter(F.col("change_type") == CREATED).select("instance", "grp", "local_id", (F.col("n") + base).alias("new_id"))
    final = counted.join(ids, ["instance", "grp", "local_id"], "left").withColumn("cluster_id", F.coalesce("new_id", "local_id"))
    live = F.least(F.col("n") + held, F.lit(config.max_clusters)) if config.max_clusters is not None else F.col("n") + held
    final = final.select("instance", "msg_id", "change_type", "cluster_id", "cluster_size", "template_mined", live.cast("long").alias("cluster_count"))
    return final if instances else final.drop("instance")


def clusters(mined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The model after all lines: cluster_id, template_tokens, size (per ``by``)."""
    last = mined.groupBy(*by, "cluster_id").agg(F.max_by("template_mined", "msg_id").alias("template"), F.max("cluster_size").alias("size"))
    split = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.split("template", " "))
    return last.select(*by, "cluster_id", split.alias("template_tokens"), "size")


def updated(model: DataFrame, mined: DataFrame) -> DataFrame:
    """``model`` after ``mined``, a run that took it up: touched clusters replaced, new ones added."""
    new = clusters(mined)
    return model.join(new, "cluster_id", "left_anti").select("cluster_id", "template_tokens", "size").unionByName(new)


def of_length(model: DataFrame, n: int) -> DataFrame:
    """Clusters whose template has ``n`` tokens."""
    return model.filter(F.size("template_tokens") == n)


def of_first_token(model: DataFrame, token: str) -> DataFrame:
    """Clusters whose template begins with a token ("" for empty templates)."""
    return model.filter(F.coalesce(F.get("template_tokens", F.lit(0)), F.lit("")) == token)


def pool_stats(mined: DataFrame) -> DataFrame:
    """Lines and clusters of each instance of a pool."""
    return mined.groupBy("instance").agg(F.count(F.lit(1)).alias("total_lines"), F.countDistinct("cluster_id").alias("cluster_count"))
