"""The fold in blocks against a serial fold."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.config import MinerConfig
from logloom.operators import blocks as bl
from logloom.operators import mine as mi
from logloom.operators.kernel import Rules, Tree

LINES = "msg_id long, line string"


def serial(lines, config, model=()):
    tree = Tree(Rules.of(config))
    for cluster, tokens, size in model:
        tree.load(cluster, tokens, size)
    out = []
    for msg_id, line in sorted(lines):
        cluster, change = tree.add(line.split())
        template, size = tree.clusters[cluster]
        out.append((msg_id, cluster, change, size, " ".join(template)))
    return out


def mined(df, config, **params):
    return sorted((r["msg_id"], r["cluster_id"], r["change_type"], r["cluster_size"], r["template_mined"]) for r in mi.mine(df, config, **params).collect())


def dated(seed, n, kinds=6):
    """Lines of one length that begin with a date, so that they share one leaf of the tree."""
    rng = random.Random(seed)
    verbs = [f"verb{chr(97 + i)}" for i in range(kinds)]
    out = []
    for i in range(n):
        own = verbs[: 1 + i * kinds // n]  # new kinds keep coming
        out.append((i * 3 + 1, f"2024-01-{i % 28:02d} {rng.choice(own)} {rng.choice(['by', 'for'])} u{rng.randrange(9)} end{rng.choice('xy')}"))
    return out


@pytest.mark.parametrize("seed,settings", [(0, {}), (2, {"depth": 6, "max_children": 3}), (3, {"engine": "jaccard", "sim_th": 0.5}), (4, {"affix_preserving": True, "sim_th": 0.6})])
def test_blocks_equal_a_serial_run(spark, seed, settings):
    config = MinerConfig(**settings)
    lines = dated(seed, 500)
    df = spark.createDataFrame(lines, LINES).repartition(3)
    assert mined(df, config, block_rows=40) == serial(lines, config)


def test_blocks_take_a_model_up(spark):
    config = MinerConfig(sim_th=0.6)
    lines = dated(7, 700)
    model = [(3, ("2024-01-01", "verba", "by", "<*>", "endx"), 10), (4, ("other", "words"), 5), (9, ("2024-01-02", "verbz", "for", "u1", "endy"), 2)]
    df = spark.createDataFrame(lines, LINES)
    held = spark.createDataFrame([(c, list(t), n) for c, t, n in model], "cluster_id long, template_tokens array<string>, size long")
    assert mined(df, config, model=held, block_rows=50) == serial(lines, config, model)


def test_long_and_short_groups_and_pools(spark):
    config = MinerConfig()
    lines = dated(5, 400) + [(i * 3 + 2, f"short line {i % 3}") for i in range(90)] + [(i * 3 + 3, "") for i in range(5)]
    df = spark.createDataFrame(lines, LINES)
    assert mined(df, config, block_rows=70) == serial(lines, config)
    pooled = mi.mine(df, config, instances=2, block_rows=40).collect()
    for k in (0, 1):
        own = sorted((r["msg_id"], r["cluster_id"], r["change_type"], r["cluster_size"], r["template_mined"]) for r in pooled if r["instance"] == k)
        assert own == serial([x for x in lines if x[0] % 2 == k], config)


def test_a_template_that_loosens_in_each_block(spark):
    """Each block changes what the next one meets: broken guesses are folded again."""
    lines = [(i, f"1 keep {' '.join(('x' if i < 40 * k else 'y') + str(k) for k in range(1, 9))} end") for i in range(400)]
    config = MinerConfig(sim_th=0.3)
    assert mined(spark.createDataFrame(lines, LINES), config, block_rows=40) == serial(lines, config)


def test_cuts_make_blocks_of_like_size(spark):
    df = spark.createDataFrame([(i * i, "a") for i in range(5000)] + [(i, "b") for i in range(50)], "msg_id long, grp string")
    found = {r["grp"]: r["cuts"] for r in bl.long_groups(df, 500).collect()}
    assert set(found) == {"a"} and len(found["a"]) == 9
    sizes = df.filter("grp = 'a'").groupBy(bl._block(F.col("msg_id"), F.array(*map(F.lit, found["a"])))).count().collect()
    assert max(r["count"] for r in sizes) < 700


@pytest.mark.parametrize("seed,bound,settings", [(0, 3, {}), (2, 25, {"sim_th": 0.9, "depth": 5, "max_children": 4}), (3, 4, {"engine": "jaccard"}), (5, 500, {})])
def test_a_bound_over_all_lines(spark, seed, bound, settings):
    """Eviction by the order of all lines, whatever their lengths, in blocks."""
    rng = random.Random(seed)
    config = MinerConfig(max_clusters=bound, **settings)
    words = ["run", "stop", "wait", "7", "go12", "end"]
    lines = [(i, " ".join(rng.choice(words[: 2 + i % 5]) for _ in range(rng.choice([0, 1, 3, 3, 4, 5])))) for i in range(500)]
    assert mined(spark.createDataFrame(lines, LINES).repartition(3), config, block_rows=40) == serial(lines, config)


def test_a_bound_with_a_model(spark):
    rng = random.Random(8)
    config = MinerConfig(max_clusters=5, sim_th=0.8)
    model = [(2, ("a", "b", "c"), 4), (5, ("x", "<*>", "z"), 9), (6, ("only",), 1)]
    held = spark.createDataFrame([(c, list(t), n) for c, t, n in model], "cluster_id long, template_tokens array<string>, size long")
    lines = [(i, " ".join(rng.choice("abcxyz") for _ in range(3))) for i in range(400)]
    assert mined(spark.createDataFrame(lines, LINES), config, model=held, block_rows=40) == serial(lines, config, model)


def test_trees_are_as_large_as_the_bound(spark, monkeypatch):
    """Clusters that are gone are not handed on from block to block."""
    written = {}

    def counted(df, label, write=bl.materialize):
        out = write(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(bl, "materialize", counted)
    config = MinerConfig(max_clusters=2, sim_th=0.9)
    lines = [(i, f"go {'abc'[i % 3]} u{i} w{i} end") for i in range(1000)]  # every line makes a cluster
    assert mined(spark.createDataFrame(lines, LINES), config, block_rows=50) == serial(lines, config)
    assert max(n for label, n in written.items() if label not in ("blocks-lines", "blocks-folded")) < 20 * 10


def _written(monkeypatch):
    """Labels of the tables that the fold in blocks writes."""
    labels = []
    monkeypatch.setattr(bl, "materialize", lambda df, label, write=bl.materialize: (labels.append(label), write(df, label))[1])
    return labels


@pytest.mark.parametrize("seed,bound", [(0, 1), (1, 3)])
def test_blocks_that_forget_need_no_pass_over_all_lines(spark, monkeypatch, seed, bound):
    """Nearly every line makes a cluster: blocks hand their ends on, nodes of rare tokens too, and no task sees all lines."""
    rng, labels = random.Random(seed), _written(monkeypatch)
    config = MinerConfig(max_clusters=bound, depth=5, max_children=8)
    lines = [(i, f"event {rng.choice('abcde')} user {rng.randrange(50)} value {rng.randrange(9)}") for i in range(1000)]
    lines[30] = 30, "rare first words of six tokens"
    lines[31] = 31, "other words"
    lines[520] = 520, "seldom 7 words of six tokens"
    assert mined(spark.createDataFrame(lines, LINES), config, block_rows=100) == serial(lines, config)
    assert "blocks-found" not in labels


def test_blocks_that_clusters_outlive_take_the_short_pass(spark, monkeypatch):
    rng, labels = random.Random(3), _written(monkeypatch)
    config = MinerConfig(max_clusters=8, depth=5)
    lines = [(i, f"event {'abcdefg'[rng.randrange(1 + i * 7 // 1000)]} user {rng.randrange(50)} value {rng.randrange(9)}") for i in range(1000)]
    assert mined(spark.createDataFrame(lines, LINES), config, block_rows=100) == serial(lines, config)
    assert labels.count("blocks-found") in (1, 2, 3)


def test_a_bound_where_no_join_is_broadcast(spark, monkeypatch):
    """Trees and lines of a block meet in one task however the joins before are done."""
    rng, labels = random.Random(4), _written(monkeypatch)
    config = MinerConfig(max_clusters=2, depth=5)
    lines = [(i, f"event {rng.choice('abc')} user {rng.randrange(50)} value {rng.randrange(9)}") for i in range(1000)]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert mined(spark.createDataFrame(lines, LINES), config, block_rows=100) == serial(lines, config)
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert "blocks-found" not in labels
