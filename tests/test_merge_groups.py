"""Merging over lengths in groups against one sweep over all clusters."""

import random

import pytest

from logloom.operators import merge as mg
from logloom.operators.connected import connected

MODEL = "cluster_id long, template_tokens array<string>, size long"


def whole(model, strategies):
    """The sweep of all clusters in one group."""
    import pandas as pd

    out = mg._sweeps(strategies, 10)(pd.DataFrame(model, columns=["cluster_id", "template_tokens", "size"]))
    merged = sorted((int(r.cluster_id), tuple(r.template_tokens), int(r.size)) for r in out.itertuples() if r.size == r.size and r.size is not None)
    moved = sorted((int(r.old_id), int(r.cluster_id)) for r in out.itertuples() if r.old_id == r.old_id and r.old_id is not None)
    return merged, moved


def models(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(14)] + ["<*>"] * (seed % 3)
    return [(i + 1, [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 6]))], rng.randint(1, 5)) for i in range(n)]


@pytest.mark.parametrize("seed,least", [(0, (2,)), (1, (2,)), (2, (3,)), (5, (3, 2))])
def test_groups_equal_one_sweep(spark, seed, least):
    rows = models(seed, 120)
    strategies = [mg.shared_affix(k) for k in least]
    merged, moved = mg.merge(spark.createDataFrame(rows, MODEL).repartition(3), strategies, by_length=False)
    want_merged, want_moved = whole(rows, strategies)
    assert sorted((r["cluster_id"], tuple(r["template_tokens"]), r["size"]) for r in merged.collect()) == want_merged
    assert sorted(tuple(r) for r in moved.collect()) == want_moved


def test_a_merged_template_that_meets_another_group(spark):
    # 1 and 2 meet at their ends; only what they become agrees with 3 at the beginning.
    rows = [(1, ["a", "b", "x", "y"], 1), (2, ["c", "b", "x", "y"], 1), (3, ["d", "b", "q"], 1), (4, ["u", "v", "w"], 1)]
    strategies = [mg.shared_affix(2)]
    merged, moved = mg.merge(spark.createDataFrame(rows, MODEL), strategies, by_length=False)
    want_merged, want_moved = whole(rows, strategies)
    assert sorted((r["cluster_id"], tuple(r["template_tokens"]), r["size"]) for r in merged.collect()) == want_merged
    assert sorted(tuple(r) for r in moved.collect()) == want_moved and len(want_merged) == 2


def test_groups_are_small(spark):
    rows = [(i + 1, [f"job{i // 3}", "did", f"v{i}", "well"][: 3 + i % 2], 1) for i in range(300)]
    links = mg._links(spark.createDataFrame(rows, MODEL).withColumnRenamed("cluster_id", "part"), [mg.shared_affix(2)], 256)
    sizes = [r["count"] for r in connected(links).groupBy("part").count().collect()]
    assert max(sizes) == 3 and mg._links(spark.createDataFrame(models(2, 60), MODEL).withColumnRenamed("cluster_id", "part"), [mg.shared_affix(3)], 2) is None


def test_connected_parts(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 201), (300, 100), (100, 300), (7, 7)]
    got = {r["node"]: r["part"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 200, 201: 200, 300: 100, 100: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
