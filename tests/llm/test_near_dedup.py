import itertools
import random

import numpy as np
import pytest

from logloom.llm import near_dedup as N
from logloom.llm.components import components


def brute(rows, words, percent):
    """Component of each id, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        tokens = (t or "").encode().lower().decode().split()
        w = min(words, len(tokens))
        sets[i] = {tuple(tokens[k : k + w]) for k in range(len(tokens) - w + 1)} if tokens else set()
    comp = {i: i for i, _ in rows}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(rng, size, length, edits, vocabulary):
    base = [rng.choice(vocabulary) for _ in range(length)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed,words,params", [(0, 2, {}), (1, 2, {"list_cost": 0.05, "salt_size": 8}), (2, 5, {"list_cost": 0.0, "broadcast_ids": 0, "k": 16})])
def test_matches_brute_force(spark, seed, words, params):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for size, length, edits in [(40, 60, 5), (25, 12, 2), (12, 200, 12), (6, 3, 1), (30, 40, 8)]:
        texts += family(rng, size, length, edits, vocabulary)
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    texts += texts[:15] + ["", None, "one", "One", "one two", "\t\n "]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_classes(df, words=words, **params).collect()}
    assert got == brute(rows, words, 80)


def test_edge_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "y"), (None, "a b c", "z"), (3, "A b C", "z"), (4, "é" * 20000 + " " + "long " * 5000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    out = [(r["doc_id"], r["component_id"], r["kept"]) for r in N.near_classes(df, words=2).collect()]
    assert sorted(x for x in out if x[0] is not None) == [(1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False), (4, 4, True)]
    assert [x[2] for x in out if x[0] is None] == [False] or [x[1] for x in out if x[0] is None] == [1]
    kept = N.keep_one(df, words=2)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 2, 4]
    assert N.near_classes(df.limit(0), words=2).count() == 0


def test_repeated_ids_with_several_texts(spark):
    a, b = " ".join(f"p{i}" for i in range(50)), " ".join(f"q{i}" for i in range(50))
    df = spark.createDataFrame([(5, a), (5, b), (2, a + " tail"), (9, b + " tail")], "doc_id long, text string")
    assert {r["component_id"] for r in N.near_classes(df, words=2).collect()} == {2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 300), (300, 200), (7, 7)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[100] == out[200] == out[300] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_on_a_sorted_chain(spark, monkeypatch):
    import logloom.llm.components as module

    written = []
    monkeypatch.setattr(module, "materialize", lambda df, label: (written.append(label), N.materialize(df, label))[1])
    edges = spark.range(1000).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in components(edges).select("component").distinct().collect()} == {0}
    assert written.count("cc-points") <= 20


def test_large_group_below_the_threshold(spark):
    """Copies of a text that all differ too much from each other meet in few pairs."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(1, " ".join(base))]
    for i in range(2, 302):
        words = list(base)
        for at in rng.sample(range(120), 2 if i % 3 else 9):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_classes(df, words=2).collect()}
    assert got == brute(rows, 2, 80) and sum(i == c for i, (_, c) in got.items()) > 90
    texts = df.select(N.F.col("doc_id").alias("doc"), N.F.col("text").cast("binary").alias("text"))
    hot = df.select(N.F.col("doc_id").alias("doc"), N.F.when(N.F.col("doc_id") % 3 == 0, N.F.col("doc_id")).otherwise(1).alias("comp"))
    assert N._refined(N._placed(hot, texts, 2, 80, 1000), hot, 80).count() < 1000  # of 25,000


def test_central_members_merge_a_group(spark):
    """Few random pairs of a group are linked, but most of its members are linked with central ones."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in rng.sample(range(100), 1 if i % 40 == 7 else rng.randint(2, 4)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = df.select(N.F.col("doc_id").alias("doc"), N.F.col("text").cast("binary").alias("text"))
    alone = df.select(N.F.col("doc_id").alias("doc"), N.F.col("doc_id").alias("comp"))
    placed = N._placed(alone, texts, 2, 80, 1000)
    everything, central = (set(map(tuple, N._refined(placed, alone, 80, c).collect())) for c in (0, 4))
    assert central <= everything and 0 < len(central) < len(everything) / 4
    ends = N._merged(alone, spark.createDataFrame(sorted(central), "a long, b long")).collect()
    assert len(ends) == 240 and len({r["comp"] for r in ends}) < 80
    want = brute(rows, 2, 80)
    for centres in (0, 4):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_classes(df, words=2, list_cost=0.0, centres=centres).collect()}
        assert got == want


@pytest.mark.parametrize("k,percent,short_list", [(32, 80, 1), (32, 80, 4), (16, 50, 1), (256, 60, 2)])
def test_split_lists_hold_every_linked_pair(spark, k, percent, short_list):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(25)]
    texts = [t for size, length in [(30, 3), (30, 5), (30, 9), (30, 15), (40, 40)] for t in family(rng, size, length, length // 6 + 1, vocabulary)]
    sets = {i: N.shingle_set(t.encode(), 2) for i, t in enumerate(texts)}
    linked = {(a, b) for a, b in itertools.combinations(sets, 2) if 0 < (100 + percent) * len(np.intersect1d(sets[a], sets[b])) >= percent * (len(sets[a]) + len(sets[b]))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text", N.F.col("text").cast("binary"))
    reps = df.mapInArrow(N._sketches(2, k, percent), "doc long, n long, gid binary, sketch binary, listed int")
    split = N._split(N._listed(reps).withColumn("comp", N.F.col("doc")), short_list).select("value", "doc").distinct().cache()
    met = split.join(split.toDF("value", "b"), "value").filter("doc < b").select("doc", "b").distinct()
    assert len(linked) > 100 and linked <= set(map(tuple, met.collect()))


def test_lists_that_grow_with_unrelated_texts(spark, monkeypatch):
    """Texts of common shingles meet on two of them, so their pairs do not grow with the lists."""
    rng = random.Random(3)
    docs = [[f"w{rng.randrange(268)}" for _ in range(600)] for _ in range(2400)]
    for i in range(0, 80, 2):
        docs[i + 1] = list(docs[i])
        for at in rng.sample(range(600), 10):
            docs[i + 1][at] = "other"
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(4)
    asked, verified = [], N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *more: (asked.append(pairs.count()), verified(pairs, *more))[1])
    got = {r["doc_id"]: r["component_id"] for r in N.near_classes(df, words=2).collect()}
    assert got == {i: i - 1 if i < 80 and i % 2 else i for i in range(2400)}
    assert asked[-1] < 20 * len(docs)


def test_exact_check_in_parts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(60) if j != i)) for i in range(40)]
    texts = spark.createDataFrame(rows, "doc long, text string").withColumn("text", N.F.col("text").cast("binary"))
    reps = texts.withColumnRenamed("doc", "doc_id").mapInArrow(N._sketches(2, 32, 80), "doc_id long, n long, gid binary, sketch binary, listed int").withColumnRenamed("doc_id", "doc")
    pairs = spark.range(1, 40).selectExpr("0L as a", "id as b")
    assert {tuple(r) for r in N._verified(pairs, reps, texts, 2, 32, 80, 0, head_rows=7).collect()} == {(0, i) for i in range(1, 40)}


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2**64 - 1, 120, dtype=np.uint64)
        a, b = (np.unique(pool[rng.random(120) < rng.random()]) for _ in range(2))
        bits = sum(int(x).bit_count() for x in (N.signature(a) ^ N.signature(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_bounds_and_union():
    assert N.tail_bound(32, 0.8) >= 8
    assert N.prefix_length(10, 32, 80) == 3 and N.prefix_length(1, 32, 80) == 1
    x, y = np.array([1, 2, 5, 9], np.uint64), np.array([2, 5, 7], np.uint64)
    shared, size, union = N.union_overlaps([x.tobytes()], [y.tobytes()], 4)
    assert (shared[0], size[0], union[0]) == (2, 4, 5)
