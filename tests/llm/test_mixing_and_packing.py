import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import mixing as X
from logloom.llm import packing as P


def test_targets():
    sizes = {"a": 10, "b": 1000, "c": 1, None: 0}
    weights = X.cycle_weights(list(sizes))
    assert weights == {"a": 1, "b": 2, "c": 3, None: 1}
    goal = X.targets(sizes, weights, 3)
    assert goal == {"a": 30.0, "b": 978.0, "c": 3.0, None: 0.0} and sum(goal.values()) == 1011
    assert X.targets({}, {}, 3) == {} and X.targets({"a": 0}, {"a": 1}, 3) == {"a": 0.0}


def test_route_is_a_cheapest_flow():
    """Against all flows of a small instance."""
    rng = random.Random(2)
    for _ in range(15):
        capacity = [rng.randint(1, 3) for _ in range(2)]
        members = [["s", "t"], rng.choice([["s"], ["t"], ["s", "t"]])]
        quota = {"s": rng.randint(0, 5), "t": rng.randint(0, 5)}
        sent = X.route(capacity, members, quota, 3)
        for s in quota:
            assert sum(to.get(s, 0) for to in sent) <= quota[s]

        def cost(used):
            return sum(sum(k // c + 1 for k in range(u)) for u, c in zip(used, capacity, strict=True))

        options = []
        for s0 in range(quota["s"] + 1):
            for t0 in range(quota["t"] + 1):
                for s1 in range(quota["s"] - s0 + 1) if "s" in members[1] else [0]:
                    for t1 in range(quota["t"] - t0 + 1) if "t" in members[1] else [0]:
                        used = (s0 + t0, s1 + t1)
                        if all(u <= 3 * c for u, c in zip(used, capacity, strict=True)):
                            options.append((-sum(used), cost(used)))
        used = [sum(to.values()) for to in sent]
        assert (-sum(used), cost(used)) == min(options)


def docs(spark, n=300, seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, "b", "x"), (0, "again here", "a", "x"), (None, "no id", "c", "y")], "doc_id long, text string, source string, size string").repartition(3)


def test_mix(spark):
    df = docs(spark)
    rows = X.by_source(df).collect()
    assert len(rows) == df.count()
    taken, size = Counter(), Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
    for r in rows:
        assert r["source_size"] == size[r["source"]] and taken[r["source"]] == int(r["target"])
    again = X.by_source(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert X.by_source(df.limit(0)).count() == 0
    copies = Counter(r["doc_id"] for r in X.repeat_rows(df).collect())
    assert max(copies.values()) <= 6 and X.repeat_rows(df).columns == df.columns


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(40)], "doc_id long, text string, of array<string>")
    taken, sources = X.mix(df, F.col("of"), weights={"a": 1, "b": 1})
    goal = {r["source"]: r["target"] for r in sources.collect()}
    assert goal == {"a": 200.0, "b": 200.0} and taken.agg(F.sum("taken")).first()[0] == 400
    by_kind = {r["n"]: r["t"] for r in taken.groupBy(F.size("members").alias("n")).agg(F.sum("taken").alias("t")).collect()}
    assert by_kind == {1: 200, 2: 200}  # all first passes before any second one
    with pytest.raises(ValueError):
        X.mix(df, F.col("of"), max_patterns=1)


def test_many_sources_in_closed_form(spark):
    """Beyond the patterns that the driver solves, one source a document gives the same mix."""
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30) if i % 7 else 90)), rng.choice(["a", "b", "c", "d", None, "Ä", "z1", "z2"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in (None, {"a": 5, "b": 1, "c": 1, "d": 9, None: 2, "Ä": 1, "z1": 1, "z2": 40}):
        few, many = (sorted(map(tuple, X.by_source(df, weights=weights, max_patterns=m).collect())) for m in (100, 2))
        assert few == many
    repeated = [sorted(map(str, X.repeat_rows(df, max_patterns=m).collect())) for m in (100, 2)]
    assert repeated[0] == repeated[1]


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 60, 1024])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.choice([1, 7, 400])))
    out = P.plan(counts, capacity)
    got = Counter()
    for lengths, times in out:
        assert sum(lengths) <= capacity and times > 0
        for x in lengths:
            got[x] += times
    assert got == counts
    assert sum(t for _, t in out) >= -(-sum(k * v for k, v in counts.items()) // capacity)


def optimum(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(9)
    for _ in range(40):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        left = Counter(items)
        fixed = sum(t for _, t in P.reduce_instance(left, 20))
        assert fixed + optimum(sorted(left.elements(), reverse=True), 20) == optimum(items, 20), items


def test_plan_against_the_optimum():
    rng = random.Random(4)
    extra = []
    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        extra.append(sum(t for _, t in P.plan(Counter(items), 20)) - optimum(items, 20))
    assert min(extra) == 0 and max(extra) <= 1 and extra.count(0) >= 140


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "x" + " " * 1_000_000 + "y", "\t \n" * 400_000])
def test_very_long_runs(text):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    got = P.token_ids(text, str(public.path("byte_bpe_50k.json")), str(public.path("byte_bpe_50k.tiktoken")), 2)
    assert got.tolist() == Tokenizer.from_file(str(public.path("byte_bpe_50k.json"))).encode(text, add_special_tokens=False).ids + [2]


def test_pack_numbers_plain_pieces(spark):
    pieces = spark.range(500).selectExpr("id as doc_id", "id % 7 + 1 as length").repartition(5)
    for broadcast_rows in (100, 0):
        out = P.pack(pieces, 8, broadcast_rows).collect()
        assert sorted(r["doc_id"] for r in out) == list(range(500)) and len({(r["sequence_id"], r["offset"]) for r in out}) == 500
        places = defaultdict(list)
        for r in out:
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert all(o == sum(n for _, n in sorted(own)[:i]) for own in places.values() for i, (o, _) in enumerate(sorted(own)))


def test_cuts():
    assert P.cuts(5, 4) == [(0, 1), (1, 4)] and P.cuts(4, 4) == [(0, 4)] and P.cuts(8, 4) == [(0, 4), (4, 4)] and P.cuts(1, 4) == [(0, 1)]


def test_packed_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(1, "Hello world, this is text."), (2, None), (3, ""), (4, "ab " * 3000), (5, "x<|endoftext|>y"), (6, "ünïcode \U0001f600   spaces\n\n\tend  "), (6, "same id"), (6, "same id"), (7, "don't 123 ..."), (8, "​﻿   é")]
    df = spark.createDataFrame(rows * 3, "doc_id long, text string")
    out = P.pack_documents(df, keep_ids=True).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, t in rows * 3:
        ids = np.array(exact.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        for piece, (a, n) in enumerate(P.cuts(len(ids), 1024)):
            expected[(i, piece, a, n, zlib.crc32(ids[a : a + n].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in out)
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert P.pack_documents(df.limit(0)).count() == 0
