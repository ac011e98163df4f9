import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from logloom.llm import exact_dedup as E
from logloom.llm import line_dedup as L

DOCS = "doc_id long, text string, key string, norm string, h1 long, hits string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "k", "n", 1, "h") for i, t in rows], DOCS).repartition(3)


@pytest.mark.parametrize("params", [{}, {"bucket_capacity": 3, "broadcast_keys": 0, "broadcast_slots": 0}, {"hot_rows": 2}])
def test_exact(spark, params):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "a\t b", "a  b ", " a b", "x", "", None, "é\n\nz", "é z", "long " * 3000])) for i in range(80)]
    rows += [(79, rows[79][1]), (None, "x"), (None, "only here")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in E.exact_dedup(frame(spark, rows), **params).collect()), key=str)
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = sorted(((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)
    assert got == expected
    assert E.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def test_directory_splits_overfull_cells_only(spark):
    # 40 keys share their first five bits, the rest are spread.
    keys = spark.range(40).selectExpr("shiftright(xxhash64(id), 5) & 576460752303423487L as key").union(spark.range(1000, 1030).selectExpr("xxhash64(id)"))
    keys = E.materialize(keys.distinct(), "test-keys")
    buckets = E.directory(keys, 20)
    rows = sorted((r["slot"] << (64 - r["depth"]), r["depth"]) for r in buckets.collect())
    assert len({d for _, d in rows}) > 1 and rows[0][0] == 0
    # Ranges of keys, without gaps: each begins where the one before it ends.
    assert all(a + (1 << (64 - d)) == b for (a, d), (b, _) in zip(rows, rows[1:]))
    placed = E.with_bucket(keys, buckets, 10**6).groupBy("bucket").count().collect()
    assert sum(r["count"] for r in placed) == keys.count() and max(r["count"] for r in placed) <= 20
    again = E.with_bucket(keys, buckets, 0).groupBy("bucket").count().collect()
    assert sorted(map(tuple, placed)) == sorted(map(tuple, again))
    assert E.directory(keys.limit(0), 20).count() == 1


def brute_lines(rows, min_chars=40, min_docs=5):
    keys = defaultdict(set)
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for n, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                keys[key(line)].add((n, i))
    last = {k: max((-(2**63) if i is None else i) for _, i in own) for k, own in keys.items() if len({i for _, i in own}) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if last.get(key(s), i) == i or (i is None and last.get(key(s)) == -(2**63)) or key(s) not in last]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(5)
    pool = [f"This is shared line number {k} with é and plenty of text in it" for k in range(6)] + ["ÀÉ" * 25, "short", "", "x" * 39, "x" * 40]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 6))] + [f"own line {i} that nobody else has, long enough to count"]
        rows.append((i, "\n".join(f" {s.upper()}\t" if rng.random() < 0.2 and s.isascii() else s for s in lines)))
    return rows + [(100, None), (101, ""), (None, pool[0]), (102, "w" * 200_000), (5, rows[5][1])] + [(i, "a line of three documents in five rows, and long enough") for i in (201, 201, 201, 202, 203)]


@pytest.mark.parametrize("params", [{}, {"broadcast_bytes": 0, "task_keys": 9}, {"shard_keys": 2}, {"shard_keys": 2, "broadcast_bytes": 0}])
def test_lines(spark, params):
    rows = line_rows()
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in L.line_dedup(frame(spark, rows), **params).collect()), key=str)
    assert got == brute_lines(rows)
    applied = L.apply(frame(spark, rows), **params)
    assert applied.columns == frame(spark, rows).columns and applied.count() == len(rows)
    assert L.line_dedup(frame(spark, rows).limit(0), **params).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    h = L.PerfectHash(keys)
    at = h(keys)
    assert h.placed + len(h.rest) == len(keys) and sorted(at[at >= 0]) == list(range(h.placed))
    other = np.setdiff1d(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64), keys)
    shard = L.Shard(keys, keys + np.uint64(1), np.ones(len(keys), np.int64), np.arange(len(keys)))
    known, keeper = shard.probe(keys, keys + np.uint64(1))
    assert known.all() and (keeper == np.arange(len(keys))).all() and not shard.probe(other, other)[0].any()
    twice = L.Shard(np.array([7, 7], np.uint64), np.array([1, 2], np.uint64), np.array([5, 6]), np.array([10, 20]))
    known, keeper = twice.probe(np.array([7, 7, 7], np.uint64), np.array([2, 1, 3], np.uint64))
    assert known.tolist() == [True, True, False] and keeper.tolist()[:2] == [20, 10]
