"""Every stage of the pipeline against a plain version, on the smallest tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from logloom.llm import near_dedup, quality
from logloom.llm.queries import ORACLES, QUERIES

from .test_dedup_and_lines import brute_lines
from .test_near_dedup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in C.STAGES:
        f(spark, out[-1], SF).write.parquet(str(base / name))
        out.append(spark.read.parquet(str(base / name)))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in C.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(sorted(d.columns) == sorted(stages[0].columns) for d in stages[:5])
    assert [d.count() > 0 for d in stages] == [True] * 6


def test_quality_stage(spark, stages):
    docs, kept = stages[:2]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    expected = {r["doc_id"] for r in quality.score(docs, model).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == expected
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {i for i, q in labels.items() if q == 1}
    assert len(good & expected) >= 0.97 * len(good)


def test_line_stage(stages):
    before, after = stages[1:3]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    kept = {i: n - d for i, n, d, _ in brute_lines(rows)}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
    assert set(got) == set(kept) and all(n == len(t) for t, n in got.values())
    dropped = {i: d for i, _, d, _ in brute_lines(rows)}
    for i, t in rows:
        assert dropped[i] or got[i][0] == t


def test_near_stage(stages):
    before, after = stages[2:4]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    kept = {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in after.collect()} == kept


def test_mixing_stage(stages):
    before, after = stages[3:5]
    size = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in before.collect()}
    copies = Counter(r["doc_id"] for r in after.collect())
    assert max(copies.values()) <= 3 and set(copies) <= set(size)
    taken, longest = Counter(), Counter()
    for i, (s, n) in size.items():
        taken[s] += n * copies[i]
        longest[s] = max(longest[s], n)
    from logloom.llm import mixing

    whole = Counter()
    for s, n in size.values():
        whole[s] += n
    goal = mixing.targets(dict(whole), mixing.cycle_weights(list(whole)), 3)
    assert all(abs(taken[s] - goal[s]) <= longest[s] for s in whole)


def test_packing_stage(stages):
    before, after = stages[4:6]
    assert Counter(r["doc_id"] for r in after.filter("piece = 0").collect()) == Counter(r["doc_id"] for r in before.collect())
    full = after.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.agg(F.max("n")).first()[0] <= 1024
    least = after.agg(F.sum("length")).first()[0] / 1024
    assert full.count() <= 1.05 * least + 1


def test_run_agrees(spark, stages):
    out = C.run(spark, SF)
    assert out.count() == stages[-1].count() and C.ORACLE_SQL is None


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_keep_one_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "q"), (2, "a b c d e f", "q"), (None, "z", "q")], "doc_id long, text string, kept string")
    out = near_dedup.keep_one(df)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "None"]


def test_stages_take_nulls_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id at all", "en", "src0", 12), (10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0), (10**6 + 2, "é " * 20_000, None, "src1", 1), (10**6 + 3, "twice the same row", "en", "src1", 1)] * 2, docs.schema)
    for k, start in enumerate((docs.limit(40).unionByName(odd), docs.limit(0))):
        now = start.withColumns({"_score": F.lit(1), "size": F.lit("s"), "pattern": F.lit(2)})
        for name, stage in C.STAGES:
            stage(spark, now, SF).write.parquet(str(tmp_path / f"{k}-{name}"))
            now = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
            if name != "packing":
                assert {"_score", "size", "pattern"} <= set(now.columns)
        assert (now.count() > 0) == (k == 0)
