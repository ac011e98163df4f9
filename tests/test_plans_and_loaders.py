"""Plans that stay small, loaders of real files, and look-ups by index."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.config import MinerConfig
from logloom.functions import masking as M
from logloom.functions import tokens as K
from logloom.operators import evaluate as ev
from logloom.operators import extract as ex
from logloom.operators import match as mt
from logloom.operators.kernel import Rules, Tree
from logloom.sources import lines as src

ARRAYS = "id long, tokens array<string>"


def test_each_mask_is_one_replacement(spark):
    lines = spark.createDataFrame([(1, "a")], "msg_id long, line string")
    for masks in (M.DEFAULT, M.EXTENDED, M.EXTENDED * 2):
        plan = lines.select(K.tokenize(M.mask(F.col("line"), masks)).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") == len(masks) + 1 and len(plan) < 3_000 * len(masks)


def test_mails_by_the_linear_search(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", ".", "-", "@", "co", " ", "_", "7", "é", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["a@b.com.x@c.org", ".x@c.org", "a@b.co@d.com", "x" * 200 + "@y.org", "a.b@c.de,d@e.fr"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").repartition(2)
    plain = M.Mask(M.EMAIL.pattern, "EMAIL")
    bad = df.select("t", M.mask(F.col("t"), [M.EMAIL]).alias("a"), M.mask(F.col("t"), [plain]).alias("b")).filter("a <> b").collect()
    assert bad == []
    long = spark.createDataFrame([("." * 200_000 + "a" * 200_000,)], "t string")
    assert long.select(F.length(M.mask(F.col("t"), [M.EMAIL]))).first()[0] == 400_000


def test_fields_by_expressions_equal_the_function(spark):
    rng = random.Random(9)
    lines = ["".join(rng.choice('a" ,\tb') for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ['x,"' + "long " * 40_000 + '",y', '"never closed, at all', ""]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string").repartition(2)
    for r in df.select("line", src.csv_fields(F.col("line")).alias("f")).collect():
        assert r["f"] == src.split_csv_line(r["line"]), r["line"]


def test_headers_with_blanks_and_quotes_and_several_files(spark, tmp_path):
    (tmp_path / "b_structured.csv").write_text('LineId, "Content" , EventTemplate\n1,"made, of parts",T <*>\n\n2,plain,"T, two"\n')
    (tmp_path / "a_structured.csv").write_text("﻿LineId, Content, EventTemplate\n1,first file,A\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("LineId,Content,EventTemplate\n9,other,B\n")
    rows = sorted(tuple(r) for r in src.read_structured(spark, str(tmp_path / "b_structured.csv")).collect())
    assert rows == [(1, "made, of parts", "T <*>"), (2, "plain", "T, two")]
    assert [tuple(r) for r in src.read_structured_dir(spark, str(tmp_path)).collect()] == [(1, "first file", "A")]
    assert src.read_structured(spark, str(tmp_path / "[ab]_structured.csv")).count() == 3
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        src.read_structured_dir(spark, str(tmp_path / "none"))


def model_of(seed, n):
    rng = random.Random(seed)
    return [(i + 1, [rng.choice([f"k{rng.randrange(n)}", "a", "b", "<*>"]) for _ in range(rng.choice([0, 2, 4, 5]))], 1) for i in range(n)]


@pytest.mark.parametrize("seed,n,broadcast", [(0, 40, 100_000), (1, 300, 0)])
def test_always_finds_by_index_what_all_pairs_find(spark, seed, n, broadcast):
    rng = random.Random(seed)
    model = model_of(seed, n)
    lines = []
    for i in range(600):
        tokens = [t if t != "<*>" else f"v{rng.randrange(5)}" for t in rng.choice(model)[1]]
        if tokens and rng.random() < 0.2:
            tokens[rng.randrange(len(tokens))] = "odd"
        lines.append((i, " ".join(tokens)))
    tree = Tree(Rules.of(MinerConfig()))
    for cluster, tokens, size in model:
        tree.load(cluster, tokens, size)
    lines = [(i, x) for i, x in lines if x]
    df = spark.createDataFrame(lines, "msg_id long, line string").repartition(3)
    known = spark.createDataFrame(model, "cluster_id long, template_tokens array<string>, size long")
    got = {r["msg_id"]: r["cluster_id"] for r in mt.match(df, known, MinerConfig(), "always", broadcast_clusters=broadcast).collect()}
    assert got == {i: tree.match(x.split(), "always") for i, x in lines}
    rows = df.select("msg_id", F.split("line", " ").alias("t")).withColumn("key", K.root_key(F.col("t")))
    entries = known.select("cluster_id", F.col("template_tokens").alias("tpl"), K.root_key(F.col("template_tokens")).alias("key"))
    compared = mt.met(rows, mt.indexed(entries, "<*>")).count()
    of_one_key = rows.join(entries, "key").count()
    assert compared < (0.5 if n == 40 else 0.2) * of_one_key


def test_template_overlap_equals_all_pairs(spark):
    rng = random.Random(6)
    make = lambda: [rng.choice(["a", "b", "c", "<*>", "<NUM>"]) for _ in range(rng.choice([0, 1, 3, 4]))]
    own, shown = [(i, make()) for i in range(40)], [(i, make()) for i in range(15)]
    loose = lambda t: "<>" if t.startswith("<") and t.endswith(">") else t
    want = {i: max([sum(loose(x) == loose(y) for x, y in zip(a, b, strict=True)) for _, b in shown if len(b) == len(a)], default=0) for i, a in own}
    got = ev._best_overlap(spark.createDataFrame(own, "template_id long, a array<string>"), spark.createDataFrame(shown, "id long, b array<string>").select("b"))
    assert {r["template_id"]: r["hit"] for r in got.collect()} == want


def test_parameters_by_a_table_function(spark):
    ex.register(spark, MinerConfig(masks=(M.NUM,)))
    rows = [(1, "job <*> took <NUM>", "job copy took 12"), (2, "job <*>", "other"), (3, None, "x"), (4, "no parameters", "no parameters")]
    df = spark.createDataFrame(rows, "id long, template string, line string")
    got = spark.sql("SELECT d.id, p.* FROM {d} d, LATERAL extract_parameters(d.template, d.line) p ORDER BY id, place", d=df).collect()
    assert [tuple(r) for r in got] == [(1, 0, "copy", "*"), (1, 1, "12", "NUM")]
    with pytest.raises(Exception, match="template and a line"):
        spark.sql("SELECT * FROM extract_parameters(1, 'x')").collect()
