"""Spark operators against goldens and against a serial run of the fold."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from logloom.config import MinerConfig
from logloom.functions import masking as M
from logloom.functions import normalize as N
from logloom.functions import similarity as S
from logloom.functions import template as T
from logloom.functions import tokens as K
from logloom.operators import evaluate as ev
from logloom.operators import extract as ex
from logloom.operators import match as mt
from logloom.operators import merge as mg
from logloom.operators import mine as mi
from logloom.operators.kernel import CREATED, Rules, Tree
from logloom.profiler import NullProfiler, Profiler
from logloom.sources import lines as src
from logloom.sources import model as md
from logloom.streaming import mine_stream as ms

LINES = "msg_id long, line string"


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("masks,text,expected", [
    ([M.IP], "rev7.7.7.7-rc 10.20.30.40", "rev7.7.7.7-rc <IP>"),
    ([M.NUM], "at -12 or +7 but x9", "at <NUM> or <NUM> but x9"),
    ([M.HEX], "mem 0XfE09 0xzz", "mem <HEX> 0xzz"),
    ([M.UUID], "job 0f0e0d0c-1111-2222-3333-aabbccddeeff done", "job <UUID> done"),
    ([M.EMAIL], "mail ops.team@north.example.org now", "mail <EMAIL> now"),
    ([M.HOST_PORT, M.NUM], "to mx.north.example:2525 took 31 ms", "to <HOST_PORT> took <NUM> ms"),
    ([M.IP, M.HOST_PORT, M.NUM], "10.0.9.8:99 up", "<IP>:<NUM> up"),
    (M.EXTENDED, "lost blk_-4400112233", "lost blk_<NUM>"),
    (M.EXTENDED, "READ /srv/data/list.txt ok", "READ /srv<PATH> ok"),
    (M.EXTENDED, "lane_77", "lane_<NUM>"),
])
def test_masks(spark, masks, text, expected):
    assert one(spark, M.mask(F.col("t"), masks), t=text) == expected


def test_mask_names(spark):
    assert one(spark, M.mask(F.col("t"), [M.NUM], "[", "]"), t="K2 lot 40 41 7Z end 5") == "K2 lot [NUM] [NUM] 7Z end [NUM]"
    assert M.mask_names([M.NUM, M.IP, M.NUM]) == ["NUM", "IP"] and M.by_name([M.NUM], "X") == []
    with pytest.raises(ValueError):
        M.Mask("", "A")


def test_linear_masks_find_the_same(spark):
    """The rewritten searches against the plain patterns, on many strings of the characters that matter."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("a1._-: /~é9bZ") for _ in range(rng.randint(1, 24))) for _ in range(4000)]
    texts += ["".join(rng.choice(["blk_", "-", "7", "_", "é", " ", "x"]) for _ in range(8)) for _ in range(1000)]
    texts += ["a.b:80.c:90", "a.b:80_x.y:90", "a.b:80__x.y:90", "c:80.d:90", "a.b:80.c.d:90", "x/y/z", "a//", "a/b/ c/", "..a.b:1", "a.:1", "__.x:2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for m in (M.HOST_PORT, M.PATH, M.EMAIL, M.BLOCK_ID, M.SYSLOG_NUM):
        slow = regex.compile(m.pattern, regex.ASCII)
        for t, got in df.select("t", m(F.col("t")).alias("x")).collect():
            assert got == slow.sub(f"<{m.name}>", t), (m.name, t)


def test_masks_on_long_tokens(spark):
    for text in ("a." * 200_000, "a.b" * 100_000 + ":", "a/" * 200_000 + "/", "/" * 300_000, "1:" * 200_000):
        began = time.time()
        assert len(one(spark, M.mask(F.col("t"), [M.HOST_PORT, M.PATH]), t=text)) > 0
        assert time.time() - began < 20


def test_tokens(spark):
    assert one(spark, K.tokenize(F.col("t"), ("_", ":")), t="rack_row:slot_lid") == ["rack", "row", "slot", "lid"]
    assert one(spark, K.tokenize(F.col("t"), ("_",)), t=" a__b c﻿ ") == ["a", "b", "c"]
    assert one(spark, K.root_key(F.col("t"), binning=True), t=["<IP>", "x", "<*>"]) == "3#2"
    assert one(spark, K.tokenize(F.col("t")), t="") == []


def test_normalizers(spark):
    t = F.col("t")
    assert one(spark, N.substitute(t, [(r"\d+", "${paramStr}")]), t=["55", "oak", "8", "elm"]) == ["<*>", "oak", "<*>", "elm"]
    assert one(spark, N.collapse(t, [(r"\[about <NUM> kg\] ?", "")]), t=["<NUM>", "sacks", "[about", "<NUM>", "kg]", "loaded"]) == ["<NUM>", "sacks", "loaded"]
    lines = spark.createDataFrame([(i, ["salt", "pan", "rye", "bun"]) for i in range(3)], "msg_id long, tokens array<string>")
    learned = N.learn_fusion(lines, 1)
    assert one(spark, learned(t), t=["salt", "pan", "rye", "bun"]) == ["salt<*>pan", "rye<*>bun"]
    assert one(spark, learned(t), t=["a", "b"]) == ["a", "b"]
    assert N.learn_fusion(lines.limit(1), 1) == N.Fusion()
    pipe = N.Pipeline().register("sub", lambda c: N.substitute(c, [("x", "y")]))
    assert one(spark, pipe.changes(t), t=["x"]) == ["[sub]"] and one(spark, pipe.changes(t), t=["z"]) == [] and len(pipe) == 1


def test_similarity_goldens(spark):
    t, m = F.col("t"), F.col("m")
    score = lambda c, a, b: tuple(one(spark, c, t=a, m=b))
    assert score(S.position(t, m), ["a", "<*>", "c"], ["a", "x", "c"]) == (2 / 3, 1)
    assert score(S.position(t, m, include_params=True), ["a", "<*>", "c"], ["a", "x", "d"]) == (2 / 3, 1)
    assert score(S.position(t, m), ["a", "b"], ["a", "b", "c"]) == (0.0, 0)
    assert score(S.diff_ratio(t, m), ["<*>", "<*>"], ["a", "b"]) == (1.0, 2)
    assert score(S.diff_ratio(t, m, max_ratio=0.5, include_params=True), ["a", "b", "<*>"], ["a", "x", "<*>"])[0] == pytest.approx(2 / 3)
    assert score(S.jaccard_index(t, m), [], []) == (0.0, 0) and score(S.jaccard_engine(t, m), [], []) == (1.0, 0)
    assert score(S.term_pairs(t, m), ["shelf", "lamp", "rug"], ["lamp", "rug", "shelf"])[0] == 1.0
    assert score(S.term_pairs(t, m), ["a"], ["a"])[0] == 0.0 and score(S.term_pairs(t, m), ["<*>"], ["<*>"])[0] == 1.0


def test_columns_agree_with_the_fold(spark):
    rng = random.Random(0)
    pick = lambda n: [rng.choice(["a", "b", "c", "d1", "<*>"]) for _ in range(n)]
    rows = [(i, pick(n), [x if x != "<*>" else "z" for x in pick(n if i % 3 else rng.randint(1, 5))]) for i in range(120) for n in [rng.randint(1, 5)]]
    df = spark.createDataFrame(rows, "i int, t array<string>, m array<string>")
    t, m = F.col("t"), F.col("m")
    for rules, column, params in [(Rules(), S.position(t, m), False), (Rules(), S.position(t, m, include_params=True), True), (Rules(engine="jaccard"), S.jaccard_engine(t, m), False), (Rules(engine="jaccard"), S.jaccard_engine(t, m, include_params=True), True), (Rules(diff_ratio=0.3), S.chain(S.diff_ratio(t, m), S.position(t, m)), False)]:
        tree = Tree(rules)
        got = {r["i"]: tuple(r["x"]) for r in df.select("i", column.alias("x")).collect()}
        for i, a, b in rows:
            expected = tree.similarity(a, b, params)
            assert got[i][0] == pytest.approx(expected[0], abs=1e-12), (rules, a, b)
    same = [r for r in rows if len(r[1]) == len(r[2])]
    tree = Tree(Rules(affix=1))
    got = {r["i"]: tuple(r["x"]) for r in df.filter(F.size("t") == F.size("m")).select("i", T.template(m, t, use_affix=True, least_affix=1).alias("x")).collect()}
    assert got == {i: tree.template(b, a) for i, a, b in same}
    tree = Tree(Rules(engine="jaccard"))
    got = {r["i"]: tuple(r["x"]) for r in df.select("i", T.template_of_sets(m, t).alias("x")).collect()}
    assert got == {i: tree.template(b, a) for i, a, b in rows}


def serial(rows, config):
    """The answers of one tree over all lines in order."""
    tree, out = Tree(Rules.of(config)), {}
    for i, line in sorted(rows):
        cluster, change = tree.add(line.split())
        out[i] = (change, cluster, tree.clusters[cluster][1], " ".join(tree.clusters[cluster][0]), len(tree.clusters))
    return out


@pytest.mark.parametrize("config,hot", [
    (MinerConfig(), 10**6), (MinerConfig(depth=6, sim_th=0.6), 5), (MinerConfig(engine="jaccard"), 10**6),
    (MinerConfig(max_clusters=4), 10**6), (MinerConfig(depth=5, max_children=4), 3), (MinerConfig(param_binning=True, diff_ratio=0.3), 10**6),
    (MinerConfig(depth=6, parametrize_numeric_tokens=False), 3), (MinerConfig(engine="jaccard", depth=6, parametrize_numeric_tokens=False), 3),
])
def test_partitioned_run_equals_serial_run(spark, config, hot):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "x1", "y2", "<IP>"]
    rows = [(i * 7, " ".join(rng.choice(words if i % 2 else words[:4]) for _ in range(rng.randint(1, 5)))) for i in range(400)]
    df = spark.createDataFrame(rows, LINES).repartition(5)
    got = {r["msg_id"]: (r["change_type"], r["cluster_id"], r["cluster_size"], r["template_mined"], r["cluster_count"]) for r in mi.mine(df, config, hot_rows=hot).collect()}
    assert got == serial(rows, config)


@pytest.mark.parametrize("engine", ["position", "jaccard"])
def test_paths_are_dealt_with_a_model_too(spark, engine):
    rng = random.Random(8)
    rows = [(i, " ".join([rng.choice(["ship", "dock"]), rng.choice(["in", "out", "off"]), rng.choice(["am", "pm"]), str(rng.randint(1, 30))][: 4 if i % 5 else 3])) for i in range(500)]
    config = MinerConfig(engine=engine, depth=6)
    df = spark.createDataFrame(rows, LINES).repartition(3)
    model = mi.clusters(mi.mine(df.filter("msg_id < 100"), config, hot_rows=5))
    got = {r["msg_id"]: (r["change_type"], r["cluster_id"], r["cluster_size"], r["template_mined"], r["cluster_count"]) for r in mi.mine(df.filter("msg_id >= 100"), config, hot_rows=5, model=model).collect()}
    assert got == {i: v for i, v in serial(rows, config).items() if i >= 100}
    t = mi.prepared(F.col("line"), config)
    keyed = df.select("msg_id", t.alias("t")).withColumn("key", K.root_key(F.col("t"), engine))
    assert mi._dealt(keyed, config, 5).select("grp").distinct().count() > keyed.select("key").distinct().count()


def test_null_and_empty_lines(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, ""), (4, "a b"), (None, "c")], LINES)
    got = [(r["msg_id"], r["change_type"], r["template_mined"]) for r in mi.mine(df).orderBy("msg_id").collect()]
    assert got == [(2, CREATED, ""), (3, "none", ""), (4, CREATED, "a b")]
    assert mi.mine(df.limit(0)).count() == 0


def test_masked_lines_match_and_merge(spark):
    config = MinerConfig(masks=M.DEFAULT)
    df = spark.createDataFrame([(1, "feed via 172.16.4.4 lane 31"), (2, "feed via 10.9.8.7 lane 6")], LINES)
    mined = mi.mine(df, config)
    assert [(r["change_type"], r["template_mined"]) for r in mined.orderBy("msg_id").collect()] == [(CREATED, "feed via <IP> lane <NUM>"), ("none", "feed via <IP> lane <NUM>")]
    model = md.from_json(spark, md.to_json(mi.clusters(mined), compress=True))
    for strategy in ("never", "fallback", "always"):
        assert {r["msg_id"]: r["cluster_id"] for r in mt.match(df.union(spark.createDataFrame([(9, "other line")], LINES)), model, config, strategy).collect()} == {1: 1, 2: 1, 9: None}
    clusters = spark.createDataFrame([(1, ["crane", "swings", "left"], 2), (2, ["crane", "swings", "right"], 3), (3, ["<*>", "swings", "left"], 1)], md.SCHEMA)
    merged, moved = mg.merge(clusters)
    assert [(r["cluster_id"], r["template_tokens"], r["size"]) for r in merged.filter("cluster_id = 1").collect()] == [(1, ["crane", "swings", "<*>"], 5)]
    assert {r["old_id"]: r["cluster_id"] for r in moved.collect()}[2] == 1
    assert mg.position_diff()(["<*>", "swings", "left"], ["crane", "swings", "left"]) is None


@pytest.mark.parametrize("a,b,expected", [
    ("red ant eats ripe figs", "red ant eats oats", "red ant eats <*> figs"),
    ("go go go", "go go now go go go", "go go <*> go go go"),
    ("big owl sees mice", "big owl sees <*>", "big owl sees mice"),
    ("one two", "six two", None),
    ("p q tea milk jam", "r s tea milk jam", "<*> <*> tea milk jam"),
    ("", "", None),
])
def test_shared_affix_merge(a, b, expected):
    got = mg.shared_affix(3)(a.split(), b.split())
    assert (got and " ".join(got)) == expected
    assert (mg.shared_affix(3)(b.split(), a.split()) is None) == (got is None)


def test_similarity_merge():
    assert mg.similar(0.7)(list("kmnp"), list("kmnq")) == ["k", "m", "n", "<*>"] and mg.similar(0.7)(list("kmn"), list("kmnq")) is None
    overlap = lambda a, b, param, _: (len(set(a) & set(b)) / len(set(a) | set(b)), 0)
    assert mg.similar(0.7, score=overlap)(list("kmn"), list("kmnq")) == list("kmnq")
    one_length = Tree(Rules()).template
    assert mg.similar(0.7, score=overlap, template=one_length)(list("kmn"), list("kmnq")) == list("kmnq")
    assert mg.similar(0.7, score=overlap, template=one_length)(list("kmnq"), list("kmqn")) == ["k", "m", "<*>", "<*>"]


def test_stores(spark, tmp_path):
    store = md.FileStore(spark, str(tmp_path / "a" / "state.json"))
    assert store.load() is None and md.from_json(spark, None).count() == 0
    store.save(b"{}x")
    assert store.load() == b"{}x"
    memory = md.MemoryStore()
    memory.save(b"1")
    assert memory.load() == b"1"
    model = spark.createDataFrame([(1, ["a"], 2)], md.SCHEMA)
    md.save(model, str(tmp_path / "m"))
    assert md.load(spark, str(tmp_path / "m")).collect() == model.collect() and md.load(spark, str(tmp_path / "none")).count() == 0
    assert md.describe(model).first()["line"] == "ID=1     : size=2         : a"


@pytest.mark.parametrize("template,line,exact,delimiters,expected", [
    ("feed via <IP> lane <NUM>", "feed via 172.16.4.4 lane 31", True, (), [("172.16.4.4", "IP"), ("31", "NUM")]),
    ("note: <*>", "note: keep it dry", True, (), [("keep it dry", "*")]),
    ("lot <NUM> ok", "lot   8   ok", True, (), [("8", "NUM")]),
    ("bin <NUM> row <NUM>", "bin_8:row_21", True, ("_", ":"), [("8", "NUM"), ("21", "NUM")]),
    ("lot <NUM>", "lid 1", True, (), []),
    ("open <bracket", "open x", False, (), []),
])
def test_extraction(spark, template, line, exact, delimiters, expected):
    df = spark.createDataFrame([(1, template, line)], "msg_id long, template string, line string")
    got = ex.extract(df, MinerConfig(masks=M.DEFAULT, extra_delimiters=delimiters), exact).first()["params"]
    assert [tuple(p) for p in got] == expected


def test_metrics(spark):
    truth = lambda rows: spark.createDataFrame(rows, "msg_id long, template_id long, template_tokens array<string>")
    parsed = lambda rows: spark.createDataFrame(rows, "msg_id long, cluster_id long, template_tokens array<string>")
    t = truth([(i, 1, ["a", "b", "c"]) for i in range(3)])
    split = ev.evaluate(t, parsed([(i, i, ["a", "x", "c"]) for i in range(3)])).first()
    assert split["group_accuracy"] == pytest.approx(1 / 3) and split["template_accuracy"] == pytest.approx(2 / 3) and split["clusters"] == 3
    assert ev.group_scores(truth([(1, 1, ["a"]), (2, 2, ["b"])]), parsed([(1, 1, ["a"]), (2, 1, ["a"])])).first()["group_accuracy"] == 1.0
    two = ev.template_scores(truth([(1, 1, ["A", "B", "C"]), (2, 2, ["X", "Y"])]), parsed([(1, 1, ["A", "B", "C"]), (2, 2, ["X", "Z"])])).first()
    assert two["template_accuracy"] == pytest.approx(0.8)
    assert ev.template_scores(t, parsed([(0, 1, ["a"])])).first()["template_accuracy"] == 0.0
    empty = ev.evaluate(t.limit(0), parsed([]).limit(0)).first()
    assert (empty["group_accuracy"], empty["template_accuracy"], empty["messages"]) == (1.0, 1.0, 0)
    assert tuple(ev.evaluate_compact(t, parsed([(i, 1, ["a", "b", "c"]) for i in range(3)])).first()) == (1.0, 1.0, 1.0, 1.0)


def brute_csv(line):
    """Character by character."""
    out, i, n = [], 0, len(line)
    while True:
        while i < n and line[i] in " \t":
            i += 1
        part, start = "", i
        if i < n and line[i] == '"':
            i += 1
            while i < n and (line[i] != '"' or line[i + 1 : i + 2] == '"'):
                part += line[i]
                i += 2 if line[i] == '"' else 1
            out.append(part)
        while i < n and line[i] != ",":
            i += 1
        if line[start : start + 1] != '"':
            out.append(line[start:i].strip())
        if i >= n:
            return out
        i += 1


def test_csv_lines():
    rng = random.Random(9)
    for _ in range(5000):
        line = "".join(rng.choice('a" ,\tb') for _ in range(rng.randint(0, 12)))
        assert src.split_csv_line(line) == brute_csv(line), line


def test_csv(spark, tmp_path):
    assert src.split_csv_line('1, a ,"x, ""y"" ",z') == ["1", "a", 'x, "y" ', "z"] and src.split_csv_line("a,") == ["a", ""]
    (tmp_path / "x_structured.csv").write_text("LineId,Level,Content,EventId,EventTemplate\n1,INFO,Packed crates for [oslo, bern, riga],E1,T1\n2,WARN,tiny\n")
    got = {r["line_no"]: (r["content"], r["template"]) for r in src.read_structured(spark, str(tmp_path / "*_structured.csv")).collect()}
    assert got == {1: ("Packed crates for [oslo,bern,riga]", "T1"), 2: ("tiny", "")}
    assert src.read_structured_dir(spark, str(tmp_path)).count() == 2
    ids = src.template_ids(spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "line_no long, template string"))
    assert {r["template"]: r["template_id"] for r in ids.collect()} == {"b": 1, "a": 2}


def test_stream_and_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n\nfirst note\n\n\nsecond remark\n")
    read = src.read_lines(spark, str(tmp_path / "in"))
    assert [tuple(r) for r in read.orderBy("msg_id").collect()] == [(1, "first note"), (2, "second remark")]
    assert [r["template_mined"] for r in mi.mine(read).orderBy("msg_id").collect()] == ["first note", "second remark"]
    stream = src.read_line_stream(spark, str(tmp_path / "in"))
    counts = ms.RunningCounts()
    spark.streams.addListener(counts)
    out = ms.counted(ms.mine_stream(stream)).writeStream.format("memory").queryName("mined").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    (tmp_path / "in" / "b.txt").write_text("third line")
    again = ms.mine_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    again.awaitTermination()
    assert sorted(r["change_type"] for r in spark.table("mined").collect()) == [CREATED, CREATED]
    for _ in range(100):
        if counts.lines == 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(counts)
    assert (counts.lines, counts.clusters) == (2, 2)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_lines_are_numbered_over_files_and_blocks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("".join(f"line {k} {i}\n\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        got = [tuple(r) for r in src.read_lines(spark, str(tmp_path)).orderBy("msg_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(1 + 400 * k + i, f"line {k} {i}") for k in range(3) for i in range(400)]


def test_accuracy_report(spark):
    from logloom.plans import accuracy as ac

    lines = spark.createDataFrame([(i, f"{'gate opened by' if i % 2 else 'belt halted near'} n{i}") for i in range(20)], LINES)
    truth = lines.select("msg_id", F.pmod("msg_id", F.lit(2)).alias("template_id"), F.concat(F.slice(F.split("line", " "), 1, 3), F.array(F.lit("<*>"))).alias("template_tokens"))
    cases = [ac.Case("HDFS", lines, truth), ac.Case("own", lines, truth, learn=True, merge=[mg.shared_affix(1)])]
    out, average = ac.report(spark, cases)
    rows = {r["name"]: r for r in out.collect()}
    assert rows["HDFS"]["passed"] is True and rows["own"]["passed"] is None and rows["HDFS"]["clusters"] == 2
    assert average.first()["data_sets"] == 2 and average.first()["group_accuracy"] == pytest.approx((1 + rows["own"]["group_accuracy"]) / 2)
    assert ac.report(spark, cases[:1], {"HDFS": (1.1, 0)})[0].first()["passed"] is False


def test_own_strategies_reach_the_fold(spark):
    config = MinerConfig(score=lambda a, b, param, _: (float(a[-1] == b[-1]), 0), token_rules=(lambda new, old, param: "<D>" if new.isdigit() and old.isdigit() else None,))
    df = spark.createDataFrame([(1, "cut 12 red"), (2, "cut 90 red"), (3, "cut 90 tan")], LINES)
    mined = mi.mine(df, config)
    assert [r["template_mined"] for r in mined.orderBy("msg_id").collect()] == ["cut 12 red", "cut <D> red", "cut 90 tan"]


def test_factories(spark):
    t, m, a, b = (F.col(c) for c in "tmab")
    lines = spark.createDataFrame([(i, ["salt", "pan"]) for i in range(3)], "msg_id long, tokens array<string>")
    assert len(N.plain()) == 0 and one(spark, N.fusing(lines)(t), t=["salt", "pan"]) == ["salt<*>pan"]
    assert tuple(one(spark, S.by_position(t, m), t=["x", "y"], m=["x", "z"])) == (0.5, 0)
    assert tuple(one(spark, S.by_ratio(t, m, max_ratio=0.1), t=["x", "y"], m=["x", "z"])) == (0.5, 0) and one(spark, S.by_ratio(t, m, max_ratio=0.5), t=["x", "y"], m=["x"])["similarity"] == 0.5
    assert one(spark, T.plain(a, b), a="slot1", b="slot2")["template_token"] == "<*>" and one(spark, T.extended(a, b), a="slot1", b="slot2")["template_token"] == "slot<*>"
    up = lambda x, y: F.when(F.upper(x) == F.upper(y), F.upper(x))
    assert [one(spark, T.custom(a, b, up), a=x, b="ox") for x in ("ox", "OX", "elk")] == ["ox", "OX", "<*>"]
