"""Mining of streams: state by node and leaf, and models batch by batch."""

import os
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logloom.config import MinerConfig
from logloom.operators import mine as mi
from logloom.operators.kernel import Rules, Tree
from logloom.streaming import mine_stream as ms
from logloom.streaming.snapshots import ModelTable


class Table:
    """A map state in memory that counts the bytes that pass through it."""

    def __init__(self):
        self.rows, self.moved = {}, 0

    def getValue(self, key):
        value = self.rows.get(key)
        self.moved += len(repr(value))
        return value

    def updateValue(self, key, value):
        self.moved += len(repr(value))
        self.rows[key] = value

    def removeKey(self, key):
        self.rows.pop(key, None)


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def processor(config):
    fold, tables = ms.Fold(Rules.of(config)), {}
    fold.init(SimpleNamespace(getMapState=lambda name, *_: tables.setdefault(name, Table()), getValueState=lambda name, *_: Value()))
    return fold, tables


def feed(fold, rows, part=30):
    parts = [pd.DataFrame(rows[i : i + part], columns=["msg_id", "joined"]) for i in range(0, len(rows), part)]
    out = list(fold.handleInputRows(("k",), iter(parts), None))
    return [tuple(r) for frame in out for r in frame[["msg_id", "local_id", "change_type", "cluster_size", "template_mined"]].itertuples(index=False)]


def serial(tree, rows):
    out = []
    for msg_id, joined in sorted(rows):
        cluster, change = tree.add(joined.split(ms.SEP) if joined else ())
        template, size = tree.clusters[cluster]
        out.append((msg_id, cluster, change, size, " ".join(template)))
    return out


SETTINGS = [
    {},
    {"max_clusters": 3},
    {"max_clusters": 40, "depth": 5, "max_children": 4},
    {"engine": "jaccard", "sim_th": 0.6},
    {"engine": "jaccard", "max_clusters": 2},
    {"depth": 6, "max_children": 3, "parametrize_numeric_tokens": False},
]


@pytest.mark.parametrize("settings", SETTINGS)
@pytest.mark.parametrize("length", [0, 1, 5])
def test_stored_trees_fold_as_a_tree_in_memory(settings, length):
    rng = random.Random(length)
    config = MinerConfig(**settings)
    fold, _ = processor(config)
    tree = Tree(Rules.of(config))
    for batch in range(12):
        lines = [(batch * 1000 + i, ms.SEP.join(["key"] * bool(length) + [rng.choice("ab12cde") for _ in range(length - 1)])) for i in range(60)]
        rng.shuffle(lines)
        assert feed(fold, lines) == serial(tree, lines)


def test_rows_come_in_order_and_in_frames(monkeypatch):
    n = 700
    for name, value in {"RUN_ROWS": 100, "BLOCK_ROWS": 7, "OUT_ROWS": 50}.items():
        monkeypatch.setattr(ms, name, value)
    rows = [(i * 37 % n, ms.SEP.join(["a", "bc"[i % 2], str(i % 5)])) for i in range(n)]
    fold, _ = processor(MinerConfig())
    parts = [pd.DataFrame(rows[i : i + 30], columns=["msg_id", "joined"]) for i in range(0, n, 30)]
    frames = list(fold.handleInputRows(("k",), iter(parts), None))
    assert max(map(len, frames)) == 50
    got = [tuple(r) for f in frames for r in f[["msg_id", "local_id", "change_type", "cluster_size", "template_mined"]].itertuples(index=False)]
    assert got == serial(Tree(Rules.of(MinerConfig())), rows)


def test_a_batch_moves_as_much_state_beside_a_large_model():
    """Bytes read and written for the same lines, from a thousand clusters to a hundred thousand."""
    moved = {}
    for clusters in (1_000, 10_000, 100_000):
        config = MinerConfig(depth=6, max_children=10**6, max_clusters=10**6)
        fold, tables = processor(config)
        words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(clusters)]
        feed(fold, [(i, ms.SEP.join(["job", w, "done", "now"])) for i, w in enumerate(words)], part=5_000)
        before = sum(t.moved for t in tables.values())
        feed(fold, [(clusters + i, ms.SEP.join(["job", words[i * 7 % 997], "done", "now"])) for i in range(500)])
        moved[clusters] = (sum(t.moved for t in tables.values()) - before) / 500
    assert max(moved.values()) < 1.3 * min(moved.values()), moved


def lines_of(folder, batch, texts):
    file = folder / f"b{batch:03d}.txt"
    file.write_text("\n".join(f"{batch * 1000 + i}\t{t}" for i, t in enumerate(texts)) + "\n")
    os.utime(file, (1_700_000_000 + batch,) * 2)  # files are taken in the order of their times


def read(spark, folder):
    raw = spark.readStream.option("maxFilesPerTrigger", 1).option("latestFirst", False).text(str(folder))
    parts = F.split("value", "\t", 2)
    return raw.select(parts[0].cast("long").alias("msg_id"), parts[1].alias("line"))


def test_models_of_a_stream_survive_a_restart(spark, tmp_path):
    """A stream that fails within a batch and starts again, against one batch run over all lines."""
    rng = random.Random(4)
    (tmp_path / "in").mkdir()
    config = MinerConfig()
    made = []
    for b in range(4):
        texts = [" ".join([rng.choice(["open", "close", "read"]), *[rng.choice(["door", "gate", str(rng.randrange(9))]) for _ in range(rng.randint(1, 3))]]) for _ in range(40)]
        made.append(texts)
        lines_of(tmp_path / "in", b, texts)
    table, fails = ModelTable(spark, str(tmp_path / "model")), [2]

    def once_broken(batch, batch_id):
        if batch_id in fails:
            fails.remove(batch_id)
            batch.limit(3).write.mode("overwrite").parquet(f"{table.path}/results/{batch_id:010d}")  # half done
            raise RuntimeError("lost")
        table(batch, batch_id)

    start = lambda sink: ms.mine_stream(read(spark, tmp_path / "in"), config).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        start(once_broken).awaitTermination()
    assert table.batches() == [0, 1]
    assert table.compact() == 1
    start(table).awaitTermination()
    assert table.batches() == [0, 1, 2, 3]

    every = spark.createDataFrame([(b * 1000 + i, t) for b, texts in enumerate(made) for i, t in enumerate(texts)], "msg_id long, line string")
    for upto in (0, 1, 3):
        mined = mi.mine(every.filter(F.col("msg_id") < (upto + 1) * 1000), config)
        want = sorted((r["cluster_id"], tuple(r["template_tokens"]), r["size"]) for r in mi.clusters(mined).collect())
        assert sorted((r["cluster_id"], tuple(r["template_tokens"]), r["size"]) for r in table.model(upto).collect()) == want
    got = sorted((r["msg_id"], r["cluster_id"], r["cluster_size"]) for r in table.results().collect())
    assert got == sorted((r["msg_id"], r["cluster_id"], r["cluster_size"]) for r in mined.collect())
    assert table.compact() == 3
    assert sorted((r["cluster_id"], tuple(r["template_tokens"]), r["size"]) for r in table.model().collect()) == want


def test_no_batches(spark, tmp_path):
    table = ModelTable(spark, str(tmp_path))
    assert table.compact() is None and table.model().count() == 0 and table.results().count() == 0
