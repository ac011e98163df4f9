"""Mining of unbounded input: the prefix tree of each root key in keyed state.

The state of a root key is a table of its tree's nodes, one of its leaves with
their clusters, and a counter.  A micro-batch reads the nodes and leaves on the
paths of its lines, folds the lines, and writes back what has changed; the rest
of the model stays in the state store, so a batch costs as much beside a large
model as beside a small one.  With ``max_clusters`` the clusters of a key are
also chained by their last lines, so the oldest is found without a look at the
others.

Rows of a micro-batch are folded in the order of their msg_id; across batches
arrival order counts.  Runs of a key's rows are sorted, spilled to the folder that
Spark gives tasks for that, and merged, so a task holds neither all rows of a key
nor all its results.  A key has no view of the others, so clusters are named by
(root_key, local_id); ``snapshots`` numbers them over all keys, batch by batch.

State of this kind needs the RocksDB store; where the session has Spark's default
store, ``mine_stream`` sets the other (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator, Sequence
from itertools import batched
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from logloom.config import MinerConfig
from logloom.functions import tokens
from logloom.operators.kernel import CREATED, Node, Rules, Tree
from logloom.operators.mine import SEP, prepared

OUTPUT = "msg_id long, root_key string, local_id long, change_type string, cluster_size long, template_mined string"


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
RUN_ROWS = 200_000  # rows sorted at a time
BLOCK_ROWS = 1_000  # rows of each run in memory while runs are merged
OUT_ROWS = 10_000  # rows of a frame of results


def _ordered(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(msg_id, joined) of all parts by msg_id, equal ones as they came."""

    def rows(held: list[pd.DataFrame]) -> Iterator[tuple]:
        run = pd.concat(held).sort_values("msg_id", kind="stable")
        return zip(run["msg_id"], run["joined"], strict=True)

    # Spark's own folders for spilled data; nobody else reads the file.
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as file:

        def read(blocks: list[int]) -> Iterator[tuple]:
            for at in blocks:
                file.seek(at)
                yield from pickle.load(file)

        runs: list[list[int]] = []
        held: list[pd.DataFrame] = []
        for part in parts:
            held.append(part)
            if sum(map(len, held)) >= RUN_ROWS:
                runs.append([])
                for block in batched(rows(held), BLOCK_ROWS):
                    runs[-1].append(file.tell())
                    pickle.dump(block, file)
                held = []
        last = [rows(held)] if held else []
        yield from heapq.merge(*map(read, runs), *last, key=itemgetter(0))


class _Entries:
    """A map state's entries that a batch has read or changed; others are not looked at."""

    def __init__(self, state: MapState):
        self.state, self.held, self.changed = state, {}, set()

    def get(self, key):
        if key not in self.held:
            self.held[key] = self.state.getValue((key,))
        return self.held[key]

    def put(self, key, value: tuple | None) -> None:
        self.held[key] = value
        self.changed.add(key)

    def flush(self) -> None:
        for key in self.changed:
            if self.held[key] is not None:
                self.state.updateValue((key,), self.held[key])
            else:
                self.state.removeKey((key,))


class StoredTree(Tree):
    """A tree of which nodes and leaves are read when a line comes to them.

    ``nodes`` has the number of children by path, ``leaves`` ids, templates and
    sizes, ``recent`` (with ``max_clusters``) for each cluster the one before
    and after it by last line, and its leaf.
    """

    def __init__(self, rules: Rules, nodes: MapState, leaves: MapState, recent: MapState | None, counter: int, ends: tuple[int, int, int]):
        super().__init__(rules)
        self.nodes, self.stored = _Entries(nodes), _Entries(leaves)
        self.recent = _Entries(recent) if recent is not None else None
        self.counter = counter
        self.oldest, self.newest, self.live = ends  # ids, 0 for none; clusters kept
        self.read: dict[str, Node] = {}
        self.home: dict[int, str] = {}

    def _at(self, place: str) -> Node:
        """A leaf with its clusters."""
        if place not in self.read:
            self.read[place] = node = Node()
            for cluster, template, size in zip(*(self.stored.get(place) or ((), (), ())), strict=True):
                self.clusters[cluster] = [tuple(template.split(SEP)) if template else (), size]
                self.home[cluster] = place
                node.ids.append(cluster)
        return self.read[place]

    def _leaf(self, tokens: Sequence[str]) -> Node | None:
        place = ""
        if self.nodes.get(place) is None:
            return None
        for token in self._path(tokens):
            place = next((p for t in (token, self.rules.param) if self.nodes.get(p := place + SEP + t) is not None), None)
            if place is None:
                return None
        return self._at(place)

    def _find(self, tokens: Sequence[str], least: float, with_params: bool) -> int | None:
        if tokens:
            return super()._find(tokens, least, with_params)
        ids = self._at("").ids
        return ids[0] if ids else None

    def _insert(self, tokens: Sequence[str], cluster: int) -> None:
        place, r = "", self.rules
        if self.nodes.get(place) is None:
            self.nodes.put(place, (0,))
        for token in self._path(tokens):
            children = self.nodes.get(place)[0]
            child = place + SEP + token
            if self.nodes.get(child) is None:
                loose = place + SEP + r.param
                if self.routed_to_param(token, self.nodes.get(loose) is not None, children):
                    child = loose
                if self.nodes.get(child) is None:
                    self.nodes.put(child, (0,))
                    self.nodes.put(place, (children + 1,))
            place = child
        leaf = self._at(place)
        leaf.ids = [*leaf.ids, cluster] if tokens else [cluster]
        self.home[cluster] = place
        if self.recent is not None:
            older, newer, _ = self.recent.get(cluster)
            self.recent.put(cluster, (older, newer, place))

    def add(self, tokens: Sequence[str]) -> tuple[int, str]:
        out = super().add(tokens)
        self.stored.changed.add(self.home[out[0]])
        return out

    # The chain by last line: each cluster has the one before and after it.

    def _unlink(self, cluster: int) -> str:
        older, newer, place = self.recent.get(cluster)
        if older:
            before = self.recent.get(older)
            self.recent.put(older, (before[0], newer, before[2]))
        else:
            self.oldest = newer
        if newer:
            after = self.recent.get(newer)
            self.recent.put(newer, (older, after[1], after[2]))
        else:
            self.newest = older
        return place

    def _append(self, cluster: int, place: str) -> None:
        if self.newest:
            last = self.recent.get(self.newest)
            self.recent.put(self.newest, (last[0], cluster, last[2]))
        else:
            self.oldest = cluster
        self.recent.put(cluster, (self.newest, 0, place))
        self.newest = cluster

    def _touch(self, cluster: int) -> None:
        if cluster != self.newest:
            self._append(cluster, self._unlink(cluster))

    def _evict(self) -> None:
        self._append(self.counter, "")
        self.live += 1
        while self.live > self.rules.max_clusters:
            gone = self.oldest
            place = self._unlink(gone)
            self.recent.put(gone, None)
            leaf = self._at(place)
            leaf.ids = [i for i in leaf.ids if i != gone]
            self.clusters.pop(gone, None)
            self.stored.changed.add(place)
            self.live -= 1

    def flush(self) -> None:
        """Write what has changed."""
        for place in self.stored.changed:
            ids = self.read[place].ids
            self.stored.held[place] = (ids, [SEP.join(self.clusters[i][0]) for i in ids], [self.clusters[i][1] for i in ids])
        for entries in (self.nodes, self.stored, self.recent):
            if entries is not None:
                entries.flush()


class Fold(StatefulProcessor):
    """Folds the lines of a root key into its stored tree."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", "place string", "children int")
        self.leaves = handle.getMapState("leaves", "place string", "ids array<long>, templates array<string>, sizes array<long>")
        self.counts = handle.getValueState("counts", "counter long, oldest long, newest long, live long")
        self.recent = handle.getMapState("recent", "cluster long", "older long, newer long, place string") if self.rules.max_clusters is not None else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counter, *ends = self.counts.get() if self.counts.exists() else (0, 0, 0, 0)
        tree = StoredTree(self.rules, self.nodes, self.leaves, self.recent, counter, tuple(ends))
        for block in batched(_ordered(rows), OUT_ROWS):
            out = []
            for msg_id, joined in block:
                cluster, change = tree.add(joined.split(SEP) if joined else ())
                template, size = tree.clusters[cluster]
                out.append((int(msg_id), key[0], cluster, change, size, " ".join(template)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
        tree.flush()
        self.counts.update((tree.counter, tree.oldest, tree.newest, tree.live))

    def close(self) -> None:
        pass


def mine_stream(lines: DataFrame, config: MinerConfig | None = None) -> DataFrame:
    """A streaming DataFrame of results for a streaming one of lines (msg_id, line)."""
    config = config or MinerConfig()
    if lines.sparkSession.conf.get(_PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        lines.sparkSession.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = lines.filter("line is not null").select(F.col("msg_id").cast("long"), prepared(F.col("line"), config).alias("t"))
    keyed = rows.select("msg_id", tokens.root_key(F.col("t"), config.engine, config.param_binning).alias("root_key"), F.array_join("t", SEP).alias("joined"))
    return keyed.groupBy("root_key").transformWithStateInPandas(Fold(Rules.of(config)), OUTPUT, "append", "None")


def counted(results: DataFrame, name: str = "mined") -> DataFrame:
    """``results`` of ``mine_stream`` with lines and new clusters counted as they pass, for ``RunningCounts``."""
    return results.observe(name, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("change_type") == CREATED).alias("clusters"))


class RunningCounts(StreamingQueryListener):
    """Lines and clusters of the streams made by ``counted``; add it with ``spark.streams.addListener``."""

    def __init__(self, name: str = "mined"):
        self.name, self.lines, self.clusters = name, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if (row := event.progress.observedMetrics.get(self.name)) is not None:
            self.lines += row["lines"]
            self.clusters += row["clusters"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
