"""One model from several: templates that may mean the same lines become one.

Two templates of one length are joined where at most ``percent`` of the
positions hold different constants (none by default: then some line fits both).
Their join has the wildcard where they differ, and the lines of both.  This goes
on until no two can be joined.

A join is no stricter than what it was made of, so whatever could be joined with
one of the two can be joined with it.  Hence the end does not depend on the
order of the joins: the model of a set of models is the model of the models of
its parts, however they are dealt.  Tasks join what they hold, and what is left
meets in fewer and fewer tasks, ``fan_in`` at a time; only the last step holds all
templates of a length, and by then they are the model.

Templates without constants of one length are one cluster.  Rows without a
template are left out; clusters are numbered by their first lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.scratch import materialize

_LEFT = "template_tokens array<string>, size long, first long"


class Join:
    """Templates of one length, no two of which can be joined, in a prefix tree."""

    def __init__(self, allowed: int, param: str):
        self.allowed, self.param = allowed, param
        self.tree: dict = {}

    def _partner(self, tokens: Sequence[str]) -> tuple[str, ...] | None:
        """A template that can be joined with ``tokens``: branches that differ too often are left."""
        open_ = [(self.tree, (), 0)]
        while open_:
            node, path, differ = open_.pop()
            if len(path) == len(tokens):
                return path
            token = tokens[len(path)]
            if token == self.param or differ < self.allowed:
                steps = node.keys()
            else:
                steps = [t for t in (token, self.param) if t in node]
            for t in steps:
                worse = self.param not in (t, token) and t != token
                if differ + worse <= self.allowed:
                    open_.append((node[t], (*path, t), differ + worse))
        return None

    def _take(self, path: Sequence[str]) -> tuple[int, int]:
        nodes = [self.tree]
        for t in path[:-1]:
            nodes.append(nodes[-1][t])
        held = nodes[-1].pop(path[-1]) if path else self.tree.pop("")
        for node, t in zip(reversed(nodes[:-1]), reversed(path[:-1]), strict=True):
            if not node[t]:
                del node[t]
        return held

    def add(self, tokens: Sequence[str], size: int, first: int) -> None:
        """Take a template in, joined with all it can be joined with."""
        tokens = tuple(tokens)
        if not tokens:
            old = self.tree.get("", (0, first))
            self.tree[""] = old[0] + size, min(old[1], first)
            return
        while (partner := self._partner(tokens)) is not None:
            more, earlier = self._take(partner)
            tokens = tuple(a if a == b else self.param for a, b in zip(tokens, partner, strict=True))
            size, first = size + more, min(first, earlier)
        node = self.tree
        for t in tokens[:-1]:
            node = node.setdefault(t, {})
        node[tokens[-1]] = size, first

    def rows(self) -> Iterator[tuple[list[str], int, int]]:
        open_ = [(self.tree, [])]
        while open_:
            node, path = open_.pop()
            for t, below in node.items():
                if isinstance(below, tuple):
                    yield ([*path, t] if t or path else []), *below
                else:
                    open_.append((below, [*path, t]))


def _joined(percent: float, param: str):
    """Rows (grp, n, template_tokens, size, first) in order of grp -> what is left of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None

        def told() -> pa.RecordBatch:
            rows = list(held.rows()) if held else []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.list_(pa.string()), pa.int64(), pa.int64()))], ["template_tokens", "size", "first"])

        for batch in batches:
            for grp, n, tokens, size, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if grp != current:
                    yield told()
                    current, held = grp, Join(int(percent * n + 1e-9), param)
                held.add(tokens, size, first)
        yield told()

    return run


def consensus(models: DataFrame, percent: float = 0.0, param: str = "<*>", fan_in: int = 8, task_rows: int = 5_000) -> DataFrame:
    """(cluster_id, template_tokens, size, first) of models (template_tokens, size, first) put together.

    ``first`` is the first line of a cluster; ``task_rows``: templates that a
    task joins in the first step.
    """
    if not 0 <= percent < 1:
        raise ValueError("percent must be at least 0 and below 1")
    rows = models.filter(F.col("template_tokens").isNotNull()).groupBy("template_tokens").agg(F.sum("size").alias("size"), F.min("first").alias("first"))
    rows = materialize(rows, "consensus-distinct")
    tasks = 1
    longest = rows.groupBy(F.size("template_tokens")).count().agg(F.max("count")).first()[0] or 0
    while tasks * task_rows < longest:
        tasks *= fan_in
    while True:
        n = F.size("template_tokens")
        grp = F.concat_ws("/", n, F.pmod(F.xxhash64("template_tokens"), F.lit(tasks)))
        dealt = rows.select(grp.alias("grp"), n.alias("n"), "template_tokens", "size", "first").repartition("grp").sortWithinPartitions("grp")
        rows = materialize(dealt.mapInArrow(_joined(percent, param), _LEFT), "consensus-joined")
        if tasks == 1:
            break
        tasks //= fan_in
    # Clusters of a model, not lines; first lines are distinct but for models of the same lines.
    order = F.row_number().over(Window.orderBy("first", F.size("template_tokens"), "template_tokens"))
    return rows.select(order.cast("long").alias("cluster_id"), "template_tokens", "size", "first")


def of_pool(mined: DataFrame, percent: float = 0.0, param: str = "<*>", **dealing) -> DataFrame:
    """One model (cluster_id, template_tokens, size) from the results of a pool's instances."""
    last = mined.groupBy("instance", "cluster_id").agg(F.max_by("template_mined", "msg_id").alias("template"), F.max("cluster_size").alias("size"), F.min("msg_id").alias("first"))
    split = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.split("template", " "))
    return consensus(last.select(split.alias("template_tokens"), "size", "first"), percent, param, **dealing).drop("first")
