"""Merge of similar clusters after training: ordered sweeps to a fixpoint.

Strategies that keep the length only merge clusters of one length, so each
length is a group of its own.  The shared-affix strategy merges over lengths; its
clusters are grouped by what can meet: two templates agree in their first tokens
where these are equal outside both's wildcards, so each is entered under its
first (and last) tokens once for each pattern of wildcards in use, and clusters
that are connected by such entries are swept together.  Merged templates are
entered as well: where one would meet another group, the groups are put together
and swept again, so the result is that of one sweep over all clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.scratch import materialize

from .connected import connected
from .kernel import Rules, Tree

Strategy = Callable[[Sequence[str], Sequence[str]], "list[str] | None"]


def position_diff(percent: float = 0.4, param: str = "<*>") -> Strategy:
    """Merge where some, but at most ``percent``, of the positions differ."""

    def pair(a: Sequence[str], b: Sequence[str]) -> list[str] | None:
        if len(a) != len(b) or not a:
            return None
        loose = [param if x == param or y == param or x != y else x for x, y in zip(a, b, strict=True)]
        differ = sum(param not in (x, y) and x != y for x, y in zip(a, b, strict=True))
        return loose if 0 < differ <= percent * len(a) and differ / len(a) <= percent else None

    return pair


def _loosened(a: Sequence[str], b: Sequence[str], param: str, ignore: Sequence[str] = ()) -> list[str]:
    """The longer one, with the wildcard where positions of both differ and none is in ``ignore``."""
    long = a if len(a) >= len(b) else b
    met = [param if x != y and x not in ignore and y not in ignore else t for t, x, y in zip(long, a, b, strict=False)]
    return met + list(long[len(met) :])


def similar(least: float = 0.7, param: str = "<*>", score: Callable | None = None, template: Callable | None = None) -> Strategy:
    """Merge where the similarity of two templates, wildcards counted, reaches ``least``.

    ``score``: (template, tokens, param, with_params) -> (similarity, wildcards);
    by default position-wise, which is 0 for unequal lengths.  ``template``
    makes the merged template; where it raises ValueError, and by default, the
    longer one is taken with the wildcard where both differ.
    """
    score = score or (lambda a, b, param, _: Tree(Rules(param=param)).similarity(a, b, True))

    def pair(a: Sequence[str], b: Sequence[str]) -> list[str] | None:
        if score(a, b, param, True)[0] < least:
            return None
        if template is not None:
            try:
                return list(template(a, b))
            except ValueError:  # a template function for one length only
                pass
        return _loosened(a, b, param)

    return pair


def shared_affix(least: int = 3, param: str = "<*>") -> Strategy:
    """Merge where ``least`` tokens in a row agree at the beginning, or at the end, wildcards agreeing with all.

    The longer template stays; only positions (from the left) where both have
    different constants become wildcards.
    """

    def run(pairs) -> int:
        n = 0
        for x, y in pairs:
            if x != y and param not in (x, y):
                break
            n += 1
        return n

    def pair(a: Sequence[str], b: Sequence[str]) -> list[str] | None:
        ends = run(zip(a, b, strict=False)), run(zip(reversed(a), reversed(b), strict=False))
        return _loosened(a, b, param, (param,)) if max(ends) >= least else None

    pair.affix = least, param
    return pair


def _sweeps(strategies: Sequence[Strategy], rounds: int):
    """Rows of a group -> its clusters (with a size), where each went (with old_id), templates on the way (with neither)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [[int(c), list(t), int(n), int(c)] for c, t, n in pdf.sort_values("cluster_id")[["cluster_id", "template_tokens", "size"]].itertuples(index=False)]
        moved: dict[int, int] = {}
        seen: list[tuple] = []
        for _ in range(rounds):
            merged = False
            i = 0
            while i < len(rows):
                j = i + 1
                while j < len(rows):
                    found = next((m for s in strategies if (m := s(rows[i][1], rows[j][1])) is not None), None)
                    if found is None:
                        j += 1
                    else:
                        rows[i][1], rows[i][2], merged = found, rows[i][2] + rows[j][2], True
                        moved[rows[j][0]] = rows[i][0]
                        seen.append((rows[i][0], found, None, None))
                        del rows[j]
                i += 1
            if not merged:
                break
        out = [(c, t, n, c) for c, t, n, _ in rows]
        for old in moved:
            to = moved[old]
            while to in moved:
                to = moved[to]
            out.append((to, None, None, old))
        return pd.DataFrame(out + seen, columns=["cluster_id", "template_tokens", "size", "old_id"])

    return run


def _entries(strategies: Sequence[Strategy], shapes: Sequence[tuple[int, int, tuple[bool, ...]]]):
    """Rows (part, template_tokens) -> (part, entry): what the template can be met by.

    ``shapes``: for strategy number and end (0: beginning, 1: end) the places of
    wildcards among the tokens that have to agree.  Templates of two shapes agree
    where they are equal outside both; they share the entry of these two shapes then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, entries = [], []
            for part, template in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, end, shape in _shapes(strategies, template):
                    own = _ends(strategies[k].affix[0], template)[end]
                    for j, e, other in shapes:
                        if (j, e) == (k, end):
                            kept = [t for t, x, y in zip(own, shape, other, strict=True) if not x and not y]
                            parts.append(part)
                            entries.append("\x1f".join([str(k), str(end), *("".join("01"[x] for x in s) for s in sorted((shape, other))), *kept]))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(entries, pa.string())], ["part", "entry"])

    return run


def _ends(least: int, template: Sequence[str]) -> tuple[Sequence[str], Sequence[str]]:
    return template[:least], template[len(template) - least :]


def _shapes(strategies: Sequence[Strategy], template: Sequence[str]) -> list[tuple[int, int, tuple[bool, ...]]]:
    """(strategy, end, places of wildcards); none for templates that are too short to agree."""
    return [(k, end, tuple(t == param for t in tokens)) for k, s in enumerate(strategies) for least, param in [s.affix] if len(template) >= least for end, tokens in enumerate(_ends(least, template))]


def _shape_rows(strategies: Sequence[Strategy]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {x for batch in batches for t in batch.column(0).to_pylist() for x in _shapes(strategies, t)}
        yield pa.RecordBatch.from_arrays([pa.array([f"{k} {end} " + "".join("01"[x] for x in s) for k, end, s in sorted(found)], pa.string())], ["shape"])

    return run


def _links(seen: DataFrame, strategies: Sequence[Strategy], most_shapes: int) -> DataFrame | None:
    """(a, b): parts of templates (part, template_tokens) that can meet; None where wildcards stand in too many ways."""
    found = seen.select("template_tokens").mapInArrow(_shape_rows(strategies), "shape string").distinct().limit(most_shapes + 1).collect()
    if len(found) > most_shapes:
        return None
    shapes = [(int(k), int(e), tuple(c == "1" for c in s)) for k, e, s in (r["shape"].split(" ") for r in found)]
    entries = materialize(seen.select("part", "template_tokens").mapInArrow(_entries(strategies, shapes), "part long, entry string").distinct(), "merge-entries")
    first = entries.groupBy("entry").agg(F.min("part").alias("b"))
    return materialize(entries.join(first, "entry").select(F.col("part").alias("a"), "b").filter("a <> b").distinct(), "merge-links")


def _apart(model: DataFrame, strategies: Sequence[Strategy], rounds: int, most_shapes: int) -> DataFrame | None:
    """Swept rows of all clusters, those that can meet together; None where too many shapes make that useless."""
    kept = model.select(F.col("cluster_id").cast("long"), "template_tokens", "size")
    parts = kept.select("cluster_id", F.col("cluster_id").alias("part"))
    links = _links(kept.withColumnRenamed("cluster_id", "part"), strategies, most_shapes)
    while True:
        if links is None:
            return None
        whole = connected(links).toDF("part", "whole")
        parts = materialize(parts.join(whole, "part", "left").select("cluster_id", F.coalesce("whole", "part").alias("part")), "merge-parts")
        grouped = kept.join(parts, "cluster_id")
        done = materialize(grouped.groupBy("part").applyInPandas(_sweeps(strategies, rounds), _SWEPT), "merge-swept")
        # Templates on the way, and those that the sweep began with.
        later = done.filter("old_id is null").select("cluster_id", "template_tokens").join(parts, "cluster_id").select("part", "template_tokens")
        links = _links(grouped.select("part", "template_tokens").union(later), strategies, most_shapes)
        if links is not None and links.isEmpty():
            return done


_SWEPT = "cluster_id long, template_tokens array<string>, size long, old_id long"


def merge(model: DataFrame, strategies: Sequence[Strategy] | None = None, by_length: bool = True, rounds: int = 10, most_shapes: int = 256) -> tuple[DataFrame, DataFrame]:
    """(merged model, (old_id, cluster_id) of every cluster).

    Sweeps depend on the order of clusters, so each length is one group.  With
    ``by_length=False`` (for strategies that merge unequal lengths) clusters that
    shared affixes can bring together are; for other strategies, and for more
    than ``most_shapes`` patterns of wildcards, the whole model is one group:
    clusters, not lines, are what a task holds.
    """
    strategies = strategies or [position_diff()]
    done = None
    if not by_length and all(hasattr(s, "affix") for s in strategies):
        done = _apart(model, strategies, rounds, most_shapes)
    if done is None:
        key = F.size("template_tokens") if by_length else F.lit(0)
        done = model.withColumn("grp", key).groupBy("grp").applyInPandas(_sweeps(strategies, rounds), _SWEPT)
    return done.filter("size is not null").drop("old_id"), done.filter("old_id is not null").select("old_id", "cluster_id")
