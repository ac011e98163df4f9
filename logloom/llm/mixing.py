"""Mixing sources to target weights as a min-cost flow.

1. One native pass gives each document its size in words and its membership
   pattern (the sources it belongs to); patterns are aggregated.
2. Targets share the total by weight and stop at ``max_repeats`` times what a
   source holds; the excess is shared again until none is above (``targets``).
3. ``route`` sends word capacity from patterns to source quotas.  Each repeat
   of a pattern costs more than the one before, so all first passes are used
   before any second one: a min-cost flow on the small graph of patterns and
   sources, solved by augmenting one cost level after the other.
4. Documents are selected in a seeded order (md5 of seed and id).  Every
   pattern takes whole passes and, of the last pass, the documents first in
   that order, the last of them in part, so the words taken match the quota
   exactly.  The cut is found on aggregated hash cells in two levels; only the
   rows of the last cell are ordered, so a source with a third of all rows
   needs no large sort.

Up to ``max_patterns`` patterns the flow is found on the driver, which gets them
and their sources alone.  Beyond that, documents with one source each need no
flow: their targets and passes follow in closed form from running sums over the
sources (``_closed``).  More overlapping patterns than that are an error.

Defined results: a null text has size 0; a null source is a source of its own
and sorts last; sources without words get target 0; repeated rows are documents
of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS_CLASS, materialize

_CELL = 3  # hex digits a level


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WS_CLASS.replace("[", "[^") + "+")), F.lit(0)).cast("long")


def cycle_weights(sources: Sequence[str | None]) -> dict[str | None, int]:
    """Weights 1, 2, 3, repeating, by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: 1 + i % 3 for i, s in enumerate(ordered)}


def targets(sizes: dict, weights: dict, max_repeats: int, total: int | None = None) -> dict:
    """Shares of the total by weight, none above ``max_repeats`` times its source.

    ``total``: words of all documents; by default the sources do not overlap.
    """
    total = sum(sizes.values()) if total is None else total
    capped: set = set()
    while True:
        left = total - sum(max_repeats * sizes[s] for s in capped)
        open_w = sum(weights[s] for s in sizes if s not in capped)
        above = {s for s in sizes if s not in capped and left * weights[s] > max_repeats * sizes[s] * open_w}
        if not above:
            break
        capped |= above
    return {s: float(max_repeats * n) if s in capped else (float(left * weights[s]) / open_w if open_w else 0.0) for s, n in sizes.items()}


def route(capacity: Sequence[int], members: Sequence[Sequence], quota: dict, max_repeats: int) -> list[dict]:
    """Words sent from each pattern to each of its sources, at least total cost.

    ``capacity[p]``: words of one pass over pattern p.  The cost of a word
    rises with the pass, and costs lie on the arcs into patterns alone, so
    raising those capacities pass by pass and augmenting along shortest
    residual paths keeps the flow cheapest at every step.
    """
    sent: list[dict] = [dict.fromkeys(m, 0) for m in members]
    used, need = [0] * len(capacity), dict(quota)
    holders: dict = {}
    for p, m in enumerate(members):
        for s in sent[p]:
            holders.setdefault(s, []).append(p)
    for passes in range(1, max_repeats + 1):
        for start in range(len(capacity)):
            while (free := passes * capacity[start] - used[start]) > 0:
                # Residual search: pattern -> its sources; source -> patterns that send to it.
                back: dict = {("p", start): None}
                queue, end = deque([("p", start)]), None
                while queue and end is None:
                    kind, x = node = queue.popleft()
                    for nxt in ([("s", s) for s in sent[x]] if kind == "p" else [("p", p) for p in holders[x] if sent[p][x] > 0]):
                        if nxt not in back:
                            back[nxt] = node
                            if nxt[0] == "s" and need.get(nxt[1], 0) > 0:
                                end = nxt
                                break
                            queue.append(nxt)
                if end is None:
                    break
                path = [end]
                while back[path[-1]] is not None:
                    path.append(back[path[-1]])
                path.reverse()
                step = min([free, need[end[1]], *(sent[b[1]][a[1]] for a, b in zip(path, path[1:]) if a[0] == "s")])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        sent[a[1]][b[1]] += step
                    else:
                        sent[b[1]][a[1]] -= step
                used[start] += step
                need[end[1]] -= step
    return sent


def _ordered(docs: DataFrame, members: Column, id_col: str, text_col: str, seed: int, *keep: Column) -> DataFrame:
    """``keep``, doc_id, members, size, the seeded order and the pattern's number of each row."""
    order = F.md5(F.concat(F.lit(f"mix-{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(*keep, F.col(id_col).alias("doc_id"), members.alias("members"), words(F.col(text_col)).alias("size"), order.alias("order"))
    return rows.withColumn("pattern", F.xxhash64(F.to_json(F.struct("members")), F.size("members")))


def _hint(few: bool):
    """Tables with a row a pattern are broadcast only if there are few."""
    return F.broadcast if few else lambda df: df


def _cuts(rows: DataFrame, plan: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """Where the last pass of each pattern ends.

    (pattern, cut: the hash cell in which it ends), and the rows of those cells
    with the words taken of each (``part``).
    """
    small = _hint(few)
    own = rows.join(small(plan), "pattern").withColumns({"c1": F.substring("order", 1, _CELL), "c2": F.substring("order", 1, 2 * _CELL)})
    cut = plan.select("pattern", F.col("extra").alias("left"))
    for cell in ("c1", "c2"):
        inside = own if cell == "c1" else own.join(small(cut), ["pattern", "c1"])
        sums = inside.groupBy("pattern", cell).agg(F.sum("size").alias("sum"))
        before = F.expr(f"sum(sum) over (partition by pattern order by {cell} rows between unbounded preceding and current row) - sum")
        # The cell in which the wanted words end: what is needed beyond the cells before it is in it.
        found = sums.withColumn("before", before).join(small(cut.select("pattern", "left")), "pattern").filter("before < left and left <= before + sum")
        cut = materialize(found.select("pattern", cell, (F.col("left") - F.col("before")).alias("left")), "mix-cut")
    last = own.join(small(cut), ["pattern", "c2"]).withColumn("before", F.expr("sum(size) over (partition by pattern order by order, doc_id, size rows between unbounded preceding and current row) - size"))
    last = last.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("before"))))
    return cut.select("pattern", F.col("c2").alias("cut")), materialize(last.select(*rows.columns, "passes", "part"), "mix-last")


def _below(rows: DataFrame, plan: DataFrame, cut: DataFrame, few: bool) -> DataFrame:
    """``rows`` with passes, cut, and ``part``: all of a row before the cut, nothing of one after it."""
    own = rows.join(_hint(few)(plan.select("pattern", "passes")), "pattern").join(_hint(few)(cut), "pattern", "left")
    return own.withColumn("part", F.when(F.substring("order", 1, 2 * _CELL) < F.col("cut"), F.col("size")).otherwise(0))


def _closed(patterns: DataFrame, weights: dict | None, max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """(plan, sources) of patterns (pattern, members, size) with one source each.

    Sources in the order of their share per weight: those before the first one
    that its share of the rest does not exceed stop at ``max_repeats`` times
    their size, the others share what these leave.  The windows over all
    sources hold one row a source.
    """
    spark = patterns.sparkSession
    one = patterns.filter(F.size("members") == 1).select("pattern", F.col("members")[0].alias("source"), "size")
    if weights is None:
        weighed = one.withColumn("w", 1 + (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3)
    else:
        given = spark.createDataFrame(list(weights.items()), T.StructType([T.StructField("of", one.schema["source"].dataType), T.StructField("w", T.IntegerType())]))
        weighed = one.join(given, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    order = Window.orderBy(F.col("size") / F.col("w"), F.col("source").asc_nulls_last())
    total = patterns.agg(F.sum("size")).first()[0] or 0
    capped = F.coalesce(F.sum(max_repeats * F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = weighed.withColumns({"k": F.row_number().over(order), "capped": capped, "open_w": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))})
    ranked = materialize(ranked, "mix-ranked")
    first = ranked.filter((F.lit(total) - F.col("capped")) * F.col("w") <= max_repeats * F.col("size") * F.col("open_w")).agg(F.min_by(F.struct("k", "capped", "open_w"), "k")).first()[0]
    limit = F.col("size") * max_repeats
    if first is None:  # every source stops at its limit
        goal = limit.cast("double")
    else:
        goal = F.when(F.col("k") < first["k"], limit.cast("double")).otherwise((F.lit(total - first["capped"]) * F.col("w")).cast("double") / first["open_w"])
    solved = ranked.select("pattern", "source", "size", goal.alias("target")).withColumn("quota", F.floor("target").cast("long"))
    some = F.col("size") > 0
    passes, extra = F.when(some, F.floor(F.col("quota") / F.col("size"))).otherwise(0).cast("long"), F.when(some, F.col("quota") % F.col("size")).otherwise(0).cast("long")
    plan = solved.select("pattern", passes.alias("passes"), extra.alias("extra"))
    none = patterns.filter(F.size("members") != 1).select("pattern", F.lit(0).cast("long").alias("passes"), F.lit(0).cast("long").alias("extra"))
    return materialize(plan.union(none), "mix-plan"), materialize(solved.select("source", F.col("size").alias("source_size"), "target"), "mix-sources")


def _planned(docs: DataFrame, members: Column, id_col: str, text_col: str, weights: dict | None, max_repeats: int, seed: int, max_patterns: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(rows, plan: passes and extra words of each pattern, sources, whether patterns are few)."""
    spark = docs.sparkSession
    rows = materialize(_ordered(docs, members, id_col, text_col, seed), "mix-rows")
    patterns = materialize(rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")), "mix-patterns")
    if patterns.count() > max_patterns:
        if not patterns.filter(F.size("members") > 1).isEmpty():
            raise ValueError(f"more than {max_patterns} patterns of overlapping sources; group the sources first")
        plan, sources = _closed(patterns, weights, max_repeats)
        return rows, plan, sources, False
    found = patterns.orderBy("pattern").collect()
    sizes: dict = {}
    for r in found:
        for s in dict.fromkeys(r["members"] or ()):
            sizes[s] = sizes.get(s, 0) + r["size"]
    goal = targets(sizes, weights or cycle_weights(list(sizes)), max_repeats, sum(r["size"] for r in found))
    sent = route([r["size"] for r in found], [r["members"] or [] for r in found], {s: int(t) for s, t in goal.items()}, max_repeats)
    plan = [(r["pattern"], *(divmod(sum(to.values()), r["size"]) if r["size"] else (0, 0))) for r, to in zip(found, sent, strict=True)]
    kind = docs.select(members.alias("m")).schema["m"].dataType.elementType
    schema = T.StructType([T.StructField("source", kind), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    sources = spark.createDataFrame([(s, n, goal[s]) for s, n in sizes.items()], schema)
    return rows, spark.createDataFrame(plan, "pattern long, passes long, extra long"), sources, True


def mix(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", weights: dict | None = None, max_repeats: int = 3, seed: int = 0, max_patterns: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(documents, sources).

    ``members`` is the array of sources of a row.  Documents: doc_id, members,
    size, taken.  Sources: source, source_size, target.
    """
    rows, plan, sources, few = _planned(docs, members, id_col, text_col, weights, max_repeats, seed, max_patterns)
    cut, last = _cuts(rows, plan, few)
    rest = _below(rows, plan, cut, few).filter(F.col("cut").isNull() | (F.substring("order", 1, 2 * _CELL) != F.col("cut")))
    both = rest.select(*last.columns).union(last)
    return both.select("doc_id", "members", "size", (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken")), sources


def by_source(docs: DataFrame, source_col: str = "source", **params) -> DataFrame:
    """Mix of documents with one source each: doc_id, source, size, source_size, target, taken."""
    taken, sources = mix(docs, F.array(source_col), **params)
    taken = taken.withColumn("source", F.col("members")[0])
    own = sources.withColumnRenamed("source", "of")
    few = own.count() <= params.get("max_patterns", 20_000)
    return taken.join(_hint(few)(own), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, max_repeats: int = 3, seed: int = 0, max_patterns: int = 20_000, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it.

    The document that a quota cuts stays whole if at least half of it is
    taken; documents without words stay once; rows that share doc_id and size at
    the cut are all taken as the fullest of them.  Texts are not shuffled: rows
    compare their place in the seeded order with the cut of their pattern, and
    only the few rows of the cut cells look their part up (in a broadcast of at
    most ``broadcast_rows``, else in a join).
    """
    members = F.array(source_col)
    rows, plan, _, few = _planned(docs, members, id_col, text_col, weights, max_repeats, seed, max_patterns)
    cut, last = _cuts(rows, plan, few)
    own = _below(_ordered(docs, members, id_col, text_col, seed, F.struct(*docs.columns).alias("row")), plan, cut, few)
    edge = last.groupBy("pattern", F.substring("order", 1, 2 * _CELL).alias("cut"), "order", "size").agg(F.max("part").alias("at_edge"))
    if edge.count() <= broadcast_rows:
        edge = F.broadcast(edge)
    part = F.coalesce("at_edge", "part")
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("passes") + F.when(2 * part >= F.col("size"), 1).otherwise(0)).cast("int")
    placed = own.join(edge, ["pattern", "cut", "order", "size"], "left").withColumn("times", times).filter("times > 0")
    return placed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")
