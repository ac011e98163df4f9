"""The ordered fold of one long group of lines, in blocks that are folded at the same time.

What a line does depends on the tree it meets, and few lines change the tree:
those that make a cluster or loosen a template.  So a group is cut into blocks
of msg_ids and each block is folded from a guess of the tree at its beginning.
Then the lines that changed something are folded in order, in one short pass a
group; at each block's beginning this gives the tree that the block should have
begun with.  If a block began with another, it is folded again from that tree.

A line that changes nothing leaves no trace in later decisions (sizes play no
part in them), so if the changing lines of all blocks before are the true ones,
so is the tree found for a block.  The first block begins with the true tree;
hence once every block began with the tree that was found for it, all of them
are what a serial run gives.  Each round settles at least one more block, and
in practice the second or third round is the last.

A tree travels as its clusters in order, each with the tokens that it was made
of and its template: the former rebuild nodes and leaves, the latter decides.
A cluster is named by the place of the line that made it, which is the same
whatever the block began with.

With ``max_clusters`` the order of the clusters' last lines decides as well, but
only when a new cluster drives the oldest out.  Between two new clusters the
last line of each cluster that had any is therefore kept along with those that
changed something, and trees carry that order.  Of clusters that are gone nothing
but the nodes of the tree is kept, so a tree is as large as the bound allows,
however many clusters there were.  All lines are one group then, as the bound is
on all of them.

A small bound forgets soon: nearly all lines change something, but the last ones of
a block decide how it ends.  So with ``max_clusters`` a block is first folded from
what the last lines of the block before leave behind, and hands its own end on to
the next one; the first block is right, so all are, once each began with what the
one before it ended with.  No task sees the lines of all blocks.  Where clusters
outlive blocks, so that most do not agree, the pass over the lines that changed
something is taken instead; it is as long as these are many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.scratch import materialize

from .kernel import CHANGED, CREATED, NONE, Node, Rules, Tree

SEP = "\x1f"
_SKIP, _NODE, _STATE, _ORDER, _LINE = -1, 0, 1, 2, 3  # how many lines are left out, nodes, clusters in order of birth, the order of their last lines, lines
TOUCH = "touch"  # a line that is kept for its turn alone
BEGUN, ENDED, HELD = "begun", "ended", "held"  # digests of the trees that a block began and ended with, rows of the latter
_MOST = 64  # blocks of a group
_WIDTH = 40  # bits of a line's place in its block


def _split(joined: str) -> tuple[str, ...]:
    return tuple(joined.split(SEP)) if joined else ()


class _Traced(Tree):
    """A tree that can be handed on: it knows the tokens its clusters were made of."""

    def __init__(self, rules: Rules):
        super().__init__(rules)
        self.born: dict[int, tuple[str, ...]] = {}

    def restore(self, kind: int, at: int, joined: str, template: str | None) -> None:
        """Put back a row of ``state``."""
        if kind == _NODE:
            key, *path = joined.split(SEP)
            node = self.roots.setdefault(key, Node())
            for token in path:
                node = node.children.setdefault(token, Node())
        elif kind == _STATE:
            self.born[at] = _split(joined)
            self.load(at, self.born[at], 0)
            self.clusters[at][0] = _split(template)
        else:
            self.clusters.move_to_end(int(joined))

    def take(self, tokens: tuple[str, ...], place: int) -> tuple[int, str]:
        """Take a line in; a cluster that it makes is named by its place."""
        self.counter = place - 1
        cluster, change = self.add(tokens)
        if change == CREATED:
            self.born[cluster] = tokens
        return cluster, change

    def _evict(self) -> None:
        while len(self.clusters) > self.rules.max_clusters:
            self.born.pop(self.clusters.popitem(last=False)[0], None)

    def _ends(self) -> Iterator[str]:
        """Root keys and paths of the nodes without children."""
        todo = list(self.roots.items())
        while todo:
            joined, node = todo.pop()
            if not node.children:
                yield joined
            todo += [(joined + SEP + token, child) for token, child in node.children.items()]

    def state(self) -> Iterator[tuple[int, int, str, str | None]]:
        """(kind, at, joined, template) of all clusters; with a bound, of all nodes and the clusters' order too."""
        bound = self.rules.max_clusters is not None
        if bound:  # nodes stay when their clusters have gone
            for place, joined in enumerate(sorted(self._ends())):
                yield _NODE, place, joined, None
        for cluster, born in self.born.items():
            yield _STATE, cluster, SEP.join(born), SEP.join(self.clusters[cluster][0])
        if bound:
            for place, cluster in enumerate(self.clusters):
                yield _ORDER, place, str(cluster), None

    def digest(self, nodes: bool = True) -> int:
        out = hashlib.blake2b(digest_size=8)
        for row in self.state():
            if row[0] == _NODE and not nodes:
                continue
            out.update("\x1e".join(map(str, row)).encode() + b"\x1d")
        return int.from_bytes(out.digest()) % 2**63


def _sent(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows of a schema in batches."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k] for k in kinds]
    for some in batched(rows, 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], list(names))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_FOLDED = "msg_id long, grp string, blk int, local_id long, change_type string, n long, template_mined string, joined string, place long"


def _fold(rules: Rules, base: int):
    """Rows (grp, blk, kind, at, joined, template) in order -> one row a line; ``n`` counts a cluster's lines in the block.

    A block's first row has the digest of the tree that it began with as ``n``, and
    as ``local_id`` the one without nodes.  With ``max_clusters`` lines that are kept
    for their turn come once more, and the tree at the end comes with its digests.
    """
    bound = rules.max_clusters is not None

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, tree, place, begun = None, _Traced(rules), 0, False
        last: dict[int, tuple[int, str, int]] = {}  # each cluster's last line since the last new cluster

        def touched() -> Iterator[tuple]:
            for cluster, (at, joined, place) in last.items():
                yield at, *current, cluster, TOUCH, None, None, joined, place
            last.clear()

        def left() -> Iterator[tuple]:
            if bound and current is not None:
                yield from touched()
                yield None, *current, tree.digest(False), ENDED, tree.digest(), None, None, None
                for kind, at, joined, template in tree.state():
                    yield None, *current, at, HELD, kind, template, joined, None

        for grp, blk, kind, at, joined, template in _rows(batches):
            if (grp, blk) != current:
                yield from left()
                current, tree, place, begun = (grp, blk), _Traced(rules), base + (blk << _WIDTH), False
            if kind == _SKIP:
                place += at
                continue
            if kind != _LINE:
                tree.restore(kind, at, joined, template)
                continue
            if not begun:
                begun = True
                yield None, grp, blk, tree.digest(False) if bound else None, BEGUN, tree.digest(), None, None, None
            place += 1
            cluster, change = tree.take(_split(joined), place)
            if bound:
                if change == CREATED:
                    yield from touched()
                elif change == NONE:
                    last[cluster] = at, joined, place
                else:
                    last.pop(cluster, None)
            template, n = tree.clusters[cluster]
            kept = (None, None) if change == NONE else (joined, place)
            yield at, grp, blk, cluster, change, n, " ".join(template), *kept
        yield from left()

    return lambda batches: _sent(told(batches), _FOLDED)


_FOUND = "grp string, blk int, kind int, at long, joined string, template string"


def _replay(rules: Rules):
    """Rows (grp, blk, kind, at, joined, used) in order of blocks -> trees that blocks should begin with.

    kind -1: a cluster of the model that is taken up; 0: a block begins, ``used``
    being the digest of the tree that it began with; 1: a line that is kept, ``at``
    being its place.  Blocks that began with another tree get a row, and that tree.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, tree = None, _Traced(rules)
        for grp, blk, kind, at, joined, used in _rows(batches):
            if grp != current:
                current, tree = grp, _Traced(rules)
            if kind < 0:
                tree.restore(_STATE, at, joined, joined)
            elif kind > 0:
                tree.take(_split(joined), at)
            elif used != tree.digest():
                yield grp, blk, None, None, None, None
                for row in tree.state():
                    yield grp, blk, *row

    return lambda batches: _sent(told(batches), _FOUND)


def long_groups(lines: DataFrame, block_rows: int) -> DataFrame:
    """(grp, cuts): msg_ids that cut groups of more than two blocks of ``block_rows`` lines into about equal ones."""
    sizes = lines.groupBy("grp").agg(F.count(F.lit(1)).alias("lines"), F.percentile_approx("msg_id", [i / _MOST for i in range(1, _MOST)], 2_000).alias("q"))
    blocks = F.least(F.lit(_MOST), F.ceil(F.col("lines") / block_rows).cast("int"))
    cuts = F.transform(F.sequence(F.lit(1), blocks - 1), lambda i: F.element_at("q", F.floor(i * _MOST / blocks).cast("int")))
    return sizes.filter(F.col("lines") > 2 * block_rows).select("grp", F.array_distinct(cuts).alias("cuts"))


def _block(msg_id: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < msg_id))


def _apart(done: DataFrame, blocks: DataFrame) -> DataFrame:
    """(grp, blk, before, far): blocks that began with another tree than the one before ended with; far: not only in nodes."""
    at = lambda kind, c: F.max(F.when(F.col("change_type") == kind, F.col(c)))
    marks = done.filter(F.col("change_type").isin(BEGUN, ENDED)).groupBy("grp", "blk").agg(at(BEGUN, "n").alias("begun"), at(BEGUN, "local_id").alias("held"), at(ENDED, "n").alias("ended"), at(ENDED, "local_id").alias("left"))
    ends = marks.select("grp", F.col("blk").alias("before"), "ended", "left")
    pairs = blocks.join(marks.select("grp", "blk", "begun", "held"), ["grp", "blk"]).join(ends, ["grp", "before"])
    return pairs.filter("begun <> ended").select("grp", "blk", "before", F.expr("held <> left").alias("far"))


def _handed(done: DataFrame, to: DataFrame) -> DataFrame:
    """Trees for the blocks ``to`` (grp, blk, before): the end of the block before, and the nodes of all before it."""
    held = done.filter(F.col("change_type") == HELD).select("grp", "blk", F.col("n").cast("int").alias("kind"), F.col("local_id").alias("at"), "joined", F.col("template_mined").alias("template"))
    names = ["grp", "blk", "kind", "at", "joined", "template"]
    last = to.select("grp", "blk", "before").join(held.filter(F.col("kind") != _NODE).withColumnRenamed("blk", "before"), ["grp", "before"]).select(names)
    nodes = held.filter(F.col("kind") == _NODE).groupBy("grp", "joined").agg(F.min("blk").alias("since"))
    known = to.select("grp", "blk").join(nodes, "grp").filter("since < blk")
    return last.union(known.select("grp", "blk", F.lit(_NODE), F.lit(0).cast("long"), "joined", F.lit(None).cast("string")))


def fold_long(lines: DataFrame, stored: DataFrame, groups: DataFrame, rules: Rules, base: int = 0, timed: Callable = lambda _, run: run) -> DataFrame:
    """Results of the lines (msg_id, grp, joined) of ``groups`` (grp, cuts), as of a serial fold.

    ``stored``: (at, grp, joined, size) of a model that is taken up.  Columns:
    msg_id, grp, local_id, change_type, cluster_size, template_mined.  ``timed``
    wraps what tasks run, by the name of its section.
    """
    cut = materialize(lines.join(groups, "grp").select("msg_id", "grp", _block(F.col("msg_id"), F.col("cuts")).alias("blk"), "joined"), "blocks-lines")
    first = materialize(stored.join(groups.select("grp"), "grp").select("grp", "at", "joined", "size"), "blocks-stored")
    none = F.lit(None).cast("string")
    blocks = cut.select("grp", "blk").distinct()
    blocks = materialize(blocks.withColumn("before", F.lag("blk").over(Window.partitionBy("grp").orderBy("blk"))), "blocks-all")

    def taken_up(by: DataFrame) -> DataFrame:
        return by.join(first, "grp").select("grp", "blk", F.lit(_STATE).alias("kind"), "at", "joined", F.col("joined").alias("template"))

    def folded(state: DataFrame, part: DataFrame) -> DataFrame:
        given = state.union(part.select("grp", "blk", F.lit(_LINE), "msg_id", "joined", none))
        ordered = given.repartition("grp", "blk").sortWithinPartitions("grp", "blk", "kind", "at", "joined")
        return ordered.mapInArrow(timed("fold", _fold(rules, base)), _FOLDED)

    def written(state: DataFrame) -> DataFrame:
        # A union of joins by block counts as dealt by block already, but adaptive execution deals each side in its own way.
        return materialize(state, "blocks-state")

    # The first guess for every block is the model that is taken up, with a bound what the tenth of the lines before the block make of it.
    state = taken_up(blocks)
    linked = rules.max_clusters is not None
    if linked:
        tails = materialize(cut.groupBy("grp", "blk").agg(F.percentile_approx("msg_id", 0.9, 1_000).alias("tail")), "blocks-tails")
        split = cut.join(tails, ["grp", "blk"])
        skipped = split.filter("msg_id <= tail").groupBy("grp", "blk").agg(F.count(F.lit(1)).alias("at"))
        skipped = skipped.select("grp", "blk", F.lit(_SKIP), "at", none, none)
        ends = materialize(folded(written(state.union(skipped)), split.filter("msg_id > tail")).filter(F.col("change_type") == HELD), "blocks-ends")
        state = written(taken_up(blocks.filter("before is null")).union(_handed(ends, blocks.filter("before is not null"))))
    todo, tables, again, most = cut, [], None, blocks.count()
    while True:
        if tables:
            tables = [t.join(again.select("grp", "blk"), ["grp", "blk"], "left_anti") for t in tables]
        tables.append(materialize(folded(state, todo), "blocks-folded"))
        done = tables[0]
        for t in tables[1:]:
            done = done.unionByName(t)
        if linked:
            broken = materialize(_apart(done, blocks), "blocks-broken")
            bad, far = broken.agg(F.count(F.lit(1)), F.count_if("far")).first()
            if not bad:
                break
            # Ends that hardly depend on beginnings settle in a round or two.
            linked, most = 2 * (far if len(tables) == 1 else bad) <= most, bad
            if linked:
                # What a block hands on may change with what it gets, nodes above all: those after it are folded again, too.
                since = broken.groupBy("grp").agg(F.min("blk").alias("since"))
                again = materialize(blocks.join(since, "grp").filter("blk >= since").select("grp", "blk", "before"), "blocks-again")
                state, todo = written(_handed(done, again)), cut.join(again.select("grp", "blk"), ["grp", "blk"])
                continue
        unset = F.lit(None).cast("long")
        before = first.select("grp", F.lit(-1).alias("blk"), F.lit(-1).alias("kind"), "at", "joined", unset.alias("used"))
        begins = done.filter(F.col("change_type") == BEGUN).select("grp", "blk", F.lit(0).alias("kind"), unset.alias("at"), none.alias("joined"), F.col("n").alias("used"))
        changed = done.filter(F.col("change_type").isin(CREATED, CHANGED, TOUCH)).select("grp", "blk", F.lit(1).alias("kind"), F.col("place").alias("at"), "joined", unset.alias("used"))
        replayed = before.union(begins).union(changed).repartition("grp").sortWithinPartitions("grp", "blk", "kind", "at")
        found = materialize(replayed.mapInArrow(timed("replay", _replay(rules)), _FOUND), "blocks-found")
        again = materialize(found.filter(F.col("kind").isNull()).select("grp", "blk"), "blocks-broken")
        if again.isEmpty():
            break
        state = found.filter(F.col("kind").isNotNull())
        todo = cut.join(again, ["grp", "blk"])
    done = done.filter(F.col("change_type").isin(CREATED, CHANGED, NONE))
    counts = done.groupBy("grp", "blk", "local_id").agg(F.max("n").alias("own"))
    earlier = F.coalesce(F.sum("own").over(Window.partitionBy("grp", "local_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = first.select("grp", F.col("at").alias("local_id"), F.col("size").alias("held"))
    bases = counts.withColumn("earlier", earlier).join(known, ["grp", "local_id"], "left").select("grp", "blk", "local_id", (F.col("earlier") + F.coalesce("held", F.lit(0))).alias("base"))
    return done.join(bases, ["grp", "blk", "local_id"]).select("msg_id", "grp", "local_id", "change_type", (F.col("n") + F.col("base")).alias("cluster_size"), "template_mined")
