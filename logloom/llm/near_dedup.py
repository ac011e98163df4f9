"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles; the
``k`` smallest are its sketch (the whole set, where that is not larger).

1. *Classes of copies.*  Documents with equal sets (a 128-bit hash of the set)
   collapse to the smallest doc_id, map-side combined; only one representative
   goes on, so thousands of exact copies cost one.
2. *Inverted lists.*  Retained values are counted over all representatives.
   If two sets reach the threshold, their sketches share at least ``m`` values,
   hence one among the ``s - m + 1`` rarest of either sketch of size ``s``, in
   the one global order (count, value).  Only those go on lists, so frequent
   shingles are on hardly any list.  For sets that fit their sketch this is
   exact; else ``m`` is such that a pair right at the threshold is missed with
   probability below 1e-8.
3. *Overlaps.*  Rows of lists become candidate pairs in two passes.  First every
   member meets the list's most central member (the one with the fewest values
   of its own) and, on its longest list, its neighbour in a seeded order.  The links found merge most
   of a group of near copies.  Then members of different components meet on the
   lists that still hold several.  Long lists are split for that by a second value
   (``_split``): unrelated texts share one value of a long list, hardly ever two of
   their few rarest, so the pairs grow with the documents where the lists grow too.
   Documents whose lists have more members than their set has
   values are first listed anew by their full sets, each entry with its place in the order.  The first
   value that two sets share bounds how much they can share after it, so an
   entry states the largest partner it can still be linked with, and members
   meet through classes of size that both bounds admit (``_refined``): first with
   the few most central members of each list, whose links merge most of what is
   left of a group, then all that are still in different components.  Thousands
   of near copies that miss the threshold with each other differ in more values
   than those bounds allow, hence hardly meet.
4. *Filter.*  The union of two sketches estimates the similarity; pairs far
   below the threshold (again below 1e-8) go.
5. *Exact check* of the rest on the full sets, hashed once a document and sent
   once a pair, then components.  Shingles are compared by 64-bit hashes; two
   different ones of a pair of documents agree with probability below 1e-13.

Defined results: null and empty texts have an empty set and are linked with
nothing; fewer words than a shingle make one shingle of all words; rows that
repeat a doc_id are one document with several texts, linked by any of them; a
null doc_id takes no part in links and is kept; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches, trimmed
from .components import components

_P = np.uint64(0x9DDFEA08EB382D69)
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    n = len(h) - width + 1
    acc = np.full(n, width, np.uint64)
    for i in range(width):
        acc = (acc ^ h[i : i + n]) * _P
        acc ^= acc >> np.uint64(29)
    acc = (acc ^ (acc >> np.uint64(33))) * _F1
    acc = (acc ^ (acc >> np.uint64(33))) * _F2
    return np.unique(acc ^ (acc >> np.uint64(33)))


def tail_bound(k: int, share: float, miss: float = 1e-8) -> int:
    """Largest m with P(Binomial(k, share) < m) <= miss."""
    total, m = 0.0, 0
    while m < k:
        total += math.comb(k, m) * share**m * (1 - share) ** (k - m)
        if total > miss:
            break
        m += 1
    return m


def prefix_length(n: int, k: int, percent: int) -> int:
    """How many of the rarest sketch values of a set of ``n`` are listed."""
    least = -(-n * percent // 100)  # shared values of a pair right at the threshold, and of the smaller set
    if n * 100 <= k * percent:
        return n - least + 1
    return min(n, k) - min(tail_bound(k, percent / 100), least) + 1


def _sketches(words: int, k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gid, sketch, listed = [], [], [], []
            for part in slices(batch, 1):
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, words)
                    n.append(len(s))
                    gid.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sketch.append(s[:k].tobytes())
                    listed.append(prefix_length(len(s), k, percent) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gid, pa.binary()), pa.array(sketch, pa.binary()), pa.array(listed, pa.int32())], ["doc_id", "n", "gid", "sketch", "listed"])

    return run


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, doc, rep) for each value of each sketch or set."""
    for batch in (part for whole in batches for part in slices(whole, 2)):
        sizes = np.array([len(s) // 8 for s in batch.column(2).to_pylist()], dtype=np.int64)
        values = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.int64)
        doc, rep = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(doc), pa.array(rep)], ["value", "doc", "rep"])


def union_overlaps(x: list[bytes], y: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: shared values among the ``k`` smallest of the union of two sketches,
    how many those are, and how many values the union has."""
    width = k * 2
    rows = np.full((len(x), width), np.iinfo(np.uint64).max, np.uint64)
    for at, side in ((0, x), (k, y)):
        sizes = np.array([len(s) // 8 for s in side])
        flat = np.frombuffer(b"".join(side), np.uint64)
        row = np.repeat(np.arange(len(side)), sizes)
        rows[row, at + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    total = np.array([(len(a) + len(b)) // 8 for a, b in zip(x, y, strict=True)])
    rows.sort(axis=1)
    real = np.arange(width)[None, :] < total[:, None]
    again = np.zeros(rows.shape, bool)
    again[:, 1:] = (rows[:, 1:] == rows[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)  # place of each value among the distinct ones
    return (again & (rank <= k)).sum(axis=1), np.minimum(rank[:, -1], k), rank[:, -1]


def _estimated(k: int, percent: int):
    least = np.array([tail_bound(u, percent / 100) for u in range(k + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            shared, size, union = union_overlaps(batch.column(2).to_pylist(), batch.column(3).to_pylist(), k)
            whole = (nx <= k) & (ny <= k) & (union <= k)
            keep = np.where(whole, 100 * shared >= percent * size, shared >= least[size])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _exact(percent: int):
    """Rows (a, salt, b, set) sorted by these: the sets of ``a`` have no b and come before those to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for part in slices(batch, 3):
                for a, salt, b, packed in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    x = np.frombuffer(packed, np.uint64)
                    if (a, salt) != at:
                        at, own = (a, salt), []
                    if b is None:
                        own.append(x)
                    elif any(100 * (shared := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - shared) for y in own):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], ["a", "b"])

    return run


_SIGNS = ("s0", "s1", "s2", "s3")


def signature(values: np.ndarray) -> np.ndarray:
    """256 bits of a set, each the parity of the values that fall on it.

    Two sets differ in at least as many values as their signatures in bits.
    """
    odd = np.bincount((values >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(words: int):
    """(doc, rep, n, shingle set as bytes, signature) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                values = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                sets = [v.tobytes() for v in values]
                signs = np.array([signature(v) for v in values], np.int64).reshape(-1, len(_SIGNS)).T
                reps, n = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in sets], [len(x) // 8 for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(reps, pa.int64()), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), *(pa.array(x) for x in signs)], ["doc", "rep", "n", "set", *_SIGNS])

    return run


def _sets_of(texts: DataFrame, ids: DataFrame, words: int, broadcast_ids: int) -> DataFrame:
    """The distinct sets of some documents, written; one each but for repeated ids."""
    own = _texts_of(texts, ids, broadcast_ids).mapInArrow(trimmed(_sets(words)), "doc long, rep long, n long, set binary, " + ", ".join(f"{c} long" for c in _SIGNS))
    return materialize(own.filter("n > 0").dropDuplicates(["doc", "rep"]), "near-sets")


def _texts_of(texts: DataFrame, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """The texts of some documents; few ids are broadcast, so that no text is shuffled to be left out."""
    return texts.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "doc", "left_semi")


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, words: int, k: int, percent: int, broadcast_ids: int, head_rows: int = 4096) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets.

    A task compares the set of one document with up to ``head_rows`` others.
    """
    side = reps.select("doc", "sketch", "n")
    met = pairs.join(side.toDF("a", "x", "nx"), "a").join(side.toDF("b", "y", "ny"), "b").select("a", "b", "x", "y", "nx", "ny")
    likely = materialize(met.mapInArrow(trimmed(_estimated(k, percent)), "a long, b long").distinct(), "near-likely")
    ids = materialize(likely.select(F.col("a").alias("doc")).union(likely.select("b")).distinct(), "near-ids")
    sets = _sets_of(texts, ids, words, broadcast_ids).select("doc", "set")
    heads = materialize(likely.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / head_rows).cast("int").alias("salts")), "near-heads")
    own = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets.toDF("a", "set"), "a")
    others = likely.join(heads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b").join(sets.toDF("b", "set"), "b")
    both = own.select("a", "salt", F.lit(None).cast("long").alias("b"), "set").union(others.select("a", "salt", "b", "set"))
    dealt = both.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialize(dealt.mapInArrow(trimmed(_exact(percent)), "a long, b long"), "near-links")


def _ranked(entries: DataFrame, own: DataFrame) -> DataFrame:
    """Shared values of ``entries`` (value, doc, rep) with their place in the order of their set.

    ``own`` has one row a set: doc, rep, size (values it entered), and more.
    Adds df, alone (values that only this set has; they come first) and place.
    """
    # Written first, so that both sides of the join are plain shuffles and a hot value's rows can be split.
    shared = materialize(entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "near-shared")
    mine = entries.join(shared, "value").join(own, ["doc", "rep"])
    per_doc = Window.partitionBy("doc", "rep")
    alone = F.col("size") - F.count(F.lit(1)).over(per_doc)
    rank = F.row_number().over(per_doc.orderBy("df", "value"))
    return mine.withColumns({"alone": alone, "rank": rank}).withColumn("place", F.col("rank") + F.col("alone"))


#: Groups that the values of long lists fall into; two values of one group make a key.
_GROUPS = 3


def _listed(reps: DataFrame) -> DataFrame:
    """Inverted lists: (value, doc, n, df, alone, last, listed, few) of the rarest values of each sketch.

    ``last``: the doc's most frequent listed one.  ``_GROUPS`` more values follow
    the listed ones (``listed`` is false).  ``few``: linked partners may share
    ``_GROUPS`` values or fewer.
    """
    own = reps.select("doc", F.xxhash64("gid").alias("rep"), "n", (F.length("sketch") / 8).cast("int").alias("size"), "listed", "sketch")
    entries = own.select("doc", "rep", "sketch").mapInArrow(trimmed(_values), "value long, doc long, rep long")
    ranked = _ranked(entries, own.drop("sketch")).filter(F.col("place") <= F.col("listed") + _GROUPS)
    last, listed, few = F.col("place") == F.least("listed", "size"), F.col("place") <= F.col("listed"), F.col("size") - F.col("listed") < _GROUPS
    return ranked.select("value", "doc", "n", "df", "alone", last.alias("last"), listed.alias("listed"), few.alias("few"))


def _split(mixed: DataFrame, short_list: int) -> DataFrame:
    """Lists (value, doc, n, comp) on which every pair meets that may be linked; those of values with df > ``short_list`` are split.

    Linked sets share m values or more of either sketch, so the first _GROUPS + 1
    shared ones are among the listed and the _GROUPS after them, where m is more than
    _GROUPS.  Either one of these is on a short list, or two of them are of long lists
    and of one group: that pair of values is a key.  Sets that share fewer
    (``few`` on both sides) meet on the long lists of their listed values.
    """
    short = mixed.filter(F.col("listed") & ((F.col("df") <= short_list) | F.col("few"))).select("value", "doc", "n", "comp")
    grouped = mixed.filter(F.col("df") > short_list).groupBy("doc", "n", "comp", F.pmod(F.xxhash64("value"), F.lit(_GROUPS)).alias("g"))
    several = grouped.agg(F.sort_array(F.collect_set("value")).alias("vs")).filter(F.size("vs") > 1)
    keys = F.flatten(F.transform("vs", lambda x, i: F.transform(F.slice("vs", i + 2, F.size("vs")), lambda y: F.xxhash64(x, y))))
    return short.union(several.select(F.explode(keys).alias("value"), "doc", "n", "comp"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Entries (value, comp, ...) of lists that hold several components, with the largest one (main) and the list's length."""
    sizes = placed.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("members"))
    main = sizes.groupBy("value").agg(F.max(F.struct("members", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("members").alias("length"))
    return materialize(placed.join(main.filter("comps > 1").select("value", F.col("top.comp").alias("main"), "length"), "value"), "near-mixed")


def _far(a: str, b: str, percent: int):
    """Set sizes alone rule the pair out."""
    return F.least(F.col(a), F.col(b)) * 100 < F.greatest(F.col(a), F.col(b)) * percent


def _placed(hot: DataFrame, texts: DataFrame, words: int, percent: int, broadcast_ids: int) -> DataFrame:
    """Documents (doc, comp) on lists by their full sets, written: value, doc, n, alone, reach, band, signature.

    Sets of ``a`` and ``b`` values reach the threshold if they share
    ``percent * (a + b) / (100 + percent)`` values.  If the first one they share,
    in the order of all values, is at place i of the set of ``a`` values, they
    share ``1 + a - i`` at most, so ``b`` is at most ``reach``.
    """
    sets = _sets_of(texts, hot.select("doc"), words, broadcast_ids)
    entries = sets.select("doc", "rep", "set").mapInArrow(trimmed(_values), "value long, doc long, rep long")
    ranked = _ranked(entries, sets.select("doc", "rep", "n", F.col("n").alias("size"), *_SIGNS))
    reach = F.floor((1 + F.col("n") - F.col("place")) * (100 + percent) / percent + 1e-9).cast("long") - F.col("n")
    placed = ranked.withColumn("reach", reach).filter(F.col("reach") * 100 >= F.col("n") * percent)
    return materialize(placed.select("value", "doc", "n", "alone", "reach", F.floor(F.log("n") * 50).cast("int").alias("band"), *_SIGNS), "near-placed")


def _alike(left: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components, one of ``left`` and one of ``mixed``, that may be linked.

    Members meet through classes of size that the bounds of both admit.  Pairs whose
    signatures differ in more bits than linked sets may differ in values are out.
    """
    bands = mixed.groupBy("value", "band").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("furthest"))
    left, right = left.drop("band").alias("l"), mixed.alias("r")
    asked = left.join(bands, "value").filter(f"low <= l.reach and high * 100 >= l.n * {percent} and l.n <= furthest")
    asked = asked.select("value", "band", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("doc", "comp", "n", "reach", *_SIGNS)])
    differ = sum((F.bit_count(F.col(f"l_{c}").bitwiseXOR(F.col(f"r.{c}"))) for c in _SIGNS), F.lit(0))
    both = F.col("l_n") + F.col("r.n")
    alike = differ <= both - 2 * F.ceil(both * percent / (100 + percent) - 1e-9)
    met = asked.join(right, ["value", "band"]).filter("l_comp <> r.comp and r.n <= l_reach and l_n <= r.reach").filter(~_far("l_n", "r.n", percent) & alike)
    return met.select(F.least("l_doc", "r.doc").alias("a"), F.greatest("l_doc", "r.doc").alias("b")).distinct()


def _centres(mixed: DataFrame, centres: int) -> DataFrame:
    """Up to ``centres`` members of each list and class of size: those with the fewest values of their own."""
    kept = ("doc", "comp", "n", "reach", *_SIGNS)
    top = mixed.groupBy("value", "band", F.pmod(F.xxhash64("doc"), F.lit(centres)).alias("h")).agg(F.min(F.struct("alone", *kept)).alias("top"))
    return top.select("value", "band", *[F.col(f"top.{c}").alias(c) for c in kept])


def _refined(placed: DataFrame, comps: DataFrame, percent: int, centres: int = 0) -> DataFrame:
    """Pairs (a, b) of different components (doc, comp) that full sets allow to be linked; with ``centres``, those of a list's most central members alone."""
    mixed = _mixed(placed.join(comps, "doc"))
    return _alike(_centres(mixed, centres) if centres else mixed.filter("comp <> main"), mixed, percent)


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (doc, comp) after more links, written."""
    ends = links.join(comps.toDF("a", "x"), "a").join(comps.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    to = components(ends).toDF("comp", "to")
    return materialize(comps.join(to, "comp", "left").select("doc", F.coalesce("to", "comp").alias("comp")), "near-merged")


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    k: int = 32,
    salt_size: int = 4096,
    list_cost: float = 1.0,
    broadcast_ids: int = 500_000,
    centres: int = 4,
    short_list: int = 8,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``percent``: least similarity, as 100 * intersection >= percent * union.
    ``salt_size``: members of one list that share a task while neighbours are
    paired.  ``list_cost``: a document is listed by its full set where its lists
    of sketch values have more members than this many times its values.
    ``broadcast_ids``: most ids (8 bytes each) that are broadcast to
    fetch texts; more are joined by a shuffle.  ``centres``: how many central members
    of a list and class of size meet its others first, where documents are listed anew.
    ``short_list``: how many documents hold a value at most whose list is not split.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = materialize(rows.mapInArrow(trimmed(_sketches(words, k, percent)), "doc_id long, n long, gid binary, sketch binary, listed int"), "near-sketches")
    usable = signed.filter("doc_id is not null and n > 0")
    reps = materialize(usable.groupBy("gid").agg(F.min(F.struct("doc_id", "n", "sketch", "listed")).alias("r")).select("gid", F.col("r.doc_id").alias("doc"), "r.n", "r.sketch", "r.listed"), "near-reps")
    texts = rows.select(F.col("doc_id").alias("doc"), "text")
    wide = materialize(_listed(reps), "near-lists")
    lists = wide.filter("listed")

    heads = lists.groupBy("value").agg(F.min(F.struct("alone", "doc", "n")).alias("head"))
    stars = lists.join(heads, "value").select(F.col("head.doc").alias("a"), F.col("doc").alias("b"), F.col("head.n").alias("na"), F.col("n").alias("nb"))
    salt = F.pmod(F.xxhash64("doc"), F.ceil(F.col("df") / salt_size)).alias("salt")
    order = Window.partitionBy("value", "salt").orderBy(F.xxhash64("doc", F.lit(7)), "doc")
    beside = lists.withColumn("salt", salt).select(F.lag("doc").over(order).alias("a"), F.col("doc").alias("b"), F.lag("n").over(order).alias("na"), F.col("n").alias("nb"), "last").filter("last").drop("last")
    first = stars.union(beside).filter(~_far("na", "nb", percent) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = materialize(first, "near-first")
    links = _verified(first, reps, texts, words, k, percent, broadcast_ids)
    found = components(links)

    mixed = _mixed(wide.filter(F.col("listed") | (F.col("df") > short_list)).drop("alone", "last").join(found.toDF("doc", "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc")))
    mixed = _mixed(_split(mixed, short_list))
    # A document whose lists are longer in all than its set is listed anew; the pairs of the
    # others are fewer than their values.  Pairs of two listed anew are found by their full sets.
    loads = mixed.groupBy("doc", "comp").agg(F.sum("length").alias("load"), F.max("n").alias("most"))
    hot = materialize(loads.filter(F.col("load") > list_cost * F.col("most")).select("doc", "comp"), "near-hot")
    marked = mixed.join(hot.select("doc", F.lit(True).alias("hot")), "doc", "left")
    marked = materialize(marked.withColumn("hot", F.coalesce("hot", F.lit(False))), "near-marked")
    # Members that are listed anew do not meet here, so the pairs are bounded by the others' loads.
    left, right = marked.filter(~F.col("hot")).alias("l"), marked.alias("r")
    cross = left.join(right, "value").filter("l.comp <> r.comp and (r.hot or l.doc < r.doc)").filter(~_far("l.n", "r.n", percent)).select(F.least("l.doc", "r.doc").alias("a"), F.greatest("l.doc", "r.doc").alias("b"))
    placed = _placed(hot, texts, words, percent, broadcast_ids)
    if centres:  # links of central members merge most of what is left of a group, before all that may be linked meet
        central = _verified(_refined(placed, hot, percent, centres), reps, texts, words, k, percent, broadcast_ids)
        links, hot = links.union(central), _merged(hot, central)
    more = cross.union(_refined(placed, hot, percent)).distinct().join(first, ["a", "b"], "left_anti")
    labels = components(links.union(_verified(more, reps, texts, words, k, percent, broadcast_ids)))

    classes = reps.join(labels.toDF("doc", "component"), "doc", "left").select("gid", F.coalesce("component", "doc").alias("component"))
    return signed.join(classes, "gid", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", broadcast_ids: int = 500_000, **params) -> DataFrame:
    """``docs`` without the documents that a smaller doc_id of their group stands for.

    Up to ``broadcast_ids`` dropped ids (8 bytes each) are broadcast, so that
    texts are not shuffled; more are met in a shuffled join.
    """
    classes = near_classes(docs, id_col, broadcast_ids=broadcast_ids, **params)
    dropped = materialize(classes.filter(~F.col("kept")).select("doc_id").distinct(), "near-dropped")
    if dropped.count() <= broadcast_ids:
        dropped = F.broadcast(dropped)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    return rows.join(dropped, "doc_id", "left_anti").select("row.*")
