"""Exact dedup over an extendible-hash index on shared files (native only).

1. Every text is reduced to a 64-bit key; index entries (doc_id, key, SHA-256)
   go to the shared folder, and keys are counted.
2. Keys that occur once need nothing more.  The others make the directory: it
   starts as one cell for all keys and doubles while a bucket holds more than
   ``bucket_capacity`` different keys, and each doubling splits the overfull
   buckets alone.  A bucket is a range of keys of its own depth; directory slots
   of the full depth point to buckets.
3. Texts of repeated keys go, with the bucket that the directory names, to the
   owner of the bucket.  The owner processes that key range: rows of a key form
   a chain, and are told apart by the bytes of their texts (the text itself is
   the grouping key, so equal hashes never merge different texts).  The buckets
   with their chains are written to the shared folder, and entries take their
   class from there.

Scale: a text is read twice and shuffled once, and only if its key occurs more
than once.  Keys with more than ``hot_rows`` rows are combined where they are
read before they go to their owner, so a text that makes up a third of all rows
costs no more than any other, nor do copies ever split a bucket.

Defined results: a null text equals an empty one; rows that repeat a doc_id
count as rows of their own; a null doc_id is ordered after all others and its
row is kept only if the whole group has no id; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# A run of white space that is not just one blank; single blanks stay as they are.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """``text`` with every run of blanks, tabs and line ends as one blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def _slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, most: int = 40) -> DataFrame:
    """Buckets: depth, the number of bits that all keys of the bucket share, and slot, these bits.

    ``keys`` has one row per distinct key.  Each doubling is one aggregation over
    the keys of overfull buckets and brings one number to the driver; buckets
    that can't be split further (``most`` bits) stay as they are.
    """
    whole = keys.sparkSession.range(1).select(F.lit(0).cast("long").alias("slot"), F.lit(0).alias("depth"))
    done, depth, open_keys = None, 0, keys
    while True:
        cells = materialize(open_keys.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "exact-cells")
        if depth:  # both halves of a bucket are buckets, also where one holds no key
            halves = above.select(F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)).alias("slot"))
            cells = materialize(halves.join(cells, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n")), "exact-cells")
        full = cells.filter(F.col("n") > capacity)
        last = depth == most or full.isEmpty()
        level = (cells if last else cells.filter(F.col("n") <= capacity)).select("slot", F.lit(depth).alias("depth"))
        done = level if done is None else done.union(level)
        if last:
            done = whole if depth == 0 else done
            return materialize(done, "exact-directory")
        above = full.select("slot")
        open_keys = open_keys.join(above, _slot(F.col("key"), depth) == F.col("slot"), "left_semi")
        depth += 1


def with_bucket(rows: DataFrame, buckets: DataFrame, broadcast_slots: int) -> DataFrame:
    """``rows`` with the number of the bucket that holds their ``key``.

    The directory has a slot for each prefix of the full depth; it is broadcast
    up to ``broadcast_slots`` slots (16 bytes each), else joined by a shuffle.
    """
    depth = buckets.agg(F.max("depth")).first()[0]
    wide = F.expr(f"shiftleft(1L, {depth} - depth)")
    first = F.col("slot") * wide
    slots = buckets.select(F.explode(F.sequence(first, first + wide - 1)).alias("slot"), first.alias("bucket"))
    if 1 << depth <= broadcast_slots:
        slots = F.broadcast(slots)
    return rows.withColumn("slot", _slot(F.col("key"), depth)).join(slots, "slot").drop("slot")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_capacity: int = 1024,
    broadcast_keys: int = 500_000,
    broadcast_slots: int = 4_000_000,
    hot_rows: int = 200,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``broadcast_keys`` bounds the repeated keys (12 bytes each) that may be
    broadcast; beyond it the texts meet their keys in a shuffled join.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("norm"))
    entries = materialize(
        text.select("doc_id", F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha")),
        "exact-entries",
    )
    keys = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "exact-keys")
    buckets = directory(keys.select("key"), bucket_capacity)
    repeated = with_bucket(keys, buckets, broadcast_slots).select("key", "bucket", (F.col("n") > hot_rows).alias("hot"))
    if keys.count() <= broadcast_keys:
        repeated = F.broadcast(repeated)
    rows = text.withColumn("key", F.xxhash64("norm")).join(repeated, "key").select("bucket", "key", "norm", "hot", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    combined = [F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    owned = rows.filter("not hot").drop("hot")
    if not keys.filter(F.col("n") > hot_rows).isEmpty():
        owned = owned.unionByName(rows.filter("hot").groupBy("bucket", "key", "norm").agg(*combined))
    owned = owned.repartition("bucket")
    # Grouped where the bucket is: all rows of a bucket are in its owner's task already.
    chains = owned.groupBy("bucket", "key", "norm").agg(*combined)
    classes = materialize(chains.select("bucket", "key", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size").sortWithinPartitions("bucket", "key"), "exact-buckets")
    return entries.join(classes.drop("bucket"), ["key", "sha"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
