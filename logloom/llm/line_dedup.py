"""Line dedup through a sharded minimal perfect hash over line hashes.

A line's key is the line without white space at its ends and with A-Z lowered.
Keys of at least ``min_chars`` code points that occur in at least ``min_docs``
documents lose all their lines except in the largest doc_id that holds them.

1. Every document emits the 128-bit hash of each distinct long key once; a
   native aggregation counts the documents of each and takes the largest id.
2. The keys that occur often enough are dealt to shards of bounded size.  A
   task turns its shard into a minimal perfect hash (levels of bit arrays with
   ranks) over the first 64 bits, and stores the other 64 bits as fingerprint,
   the document count and the largest id in arrays addressed by it.  The shards
   are written to the shared folder.
3. Documents probe the arrays.  Arrays of up to ``broadcast_bytes`` go to all
   tasks.  Larger ones stay where they are: the documents' keys are dealt to the
   shards by hash, each probing task holds the arrays of one shard and streams
   the keys past them, and what was found goes back to its documents.  A shard
   whose keys occur often is probed by as many tasks as its counts call for.

Defined results: a null or empty text is one empty line and stays as it is
(null becomes empty); rows that repeat a doc_id are one document in the counts,
and all rows that share the largest doc_id keep their lines; rows without
doc_id count as one document, which comes before all others; extra columns pass
through ``apply``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, small_batches, trimmed

_BLANK = b" \t\n\x0b\x0c\r"
_NO_ID = -(2**63)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; another seed gives another hash function."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over uint64 keys as levels of ranked bit arrays.

    A level has ``gamma`` bits a key; keys that are alone at their bit are
    placed, the rest go to the next level.  What is left after the last level
    (keys that are equal, or very unlucky) is kept as a plain list.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 2.0, max_levels: int = 24):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        base, left = 0, keys
        for level in range(max_levels):
            if not len(left):
                break
            m = max(64, int(gamma * len(left)) // 64 * 64 + 64)
            at = _mix(left, level) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            per_word = np.bitwise_count(words).astype(np.int64)
            self.levels.append((m, words, base + np.concatenate([[0], np.cumsum(per_word)[:-1]])))
            base += int(per_word.sum())
            left = left[~alone[at.astype(np.int64)]]
        self.placed, self.rest = base, left

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1 where no level has it (not a member)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (m, words, ranks) in enumerate(self.levels):
            at = (_mix(keys[todo], level) % np.uint64(m)).astype(np.int64)
            word, bit = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (words[word] & bit) != 0
            w = word[hit]
            out[todo[hit]] = ranks[w] + np.bitwise_count(words[w] & (bit[hit] - np.uint64(1)))
            todo = todo[~hit]
        return out


class Shard:
    """Perfect hash, fingerprints, counts and keepers of one shard's keys."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, keeper: np.ndarray):
        self.hash = PerfectHash(h1)
        at = self.hash(h1)
        unplaced = np.isin(h1, self.hash.rest) if len(self.hash.rest) else np.zeros(len(h1), bool)
        placed = ~unplaced
        n = self.hash.placed
        self.fingerprint, self.count, self.keeper = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for own, values in ((self.fingerprint, h2), (self.count, count), (self.keeper, keeper)):
            own[at[placed]] = values[placed]
        self.rest = {(int(a), int(b)): int(k) for a, b, k in zip(h1[unplaced], h2[unplaced], keeper[unplaced], strict=True)}
        if unplaced.any():  # keys without a place: their counts follow the arrays
            self.count = np.concatenate([self.count, count[unplaced]])

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are members, and their keepers."""
        at = self.hash(h1)
        known = at >= 0
        known[known] = self.fingerprint[at[known]] == h2[known]
        keeper = np.full(len(h1), _NO_ID, dtype=np.int64)
        keeper[known] = self.keeper[at[known]]
        if self.rest:
            for i in np.flatnonzero(~known):
                if (k := self.rest.get((int(h1[i]), int(h2[i])))) is not None:
                    known[i], keeper[i] = True, k
        return known, keeper


def long_keys(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """All lines, the numbers of those with a long key, and the keys' 128-bit hashes."""
    lines = (text or b"").split(b"\n")
    at, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(_BLANK).lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                at.append(i)
                digests.append(xxhash.xxh3_128_digest(key))
    return lines, at, digests


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _keys_of(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            owner, digests = [], []
            for i, text in enumerate(texts):
                own = dict.fromkeys(long_keys(text, min_chars)[2])
                owner += [i] * len(own)
                digests += own
            h1, h2 = _halves(digests)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[owner].astype(np.int64))], ["h1", "h2", "id"])

    return run


def repeated_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """Hashes of the keys found in at least ``min_docs`` documents: h1, h2, n, keeper."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(trimmed(_keys_of(min_chars)), "h1 long, h2 long, id long")
    return found.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs)


def _build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    import pickle

    h1, h2, n, keeper = (rows[c].to_numpy() for c in ("h1", "h2", "n", "keeper"))
    shard = Shard(h1.view(np.uint64), h2.view(np.uint64), n, keeper)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "uses": pa.array([int(shard.count.sum())], pa.int64()), "arrays": pa.array([pickle.dumps(shard)], pa.binary())})


def build_shards(keys: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: its number, how many keys of documents it holds in all, and its arrays."""
    return keys.withColumn("shard", F.pmod("h2", F.lit(n_shards))).groupBy("shard").applyInArrow(_build, "shard long, uses long, arrays binary")


def _drop(probe, min_chars: int, id_at: int, text_at: int):
    """Batches with the text replaced and n_lines, n_dropped, kept_sha256 added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text_at)):
            ids = batch.column(id_at).cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            split = [long_keys(t, min_chars) for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            sizes = np.array([len(s[1]) for s in split], dtype=np.int64)
            h1, h2 = _halves([d for s in split for d in s[2]])
            known, keeper = probe(h1, h2, batch, np.repeat(np.arange(len(split)), sizes))
            gone = known & (keeper != np.repeat(ids, sizes))
            texts, n_lines, n_dropped, shas, start = [], [], [], [], 0
            for (lines, at, _), n in zip(split, sizes.tolist(), strict=True):
                mark = gone[start : start + n]
                start += n
                n_lines.append(len(lines))
                n_dropped.append(int(mark.sum()))
                if n_dropped[-1]:
                    drop = {i for i, m in zip(at, mark, strict=True) if m}
                    lines = [line for i, line in enumerate(lines) if i not in drop]
                texts.append(b"\n".join(lines))
                shas.append(hashlib.sha256(texts[-1]).hexdigest())
            columns = [batch.column(i) for i in range(len(batch.schema.names)) if batch.schema.names[i] != "hits"]
            columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(shas, pa.string())]
            names = [n for n in batch.schema.names if n != "hits"] + ["n_lines", "n_dropped", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _probe_shards(shards, n_shards: int):
    """Probe of broadcast arrays."""

    def probe(h1, h2, _batch, _row):
        import pickle

        known, keeper = np.zeros(len(h1), bool), np.full(len(h1), _NO_ID, dtype=np.int64)
        own = np.mod(h2.view(np.int64), n_shards)
        for s in np.unique(own).tolist():
            if (packed := shards.value.get(s)) is not None:
                if isinstance(packed, bytes):
                    packed = shards.value[s] = pickle.loads(packed)
                at = np.flatnonzero(own == s)
                known[at], keeper[at] = packed.probe(h1[at], h2[at])
        return known, keeper

    return probe


def _probe_hits(h1, h2, batch, row):
    """Probe of what was found for each row."""
    found = [{(h["h1"], h["h2"]): h["keeper"] for h in hits or ()} for hits in batch.column("hits").to_pylist()]
    keeper = [found[r].get((a, b)) for r, a, b in zip(row.tolist(), h1.view(np.int64).tolist(), h2.view(np.int64).tolist(), strict=True)]
    return np.array([k is not None for k in keeper], dtype=bool), np.array([_NO_ID if k is None else k for k in keeper], dtype=np.int64)


def _own_keys(min_chars: int):
    """(id, content, h1, h2) for each distinct long key of each (id, text, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            row, digests = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                mine = dict.fromkeys(long_keys(text, min_chars)[2])
                row += [i] * len(mine)
                digests += mine
            h1, h2 = _halves(digests)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["id", "content", "h1", "h2"])

    return run


def _stream_past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, salt, arrays, id, content, h1, h2), the arrays of a shard before its keys: those of other documents' lines."""
    import pickle

    at, shard = None, None
    for batch in batches:
        places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        starts = [i for i, p in enumerate(places) if i == 0 or p != places[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(places)], strict=True):
            if places[a] != at:
                at, shard = places[a], None
            if (packed := batch.column(2)[a].as_py()) is not None:
                shard, a = pickle.loads(packed), a + 1
            if shard is None or a == b:
                continue
            own = batch.slice(a, b - a)
            h1, h2 = (own.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (5, 6))
            known, keeper = shard.probe(h1, h2)
            hit = pa.array(known & (keeper != own.column(3).to_numpy(zero_copy_only=False)))
            found = pa.RecordBatch.from_arrays([own.column(3), own.column(4), own.column(5), own.column(6), pa.array(keeper)], ["id", "content", "h1", "h2", "keeper"])
            yield found.filter(hit)


def _dealt_hits(own: DataFrame, shards: DataFrame, n_shards: int, min_chars: int, task_keys: int) -> DataFrame:
    """Lines to drop of each (id, content): hits, found by probing each shard with the keys dealt to it."""
    keys = own.mapInArrow(trimmed(_own_keys(min_chars)), "id long, content long, h1 long, h2 long").distinct()
    sizes = materialize(shards.select("shard", F.greatest(F.lit(1), F.ceil(F.col("uses") / task_keys)).cast("int").alias("salts")), "line-salts")
    nothing = [F.lit(None).cast("long").alias(c) for c in ("id", "content", "h1", "h2")]
    arrays = shards.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "arrays", *nothing)
    asked = keys.withColumn("shard", F.pmod("h2", F.lit(n_shards))).join(sizes, "shard")
    asked = asked.select("shard", F.pmod(F.xxhash64("id", "content"), F.col("salts")).cast("int").alias("salt"), F.lit(None).cast("binary").alias("arrays"), "id", "content", "h1", "h2")
    met = arrays.union(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("arrays").isNull())
    found = met.mapInArrow(trimmed(_stream_past), "id long, content long, h1 long, h2 long, keeper long")
    return found.groupBy("id", "content").agg(F.collect_list(F.struct("h1", "h2", "keeper")).alias("hits"))


def _dedup(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, shard_keys: int, broadcast_bytes: int, task_keys: int) -> DataFrame:
    """``docs`` with columns c0.. (text replaced) and the three counts."""
    spark = docs.sparkSession
    small_batches(spark)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    fields = [T.StructField(f"c{i}", T.StringType() if i == text_at else f.dataType) for i, f in enumerate(docs.schema.fields)]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    keys = materialize(repeated_keys(docs, id_col, text_col, min_chars, min_docs), "line-keys")
    n_keys = keys.count()
    n_shards = max(1, -(-n_keys // shard_keys))
    shards = materialize(build_shards(keys, n_shards), "line-shards")
    if n_keys * 28 <= broadcast_bytes:  # 8 + 8 + 8 bytes of arrays and under 4 of bits a key
        arrays = spark.sparkContext.broadcast({r["shard"]: bytes(r["arrays"]) for r in shards.collect()})
        return rows.mapInArrow(trimmed(_drop(_probe_shards(arrays, n_shards), min_chars, id_at, text_at)), schema)
    names = {"id": F.coalesce(F.col(f"c{id_at}").cast("long"), F.lit(_NO_ID)), "content": F.xxhash64(f"c{text_at}")}
    own = rows.select(names["id"].alias("id"), F.col(f"c{text_at}").cast("binary").alias("text"), names["content"].alias("content"))
    hits = _dealt_hits(own, shards, n_shards, min_chars, task_keys)
    joined = rows.withColumns(names).join(hits, ["id", "content"], "left")
    return joined.select(*rows.columns, "hits").mapInArrow(trimmed(_drop(_probe_hits, min_chars, id_at, text_at)), schema)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, shard_keys: int = 50_000, broadcast_bytes: int = 64 << 20, task_keys: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, text (what stays), n_lines, n_dropped, kept_sha256."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _dedup(slim, "doc_id", "text", min_chars, min_docs, shard_keys, broadcast_bytes, task_keys).withColumnsRenamed({"c0": "doc_id", "c1": "text"})


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with all its columns, the repeated lines gone from the text."""
    done = _dedup(docs, id_col, text_col, **{"min_chars": 40, "min_docs": 5, "shard_keys": 50_000, "broadcast_bytes": 64 << 20, "task_keys": 2_000_000} | params)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
