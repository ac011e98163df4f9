"""Best-fit packing of tokenised documents into fixed-length sequences.

1. Tasks tokenise whole texts and cut those longer than a sequence into pieces.
2. Packing needs lengths only, and there are at most ``capacity`` different
   ones, so the whole instance is a histogram of that many counts however many
   documents there are.  ``plan`` solves it on the driver, with multiplicities:
   first the Martello-Toth reduction fixes sets of up to three pieces that
   dominate every other way to fill a sequence with their largest piece; what
   is left is packed best-fit in order of falling length.
3. The plan is a list of runs "the next n pieces of this length go to these
   sequences at this offset".  Tokenising tasks number their pieces of each
   length as they write them, so a piece's rank among all pieces of its length
   is that number and the counts of the tasks before its own: a table of
   (task, length) that is broadcast where it is small.  Pieces look up their
   run in a binary search; neither ids nor texts are shuffled for it.

Defined results: a null or empty text is one piece that holds the end token;
repeated rows are documents of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches, trimmed

#: The one special token of the vocabulary; texts that hold it go to the slower library.
_SPECIAL = "<|endoftext|>"
#: So do texts with white space of that length in a row: the faster library takes time in proportion to the square of such a run.
_LONG_BLANK = 100
_BLANKS = re.compile(r"\s{%d}" % _LONG_BLANK)


@functools.lru_cache(maxsize=2)
def _exact(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@functools.lru_cache(maxsize=2)
def _fast(ranks_path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, json_path: str, ranks_path: str, end_id: int) -> np.ndarray:
    """Ids of a text and the end token.

    Both files hold one vocabulary; the rank file's library gives the same ids
    several times faster, so the other is loaded only where a text needs it.
    """
    if not text:
        return np.array([end_id], dtype="<u4")
    slow = _SPECIAL in text or (len(text) >= _LONG_BLANK and _BLANKS.search(text))
    ids = _exact(json_path).encode(text, add_special_tokens=False).ids if slow else _fast(ranks_path).encode_ordinary(text)
    ids.append(end_id)
    return np.array(ids, dtype="<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be short."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


class _Numbers:
    """Running numbers of pieces within their length."""

    def __init__(self) -> None:
        self.seen: Counter = Counter()

    def __call__(self, lengths: list[int]) -> list[int]:
        out = []
        for x in lengths:
            out.append(self.seen[x])
            self.seen[x] += 1
        return out


def _pieces(capacity: int, json_path: str, ranks_path: str, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids + ["part", "nth"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        number, part = _Numbers(), TaskContext.get().partitionId()
        for batch in (x for whole in batches for x in slices(whole, 1, 2 << 20)):
            rows: list[list] = [[] for _ in kinds]
            kept: list = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(text, json_path, ranks_path, end_id)
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + length]
                    for to, value in zip(rows, (doc_id, piece, start, length, zlib.crc32(own.tobytes())), strict=True):
                        to.append(value)
                    if keep_ids:
                        kept.append(own)
            arrays = [pa.array(v, t) for v, t in zip(rows, kinds, strict=True)]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(rows[3])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).astype(np.int32) if kept else np.zeros(0, np.int32))))
            arrays += [pa.array([part] * len(rows[0]), pa.int32()), pa.array(number(rows[3]), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, part = _Numbers(), TaskContext.get().partitionId()
    for batch in batches:
        nth = number(batch.column(batch.schema.names.index("length")).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], [*batch.schema.names, "part", "nth"])


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, json_path: str | None = None, ranks_path: str | None = None, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids; part and nth number them by task and length."""
    small_batches(docs.sparkSession)
    if json_path is None or ranks_path is None:
        import public_tokenizers as public

        json_path, ranks_path = json_path or public.path("byte_bpe_50k.json"), ranks_path or public.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "") + ", part int, nth long"
    return rows.mapInArrow(trimmed(_pieces(capacity, str(json_path), str(ranks_path), end_id, keep_ids)), schema)


def reduce_instance(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction: fixed (set of lengths, times), removed from ``counts``.

    Works from the longest piece down.  A set that holds piece j is fixed if
    every other feasible set with j can be exchanged for it without need for
    more sequences.  Sets of three are considered where no fourth piece fits.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(*lengths: int) -> None:
        need = Counter(lengths)
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= times * n
        fixed.append((tuple(sorted(lengths, reverse=True)), times))

    def free(x: int, *taken: int) -> int:
        return counts[x] - taken.count(x)

    for j in range(capacity, 0, -1):
        while counts[j] > 0:
            room = capacity - j
            smallest = [x for x in range(1, room + 1) for _ in range(min(3, max(0, free(x, j))))][:3]
            if not smallest:
                fix(j)
                continue
            best = next(x for x in range(room, 0, -1) if free(x, j) > 0)
            if best == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
                fix(j, best)
                continue
            if len(smallest) == 3 and sum(smallest) <= room:
                break
            pair = max(((x + y, x, y) for x in range(room, 0, -1) if free(x, j) > 0 for y in [next((y for y in range(min(x, room - x), 0, -1) if free(y, j, x) > 0), 0)] if y), default=None)
            if pair is None or best >= pair[0]:
                fix(j, best)
                continue
            above = [x for x in range(pair[2] + 1, room + 1) for _ in range(min(2, max(0, free(x, j))))][:2]
            if best == pair[1] and (len(above) < 2 or sum(above) > room):
                fix(j, pair[1], pair[2])
                continue
            break
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit by falling length over counts: (lengths in a sequence, times)."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(pattern: tuple[int, ...], times: int) -> None:
        if times:
            by_room.setdefault(capacity - sum(pattern), []).append((pattern, times))

    for length in range(capacity, 0, -1):
        left = counts[length]
        while left:
            room = next((r for r in range(length, capacity + 1) if by_room.get(r)), None)
            pattern, times = by_room[room].pop() if room is not None else ((), -(-left // (capacity // length)))
            per = (capacity - sum(pattern)) // length  # a part-filled sequence stays the tightest until it is full
            full = min(times, left // per)
            put(pattern + (length,) * per, full)
            left -= full * per
            rest = times - full
            if rest and left:
                put(pattern + (length,) * left, 1)
                rest, left = rest - 1, 0
            if pattern:
                put(pattern, rest)
    return [x for group in by_room.values() for x in group]


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, times)."""
    counts = Counter(lengths)
    return reduce_instance(counts, capacity) + best_fit(counts, capacity)


def _runs(sequences: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of each run, its first sequence, its offset."""
    out: dict[int, list[list[int]]] = {}
    at: Counter = Counter()
    base = 0
    for pattern, times in sequences:
        offset = 0
        for x in pattern:
            out.setdefault(x, []).append([at[x], base, offset])
            at[x] += times
            offset += x
        base += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*runs, strict=True)) for x, runs in out.items()}


def _place(runs):
    """Column function: (sequence_id, offset) of pieces from length and rank."""

    @F.arrow_udf("sequence_id long, offset long")
    def run(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for x in np.unique(length).tolist():
            first, base, off = runs.value[x]
            own = np.flatnonzero(length == x)
            i = np.searchsorted(first, rank[own], side="right") - 1
            sequence[own], offset[own] = base[i] + rank[own] - first[i], off[i]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = 1024, broadcast_rows: int = 4_000_000) -> DataFrame:
    """``pieces`` (length, ...) with sequence_id and offset.

    Pieces without the numbers of ``tokenized`` are numbered and written first;
    else they are a written table already.  ``broadcast_rows``: most rows (24
    bytes each) of the table of counts by task and length that are broadcast;
    more are met in a shuffled join.
    """
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c not in ("part", "nth")]
    if "nth" not in pieces.columns:
        schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pieces.schema.fields) + "part int, nth long"
        pieces = materialize(pieces.mapInArrow(_numbered, schema), "pack-numbered")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    cells = materialize(counts.select("length", "part", "n", before.alias("before")), "pack-cells")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(_runs(plan(histogram, capacity)))
    ends = cells.select("length", "part", "before")
    placed = pieces.join(F.broadcast(ends) if cells.count() <= broadcast_rows else ends, ["length", "part"])
    return placed.withColumn("at", _place(runs)("length", F.col("before") + F.col("nth"))).select(*columns, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, **tokens) -> DataFrame:
    """Pieces of whole documents and their places: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(materialize(tokenized(docs, id_col, text_col, capacity, **tokens), "pack-pieces"), capacity)
