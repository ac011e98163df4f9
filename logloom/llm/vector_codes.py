"""Product codes of vectors by exact integer clustering with bitmask search.

Components become integers, so sums and distances are exact and any order of
the rows gives the same codebooks.  Each vector is cut into equal parts; every
part position has a codebook.

The nearest entry of a part is found by slices: in each dimension the entries'
coordinates are sorted, and position i carries the mask of the first i entries
as uint64 words.  For a radius, two binary searches in each dimension give the
range of entries within it, as the difference of two prefix masks; the AND over
dimensions leaves the entries inside the box, and only those are compared.  A
distance within the radius is final; else the radius becomes the best distance
found, or doubles where the box was empty.

A round is one pass over the rows.  Tasks send sums and counts by (part, entry)
only, whatever the number of rows; the codebooks (parts x entries) are all that
the driver holds.  Rounds read the input again rather than keep a copy of it.

Defined results: rows whose vector is null or holds null or non-finite
components, and rows whose vector has not the commonest length (ties: the
longest), are left out; a length that the parts do not divide is an error; null
ids are kept and come last when entries are chosen, rows that repeat an id are
rows of their own, chosen by their components; with fewer rows than entries the
codebooks are as small as the table; an empty table gives an empty result;
other columns are ignored.  Distances are exact for components of any size; an
error that a 64-bit integer cannot state raises OverflowError.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, trimmed

_NEVER = 1 << 62


@dataclass
class Slices:
    """Sorted coordinates and prefix masks of one codebook (entries x dimensions)."""

    entries: np.ndarray
    sorted: list[np.ndarray]  # by dimension: coordinates in order
    masks: np.ndarray  # dimension, position, word: entries before the position
    radius: int  # where the search begins

    @classmethod
    def of(cls, entries: np.ndarray) -> Slices:
        n, dims = entries.shape
        words = max(1, -(-n // 64))
        masks = np.zeros((dims, n + 1, words), np.uint64)
        columns = []
        for d in range(dims):
            order = sorted(range(n), key=lambda i: entries[i, d])  # noqa: B023
            columns.append(entries[order, d])
            for place, i in enumerate(order):
                masks[d, place + 1] = masks[d, place]
                masks[d, place + 1, i // 64] |= np.uint64(1 << i % 64)
        # Half of the mean spread of the coordinates: boxes that hold a few entries.
        spread = sum(int(c[-1] - c[0]) for c in columns) // max(1, 4 * dims) if n else 0
        return cls(entries, columns, masks, max(1, spread))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry and squared distance of each row, ties to the lower entry; how many distances were computed."""
        n, best, compared = len(x), np.zeros(len(x), np.int64), 0
        far = np.full(n, _NEVER if x.dtype != object else None, x.dtype)
        radius, todo = np.full(n, self.radius, x.dtype), np.arange(n)
        while len(todo):
            inside = None
            for d, column in enumerate(self.sorted):
                at, r = x[todo, d], radius[todo]
                low, high = np.searchsorted(column, at - r, side="left"), np.searchsorted(column, at + r, side="right")
                between = self.masks[d][high] ^ self.masks[d][low]
                inside = between if inside is None else inside & between
            found = np.zeros(len(todo), bool)
            for e, entry in enumerate(self.entries):
                has = np.flatnonzero((inside[:, e // 64] >> np.uint64(e % 64)) & np.uint64(1))
                rows = todo[has]
                distance = ((x[rows] - entry) ** 2).sum(axis=1)
                compared += len(rows)
                nearer = np.array([a is None or b < a for a, b in zip(far[rows], distance, strict=True)], bool) if x.dtype == object else distance < far[rows]
                # A later, wider box repeats distances; the lower entry of equal ones stays.
                again = (distance == far[rows]).astype(bool) & (e < best[rows])
                change = rows[nearer | again]
                far[change], best[change] = distance[nearer | again], e
                found[has] = True
            edge = radius[todo]
            closed = np.zeros(len(todo), bool)
            closed[found] = far[todo[found]] <= edge[found] * edge[found]
            radius[todo] = np.where(found, _ceil_root(np.where(found, far[todo], 0)), edge * 2)
            todo = todo[~closed]
        return best, far, compared


def _ceil_root(squares: np.ndarray) -> np.ndarray:
    """Whole numbers at least as large as the roots."""
    if squares.dtype == object:
        return np.array([math.isqrt(int(s)) + 1 for s in squares], object)
    return np.sqrt(squares.astype(float)).astype(np.int64) + 2


def _integers(batch: pa.RecordBatch, column: int, scale: int, books: list[np.ndarray]) -> np.ndarray:
    """Components times scale, floored; whole numbers of any size where squares may not fit 64 bits."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(flat * scale).reshape(len(batch), -1)
    highest = max([np.abs(x).max(initial=0), *(float(max(map(abs, b.ravel()), default=0)) for b in books)])
    if 4 * highest * highest * max(1, x.shape[1]) < 2**60:
        return x.astype(np.int64)
    return np.array([[math.floor(v * scale) for v in row] for row in flat.reshape(len(batch), -1).tolist()], object).reshape(x.shape)


def _assigned(x: np.ndarray, books: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances by row and part."""
    width = x.shape[1] // len(books)
    parts = [book.nearest(x[:, p * width : (p + 1) * width]) for p, book in enumerate(books)]
    return np.stack([p[0] for p in parts], axis=1), np.stack([p[1] for p in parts], axis=1)


def _same_kind(books: list[np.ndarray], x: np.ndarray) -> list[Slices]:
    return [Slices.of(b.astype(x.dtype)) for b in books]


def _sums(books: list[np.ndarray], scale: int):
    """(cell, dim, total, n) of a task's parts, cell being part * entries + entry; totals as decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, width = books[0].shape
        totals = np.zeros((len(books) * entries, width), object)
        counts = np.zeros(len(books) * entries, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = _integers(batch, 0, scale, books)
            codes, _ = _assigned(x, _same_kind(books, x))
            cells = (codes + np.arange(len(books)) * entries).ravel()
            counts += np.bincount(cells, minlength=len(counts))
            own = np.zeros(totals.shape, x.dtype)
            np.add.at(own, cells, x.reshape(-1, width))
            totals += own.astype(object)
        cell, dim = np.nonzero(np.repeat(counts[:, None] > 0, width, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(dim, pa.int32()), pa.array([str(v) for v in totals[cell, dim]]), pa.array(counts[cell])], ["cell", "dim", "total", "n"])

    return run


def _coded(books: list[np.ndarray], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _integers(batch, 2, scale, books)
            codes, far = _assigned(x, _same_kind(books, x))
            digits = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            errors = [sum(map(int, row)) for row in far.tolist()]
            if max(errors) >= 1 << 63:
                raise OverflowError("an error does not fit 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digits), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def _usable(vectors: DataFrame, vec_col: str) -> tuple[Column, int]:
    """The condition on rows that take part, and their vectors' length (0: there are none)."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    first = vectors.filter(finite).groupBy(F.size(v).alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    length = first["length"] if first else 0
    return finite & (F.size(v) == length), length


@dataclass
class Codebooks:
    """Trained entries by part, and the settings they were made with."""

    parts: list[np.ndarray]
    scale: int

    def sha256(self) -> str:
        """Of all entries' components in decimal by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(int(v)) for book in self.parts for v in book.ravel()).encode()).hexdigest()


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks after ``rounds`` of assignment and floored means, begun with the rows of the smallest ids."""
    usable, length = _usable(vectors, vec_col)
    if length % parts:
        raise ValueError(f"{parts} parts do not divide {length} components")
    if not length:
        return Codebooks([], scale)
    v = F.col(vec_col).cast("array<double>")
    kept = vectors.filter(usable).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()  # bounded by entries
    start = np.array([[math.floor(x * scale) for x in r["v"]] for r in first], object)
    width = length // parts
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(trimmed(_sums(books, scale)), "cell int, dim int, total string, n long")
        # One number a task for each cell and dimension; their sums are all the driver gets.
        whole = sums.groupBy("cell", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in whole.collect():  # parts x entries x width rows at most
            p, e = divmod(r["cell"], len(first))
            books[p][e, r["dim"]] = int(r["total"]) // r["n"]
    return Codebooks(books, scale)


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of the rows that take part: entry of each part in two hex digits or more, and squared distance."""
    usable, length = _usable(vectors, vec_col)
    rows = vectors.filter(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, code string, error long"
    if not length:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return rows.mapInArrow(trimmed(_coded(books.parts, books.scale)), schema)


def codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **settings) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes by codebooks fitted on the same rows.

    label_error is the error of all rows of a label; nulls are one label.
    """
    books = fit(vectors, id_col, vec_col, **settings)
    rows = materialize(encode(vectors, books, id_col, vec_col, label_col), "vector-codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    met = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
