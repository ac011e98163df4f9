"""Helpers shared by the corpus operators: tables, shared scratch files, ids."""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.scratch import materialize, shared_dir

__all__ = ["WS_CLASS", "crc_mod", "crc_of", "held_out", "labelled", "materialize", "shared_dir", "slices", "small_batches", "table", "trimmed"]

#: Bytes that separate words everywhere in this subpackage: blank and TAB..CR.
WS_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def held_out(doc_id: Column) -> Column:
    """True for rows kept out of every fit (a null id counts as held out)."""
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(True))


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of a bounded sample: the ``max_rows`` labelled ids first in a seeded order.

    Rows that repeat an id enter once, with the text that comes first.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y is not null").filter(~held_out(F.col("id")))
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(max_rows)
    # At most max_rows rows of 12 bytes.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    return rows.groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text")).select("id", "y", "text")


def slices(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose strings or bytes in ``column`` add up to ``limit`` or are one row."""
    start = held = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if held and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    yield batch.slice(start)


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Arrow batches of the session hold ``limit`` bytes at most: texts vary from a word to megabytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # the default; what a user has set stays
        spark.conf.set(key, str(limit))


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: its allocator keeps freed memory as it likes
        return None


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; workers live on between tasks, so freed memory goes back to the system after each."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(_libc(), "malloc_trim"):
                _libc().malloc_trim(0)

    return whole
