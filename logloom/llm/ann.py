"""Approximate nearest neighbours by multiprobe p-stable hashing.

Cosine order on unit vectors is Euclidean order.  Each of ``tables`` hash tables
has Gaussian (2-stable) projections with cells open to both sides, so a bucket
is one bit a projection, and as many projections as make buckets of about
``bucket_rows`` rows: buckets grow in number with the rows.

A query visits the buckets of a table in order of estimated success.  A
neighbour with cosine ``c`` projects normally around ``c`` times the query's own
projection, which gives the chance of every bucket; visited are the likeliest
ones that together hold such a neighbour with probability ``s``, where ``tables``
tries of ``s`` give ``recall``.  The least chance that is visited, a number for
each query and table, stands for the whole list of buckets.  ``c`` is fitted on
a bounded sample (``fit_rows`` rows) and is the k-th best cosine that 60 % of its
different vectors reach (the rank taken down by the share of rows sampled).

Rows are dealt by the leading bits of their bucket (a region of about
``block_rows`` rows).  A query goes to the regions that hold a bucket it visits;
there it is compared, exactly and in double precision, with the rows of those
buckets alone.  A region's rows and queries come in blocks, so a vector that a
third of all rows repeat is spread over many tasks.  The tables' candidates are
merged by the best scores; a query that met fewer than ``k`` is compared with
all rows in a second pass.

Defined results: rows whose vector is null, empty, zero, of another length than
most, or holds null or non-finite components take no part; repeated rows of one
vec_id count once for each different vector, and a vec_id is found by its best
vector; a query never finds its own vec_id; with fewer candidates than ``k`` all
are returned; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches

@dataclass(frozen=True)
class Tables:
    """The hash functions and the cosine that probing expects."""

    lines: np.ndarray  # tables x projections x dimensions
    cosine: float
    success: float  # wanted of one table
    leading: int  # bits that name the region

    def bits(self, t: int, unit: np.ndarray) -> np.ndarray:
        return unit @ self.lines[t].T > 0

    def logs(self, t: int, unit: np.ndarray) -> np.ndarray:
        """Log chance of each side of each projection (rows x projections x 2) for a neighbour of the rows."""
        z = self.cosine * (unit @ self.lines[t].T) / math.sqrt(1 - self.cosine**2)
        return np.log(np.maximum(np.stack([_normal(-z), _normal(z)], axis=2), 1e-12))

    def least(self, logs: np.ndarray) -> np.ndarray:
        """Log chance of the last bucket that rows visit: drawn neighbours fall below it with probability 1 - success."""
        drawn = np.random.default_rng(1).random((400, logs.shape[1]))
        out = np.empty(len(logs))
        for i, own in enumerate(logs):
            out[i] = np.sort(np.where(drawn < np.exp(own[:, 1]), own[:, 1], own[:, 0]).sum(axis=1))[int(400 * (1 - self.success))]
        return out - 1e-9


def sums(logs: np.ndarray) -> np.ndarray:
    """Log chance of all buckets over some projections; the first is the highest bit."""
    out = np.zeros(1)
    for own in logs:
        out = (out[:, None] + own[None, :]).ravel()
    return out


def numbers(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as integers, the first bit the highest."""
    return bits.astype(np.int64) @ (1 << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int64))


def _normal(z: np.ndarray) -> np.ndarray:
    """Standard normal distribution function (logistic-cubic approximation, good to 1e-3)."""
    x = np.clip(z, -9, 9)
    return 1 / (1 + np.exp(-(1.5976 * x + 0.070566 * x**3)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, dim)


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector as doubles in bytes, dim) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, dims = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                a = np.array(v, np.float64)
                if np.isfinite(a).all() and a.any():
                    ids.append(i)
                    out.append(a.tobytes())
                    dims.append(len(a))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "vector", "dim"])

    return rows.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "vec_id long, vector binary, dim int")


def fit(vectors: DataFrame, dim: int, n: int, tables: int, recall: float, bucket_rows: int, block_rows: int, fit_rows: int, seed: int, k: int) -> Tables:
    """Draw the hash functions for ``n`` rows and fit the expected cosine on a seeded sample."""
    bits = min(48, max(0, round(math.log2(max(1, n) / bucket_rows))))
    lines = np.random.default_rng(seed).standard_normal((tables, bits, dim))
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "vector").limit(fit_rows).toPandas().drop_duplicates("vec_id").drop_duplicates("vector")
    cosine = 0.0
    if len(sample) > 1:
        unit = _unit(np.frombuffer(b"".join(sample["vector"]), np.float64).reshape(-1, dim))
        near = unit[:256] @ unit.T
        near[np.arange(len(near)), np.arange(len(near))] = -2
        # The k-th of all rows is about that many times nearer the top among fewer.
        at = min(max(1, math.ceil(k * len(unit) / max(1, n))), len(unit) - 1) - 1
        cosine = float(np.clip(np.quantile(-np.partition(-near, at, axis=1)[:, at], 0.4), 0.0, 0.999))
    leading = min(bits, max(0, math.ceil(math.log2(max(1, n) / block_rows))), 40)
    return Tables(lines, cosine, 1 - (1 - recall) ** (1 / tables), leading)


_COLUMNS = "t int, region long, vec_id long, vector binary"


def _part(t: int, region: np.ndarray, batch: pa.RecordBatch, row: np.ndarray | None = None) -> pa.RecordBatch:
    own = [batch.column(i) if row is None else batch.column(i).take(pa.array(row)) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(region), t, np.int32)), pa.array(region.astype(np.int64)), *own], ["t", "region", "vec_id", "vector"])


def _indexed(model: Tables, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, 1)):
            unit = _unit(_rows(batch, dim))
            for t in range(len(model.lines)):
                yield _part(t, numbers(model.bits(t, unit)[:, : model.leading]), batch)

    return run


def _probes(model: Tables, dim: int, everything: bool):
    """Queries in the regions that hold a bucket they visit (in all regions of one table, if ``everything``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, 1, 1 << 18)):
            unit = _unit(_rows(batch, dim))
            for t in range(1 if everything else len(model.lines)):
                logs = model.logs(t, unit)
                least = np.full(len(unit), -np.inf) if everything else model.least(logs)
                rows, regions = [], []
                for i, own in enumerate(logs):
                    beyond = np.r_[np.cumsum(own.max(axis=1)[::-1])[::-1], 0.0]  # best of the projections from here on
                    chance, name = np.zeros(1), np.zeros(1, np.int64)
                    for j in range(model.leading):  # one more bit, unlikely prefixes left out
                        chance, name = (chance[:, None] + own[j][None, :]).ravel(), (2 * name[:, None] + np.arange(2)[None, :]).ravel()
                        keep = chance + beyond[j + 1] >= least[i]
                        chance, name = chance[keep], name[keep]
                    rows.append(np.full(len(name), i))
                    regions.append(name)
                if rows:
                    yield _part(t, np.concatenate(regions), batch, np.concatenate(rows))

    return run


def _best(model: Tables, dim: int, k: int, everything: bool):
    """The best rows of each query of a block, and how many it was compared with (``met``)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf["query"]], pdf[~pdf["query"]]
        out: list[tuple] = []
        if len(q) and len(x):
            t, region = int(pdf["t"].iloc[0]), int(pdf["region"].iloc[0])
            a, b = (np.frombuffer(b"".join(s["vector"]), np.float64).reshape(-1, dim) for s in (q, x))
            na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            ids, own = x["vec_id"].to_numpy(), q["vec_id"].to_numpy()
            fine = numbers(model.bits(t, b / nb[:, None])[:, model.leading :])
            logs = model.logs(t, a / na[:, None])
            least = np.full(len(a), -np.inf) if everything else model.least(logs)
            first = [(region >> (model.leading - 1 - j)) & 1 for j in range(model.leading)]
            for i in range(len(a)):
                inside = logs[i, np.arange(model.leading), first].sum() + sums(logs[i, model.leading :]) >= least[i]
                c = np.flatnonzero(inside[fine] & (ids != own[i]))
                if not len(c):
                    continue
                score = (b[c] * a[i]).sum(axis=1) / (nb[c] * na[i])
                top = np.lexsort((ids[c], -score))
                top = top[np.sort(np.unique(ids[c[top]], return_index=True)[1])[:k]]
                out += [(own[i], ids[c[j]], score[j], len(c) if r == 0 else 0) for r, j in enumerate(top)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "met"])

    return run


def _found(index: DataFrame, asked: DataFrame, model: Tables, dim: int, k: int, block_rows: int, everything: bool) -> DataFrame:
    """(query_id, vec_id, score, met) of the visited buckets, block by block."""
    probes = materialize(asked.mapInArrow(_probes(model, dim, everything), _COLUMNS), "ann-probes")
    size = lambda df, name: df.groupBy("t", "region").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    sizes = materialize(size(index, "xs").join(size(probes, "qs"), ["t", "region"]), "ann-sizes")

    def block(df: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        dealt = df.join(sizes, ["t", "region"]).withColumn(own[0], F.pmod(F.xxhash64("vec_id", "vector"), F.col(own)))
        return dealt.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("t", "region", F.col("x").cast("long"), F.col("q").cast("long"), "vec_id", "vector", F.lit(query).alias("query"))

    met = block(index, "xs", "qs", False).unionByName(block(probes, "qs", "xs", True))
    return met.groupBy("t", "region", "x", "q").applyInPandas(_best(model, dim, k, everything), "query_id long, vec_id long, score double, met long")


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = 8,
    recall: float = 0.94,
    bucket_rows: int = 2,
    fit_rows: int = 4096,
    block_rows: int = 4096,
    seed: int = 0,
) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score, compared (its exact comparisons)."""
    small_batches(rows.sparkSession)
    vectors = materialize(valid_vectors(rows, id_col, vector_col).groupBy("vec_id", "vector", "dim").count(), "ann-vectors")
    asked = valid_vectors(queries, id_col, vector_col).distinct()
    common = vectors.groupBy("dim").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids")).orderBy(F.desc("count"), "dim").first()
    dim, n, ids = (common["dim"], common["n"], common["ids"]) if common else (1, 0, 0)
    vectors, asked = (v.filter(F.col("dim") == dim).select("vec_id", "vector") for v in (vectors, asked))
    model = fit(vectors, dim, n, tables, recall, bucket_rows, block_rows, fit_rows, seed, k)
    index = materialize(vectors.mapInArrow(_indexed(model, dim), _COLUMNS), "ann-index")

    def merged(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("met").alias("met"))
        query = Window.partitionBy("query_id")
        ranked = best.withColumns({"rank": F.row_number().over(query.orderBy(F.desc("score"), "vec_id")), "compared": F.sum("met").over(query)})
        return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")

    out = materialize(merged(_found(index, asked, model, dim, k, block_rows, False)), "ann-found")
    full = out.groupBy("query_id").count().filter(F.col("count") >= min(k, ids - 1)).select("query_id")
    short = materialize(asked.join(full, asked["vec_id"] == full["query_id"], "left_anti"), "ann-short")
    if short.isEmpty():
        return out
    again = merged(_found(index.filter("t = 0"), short, model, dim, k, block_rows, True))
    return out.join(full, "query_id", "left_semi").unionByName(again)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (query_id, vec_id) that were found."""
    total = exact.count()
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / total if total else math.nan
