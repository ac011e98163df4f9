"""Model snapshots: Parquet tables, and the JSON form."""

from __future__ import annotations

import base64
import json
import time
import zlib
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "cluster_id long, template_tokens array<string>, size long"
VERSION = "0.1.1"


class Store(Protocol):
    """Where a snapshot's bytes are kept."""

    def save(self, state: bytes) -> None: ...

    def load(self) -> bytes | None: ...


class MemoryStore:
    def __init__(self) -> None:
        self.state: bytes | None = None

    def save(self, state: bytes) -> None:
        self.state = state

    def load(self) -> bytes | None:
        return self.state


class FileStore:
    """A file behind any path that Hadoop file systems can open; missing files load as None."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _open(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, state: bytes) -> None:
        fs, p = self._open()
        out = fs.create(p, True)
        out.write(bytearray(state))
        out.close()

    def load(self) -> bytes | None:
        fs, p = self._open()
        if not fs.exists(p):
            return None
        return bytes(self.spark.read.format("binaryFile").load(self.path).first()["content"])


def to_json(model: DataFrame, compress: bool = False, most: int = 5_000_000) -> bytes:
    """The JSON snapshot of a model (a bounded table; larger ones are kept as Parquet)."""
    rows = model.orderBy("cluster_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} clusters; write the model as Parquet")
    state = {
        "version": VERSION,
        "clusters_counter": max((r["cluster_id"] for r in rows), default=0),
        "clusters": [{"cluster_id": r["cluster_id"], "log_template_tokens": list(r["template_tokens"]), "size": r["size"]} for r in rows],
    }
    data = json.dumps(state, ensure_ascii=False).encode()
    return base64.b64encode(zlib.compress(data)) if compress else data


def from_json(spark: SparkSession, state: bytes | None) -> DataFrame:
    """The model of a snapshot; no snapshot gives an empty model."""
    if not state:
        return spark.createDataFrame([], SCHEMA)
    if state.lstrip()[:1] != b"{":
        state = zlib.decompress(base64.b64decode(state))
    rows = [(c["cluster_id"], c["log_template_tokens"], c["size"]) for c in json.loads(state)["clusters"]]
    return spark.createDataFrame(rows, SCHEMA)


class Snapshots:
    """When to save: after any change, else once the interval is over."""

    def __init__(self, store: Store, minutes: float = 1, compress: bool = False):
        self.store, self.minutes, self.compress = store, minutes, compress
        self._saved = time.monotonic()

    def reason(self, changed: bool) -> str | None:
        if changed:
            return "changed"
        return "periodic" if time.monotonic() - self._saved >= self.minutes * 60 else None

    def offer(self, model: DataFrame, changed: bool) -> str | None:
        """Save if there is a reason; the reason."""
        why = self.reason(changed)
        if why:
            self.store.save(to_json(model, self.compress))
            self._saved = time.monotonic()
        return why


def save(model: DataFrame, path: str) -> None:
    model.select("cluster_id", "template_tokens", "size").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A model written by ``save``; an empty one where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.parquet(path)


def describe(model: DataFrame) -> DataFrame:
    """One text line per cluster."""
    return model.select(F.format_string("ID=%-5s : size=%-10s: %s", "cluster_id", "size", F.array_join("template_tokens", " ")).alias("line"))
