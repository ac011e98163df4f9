"""Models and results of a running stream, batch by batch.

``ModelTable`` is the sink of a stream of ``mine_stream`` results.  Each
micro-batch writes three small tables to folders that carry its number: the
results, the clusters it touched as they are after it, and the clusters it
created with their numbers over all root keys.  A batch that runs again after a
failure writes the same folders anew, so every batch counts once.

Cluster numbers follow the first lines: batches in order, msg_ids within one.
A new batch only adds numbers behind those of the batches before, so a number
never changes, and a batch reads of earlier ones no more than their counts.

``model(batch)`` is the model after that batch: for each cluster its last state
up to then.  ``compact`` writes that down as one table, so that later reads need
not go through all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.kernel import CREATED
from logloom.operators.mine import running

_RESULTS = "msg_id long, root_key string, local_id long, change_type string, cluster_size long, template_mined string"
_TOUCHED = "root_key string, local_id long, template string, size long"
_BORN = "root_key string, local_id long, cluster_id long"
_MODEL = "root_key string, local_id long, cluster_id long, template string, size long"


class ModelTable:
    """Results and models of one stream below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        results = f"{self.path}/results/{batch_id:010d}"
        batch.write.mode("overwrite").parquet(results)
        rows = self.spark.read.schema(_RESULTS).parquet(results)
        last = F.max_by("template_mined", "cluster_size").alias("template"), F.max("cluster_size").alias("size")
        rows.groupBy("root_key", "local_id").agg(*last).write.mode("overwrite").parquet(f"{self.path}/touched/{batch_id:010d}")
        born = rows.filter(F.col("change_type") == CREATED).select("msg_id", "root_key", "local_id", F.lit(0).alias("all"))
        numbered = running(born, ["all"], F.lit(True))
        # Written last: its _SUCCESS file says that the batch is whole.
        numbered.select("root_key", "local_id", (F.col("n") + self._born_before(batch_id)).alias("cluster_id")).write.mode("overwrite").parquet(f"{self.path}/born/{batch_id:010d}")

    def start(self, results: DataFrame, checkpoint: str, **trigger):
        """Start a stream of ``mine_stream`` results into this table."""
        return results.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _listed(self, kind: str) -> list[int]:
        """Batches with whole folders of a kind, in order."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS")
        found = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def _read(self, kind: str, batches: list[int], schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{b:010d}" for b in batches]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _born_before(self, batch_id: int) -> int:
        base = max((b for b in self._listed("model") if b < batch_id), default=-1)
        held = self._read("model", [base], _MODEL).count() if base >= 0 else 0
        later = [b for b in self._listed("born") if base < b < batch_id]
        return held + self._read("born", later, _BORN).count()

    def batches(self) -> list[int]:
        """Batches that are whole."""
        return self._listed("born")

    def results(self, upto: int | None = None) -> DataFrame:
        """Results of whole batches, with the number of each line's cluster over all root keys."""
        own = [b for b in self.batches() if upto is None or b <= upto]
        return self._read("results", own, _RESULTS).join(self._read("born", own, _BORN), ["root_key", "local_id"])

    def model(self, upto: int | None = None) -> DataFrame:
        """(cluster_id, template_tokens, size, root_key, local_id) after batch ``upto``, the last one by default."""
        whole = [b for b in self.batches() if upto is None or b <= upto]
        base = max((b for b in self._listed("model") if not whole or b <= whole[-1]), default=-1)
        later = [b for b in whole if b > base]
        known = self._read("model", [base] if base >= 0 else [], _MODEL)
        born = known.select("root_key", "local_id", "cluster_id").union(self._read("born", later, _BORN))
        touched = known.select("root_key", "local_id", "template", "size").union(self._read("touched", later, _TOUCHED))
        # Sizes only grow, so the largest belongs to the last state.
        last = touched.groupBy("root_key", "local_id").agg(F.max_by("template", "size").alias("template"), F.max("size").alias("size"))
        split = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.split("template", " "))
        return born.join(last, ["root_key", "local_id"]).select("cluster_id", split.alias("template_tokens"), "size", "root_key", "local_id")

    def compact(self) -> int | None:
        """Write the model after the last whole batch as one table; that batch's number."""
        if not (whole := self.batches()):
            return None
        model = self.model(whole[-1]).select("root_key", "local_id", "cluster_id", F.array_join("template_tokens", " ").alias("template"), "size")
        model.write.mode("overwrite").parquet(f"{self.path}/model/{whole[-1]:010d}")
        return whole[-1]
