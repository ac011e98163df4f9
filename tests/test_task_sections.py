"""Sections that tasks spend their time in."""

import time

import pyarrow as pa

from logloom.config import MinerConfig
from logloom.miner import TemplateMiner
from logloom.profiler import TaskSections


def test_sections_add_up_over_tasks(spark):
    lines = spark.createDataFrame([(i, f"{' '.join(['go'] * (i % 5 + 1))} {i}") for i in range(400)], "msg_id long, line string").repartition(4)
    miner = TemplateMiner(spark, MinerConfig(profiling=True))
    mined = miner.mine(lines)
    miner.match(lines).collect()
    rows = mined.join(lines, "msg_id").withColumnRenamed("template_mined", "template")
    miner.extract(rows).collect()
    found = miner.sections.sums
    assert {k: v[1] for k, v in found.items()} == {"fold": 400, "lookup": 400 + 8 * miner.model.count(), "extract": 400}
    assert all(seconds > 0 and tasks >= 1 for seconds, _, tasks in found.values()) and len(miner.sections.lines()) == 3
    assert TemplateMiner(spark).sections is None


def test_waiting_for_input_is_left_out(spark):
    sections = TaskSections(spark)
    rows = spark.range(0, 40, numPartitions=2)

    def slow(batches):
        for b in batches:
            time.sleep(0.2)
            yield b

    def same(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns, ["id"])

    rows.mapInArrow(sections.timed("inner", slow), "id long").mapInArrow(sections.timed("outer", same), "id long").collect()
    assert sections.sums["inner"][0] > 0.35 and sections.sums["outer"][0] < 0.2
    assert sections.sums["inner"][1:] == sections.sums["outer"][1:] == (40, 2)
