"""One model from many, whatever the order in which they meet."""

import itertools
import random

import pytest

from logloom.config import MinerConfig
from logloom.operators import consensus as co
from logloom.operators import mine as mi

P = "<*>"


def brute(rows, percent):
    """Join any two that can be joined, in the order they are given, until none can."""
    rows = [(tuple(t), s, f) for t, s, f in rows]
    while True:
        for i, j in itertools.combinations(range(len(rows)), 2):
            a, b = rows[i][0], rows[j][0]
            if len(a) == len(b) and sum(x != y and P not in (x, y) for x, y in zip(a, b, strict=True)) <= int(percent * len(a) + 1e-9):
                new = (tuple(x if x == y else P for x, y in zip(a, b, strict=True)), rows[i][1] + rows[j][1], min(rows[i][2], rows[j][2]))
                rows = [r for k, r in enumerate(rows) if k not in (i, j)] + [new]
                break
        else:
            return sorted(rows)


def templates(seed, n=60):
    rng = random.Random(seed)
    return [([rng.choice(["a", "b", "c", "d", P]) for _ in range(rng.choice([0, 1, 3, 4, 5]))], rng.randint(1, 9), i) for i in range(n)]


@pytest.mark.parametrize("percent", [0.0, 0.25, 0.4])
def test_the_end_does_not_depend_on_the_order(percent):
    for seed in range(25):
        rows = templates(seed, 14)
        want = brute(rows, percent)
        for turn in range(4):
            random.Random(turn).shuffle(rows)
            assert brute(rows, percent) == want
            held = {}
            for t, s, f in rows:
                held.setdefault(len(t), co.Join(int(percent * len(t) + 1e-9), P)).add(t, s, f)
            assert sorted((tuple(t), s, f) for j in held.values() for t, s, f in j.rows()) == want
            # The model of parts' models is the model of all.
            cut = len(rows) // 3
            assert brute(brute(rows[:cut], percent) + brute(rows[cut:], percent), percent) == want


@pytest.mark.parametrize("percent,task_rows", [(0.0, 5_000), (0.0, 4), (0.3, 3)])
def test_reduction_over_tasks(spark, percent, task_rows):
    rows = templates(3, 200)
    df = spark.createDataFrame([(t, s, f) for t, s, f in rows] + [(None, 1, 1)], "template_tokens array<string>, size long, first long").repartition(5)
    got = co.consensus(df, percent, task_rows=task_rows, fan_in=2).collect()
    assert sorted((tuple(r["template_tokens"]), r["size"], r["first"]) for r in got) == brute(rows, percent)
    assert [r["cluster_id"] for r in sorted(got, key=lambda r: r["first"])] == list(range(1, len(got) + 1))
    assert co.consensus(df.limit(0)).count() == 0


def test_pool_gives_one_model(spark):
    lines = [(i, f"{['open', 'shut'][i % 2]} gate {i % 7} now") for i in range(200)] + [(200 + i, f"idle {i}") for i in range(9)]
    df = spark.createDataFrame(lines, "msg_id long, line string")
    got = {" ".join(r["template_tokens"]): r["size"] for r in co.of_pool(mi.mine(df, MinerConfig(), instances=3)).collect()}
    assert sum(got.values()) == len(lines)
    one = {" ".join(r["template_tokens"]): r["size"] for r in mi.clusters(mi.mine(df, MinerConfig())).collect()}
    assert got == one
    with pytest.raises(ValueError):
        co.consensus(df, 1.0)
