"""Wall-clock sections of a driver program, and of the tasks that it starts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import SparkSession


class NullProfiler:
    @contextmanager
    def section(self, name: str):
        yield

    def report(self, every_seconds: float = 0) -> None:
        pass


class Profiler:
    """Sums, counts and rates per section, optionally as shares of an enclosing one."""

    def __init__(self, reset_after: int = 0, enclosing: str = "total", show: Callable[[str], None] = print):
        self.reset_after, self.enclosing, self.show = reset_after, enclosing, show
        self.sums: dict[str, list[float]] = {}
        self._open: dict[str, float] = {}
        self._reported = time.monotonic()

    def start(self, name: str) -> None:
        if not name:
            raise ValueError("a section needs a name")
        if name in self._open:
            raise ValueError(f"section {name} is open already")
        self._open[name] = time.monotonic()

    def end(self, name: str) -> None:
        if name not in self._open:
            raise ValueError(f"section {name} is not open")
        own = self.sums.setdefault(name, [0.0, 0])
        if self.reset_after and own[1] >= self.reset_after:
            own[:] = [0.0, 0]
        own[0] += time.monotonic() - self._open.pop(name)
        own[1] += 1

    @contextmanager
    def section(self, name: str):
        self.start(name)
        try:
            yield
        finally:
            self.end(name)

    def lines(self) -> list[str]:
        whole = self.sums.get(self.enclosing, [0.0, 0])[0]
        out = []
        for name, (seconds, count) in sorted(self.sums.items(), key=lambda x: -x[1][0]):
            share = f" ({100 * seconds / whole:.1f}%)" if whole else ""
            rate = f"{count / seconds:.0f}" if seconds else "-"
            out.append(f"{name}: {count} times, {seconds:.3f} s{share}, {rate} a second")
        return out

    def report(self, every_seconds: float = 0) -> None:
        if time.monotonic() - self._reported >= every_seconds:
            self._reported = time.monotonic()
            for line in self.lines():
                self.show(line)


class _Sums(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for name, (seconds, rows, tasks) in b.items():
            own = a.get(name, (0.0, 0, 0))
            a[name] = own[0] + seconds, own[1] + rows, own[2] + tasks
        return a


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class TaskSections:
    """Seconds, rows and tasks of sections of Arrow code inside tasks, summed over all executors.

    A section's seconds leave out the time it waits for its input.  Tasks that
    run again count again.
    """

    def __init__(self, spark: SparkSession):
        self._held = spark.sparkContext.accumulator({}, _Sums())

    @property
    def sums(self) -> dict[str, tuple[float, int, int]]:
        return dict(self._held.value)

    def timed(self, name: str, run: Run) -> Run:
        """``run`` for mapInArrow as a section."""
        held = self._held

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waited = spent = 0.0
            rows = 0

            def given() -> Iterator[pa.RecordBatch]:
                nonlocal waited, rows
                source = iter(batches)
                while True:
                    began = time.perf_counter()
                    batch = next(source, None)
                    waited += time.perf_counter() - began
                    if batch is None:
                        return
                    rows += len(batch)
                    yield batch

            out = run(given())
            try:
                while True:
                    began = time.perf_counter()
                    batch = next(out, None)
                    spent += time.perf_counter() - began
                    if batch is None:
                        break
                    yield batch
            finally:
                held.add({name: (spent - waited, rows, 1)})

        return whole

    def lines(self) -> list[str]:
        return [f"{name}: {rows} rows in {tasks} tasks, {seconds:.3f} s, {rows / seconds if seconds else 0:.0f} a second and task" for name, (seconds, rows, tasks) in sorted(self.sums.items())]
