"""Parameters of a message under its template."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from logloom.config import MinerConfig
from logloom.functions.masking import Mask, by_name, mask_names
from logloom.profiler import TaskSections


def _plain(pattern: str) -> str:
    """A mask pattern without named groups and back references, with ASCII classes."""
    pattern = re.sub(r"\(\?P<[^>]*>", "(?:", pattern)
    return re.sub(r"\\[1-9][0-9]?", "(?:.+?)", pattern)


def extraction_regex(template: str, config: MinerConfig, exact: bool) -> tuple[re.Pattern | None, list[str]]:
    """Anchored pattern with a group p0, p1, ... for each placeholder, and their mask names."""
    known = set(mask_names(config.masks))
    out, names = [], []
    pieces = template.split(config.mask_prefix)
    out.append(re.escape(pieces[0]))
    for i, piece in enumerate(pieces[1:]):
        name, closed, literal = piece.partition(config.mask_suffix)
        if not closed:
            # Without an end the rest is text, later prefixes included.
            out.append(re.escape(config.mask_prefix + config.mask_prefix.join(pieces[1 + i :])))
            break
        own = [_plain(m.pattern) for m in by_name(config.masks, name) if isinstance(m, Mask)] if exact and name in known and name != "*" else []
        out.append(f"(?P<p{len(names)}>{'|'.join(own) if own else '.+?'})")
        names.append(name)
        out.append(re.escape(literal))
    pattern = "".join(out).replace("\\ ", " ").replace(" ", r"\s+")
    try:
        return re.compile(f"^{pattern}\\Z", re.ASCII), names
    except re.error:
        return None, names


class Extractor:
    """Parameters of lines, with the patterns of the templates met last."""

    def __init__(self, config: MinerConfig, exact: bool):
        self.delimiters = config.extra_delimiters
        self.pattern = functools.lru_cache(maxsize=config.extraction_cache)(lambda template: extraction_regex(template, config, exact))

    def __call__(self, template: str | None, line: str | None) -> list[tuple[str, str]]:
        """(value, mask name) of each placeholder; none where the line does not fit."""
        if template is None or line is None:
            return []
        for d in self.delimiters:
            line = line.replace(d, " ")
        pattern, names = self.pattern(template)
        found = pattern.match(line) if pattern else None
        return [(found.group(f"p{i}"), n) for i, n in enumerate(names)] if found else []


def _extract(config: MinerConfig, exact: bool):
    kind = pa.list_(pa.struct([("value", pa.string()), ("mask_name", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Extractor(config, exact)
        for batch in batches:
            out = [[{"value": v, "mask_name": n} for v, n in own(*pair)] for pair in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["msg_id", "params"])

    return run


def extract(rows: DataFrame, config: MinerConfig | None = None, exact: bool = True, sections: TaskSections | None = None) -> DataFrame:
    """(msg_id, params) for rows (msg_id, template, line); params is an array of (value, mask_name)."""
    config = config or MinerConfig()
    line = config.preprocessor(F.col("line")) if config.preprocessor else F.col("line")
    schema = "msg_id long, params array<struct<value: string, mask_name: string>>"
    run = _extract(config, exact)
    run = sections.timed("extract", run) if sections else run
    return rows.select(F.col("msg_id").cast("long"), "template", line.alias("line")).mapInArrow(run, schema)


def values(rows: DataFrame, config: MinerConfig | None = None) -> DataFrame:
    """(msg_id, values): the parameters alone, found inexactly."""
    return extract(rows, config, exact=False).select("msg_id", F.transform("params", lambda p: p["value"]).alias("values"))


def register(spark: SparkSession, config: MinerConfig | None = None, name: str = "extract_parameters", exact: bool = True) -> None:
    """A SQL table function ``name(template, line)``: a row (place, value, mask_name) for each parameter.

    For use beside a table: ``SELECT m.msg_id, p.* FROM mined m, LATERAL extract_parameters(m.template_mined, m.line) p``.
    The preprocessor of the settings is not applied.
    """
    config = (config or MinerConfig()).with_()

    class Parameters:
        @staticmethod
        def analyze(template: AnalyzeArgument, line: AnalyzeArgument) -> AnalyzeResult:
            if any(not isinstance(a.dataType, (StringType, NullType)) for a in (template, line)):
                raise ValueError("a template and a line are needed, both strings")
            return AnalyzeResult(StructType().add("place", IntegerType()).add("value", StringType()).add("mask_name", StringType()))

        def __init__(self) -> None:
            self.own = Extractor(config, exact)

        def eval(self, template: str, line: str):
            for place, (value, mask_name) in enumerate(self.own(template, line)):
                yield place, value, mask_name

    spark.udtf.register(name, udtf(Parameters))
