"""Line sources: text files, and structured CSV logs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.tokens import trim
from logloom.scratch import materialize


def clean(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed, non-empty lines in ``line``, in place of a column of that name; other columns stay."""
    return lines.withColumn("line", trim(F.col(column))).filter("line <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(msg_id, line) of text files: lines that are not blank, numbered from 1 by file name and place.

    Lines are counted by file block first, so no task orders all of them.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    rows = clean(spark.read.text(path).select("value", *place)).select("file", "block", "at", "line")
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    # One row a block: the only window over all of them.
    before = materialize(counts.select("file", "block", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before")), "line-blocks")
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return rows.withColumn("inside", inside).join(before, ["file", "block"]).select((F.col("before") + F.col("inside")).alias("msg_id"), "line")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = TaskContext.get().partitionId() << 40
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(range(n, n + len(batch)), pa.int64()), *batch.columns], ["msg_id", *batch.schema.names])
        n += len(batch)


def read_line_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of (msg_id, file, line); ids rise within a micro-batch and name a line together with its file."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return clean(raw.select("value", F.col("_metadata.file_path").alias("file"))).select("file", "line").mapInArrow(_number, "msg_id long, file string, line string")


_FIELD = re.compile(r'[ \t]*(?:"((?:[^"]|"")*)(?:"|\Z)[^,]*|([^,]*))(,|\Z)')


def split_csv_line(line: str) -> list[str]:
    """Fields of one line: quotes doubled inside quotes, plain fields trimmed."""
    out, at = [], 0
    while True:
        m = _FIELD.match(line, at)
        quoted, plain, end = m.groups()
        out.append(plain.strip() if quoted is None else quoted.replace('""', '"'))
        if not end:
            return out
        at = m.end()


# A field of a line that ends in a comma; each character is in one alternative, so long fields cost no stack.
_RAW = r'(?!\z)[ \t]*+(?:"[^"]*+(?:""[^"]*+)*+(?:"|\z)[^,]*+|[^,]*+)(?:,|\z)'
_INSIDE = r'^[ \t]*"([^"]*+(?:""[^"]*+)*+)'


def csv_fields(line: Column) -> Column:
    """Fields of CSV lines as an array, as ``split_csv_line`` has them."""

    def clean_field(raw: Column) -> Column:
        # A quote that is never closed takes the comma in that was added to the line.
        inside = F.regexp_extract(raw, _INSIDE, 1)
        open_end = ~raw.rlike(_INSIDE + '"')
        kept = F.when(open_end, F.substring(inside, F.lit(1), F.length(inside) - 1)).otherwise(inside)
        return F.when(raw.rlike(r'^[ \t]*"'), F.replace(kept, F.lit('""'), F.lit('"'))).otherwise(trim(F.regexp_replace(raw, r",\z", "")))

    return F.transform(F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(_RAW), F.lit(0)), clean_field)


def reconcile(fields: Column, columns: int, content: int) -> Column:
    """Exactly ``columns`` fields: short rows are padded, surplus commas go back into the content."""
    surplus = F.size(fields) - columns
    padded = F.concat(fields, F.array_repeat(F.lit(""), F.greatest(F.lit(0), -surplus)))
    joined = F.array_join(F.slice(fields, F.lit(content + 1), F.greatest(F.lit(1), surplus + 1)), ",")
    tail = F.slice(fields, content + 2 + F.greatest(F.lit(0), surplus), F.lit(columns))
    merged = F.concat(F.slice(fields, F.lit(1), F.lit(content)), F.array(joined), tail)
    return F.when(surplus > 0, merged).otherwise(padded)


# Parts that no log line holds, so that the CSV reader gives whole lines and drops each file's first.
_WHOLE_LINES = {"header": True, "sep": "\x1e\x1f\x1e", "quote": "", "enforceSchema": True, "maxCharsPerColumn": -1, "nullValue": ""}


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, content, template) of CSV logs whose header names ``Content``; the template is the last column.

    Each file's first line is its header, in one form for all files; fields of it
    may have blanks around them or quotes.  Without ``LineId`` lines are numbered
    in the order of the files' names, with gaps.
    """
    header = split_csv_line(spark.read.text(path).first()[0].lstrip("\ufeff"))
    content = header.index("Content")
    text = spark.read.schema("value string").options(**_WHOLE_LINES).csv(path)
    rows = text.filter("trim(value) <> ''").select(reconcile(csv_fields(F.col("value")), len(header), content).alias("f"))
    line_no = F.get("f", F.lit(header.index("LineId"))).cast("long") if "LineId" in header else F.monotonically_increasing_id()
    return rows.select(line_no.alias("line_no"), F.get("f", F.lit(content)).alias("content"), F.get("f", F.lit(len(header) - 1)).alias("template"))


def read_structured_dir(spark: SparkSession, folder: str) -> DataFrame:
    """``read_structured`` of the log that a folder holds as ``*_structured.csv``: the first by name, if there are several."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*_structured.csv").load(folder)
    if (first := found.agg(F.min("path")).first()[0]) is None:
        raise FileNotFoundError(f"no *_structured.csv in {folder}")
    return read_structured(spark, first)


def template_ids(rows: DataFrame, by: Sequence[str] = ("template",)) -> DataFrame:
    """Templates numbered from 1 by their first line."""
    first = rows.groupBy(*by).agg(F.min("line_no").alias("first"))
    return first.withColumn("template_id", F.row_number().over(Window.orderBy("first"))).drop("first")
