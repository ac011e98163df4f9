"""Token normalizers as column expressions, and learning where to fuse tokens."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import BLANK


def _java(template: str, param: str) -> str:
    """A replacement with ``${paramStr}`` filled in; ``$1`` still names a group."""
    return template.replace("${paramStr}", param.replace("\\", "\\\\").replace("$", "\\$"))


def substitute(tokens: Column, patterns: Sequence[tuple[str, str]], param: str = "<*>") -> Column:
    """Each pattern in each token, in order."""

    def one(t: Column) -> Column:
        for pattern, template in patterns:
            t = F.regexp_replace(t, F.lit(pattern), F.lit(_java(template, param)))
        return t

    return F.transform(tokens, one)


def collapse(tokens: Column, patterns: Sequence[tuple[str, str]], param: str = "<*>") -> Column:
    """Patterns over the tokens joined by blanks, split again."""
    line = F.array_join(tokens, " ")
    for pattern, template in patterns:
        line = F.regexp_replace(line, F.lit(pattern), F.lit(_java(template, param)))
    return F.filter(F.split(line, BLANK + "+"), lambda t: t != "")


@dataclass(frozen=True)
class Fusion:
    """Positions (0-based, ascending) whose token is joined with the next one."""

    length: int = 0
    positions: tuple[int, ...] = ()
    insert_param: bool = True

    def __call__(self, tokens: Column, param: str = "<*>") -> Column:
        """Lines of the learned length have the pairs fused, whatever their tokens are."""
        if not self.positions:
            return tokens
        parts, i = [], 0
        while i < self.length:
            if i in self.positions and i + 1 < self.length:
                parts.append(F.concat(F.get(tokens, F.lit(i)), F.lit(param if self.insert_param else ""), F.get(tokens, F.lit(i + 1))))
                i += 2
            else:
                parts.append(F.get(tokens, F.lit(i)))
                i += 1
        return F.when(F.size(tokens) == self.length, F.array(*parts)).otherwise(tokens)


def learn_fusion(lines: DataFrame, min_length: int = 2, insert_param: bool = True) -> Fusion:
    """Neighbouring constant words among lines (msg_id, tokens) of the commonest length.

    One aggregation finds the length (ties: seen first), one the constant
    positions; only a row per position reaches the driver.
    """
    sizes = lines.groupBy(F.size("tokens").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.min("msg_id").alias("first"))
    top = sizes.withColumn("all", F.expr("sum(c) over ()")).orderBy(F.desc("c"), "first").first()
    if top is None or top["all"] < 2 or top["c"] < 2:
        return Fusion()
    words = lines.filter(F.size("tokens") == top["n"]).select(F.posexplode("tokens"))
    fixed = words.groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).filter("low = high").collect()
    constant = {r["pos"] for r in fixed if len(r["low"]) >= min_length and r["low"].isascii() and r["low"].isalpha()}
    positions, i = [], 0
    while i < top["n"] - 1:
        if i in constant and i + 1 in constant:
            positions.append(i)
            i += 1
        i += 1
    return Fusion(top["n"], tuple(positions), insert_param)


class Pipeline:
    """Normalizers applied one after the other; each takes and returns a token column."""

    def __init__(self, stages: Sequence[tuple[str, Callable[[Column], Column]]] = ()):
        self.stages = list(stages)

    def register(self, name: str, stage: Callable[[Column], Column]) -> Pipeline:
        self.stages.append((name, stage))
        return self

    def __len__(self) -> int:
        return len(self.stages)

    def __call__(self, tokens: Column) -> Column:
        for _, stage in self.stages:
            tokens = stage(tokens)
        return tokens

    def changes(self, tokens: Column) -> Column:
        """Names of the stages that change the tokens."""
        marks = []
        for name, stage in self.stages:
            after = stage(tokens)
            marks.append(F.when(after != tokens, F.lit(f"[{name}]")))
            tokens = after
        return F.filter(F.array(*marks), lambda m: m.isNotNull()) if marks else F.array().cast("array<string>")


def plain() -> Pipeline:
    """A pipeline without stages."""
    return Pipeline()


def fusing(lines: DataFrame, min_length: int = 2, insert_param: bool = True, param: str = "<*>") -> Pipeline:
    """A pipeline that fuses what ``learn_fusion`` finds in ``lines``."""
    fusion = learn_fusion(lines, min_length, insert_param)
    return Pipeline().register("fusion", lambda t: fusion(t, param))
