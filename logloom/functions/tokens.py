"""Tokens of a line and what the miner reads off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as the original dialect has it (Unicode blanks and the byte-order mark).
BLANK = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+\\z", "")


def tokenize(text: Column, extra_delimiters: Sequence[str] = ()) -> Column:
    """Non-empty parts between blanks; delimiters (plain strings) count as blanks."""
    text = trim(text)
    for d in extra_delimiters:
        text = F.replace(text, F.lit(d), F.lit(" "))
    return F.filter(F.split(text, BLANK + "+"), lambda t: t != "")


def has_digit(token: Column) -> Column:
    return token.rlike("[0-9]")


def param_count(tokens: Column) -> Column:
    """Tokens in angle brackets, wildcards included."""
    return F.size(F.filter(tokens, lambda t: t.startswith("<") & t.endswith(">")))


def is_masked(token: Column, prefix: str = "<", suffix: str = ">") -> Column:
    """A named mask: in brackets, longer than two characters, not the wildcard."""
    return (F.length(token) > 2) & token.startswith(prefix) & token.endswith(suffix) & (token != prefix + "*" + suffix)


def root_key(tokens: Column, engine: str = "position", binning: bool = False) -> Column:
    """The part of the model a line can meet; lines of different keys never interact."""
    if engine == "jaccard":
        return F.when(F.size(tokens) == 0, F.lit("")).otherwise(F.get(tokens, F.lit(0)))
    size = F.size(tokens).cast("string")
    return F.concat_ws("#", size, param_count(tokens).cast("string")) if binning else size
