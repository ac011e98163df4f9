"""Masks: ordered global regex replacements as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mask:
    """Replace each match of ``pattern`` by the name between prefix and suffix.

    ``search`` finds the same matches in time that is linear in the text; what
    its first group holds comes before the match and stays.  A mask names its
    text once, so a chain of masks is a chain of as many replacements.
    """

    pattern: str
    name: str
    search: str | None = None

    def __post_init__(self) -> None:
        if not self.pattern or not self.name:
            raise ValueError("a mask needs a pattern and a name")

    def __call__(self, text: Column, prefix: str = "<", suffix: str = ">") -> Column:
        with_ = (prefix + self.name + suffix).replace("\\", "\\\\").replace("$", "\\$")
        if self.search is None:
            return F.regexp_replace(text, F.lit(self.pattern), F.lit(with_))
        return F.regexp_replace(text, F.lit(self.search), F.lit("$1" + with_))


# The preset patterns.
IP = Mask(r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)", "IP")
NUM = Mask(r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)", "NUM")
HEX = Mask(r"((?<=[^A-Za-z0-9])|^)(0[xX][0-9a-fA-F]+)((?=[^A-Za-z0-9])|$)", "HEX")
UUID = Mask(r"((?<=[^A-Za-z0-9])|^)([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32})((?=[^A-Za-z0-9])|$)", "UUID")
EMAIL = Mask(
    r"((?<=[^A-Za-z0-9])|^)([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})((?=[^A-Za-z0-9])|$)",
    "EMAIL",
    # One try a run of these characters: from its beginning, or after the character that follows a match.
    search=r"((?<![a-zA-Z0-9._%+\-])|\G(?<=[a-zA-Z])[._%+\-])[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}(?![A-Za-z0-9])",
)
HOST_PORT = Mask(
    r"((?<=[^A-Za-z0-9])|^)([\w][\w.-]*\.[\w.-]+:\d+)((?=[^A-Za-z0-9])|$)",
    "HOST_PORT",
    # One try at the beginning of each run of these characters and after each match: the first word
    # character that follows another kind starts the only match the run can hold.
    search=r"(?:(?<![\w.-])|\G)((?:(?<=[A-Za-z0-9])_)?+[.-]*+)(?<![A-Za-z0-9])\w[\w-]*+\.[\w.-]++:\d++(?![A-Za-z0-9])",
)
# Where a word ends or begins, words being of ASCII letters, digits and "_".
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
BLOCK_ID = Mask(r"\b(blk_[-\d]+)\b", "BLOCK_ID", search=rf"()(?<!\w)blk_[-\d]+{_EDGE}")
PATH = Mask(r"\b(/[\w.\-~%+/]+)+/?\b", "PATH", search=rf"()(?<=\w)/[\w.\-~%+/]+{_EDGE}")
SYSLOG_NUM = Mask(r"(?<=_)\d+\b", "SYSLOG_NUM", search=r"()(?<=_)\d+(?!\w)")
DEFAULT = (IP, NUM)
EXTENDED = (IP, HOST_PORT, NUM, HEX, UUID, EMAIL, PATH, BLOCK_ID, SYSLOG_NUM)

AnyMask = Mask | Callable[[Column], Column]


def mask(text: Column, masks: Sequence[AnyMask], prefix: str = "<", suffix: str = ">") -> Column:
    """All masks, one after the other; plain functions on columns are custom masks."""
    for m in masks:
        text = m(text, prefix, suffix) if isinstance(m, Mask) else m(text)
    return text


def mask_names(masks: Sequence[AnyMask]) -> list[str]:
    """Distinct names in order of first appearance."""
    return list(dict.fromkeys(m.name for m in masks if isinstance(m, Mask)))


def by_name(masks: Sequence[AnyMask], name: str) -> list[Mask]:
    return [m for m in masks if isinstance(m, Mask) and m.name == name]
