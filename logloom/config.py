"""Settings of the miner, and their INI form."""

from __future__ import annotations

import configparser
import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column

from logloom.functions.masking import Mask


@dataclass(frozen=True)
class MinerConfig:
    engine: str = "position"  # or "jaccard"
    sim_th: float = 0.4
    depth: int = 4
    max_children: int = 100
    max_clusters: int | None = None
    extra_delimiters: tuple[str, ...] = ()
    parametrize_numeric_tokens: bool = True
    param_binning: bool = False
    mask_generalization: bool = False
    diff_ratio: float | None = None  # largest share of differing constants; None: position-wise only
    merge_percent: float = 0.4
    affix_preserving: bool = False
    min_affix_length: int = 2
    regex_patterns: tuple[tuple[str, str], ...] = ()  # (pattern with groups, template with ${paramStr})
    substitutions: tuple[tuple[str, str], ...] = ()
    collapses: tuple[tuple[str, str], ...] = ()
    masks: tuple[Mask, ...] = ()
    mask_prefix: str = "<"
    mask_suffix: str = ">"
    extraction_cache: int = 100
    snapshot_minutes: float = 1
    snapshot_compress: bool = False
    profiling: bool = False
    profiling_seconds: float = 60
    preprocessor: Callable[[Column], Column] | None = field(default=None, compare=False)
    #: Own similarity in the fold: (template, tokens, param, with_params) -> (similarity, wildcards).
    score: Callable | None = field(default=None, compare=False)
    #: Own template tokens, tried in order for tokens that differ: (new, old, param) -> token or None.
    token_rules: tuple[Callable, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        if self.depth < 3:
            raise ValueError("depth must be at least 3")
        if not 0 <= self.sim_th <= 1:
            raise ValueError("sim_th must be between 0 and 1")
        if self.engine not in ("position", "jaccard"):
            raise ValueError("engine must be position or jaccard")

    @property
    def param(self) -> str:
        return f"{self.mask_prefix}*{self.mask_suffix}"

    def with_(self, **changes: Any) -> MinerConfig:
        """A copy with the settings that are not None changed."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


_KEYS = {
    "drain": {"engine": "engine", "sim_th": "sim_th", "depth": "depth", "max_children": "max_children", "max_clusters": "max_clusters", "extra_delimiters": "extra_delimiters", "parametrize_numeric_tokens": "parametrize_numeric_tokens", "enable_affix_preserving": "affix_preserving", "min_affix_length": "min_affix_length"},
    "masking": {"masking": "masks", "mask_prefix": "mask_prefix", "mask_suffix": "mask_suffix", "parameter_extraction_cache_capacity": "extraction_cache"},
    "snapshot": {"snapshot_interval_minutes": "snapshot_minutes", "compress_state": "snapshot_compress"},
    "profiling": {"enabled": "profiling", "report_sec": "profiling_seconds"},
}


def _list(text: str) -> list:
    try:
        return json.loads(text.replace("True", "true").replace("False", "false").replace("None", "null"))
    except ValueError:
        return [text]


def from_ini(text: str) -> MinerConfig:
    """Settings from INI text; missing keys keep their defaults."""
    parser = configparser.RawConfigParser(comment_prefixes=("#", ";"), strict=False)
    parser.read_string(text)
    types = {f.name: f.type for f in fields(MinerConfig)}
    out: dict[str, Any] = {}
    for section in parser.sections():
        for key, name in _KEYS.get(section.lower(), {}).items():
            if not parser.has_option(section, key):
                continue
            value = parser.get(section, key).strip()
            kind = types[name]
            if name == "masks":
                out[name] = tuple(Mask(m["regex_pattern"], m["mask_with"]) for m in _list(value) if isinstance(m, dict))
            elif name == "extra_delimiters":
                out[name] = tuple(str(x) for x in _list(value))
            elif name == "engine":
                out[name] = "jaccard" if value.lower().startswith("jaccard") else "position"
            elif kind == "bool":
                out[name] = value in ("True", "true")
            elif kind.startswith("int"):
                out[name] = int(value) if value.lstrip("-").isdigit() else None
            elif kind == "float":
                out[name] = float(value)
            else:
                out[name] = value
    return MinerConfig(**{k: v for k, v in out.items() if v is not None})
