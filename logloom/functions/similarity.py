"""Similarity of a template and a message as column expressions.

Each function returns a struct (similarity double, param_count int).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _result(similarity: Column, params: Column) -> Column:
    return F.struct(similarity.cast("double").alias("similarity"), params.cast("int").alias("param_count"))


def _params(template: Column, param: str) -> Column:
    return F.size(F.filter(template, lambda t: t == param))


def _at_other(template: Column, message: Column, param: str) -> Column:
    """Tokens of the message at positions where the template has no wildcard."""
    return F.filter(message, lambda t, i: ~F.coalesce(F.get(template, i) == param, F.lit(False)))


def position(template: Column, message: Column, param: str = "<*>", include_params: bool = False) -> Column:
    """Share of positions with equal constants."""
    n, params = F.size(template), _params(template, param)
    equal = F.size(F.filter(F.zip_with(template, message, lambda a, b: (a == b) & (a != param)), lambda x: x))
    score = (equal + (params if include_params else F.lit(0))) / n
    return F.when(n != F.size(message), _result(F.lit(0.0), F.lit(0))).when(n == 0, _result(F.lit(1.0), F.lit(0))).otherwise(_result(score, params))


def diff_ratio(template: Column, message: Column, param: str = "<*>", max_ratio: float = 0.3, include_params: bool = False) -> Column:
    """One less the share of differing constants, 0 above ``max_ratio``; lengths may differ."""
    n, params = F.size(template), _params(template, param)
    constants = n - params
    differ = F.size(F.filter(F.transform(template, lambda a, i: (a != param) & ~F.coalesce(a == F.get(message, i), F.lit(False))), lambda x: x))
    ratio = differ / constants
    own = F.when(constants == 0, F.lit(1.0)).when(ratio <= max_ratio, 1 - ratio).otherwise(F.lit(0.0))
    score = F.when(n == 0, F.lit(1.0)).otherwise((own * constants + params) / n) if include_params else own
    return _result(score, params)


def jaccard_index(template: Column, message: Column, param: str = "<*>") -> Column:
    """1.3 times the Jaccard index of the constants, at most 1; 0 for two empty sets."""
    own = F.array_distinct(F.filter(template, lambda t: t != param))
    other = F.array_distinct(_at_other(template, message, param))
    union = F.size(F.array_union(own, other))
    score = F.when(union == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.3) * (F.size(F.array_intersect(own, other)) / union), F.lit(1.0)))
    return _result(score, _params(template, param))


def jaccard_engine(template: Column, message: Column, param: str = "<*>", include_params: bool = False) -> Column:
    """The set similarity that the Jaccard engine scores candidates by."""
    params = _params(template, param)
    same = (F.size(template) == F.size(message)) & (params > 0)
    other = F.array_distinct(F.when(same, _at_other(template, message, param)).otherwise(message))
    own = F.array_distinct(F.filter(template, lambda t: t != param) if include_params else template)
    union = F.size(F.array_union(own, other))
    score = F.when(union == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.3) * (F.size(F.array_intersect(own, other)) / union), F.lit(1.0)))
    return F.when(F.size(template) == 0, _result(F.lit(1.0), F.lit(0))).otherwise(_result(score, params))


def term_pairs(template: Column, message: Column, param: str = "<*>", least: float = 0.5) -> Column:
    """Overlap of the unordered pairs of constants, 0 below ``least``."""

    def pairs(tokens: Column) -> Column:
        words = F.filter(tokens, lambda t: t != param)
        both = F.flatten(F.transform(words, lambda a, i: F.transform(F.filter(words, lambda _, j: j > i), lambda b: F.concat_ws("|", F.least(a, b), F.greatest(a, b)))))
        return F.array_distinct(both)

    own, other = pairs(template), pairs(message)
    a, b = F.size(own), F.size(other)
    score = F.size(F.array_intersect(own, other)) / F.greatest(a, b)
    n, params = F.size(template), _params(template, param)
    blank_own, blank_other = F.size(F.filter(template, lambda t: t != param)) == 0, F.size(F.filter(message, lambda t: t != param)) == 0
    return (
        F.when(blank_own & blank_other, _result(F.lit(1.0), n))
        .when((a == 0) | (b == 0), _result(F.lit(0.0), F.when(blank_own | blank_other, n).otherwise(params)))
        .otherwise(_result(F.when(score >= least, score).otherwise(F.lit(0.0)), params))
    )


def chain(*results: Column) -> Column:
    """The first result with any similarity or wildcard."""
    out = _result(F.lit(0.0), F.lit(0))
    for r in reversed(results):
        out = F.when((r["similarity"] > 0) | (r["param_count"] > 0), r).otherwise(out)
    return out


def by_position(template: Column, message: Column, param: str = "<*>", include_params: bool = False) -> Column:
    """The default chain: equal positions alone."""
    return chain(position(template, message, param, include_params))


def by_ratio(template: Column, message: Column, param: str = "<*>", max_ratio: float = 0.3, include_params: bool = False) -> Column:
    """The share of differing constants first, then equal positions."""
    return chain(diff_ratio(template, message, param, max_ratio, include_params), position(template, message, param, include_params))
