"""Template tokens from two different tokens, and templates of token arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def full(a: Column, b: Column, param: str = "<*>") -> Column:
    return F.when(a == b, b).otherwise(F.lit(param))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.lit(0), n), lambda k: F.when(F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k), k).otherwise(F.lit(0)))
    return F.array_max(steps)


def affix(a: Column, b: Column, param: str = "<*>", least: int = 2, least_confidence: float = 0.6) -> Column:
    """Common prefix and suffix around the wildcard, or null where both are too short."""
    p = common_prefix(a, b)
    s = common_prefix(F.reverse(F.substring(a, p + 1, F.length(a))), F.reverse(F.substring(b, p + 1, F.length(b))))
    confidence = F.least(F.lit(0.6) + F.lit(0.3) * ((p + s) / ((F.length(a) + F.length(b)) / 2)), F.lit(0.95))
    out = F.concat(F.substring(a, F.lit(1), p), F.lit(param), F.substring(a, F.length(a) - s + 1, s))
    return F.when(((p >= least) | (s >= least)) & (confidence >= least_confidence) & (a != b), out)


def regex(a: Column, b: Column, patterns: Sequence[tuple[str, int, str]], param: str = "<*>") -> Column:
    """Template of the first (pattern, groups, template) that both match with a differing group, or null."""
    out = F.lit(None).cast("string")
    for pattern, groups, template in reversed(list(patterns)):
        differ = F.lit(False)
        for g in range(1, groups + 1):
            differ = differ | (F.regexp_extract(a, pattern, g) != F.regexp_extract(b, pattern, g))
        out = F.when(a.rlike(pattern) & b.rlike(pattern) & differ, F.lit(template.replace("${paramStr}", param))).otherwise(out)
    return out


def parameterize(a: Column, b: Column, param: str = "<*>", least_affix: int | None = None, patterns: Sequence[tuple[str, int, str, float]] = ()) -> Column:
    """Struct (template_token, extracted, confidence, strategy) of two tokens.

    Order: equal tokens, regular expressions, affixes (if asked for), wildcard.
    """

    def result(token: Column, extracted: Column, confidence: Column, strategy: str) -> Column:
        return F.struct(token.alias("template_token"), extracted.cast("array<string>").alias("extracted"), confidence.cast("double").alias("confidence"), F.lit(strategy).alias("strategy"))

    out = result(F.lit(param), F.array(a, b), F.lit(0.5), "full")
    if least_affix is not None:
        p = common_prefix(a, b)
        s = common_prefix(F.reverse(F.substring(a, p + 1, F.length(a))), F.reverse(F.substring(b, p + 1, F.length(b))))
        middle = lambda t: F.substring(t, p + 1, F.length(t) - p - s)
        confidence = F.least(F.lit(0.6) + F.lit(0.3) * ((p + s) / ((F.length(a) + F.length(b)) / 2)), F.lit(0.95))
        out = F.when(affix(a, b, param, least_affix).isNotNull(), result(affix(a, b, param, least_affix), F.array(middle(a), middle(b)), confidence, "affix")).otherwise(out)
    for pattern, groups, form, sure in reversed(list(patterns)):
        token = regex(a, b, [(pattern, groups, form)], param)
        extracted = F.array(*[F.regexp_extract(t, pattern, g) for t in (a, b) for g in range(1, groups + 1)])
        out = F.when(token.isNotNull(), result(token, extracted, F.lit(sure), "regex")).otherwise(out)
    return F.when(a == b, result(b, F.array(), F.lit(1.0), "exact")).otherwise(out)


def fits(template_token: Column, token: Column, param: str = "<*>") -> Column:
    """Whether a token is an instance of a template token, wildcards standing for one or more characters."""
    pattern = F.concat(F.lit("\\A\\Q"), F.replace(template_token, F.lit(param), F.lit("\\E.+?\\Q")), F.lit("\\E\\z"))
    return F.rlike(token, pattern)


def template(new: Column, old: Column, param: str = "<*>", masked_to_param: bool = False, use_affix: bool = False, least_affix: int = 2, patterns: Sequence[tuple[str, int, str]] = ()) -> Column:
    """Template of two token arrays of one length."""

    def one(a: Column, b: Column) -> Column:
        parts = [regex(a, b, patterns, param)] if patterns else []
        if use_affix:
            parts.append(affix(a, b, param, least_affix))
        out = F.when(a == b, b).otherwise(F.coalesce(*parts, F.lit(param)))
        if masked_to_param:
            masked = (F.length(a) > 2) & a.startswith("<") & a.endswith(">") & (a != param)
            out = F.when(masked, F.lit(param)).otherwise(out)
        return out

    return F.zip_with(new, old, one)


def template_of_sets(new: Column, old: Column, param: str = "<*>") -> Column:
    """The Jaccard engine's template: unequal lengths keep the longer one's shared tokens."""
    base = F.when(F.size(new) > F.size(old), new).otherwise(old)
    shared = F.array_intersect(new, old)
    loose = F.transform(base, lambda t: F.when(F.array_contains(shared, t), t).otherwise(F.lit(param)))
    return F.when(F.size(new) == F.size(old), template(new, old, param)).otherwise(loose)


def plain(a: Column, b: Column, param: str = "<*>") -> Column:
    """The default chain: equal tokens, else the wildcard."""
    return parameterize(a, b, param)


def extended(a: Column, b: Column, param: str = "<*>", least_affix: int = 2) -> Column:
    """The chain that also keeps common beginnings and ends."""
    return parameterize(a, b, param, least_affix)


def custom(a: Column, b: Column, *rules: Callable[[Column, Column], Column], param: str = "<*>") -> Column:
    """Template token by own rules (null: not this one), tried in order, then the default chain."""
    return F.when(a == b, b).otherwise(F.coalesce(*[rule(a, b) for rule in rules], F.lit(param)))
