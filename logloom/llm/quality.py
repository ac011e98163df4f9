"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

1. ``statistics`` are native columns over the whole text.
2. ``fit`` takes a bounded sample of labelled rows (``max_rows`` documents, the
   first in a seeded order), grows small boosted trees on their statistics and
   reads every path from a root as a conjunctive rule.
3. Lasso-penalised logistic regression over rules and clipped linear terms
   keeps few of them; the penalty is picked on a part of the sample.
4. ``Ensemble.score`` turns the kept rules into one column expression, so
   scoring runs in generated code next to the scan, without Python.

Defined results: null texts count as empty, and empty texts have a score like
any other; without labels, or with one label only, every score is the smoothed
rate of label 1; repeated labels of an id count as 1 if any is 1; null labels
are left out; other columns of ``docs`` are ignored by ``score`` and kept by
``apply``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, held_out, labelled


def _rate(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a whole text, in two layers: counts are in ``_counts``."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, WS_CLASS + "+"), lambda w: w != "")
    lines = F.split(t, "\n")
    return {
        "_chars": F.length(t),
        "_symbols": F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "")),
        "_common": F.length(F.regexp_replace(t, r"[^.,;:!?'\"()-]+", "")),
        "_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
        "_digits": F.length(F.regexp_replace(t, r"\P{N}+", "")),
        "_shouts": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
        "_words": F.size(words),
        "_kinds": F.size(F.array_distinct(words)),
        "_letters_in_words": F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)),
        "_lines": F.size(lines),
        "_line_kinds": F.size(F.array_distinct(lines)),
    }


#: Features over the counts above, in the order of the model's columns.
FEATURES = ("log_chars", "log_words", "odd_symbols", "punctuation", "upper", "digits", "shouts", "word_length", "distinct_words", "vocabulary_growth", "repeats_per_word", "distinct_lines", "words_per_line")


def features() -> dict[str, Column]:
    return {
        "log_chars": F.log1p(F.col("_chars").cast("double")),
        "log_words": F.log1p(F.col("_words").cast("double")),
        "odd_symbols": _rate(F.col("_symbols") - F.col("_common"), F.col("_chars")),
        "punctuation": _rate(F.col("_common"), F.col("_chars")),
        "upper": _rate(F.col("_upper"), F.col("_chars")),
        "digits": _rate(F.col("_digits"), F.col("_chars")),
        "shouts": _rate(F.col("_shouts"), F.col("_words")),
        "word_length": _rate(F.col("_letters_in_words"), F.col("_words")),
        "distinct_words": _rate(F.col("_kinds"), F.col("_words")),
        "vocabulary_growth": F.log1p(F.col("_kinds").cast("double")) / F.log1p(F.greatest(F.col("_words"), F.lit(1)).cast("double")),
        "repeats_per_word": _rate(F.col("_words"), F.col("_kinds")),
        "distinct_lines": _rate(F.col("_line_kinds"), F.col("_lines")),
        "words_per_line": _rate(F.col("_words"), F.col("_lines")),
    }


def with_features(rows: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``keep`` and all features."""
    counted = rows.select(*keep, *[c.alias(n) for n, c in statistics(F.col(text)).items()])
    return counted.select(*keep, *[c.alias(n) for n, c in features().items()])


Rule = tuple[tuple[int, str, float], ...]  # (feature, "<=" or ">", cut), all of which hold


def _split(x: np.ndarray, r: np.ndarray, cuts: list[np.ndarray], least: int):
    best, total = (1e-9, None, None), r.sum() ** 2 / len(r)
    for j, candidates in enumerate(cuts):
        order = np.argsort(x[:, j], kind="stable")
        sums = np.concatenate([[0.0], np.cumsum(r[order])])
        n_left = np.searchsorted(x[order, j], candidates, side="right")
        ok = (n_left >= least) & (len(r) - n_left >= least)
        if ok.any():
            left = sums[n_left[ok]]
            gain = left**2 / n_left[ok] + (sums[-1] - left) ** 2 / (len(r) - n_left[ok]) - total
            if gain.max() > best[0]:
                best = (gain.max(), j, float(candidates[ok][gain.argmax()]))
    return best[1:]


def _grow(x: np.ndarray, r: np.ndarray, own: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule, rules: list[Rule], out: np.ndarray, least: int) -> None:
    """One regression tree on residuals; adds its rules and its predictions."""
    j, cut = _split(x[own], r[own], cuts, least) if depth and len(own) >= 2 * least else (None, None)
    if j is None:
        out[own] = r[own].mean() if len(own) else 0.0
        return
    for op, side in (("<=", x[own, j] <= cut), (">", x[own, j] > cut)):
        rules.append((*path, (j, op, cut)))
        _grow(x, r, own[side], cuts, depth - 1, rules[-1], rules, out, least)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int) -> list[Rule]:
    """Distinct rules of ``trees`` boosted trees on random halves of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 48))) for c in x.T]
    rules: list[Rule] = []
    f = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(trees):
        r = y - 1 / (1 + np.exp(-f))
        part = np.sort(rng.choice(len(y), size=max(2, len(y) // 2), replace=False))
        grown: list[Rule] = []
        step = np.zeros(len(part))
        _grow(x[part], r[part], np.arange(len(part)), cuts, depth, (), grown, step, max(3, len(part) // 200))
        value = np.zeros(len(y))
        value[part] = step
        f += 1.0 * value
        rules += grown
    return list(dict.fromkeys(tuple(sorted(rule)) for rule in rules))


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, cut in rule:
        out &= x[:, j] <= cut if op == "<=" else x[:, j] > cut
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps."""
    n = len(y)
    rate = 4.0 / max(1e-9, np.linalg.norm(z, 2) ** 2 / n + 1)
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    t = 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(z @ v + c))) - y
        w_new = v - rate * (z.T @ g) / n
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - rate * penalty, 0)
        b_new = c - rate * g.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return b, w


@dataclass(frozen=True)
class Ensemble:
    """Intercept, weighted rules, and weighted linear terms clipped to [low, high]."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()
    linear: tuple[tuple[int, float, float, float], ...] = ()  # feature, low, high, weight

    def score(self) -> Column:
        """Probability of label 1 over the columns of ``FEATURES``."""
        names = list(FEATURES)
        total = F.lit(self.intercept)
        for j, low, high, w in self.linear:
            total = total + F.lit(w) * F.least(F.greatest(F.col(names[j]), F.lit(low)), F.lit(high))
        for rule, w in self.rules:
            test = F.lit(True)
            for j, op, cut in rule:
                test = test & (F.col(names[j]) <= cut if op == "<=" else F.col(names[j]) > cut)
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The same on the driver, for tests."""
        total = np.full(len(x), self.intercept)
        for j, low, high, w in self.linear:
            total += w * np.clip(x[:, j], low, high)
        for rule, w in self.rules:
            total += w * holds(x, rule)
        return 1 / (1 + np.exp(-total))


def fit_sample(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, seed: int = 0, penalties: Sequence[float] = (0.02, 0.01, 0.004, 0.0015, 0.0005)) -> Ensemble:
    """Rules from trees, lasso over them, the penalty by the loss on a fifth of the rows."""
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    if len(y) < 10 or y.min() == y.max():
        return Ensemble(float(np.log(rate / (1 - rate))))
    rules = tree_rules(x, y, trees, depth, seed)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    spread = np.maximum(np.clip(x, low, high).std(axis=0), 1e-9)
    flat = high - low < 1e-9
    linear = 0.4 * np.clip(x, low, high) / spread * ~flat
    shift = linear.mean(axis=0)
    z = np.hstack([np.stack([holds(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(x), 0)), linear - shift])
    test = np.random.default_rng(seed + 1).random(len(y)) < 0.2

    def loss(fitted: tuple[float, np.ndarray]) -> float:
        p = np.clip(1 / (1 + np.exp(-(z[test] @ fitted[1] + fitted[0]))), 1e-6, 1 - 1e-6)
        return float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())

    penalty = min(penalties, key=lambda q: loss(lasso_logistic(z[~test], y[~test], q))) if test.any() and 0 < y[~test].mean() < 1 else penalties[2]
    b, w = lasso_logistic(z, y, penalty)
    n = len(rules)
    kept = tuple((r, float(v)) for r, v in zip(rules, w[:n], strict=True) if abs(v) > 1e-6)
    terms = tuple((j, float(low[j]), float(high[j]), float(0.4 * v / spread[j])) for j, v in enumerate(w[n:]) if abs(v) > 1e-6 and not flat[j])
    b -= float(sum(w[n + j] * shift[j] for j, *_ in terms))
    return Ensemble(b, kept, terms)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", **params) -> Ensemble:
    sample = with_features(labelled(docs, labels, label, max_rows, id_col, text_col), "text", ["id", "y"]).toPandas().sort_values(["id", *FEATURES], kind="stable")
    return fit_sample(sample[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), sample["y"].to_numpy(float), **params)


def score(docs: DataFrame, model: Ensemble, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = with_features(rows, "text", ["doc_id", "held_out"]).select("doc_id", "held_out", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def apply(docs: DataFrame, model: Ensemble, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns."""
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    return with_features(whole, "_text", ["_row"]).filter(model.score() >= threshold).select("_row.*")
