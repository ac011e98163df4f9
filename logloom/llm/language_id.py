"""Language identification by prediction with partial matching (PPM).

Per language a variable-order byte context tree of depth ``order`` is counted
over a bounded training sample and frozen.  The code length of a byte follows
PPM with escape method C: in the longest known context a byte seen ``c`` times
costs ``-log2(c / (n + d))`` (``n`` bytes, ``d`` different ones seen there); an
unseen byte pays the escape ``-log2(d / (n + d))`` and is coded one order lower,
without the bytes excluded above; below order 0 all bytes are equally likely.
The language with the shortest code for the whole text is predicted.

As statistics are frozen, the code length depends on the last ``order`` bytes
and the byte alone.  The driver therefore unrolls the trees once into a table
(known context x byte x language), and tasks score every byte of every text
with two array look-ups: contexts are found through a suffix-closed numbering,
so an unknown context falls back to its longest known suffix, as in the tree.

The sample: per language the first ``docs_per_language`` training documents in
a seeded order, whole texts.  Counting them is a distributed job; only the
n-gram counts reach the driver, of up to ``block_languages`` languages at a
time.  Those make one table, or several where one would take more than
``block_bytes``, and a table is what is broadcast: with more of them documents
pass one after the other, and keep the shortest code so far.

Defined results: ``und`` with score 0 for null texts, texts without a letter,
and everything where no training rows exist; ties go to the language first in
code-point order; repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, materialize, slices, small_batches, trimmed

_HOLD = 256  # symbol that stands before a text


def grams(text: bytes, order: int) -> np.ndarray:
    """Codes of all (order + 1)-grams in base 257, one per byte of the text."""
    s = np.concatenate([np.full(order, _HOLD, np.int64), np.frombuffer(text, np.uint8).astype(np.int64)])
    code = np.zeros(len(s) - order, np.int64)
    for i in range(order + 1):
        code = code * 257 + s[i : i + len(code)]
    return code


def fold(text: str) -> bytes:
    """Lower case, so that shouted text is scored by the same trees."""
    return text.lower().encode("utf-8", "replace")


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gram, n = np.unique(grams(fold(text or ""), order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return run


class ContextTrees:
    """Frozen trees of all languages as one table of code lengths."""

    def __init__(self, languages: list[str], by_language: list[tuple[np.ndarray, np.ndarray]], order: int, min_count: int):
        self.languages, self.order = languages, order
        trees = [self._tree(gram, n, order, min_count) for gram, n in by_language]
        seen = sorted({c for tree in trees for c in tree}, key=lambda c: (len(c), c))
        # The empty context is row 0; a known context's suffixes are known as well.
        self.rows = {c: i for i, c in enumerate(seen or [()])}
        # Columns: 0 stands for all bytes that no tree holds (they cost the same), then the bytes in use.
        used = sorted({b for c in self.rows for b in c} | {int(b) for tree in trees for s, _ in tree.values() for b in s})
        self.symbol = np.zeros(257, np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.base = len(used) + 1
        spare = next((b for b in range(256) if self.symbol[b] == 0), 0)
        columns = np.array([spare, *(b if b < _HOLD else spare for b in used)])
        flat = np.full(self.base, 8.0)
        self.cost = np.empty((len(self.rows), self.base, len(languages)), np.float32)
        for k, tree in enumerate(trees):
            for c, row in self.rows.items():
                node = tree.get(c)
                if node is None:
                    self.cost[row, :, k] = self.cost[self.rows[c[1:]], :, k] if c else flat
                else:
                    self.cost[row, :, k] = self._node_cost(tree, c)[columns]
        self._number()

    @staticmethod
    def _tree(gram: np.ndarray, n: np.ndarray, order: int, min_count: int) -> dict:
        """context -> (bytes seen, counts), for all orders; longer contexts need ``min_count`` bytes."""
        tree: dict = {}
        for o in range(order + 1):
            code, inv = np.unique(gram % 257 ** (o + 1), return_inverse=True)
            total = np.bincount(inv, weights=n.astype(np.float64)) if len(code) else np.zeros(0)
            context, symbol = code // 257, code % 257
            starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(code) else []
            for a, b in zip(starts, [*starts[1:], len(code)], strict=True):
                if o and total[a:b].sum() < min_count:
                    continue
                c, digits = int(context[a]), []
                for _ in range(o):
                    c, d = divmod(c, 257)
                    digits.append(d)
                tree[tuple(digits[::-1])] = (symbol[a:b].astype(np.int64), total[a:b])
        return tree

    @staticmethod
    def _node_cost(tree: dict, context: tuple) -> np.ndarray:
        cost, paid, excluded = np.zeros(256), 0.0, np.zeros(256, bool)
        while True:
            symbols, n = tree[context]
            use = ~excluded[symbols]
            symbols, n = symbols[use], n[use]
            if len(symbols):
                total = n.sum() + len(symbols)
                cost[symbols] = paid - np.log2(n / total)
                paid -= np.log2(len(symbols) / total)
                excluded[symbols] = True
            if not context:
                rest = ~excluded
                cost[rest] = paid + np.log2(max(1, rest.sum()))
                return cost
            context = context[1:]

    def _number(self) -> None:
        """Array form of the look-up: the row of each context over the symbols in use."""
        base = self.base
        row_of = np.zeros(1, np.int32)
        for o in range(1, self.order + 1):
            wider = np.tile(row_of, base)  # an added older byte changes nothing unless the longer context is known
            for c, row in self.rows.items():
                if len(c) == o:
                    i = 0
                    for b in c:
                        i = i * base + int(self.symbol[b])
                    wider[i] = row
            row_of = wider
        self.row_of = row_of
        self.cost = self.cost.reshape(len(self.rows) * base, len(self.languages))

    def code_length(self, text: bytes) -> np.ndarray:
        """Bits of the whole text in each language."""
        out = np.zeros(len(self.languages))
        step = 1 << 20  # very long texts go through in blocks, each with the bytes before it
        s = np.concatenate([np.full(self.order, _HOLD, np.int64), np.frombuffer(text, np.uint8).astype(np.int64)])
        small = self.symbol[s]
        for start in range(0, len(text), step):
            n = min(step, len(text) - start)
            context = np.zeros(n, np.int64)
            for i in range(self.order):
                context = context * self.base + small[start + i : start + i + n]
            at = self.row_of[context].astype(np.int64) * self.base + small[start + self.order : start + self.order + n]
            out += self.cost[at].sum(axis=0, dtype=np.float64)
        return out


class Languages:
    """Context trees of all languages, in tables of bounded size."""

    def __init__(self, blocks: list[ContextTrees]):
        self.blocks = blocks
        self.languages = [x for b in blocks for x in b.languages]


def table_bytes(by_language: list[tuple[np.ndarray, np.ndarray]], order: int) -> int:
    """Upper bound of the size of the languages' table, from the grams alone."""
    grams = np.unique(np.concatenate([g for g, _ in by_language]))
    contexts = 1 + sum(len(np.unique(grams % 257 ** (o + 1) // 257)) for o in range(1, order + 1))
    symbols = 1 + len(np.unique(np.concatenate([grams // 257**o % 257 for o in range(order + 1)])))
    return 4 * (contexts * symbols * len(by_language) + symbols**order)


def _tables(languages: list[str], by_language: list[tuple[np.ndarray, np.ndarray]], order: int, min_count: int, block_bytes: int) -> list[ContextTrees]:
    """One table, or those of halves of the languages where it may be too large; that is known before it is made."""
    if len(languages) < 2 or table_bytes(by_language, order) <= block_bytes:
        return [ContextTrees(languages, by_language, order, min_count)]
    half = len(languages) // 2
    return _tables(languages[:half], by_language[:half], order, min_count, block_bytes) + _tables(languages[half:], by_language[half:], order, min_count, block_bytes)


def train(docs: DataFrame, order: int = 3, docs_per_language: int = 400, block_languages: int = 50, block_bytes: int = 256 << 20, min_count: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Context trees from rows with a non-null language (held-out rows are left to the caller)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null")
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of")), "language-sizes")
    # A seeded cut leaves about four times the sample, so that few rows are ranked; languages whose ids
    # repeat so often that it leaves too little are ranked whole.
    order_by = F.xxhash64("id", F.lit(11))
    spare = F.pmod(order_by, F.lit(1_000_000)) < F.floor(F.least(F.lit(1.0), F.lit(4 * docs_per_language) / F.col("of")) * 1_000_000)
    names = sorted(r["lang"] for r in sizes.select("lang").collect())
    few = lambda t: F.broadcast(t) if len(names) <= 100_000 else t
    left = rows.select("id", "lang").join(few(sizes), "lang").groupBy("lang", "of").agg(F.count_if(spare).alias("left"))
    sizes = materialize(left.select("lang", "of", (F.col("left") < F.least("of", F.lit(docs_per_language))).alias("whole")), "language-cuts")
    ranked = rows.join(few(sizes), "lang").filter(F.col("whole") | spare)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(order_by, "id", F.xxhash64("text"))))
    # Null texts of the sample count as empty ones.
    sample = ranked.filter(F.col("rank") <= docs_per_language).select("lang", "text")
    if len(names) > block_languages:
        sample = materialize(sample, "language-sample")
    blocks: list[ContextTrees] = []
    for low in range(0, len(names), block_languages):
        own = names[low : low + block_languages]
        counted = sample.filter(F.col("lang").isin(own)).mapInArrow(trimmed(_counts(order)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
        found = {lang: g.sort_values("gram") for lang, g in counted.groupby("lang")}
        languages = [x for x in own if x in found]
        if languages:
            blocks += _tables(languages, [(found[x]["gram"].to_numpy(dtype=np.int64), found[x]["n"].to_numpy(dtype=np.int64)) for x in languages], order, min_count, block_bytes)
    return Languages(blocks)


def _pass(model, last: bool):
    """Rows (..., text, lang, bits, total): the shortest code so far, and the sum of 2 ** (bits - code) over languages.

    The last pass gives no text back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: ContextTrees = model.value
        for batch in (part for whole in batches for part in slices(whole, 2)):
            lang, best, total = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for i, text in enumerate(batch.column(2).to_pylist()):
                if text and any(map(str.isalpha, text)):
                    bits = trees.code_length(fold(text))
                    k = int(bits.argmin())
                    own = float(np.exp2(np.maximum(bits[k] - bits, -1000.0)).sum())
                    if lang[i] is None:
                        lang[i], best[i], total[i] = trees.languages[k], float(bits[k]), own
                    elif bits[k] < best[i]:
                        lang[i], best[i], total[i] = trees.languages[k], float(bits[k]), own + total[i] * 2.0 ** max(float(bits[k]) - best[i], -1000.0)
                    else:
                        total[i] += own * 2.0 ** max(best[i] - float(bits[k]), -1000.0)
            text = pa.nulls(len(batch), pa.string()) if last else batch.column(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(lang, pa.string()), pa.array(best, pa.float64()), pa.array(total, pa.float64())], batch.schema.names)

    return run


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The score is the probability under equal priors; it saturates at 1 for all
    but short texts.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("bits"), F.lit(None).cast("double").alias("total"))
    for k, trees in enumerate(model.blocks):
        if k:  # one table in a worker at a time
            rows = materialize(rows, "language-pass")
        shared = docs.sparkSession.sparkContext.broadcast(trees)
        rows = rows.mapInArrow(trimmed(_pass(shared, k == len(model.blocks) - 1)), f"doc_id {kind}, held_out boolean, text string, lang string, bits double, total double")
    return rows.select("doc_id", "held_out", F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.coalesce(1.0 / F.col("total"), F.lit(0.0)).alias("score"))
