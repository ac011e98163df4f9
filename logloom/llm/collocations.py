"""Phrase collocations by sorted count streams.

1. *Words.*  Tasks count words by language; sums give n and the words that are
   frequent enough to be in a phrase.
2. *Pairs and triples.*  A phrase is as frequent as each of its parts at most.
   Tasks count fingerprints of neighbouring words that may both be frequent, then
   of three words whose pairs may both be.
3. *Phrases* of two to ``longest`` words whose pairs and triples may all be
   frequent are counted exactly, as text.  What "may be" is a bitmap of fixed
   size: a bit that is set for another word or pair costs a count, never a phrase.
   Counts of a task travel as sorted blocks, cut at fixed places of the order, and
   are merged place by place.
4. *Streams.*  Frequent words and phrases are sorted by their words read
   backwards (suffix order).  There each phrase follows its own endings, so one
   pass with a stack of open phrases meets the counts of all endings of a phrase
   and, for each phrase, the largest count of those that put a word before it.
   That result, sorted by words (prefix order), is read in the same way: the
   beginnings of a phrase and the largest count with a word after it.  Nothing is
   looked up in a table; a task holds the open phrases alone.

A stream is dealt to tasks by cuts in its own order, found on a bounded sample,
so a word that begins a third of all phrases is spread over several tasks.  The
few phrases whose continuations reach over a cut are sent to each task
concerned, and what these find is put together by a maximum.

A phrase that is covered by a longer one of the same count is covered by one of
a single word more, since counts never rise with length.

Defined results: a null language is ``und``; null and empty texts hold no words;
repeated rows count each time; an empty table gives an empty result; other
columns are ignored.  A language whose phrases are all rare has no rows.
"""

from __future__ import annotations

import bisect
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches, trimmed

# What ends a piece of text, and what parts its words.
_ENDS, _BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_MARK = b"\n"
_TO_PARTS = bytes.maketrans(_ENDS + _BLANKS, _MARK * len(_ENDS) + b" " * len(_BLANKS))
_MIX, _MIX2 = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xFF51AFD7ED558CCD)
#: Rows of a task that are counted together before they are sent.
_HELD = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in lower case, with a mark at each end of a piece."""
    parts = (text or "").encode().lower().translate(_TO_PARTS).replace(_MARK, b" \n ").split(b" ")
    return [w for w in parts if w]


def _fingerprint(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\x00" + word)


def pair_fingerprints(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of two words in a row from their own."""
    h = (left ^ (left >> np.uint64(31))) * _MIX + right
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words) of some texts at a time; a mark stands between texts."""
    for part in (p for batch in batches for p in slices(batch, 1)):
        texts = defaultdict(list)
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if text:
                texts[lang].append(text)
        for lang, own in texts.items():
            yield lang, words_of("\n".join(own))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a task."""
    held: dict[str, Counter] = defaultdict(Counter)

    def told() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(_MARK, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
        held.clear()

    for lang, words in _by_lang(batches):
        held[lang].update(words)
        if sum(map(len, held.values())) > _HELD // 8:
            yield from told()
    yield from told()


class _Coder:
    """Words of a language as numbers within a task, with their fingerprints and whether they may be frequent."""

    def __init__(self, lang: str, bits: np.ndarray):
        self.lang, self.bits = lang, bits
        self.ids: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.ids[_MARK]
        self.prints, self.often = np.zeros(1, np.uint64), np.zeros(1, bool)
        self.names: list[bytes] = [_MARK]

    def __call__(self, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) > len(self.names):
            new = list(itertools.islice(self.ids, len(self.names), None))
            prints = np.fromiter((_fingerprint(self.lang, w) for w in new), np.uint64, len(new))
            self.names += new
            self.prints, self.often = np.concatenate([self.prints, prints]), np.concatenate([self.often, has_bits(self.bits, prints)])
        return ids


def has_bits(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the bit of each fingerprint is set; ``bits`` has a power of two bytes."""
    at = prints >> np.uint64(64 - int(np.log2(len(bits) * 8)))
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class _Marks:
    """What may be frequent at each place of a run of words."""

    def __init__(self, coder: _Coder, words: list[bytes], pairs: np.ndarray | None, triples: np.ndarray | None):
        self.ids = coder(words)
        self.own = coder.prints[self.ids]
        often = coder.often[self.ids]
        pair = often[:-1] & often[1:]
        at = np.flatnonzero(pair)
        self.pair_prints = np.zeros(len(pair), np.uint64)
        self.pair_prints[at] = pair_fingerprints(self.own[at], self.own[at + 1])
        if pairs is not None:
            pair[at] = has_bits(pairs, self.pair_prints[at])
        self.pair = pair
        triple = pair[:-1] & pair[1:]
        if triples is not None:
            at = np.flatnonzero(triple)
            triple[at] = has_bits(triples, self.triple_prints(at))
        self.triple = triple

    def triple_prints(self, at: np.ndarray) -> np.ndarray:
        return pair_fingerprints(self.pair_prints[at], self.own[at + 2])


def _coded(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[tuple[_Coder, list[bytes]]]:
    """Words of some texts at a time with the numbers of their language's words."""
    coders: dict[str, _Coder] = {}
    for lang, texts in _by_lang(batches):
        yield coders.setdefault(lang, _Coder(lang, words)), texts
        if sum(len(c.names) for c in coders.values()) > _HELD // 8:
            coders.clear()


def _blocks(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers in a sorted array."""
    if not len(bucket):
        return
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[low]), slice(low, high)


def _prints(words: Broadcast, pairs: Broadcast | None, log_buckets: int):
    """Blocks (bucket, keys, counts) of the fingerprints of pairs, or of triples where the pairs' bitmap is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            prints, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            own = [(k, prints[i].tobytes(), n[i].astype(np.int64).tobytes()) for k, i in _blocks(prints >> np.uint64(64 - log_buckets))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "keys", "counts"])

        for coder, texts in _coded(batches, words.value):
            marks = _Marks(coder, texts, pairs and pairs.value, None)
            held.append(marks.triple_prints(np.flatnonzero(marks.triple)) if pairs else marks.pair_prints[marks.pair])
            if sum(map(len, held)) > _HELD:
                yield told()
        yield told()

    return run


def _frequent_prints(least: int):
    """Blocks of ``_prints`` in order of bucket -> fingerprints counted ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, counts = None, [], []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

        def told() -> pa.RecordBatch:
            key, n = merged() if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(key[n >= least].view(np.int64))], ["print"])

        for batch in batches:
            for b, key, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket:
                    yield told()
                    bucket, keys, counts = b, [], []
                keys.append(np.frombuffer(key, np.uint64))
                counts.append(np.frombuffer(n, np.int64))
                if len(keys) > 1 and sum(map(len, keys)) > max(_HELD, 2 * len(keys[0])):
                    key, total = merged()
                    keys, counts = [key], [total]
        yield told()

    return run


def _phrases(words: Broadcast, pairs: Broadcast, triples: Broadcast, longest: int, log_buckets: int):
    """Blocks (bucket, lang, phrases, counts) of a task: two words or more, of which all pairs and triples may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def told() -> pa.RecordBatch:
            rows = []
            for lang, counts in held.items():
                texts, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                place = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)) >> np.uint64(64 - log_buckets)
                order = np.argsort(place, kind="stable")
                rows += [(k, lang, _MARK.join([texts[j] for j in order[i]]), n[order[i]].tobytes()) for k, i in _blocks(place[order])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["bucket", "lang", "phrases", "counts"])

        for coder, texts in _coded(batches, words.value):
            marks = _Marks(coder, texts, pairs.value, triples.value)
            names, phrase = coder.names, marks.ids  # phrase: number of the one that begins at a place
            known = np.arange(len(names))[:, None]
            at = np.flatnonzero(marks.pair)
            for order in range(2, longest + 1):
                if order > 2:
                    at = at[at + order - 3 < len(marks.triple)]
                    at = at[marks.triple[at + order - 3]]
                if not len(at):
                    break
                # A phrase is the number of its beginning and its last word.
                codes, inverse, n = np.unique(phrase[at] * len(names) + marks.ids[at + order - 1], return_inverse=True, return_counts=True)
                known = np.concatenate([known[codes // len(names)], (codes % len(names))[:, None]], axis=1)
                own = held[coder.lang]
                for row, count in zip(known.tolist(), n.tolist(), strict=True):
                    own[b" ".join([names[i] for i in row])] += count
                phrase = np.zeros(len(marks.ids), np.int64)
                phrase[at] = inverse
            if sum(map(len, held.values())) > _HELD // 8:
                yield told()
        yield told()

    return run


def _frequent_phrases(least: int):
    """Blocks of ``_phrases`` in order of bucket -> (lang, phrase, a) of those counted ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, defaultdict(Counter)

        def told() -> pa.RecordBatch:
            rows = [(lang, text, n) for lang, counts in held.items() for text, n in counts.items() if n >= least]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "phrase", "a"])

        for batch in batches:
            for b, lang, texts, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != bucket:
                    yield told()
                    bucket = b
                own = held[lang]
                for text, count in zip(texts.split(_MARK), np.frombuffer(n, np.int64).tolist(), strict=True):
                    own[text] += count
        yield told()

    return run


def _word_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_fingerprint(lang, word.encode()) for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(prints, np.uint64).view(np.int64))], ["print"])


def _bitmap(prints: DataFrame, log_bits: int) -> Broadcast:
    """One bit for each fingerprint (column print): 2 ** log_bits bits however many there are.

    The bitmap is put together in blocks of 32 KB, a task holding one at a time.
    """
    place = F.shiftrightunsigned("print", 64 - log_bits)
    block = 1 << min(18, log_bits)
    places = prints.select((place / block).cast("long").alias("block"), (place % block).cast("int").alias("bit")).distinct()

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(block, np.uint8)
        own[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    out = np.zeros(1 << (log_bits - 3), np.uint8)
    for r in places.groupBy("block").applyInPandas(packed, "block long, bits binary").toLocalIterator():
        out[r["block"] * (block // 8) : (r["block"] + 1) * (block // 8)] = np.frombuffer(r["bits"], np.uint8)
    return prints.sparkSession.sparkContext.broadcast(out)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (lang, key, ...) by parts in the order of (lang, key), sorted within.

    ``copy`` marks a phrase that is sent along to a later part, as phrases that
    begin with it are there.
    """
    sample = rows.select("lang", "key").orderBy(F.xxhash64("lang", "key")).limit(parts * 50).collect()
    ordered = sorted((r["lang"], tuple(r["key"])) for r in sample)
    cuts = sorted({ordered[i * len(ordered) // parts] for i in range(1, parts)}) if ordered else []

    def place(lang: pd.Series, key: pd.Series) -> pd.DataFrame:
        first, last = [], []
        for at in zip(lang, map(tuple, key), strict=True):
            i = j = bisect.bisect_right(cuts, at)
            while j < len(cuts) and cuts[j][0] == at[0] and cuts[j][1][: len(at[1])] == at[1]:
                j += 1
            first.append(i)
            last.append(j)
        return pd.DataFrame({"first": first, "last": last})

    at = F.pandas_udf(place, "first int, last int")("lang", "key")
    spread = rows.withColumn("at", at).withColumn("part", F.explode(F.sequence("at.first", "at.last")))
    marked = spread.withColumn("copy", F.col("part") > F.col("at.first")).drop("at")
    return marked.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "lang", "key")


class _Open:
    """A phrase of the stream whose continuations are being read."""

    def __init__(self, lang, key, copy, n, a, counts, wider):
        self.lang, self.key, self.copy, self.n, self.a = lang, key, copy, n, a
        self.counts, self.wider, self.next = counts, wider, 0


def _stream(longest: int):
    """Rows (part, lang, key, copy, n, a, counts, wider) in order -> (lang, key, copy, n, a, begins, counts, wider).

    ``begins``: counts of the phrase's beginnings of one word, two, and so on;
    ``wider``: the largest count of a longer phrase with one word more.
    """
    kinds = (pa.string(), pa.list_(pa.string()), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
    names = ["lang", "key", "copy", "n", "a", "begins", "counts", "wider"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Open] = []
        out: list[tuple] = []
        part = None

        def close(depth: int) -> None:
            while len(stack) > depth:
                x = stack.pop()
                begins = None if x.copy else [s.a for s in stack]
                out.append((x.lang, list(x.key), x.copy, x.n, x.a, begins, x.counts, max(x.wider, x.next)))

        for batch in batches:
            for p, lang, key, copy, n, a, counts, wider in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                key = tuple(key)
                if p != part:
                    close(0)
                    part = p
                while stack and not (stack[-1].lang == lang and key[: len(stack[-1].key)] == stack[-1].key):
                    close(len(stack) - 1)
                if stack and stack[-1].key == key:  # found by two tasks of the stream before
                    top = stack[-1]
                    top.wider = max(top.wider, wider)
                    if a is not None:
                        top.n, top.a, top.counts = n, a, counts
                else:
                    stack.append(_Open(lang, key, copy, n, a, counts, wider))
                if len(stack) > 1 and a is not None:
                    stack[-2].next = max(stack[-2].next, a)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        close(0)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names)

    return run


_STREAMED = "lang string, key array<string>, copy boolean, n long, a long, begins array<long>, counts array<long>, wider long"


def lowest_cut(a: int, n: int, begins: list[int], ends: list[int]) -> tuple[int, int, int]:
    """(score, l, r) of the cut with the lowest score, ties to the shortest first part; ends by length."""
    score, _, left, right = min(((1000 * a * n) // (x * y), k, x, y) for k, (x, y) in enumerate(zip(begins, reversed(ends), strict=True)))
    return score, left, right


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for lang, key, copy, n, a, begins, ends, wider in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            found = (None,) * 5 if copy else (a, n, *lowest_cut(a, n, begins, ends))
            out.append((lang, " ".join(key), *found, wider))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        kinds = [pa.string(), pa.string()] + [pa.int64()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "phrase", "a", "n", "score", "l", "r", "wider"])


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, log_bits: int = 26, log_buckets: int = 12) -> DataFrame:
    """(lang, phrase, a, n): words and phrases found ``least`` times or more, and the words of their language.

    ``log_bits``: size of the bitmaps (2 ** 26 bits are 8 MB).  ``log_buckets``:
    into how many places blocks of counts are cut; a task merges one at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = rows.mapInArrow(trimmed(_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("a"))
    words = materialize(words, "phrase-words")
    common = words.filter(F.col("a") >= least)
    word_bits = _bitmap(common.select("lang", "word").mapInArrow(_word_prints, "print long"), log_bits)

    def merged(blocks: DataFrame, least_of, schema: str) -> DataFrame:
        return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(least_of(least)), schema)

    def bits(pairs: Broadcast | None) -> Broadcast:
        blocks = rows.mapInArrow(trimmed(_prints(word_bits, pairs, log_buckets)), "bucket int, keys binary, counts binary")
        return _bitmap(materialize(merged(blocks, _frequent_prints, "print long"), "phrase-prints"), log_bits)

    pair_bits = bits(None)
    triple_bits = bits(pair_bits) if longest > 2 else word_bits
    blocks = rows.mapInArrow(trimmed(_phrases(word_bits, pair_bits, triple_bits, longest, log_buckets)), "bucket int, lang string, phrases binary, counts binary")
    phrases = merged(blocks, _frequent_phrases, "lang string, phrase string, a long")
    both = phrases.union(common.select("lang", "word", "a"))
    return materialize(both.join(words.groupBy("lang").agg(F.sum("a").alias("n")), "lang"), "phrase-counts")


def candidates(counts: DataFrame, longest: int = 5, parts: int | None = None) -> DataFrame:
    """(lang, phrase, a, n, score, l, r, wider) of the phrases of two words or more of ``frequent``.

    ``wider`` is the largest count of a phrase that holds it and one word more, else 0.
    ``parts``: tasks of a stream, by default as many as a shuffle has.
    """
    parts = parts or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = trimmed(_stream(longest))
    columns = ["part", "lang", "key", "copy", "n", "a", "counts", "wider"]
    words = F.split("phrase", " ")
    none = [F.lit(None).cast("array<long>").alias("counts"), F.lit(0).cast("long").alias("wider")]
    suffix = _dealt(counts.select("lang", F.reverse(words).alias("key"), "n", "a", *none), parts).select(columns).mapInArrow(step, _STREAMED)
    # Copies state only what a later task has found; a is theirs no longer, so that it counts once.
    own = lambda c: F.when(~F.col("copy"), F.col(c)).alias(c)
    ends = materialize(suffix.select("lang", F.reverse("key").alias("key"), own("n"), own("a"), F.col("begins").alias("counts"), "wider"), "phrase-ends")
    prefix = _dealt(ends, parts).select(columns).mapInArrow(step, _STREAMED)
    scored = prefix.filter(F.size("key") > 1).select("lang", "key", "copy", "n", "a", "begins", "counts", "wider").mapInArrow(_scored, "lang string, phrase string, a long, n long, score long, l long, r long, wider long")
    whole = scored.groupBy("lang", "phrase").agg(*[F.max(c).alias(c) for c in ("a", "n", "score", "l", "r", "wider")])
    return whole


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, parts: int | None = None, log_bits: int = 26) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, count and text.

    Phrases inside a longer one that is as frequent are left out.
    """
    found = candidates(frequent(docs, text_col, lang_col, least, longest, log_bits), longest, parts)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.filter(F.col("wider") < F.col("a")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
