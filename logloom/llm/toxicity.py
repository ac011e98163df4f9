"""Toxicity by a subsequence-kernel SVM with Nystroem landmarks.

A text is a list of sentences and a sentence a set of parts: its words, in lower
case, without punctuation at the ends, also without separators inside, what
stands between separators, alone and with all that follows, and runs of single
letters joined; a long word counts from each of its characters on.

A part and a landmark are compared by the gap-weighted subsequence kernel of
length ``P``: common subsequences of ``P`` characters count, the word's start
being a character, and each gap character costs a factor ``DECAY``.  The kernel
is normalised over a stretch of the part as long as the landmark and ``SLACK``
more, so that what surrounds an insult does not count, and the best stretch of
the whole part is taken: the one from its start, and those from each of the
landmark's first letters on (``INNER`` times).  It counts as 0 where the longest
common subsequence is shorter than ``SUPPORT`` of the landmark, and for
stretches that hold fewer of the landmark's characters than that.  So "i-d-i0ot" stays
close to "idiot", while most words of a corpus are screened out by a
bit-parallel test.  A sentence's value at a landmark is the best of its parts.

Labels are of texts, and training is on sentences: those of clean texts are
negative, and of each toxic text the sentence that scores highest so far is
positive (the rest of it stays open), over a few rounds.  Landmarks are parts of
labelled sentences: word beginnings whose documents are toxic more often than
chance explains (a binomial tail, corrected for their number) and which between
them explain most toxic texts, then parts of the clean sentences that score
highest.  Interrupted and stretched forms of the toxic parts join as sentences
of one part.  A squared-hinge linear SVM is fitted on the Nystroem features of
the sentences on the driver.  A text scores by its highest sentences, mapped to
a probability by Platt scaling of the three highest.

Bounds: ``max_rows`` labelled documents (a seeded sample; whole texts), of them
``max_texts`` on the driver, ``max_stems`` landmarks of toxic parts and
``max_forms`` parts with their forms.  All of this is only the fit; scoring
covers every part of every whole text.

Defined results: null texts, empty texts and texts without units get the score
of a text far from all landmarks; without labels of both kinds every score is
the smoothed rate of label 1; repeated rows are rows of their own; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled, materialize, slices, small_batches, trimmed

P = 4
DECAY = 0.8
LEAST = P - 1  # letters of the shortest units, which have P characters with the start mark
SUPPORT = 0.7
SLACK = 2
INNER = 0.7  # worth of a stretch inside a word next to one from its start
TOP = 3
SURE = 0.6  # decision value from which one unit is close to certain
WIDTH = 24  # longer units are cut into windows of this many characters with the mark, one from each character on
# Single letters or digits with separators between them. No character is both, and nothing is
# tried twice, so a text takes time in proportion to its length.
_CHAIN = re.compile(r"(?<![^\W_])[^\W_](?![^\W_])(?:[\s.*_-]++[^\W_](?![^\W_]))++")
_SEPARATORS = re.compile(r"[\s.*_-]+")
_INNER = re.compile(r"[\W_]+")
_ENDS = ".,;:!?\"'()[]{}<>«»“”‘’…|#$%&*-_/\\=+~^`@"


def units(text: str | None) -> set[str]:
    """Distinct units of a text."""
    if not text:
        return set()
    text = text.lower()
    out = {w.strip(_ENDS) for w in set(text.split())}
    if _single_letters(text):
        out.update(spelt(text))
    for w in [w for w in out if not w.isalnum()]:
        parts = [p for p in _INNER.split(w) if p]
        joined = "".join(parts)  # without separators inside
        out.update(parts)
        out.add(joined)
        if len(joined) < WIDTH:  # else the windows begin there too
            at = 0
            for p in parts:
                out.add(joined[at:])
                at += len(p)
    for w in [w for w in out if len(w) >= WIDTH]:
        out.discard(w)
        out.update(w[i : i + WIDTH - 1] for i in range(len(w) - LEAST + 1))
    return {w for w in out if len(w) >= LEAST}


def spelt(text: str, least: int = 4) -> Iterator[str]:
    """Single letters in a row, joined: from one that begins a word (between blanks) to one that ends a word."""
    for m in _CHAIN.finditer(text):
        own = m.group()
        if m.start() and not text[m.start() - 1].isspace():
            begins = re.search(r"\s(?=[^\W_])", own)
            own = own[begins.end() :] if begins else ""
        if m.end() < len(text) and not text[m.end()].isspace():
            ends = [x.end() for x in re.finditer(r"[^\W_](?=\s)", own)]
            own = own[: ends[-1]] if ends else ""
        joined = _SEPARATORS.sub("", own)
        if len(joined) >= least:
            yield joined


def _single_letters(text: str) -> bool:
    """Quick test for two single letters in a row."""
    return bool(re.search(r"(?<!\S)\w\s\w(?!\S)", text))


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]


def coded(words: Sequence[str]) -> np.ndarray:
    """Characters of words as bytes, the start mark first, 0 after the end."""
    a = np.array(["^" + w for w in words], dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
    return np.where(a < 256, a, 128 + a % 128).astype(np.uint8)


def common_lengths(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each row with each landmark, bit-parallel.

    Landmarks share 64-bit words, each in a field of its own with a guard bit
    that takes the carry of the field's addition.
    """
    sizes = (landmarks > 0).sum(axis=1)
    packs: list[list[tuple[int, int]]] = []  # (landmark, first bit) of each word
    room = 0
    for k, n in enumerate(sizes.tolist()):
        if n + 1 > room:
            packs.append([])
            room = 64
        packs[-1].append((k, 64 - room))
        room -= n + 1
    out = np.zeros((len(x), len(landmarks)), np.int8)
    longest = int((x > 0).sum(axis=1).max(initial=0))
    for pack in packs:
        table = np.zeros(256, np.uint64)
        fields = [(k, np.uint64(((1 << int(sizes[k])) - 1) << start)) for k, start in pack]
        for k, start in pack:
            for j in range(int(sizes[k])):
                table[landmarks[k, j]] |= np.uint64(1 << (start + j))
        whole = np.bitwise_or.reduce([f for _, f in fields])
        v = np.full(len(x), whole, np.uint64)
        for i in range(longest):
            u = v & table[x[:, i]]
            v = ((v + u) | (v - u)) & whole
        for k, f in fields:
            out[:, k] = sizes[k] - np.bitwise_count(v & f)
    return out


def raw_kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of aligned rows of two code arrays."""
    x, y = (a[:, : max(1, int((a > 0).sum(axis=1).max(initial=0)))] for a in (x, y))
    b, s, t = len(x), x.shape[1], y.shape[1]
    decay = np.triu(DECAY ** np.maximum(0, np.arange(t)[None, :] - np.arange(t)[:, None])).astype(np.float64)
    # ends[i][:, j]: weight of common subsequences of i+1 characters in the part of x read so
    # far and y[:j+1], gaps counted up to both ends.
    ends = [np.zeros((b, t)) for _ in range(P - 1)]
    total = np.zeros(b)
    for k in range(s):  # no array is wider than its longest row
        match = ((y == x[:, k : k + 1]) & (y > 0)).astype(np.float64) * DECAY**2
        for i in range(P - 1, -1, -1):
            if i == 0:
                before = np.ones((b, t))
            else:
                before = np.concatenate([np.zeros((b, 1)), ends[i - 1][:, :-1]], axis=1)
            now = match * before
            if i == P - 1:
                total += now.sum(axis=1)
            else:
                ends[i] = ends[i] * DECAY + now @ decay
    return total


def kernel(x: np.ndarray, landmarks: np.ndarray, self_landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows near any landmark, their normalised kernel values with all landmarks)."""
    lengths = (landmarks > 0).sum(axis=1)
    least = np.maximum(P, np.ceil(SUPPORT * lengths))
    sizes = (x > 0).sum(axis=1)
    near = np.zeros((len(x), len(landmarks)), bool)
    for low, high in ((0, 8), (8, 12), (12, WIDTH)):  # short words need few steps
        own = np.flatnonzero((sizes > low) & (sizes <= high))
        near[own] = common_lengths(x[own], landmarks) >= least
    rows = np.flatnonzero(near.any(axis=1))
    out = np.zeros((len(rows), len(landmarks)))
    pair_row, pair_mark = np.nonzero(near[rows])
    by_length = np.argsort(lengths[pair_mark], kind="stable")
    pair_row, pair_mark = pair_row[by_length], pair_mark[by_length]
    at = np.arange(WIDTH)
    for low in range(0, len(pair_row), 10_000):
        i, j = pair_row[low : low + 10_000], pair_mark[low : low + 10_000]
        part = x[rows[i]]
        same = (part[:, :, None] == landmarks[j][:, None, :]) & (part > 0)[:, :, None]
        # Characters of the landmark in each stretch; the start mark is in the first one alone.
        seen = np.concatenate([np.zeros((len(i), 1), np.int64), np.cumsum(same.any(axis=2), axis=1)], axis=1)
        end = np.minimum(at + (lengths[j] + SLACK)[:, None], WIDTH)
        enough = np.take_along_axis(seen, end, 1) - seen[:, :-1] >= least[j][:, None] - (at > 0)
        # The first letter lies in the stretch from the start already.
        starts = same[:, :, 1:4].any(axis=2) & (at > 1)
        starts[:, 0] = True
        p, o = np.nonzero(starts & enough)
        where = o[:, None] + at
        stretch = np.where((where < WIDTH) & (at < (lengths[j] + SLACK)[p][:, None]), part[p[:, None], np.minimum(where, WIDTH - 1)], 0)
        value = raw_kernel(stretch, landmarks[j[p]]) / np.sqrt(np.maximum(raw_kernel(stretch, stretch) * self_landmarks[j[p]], 1e-300))
        np.maximum.at(out, (i[p], j[p]), np.where(o > 0, INNER, 1.0) * value)
    return rows, out


def _evidence(top: np.ndarray) -> np.ndarray:
    """Features of the highest units: each value, and how far the highest is beyond doubt."""
    x = np.clip(top, -2, 1.5)
    return np.hstack([x, np.maximum(0, x[:, :1] - SURE)])


class Model:
    """Landmarks, their weights, the intercept and the Platt line."""

    def __init__(self, landmarks: Sequence[str], weights: np.ndarray, intercept: float, slope: Sequence[float], shift: float):
        """``slope``: weights of the highest ``TOP`` units of a text in its log-odds."""
        self.words, self.weights, self.intercept, self.slope, self.shift = list(landmarks), weights, intercept, np.asarray(slope, float), shift
        self.landmarks = coded(self.words) if self.words else np.zeros((0, WIDTH), np.uint8)
        self.own = raw_kernel(self.landmarks, self.landmarks) if self.words else np.zeros(0)

    def near(self, parts: Sequence[str]) -> dict[str, np.ndarray]:
        """Kernel values with all landmarks of the parts near any."""
        out: dict[str, np.ndarray] = {}
        for low in range(0, len(parts) if self.words else 0, 20_000):
            block = parts[low : low + 20_000]
            rows, k = kernel(coded(block), self.landmarks, self.own)
            out.update(zip((block[r] for r in rows.tolist()), k, strict=True))
        return out

    def decide(self, values: np.ndarray) -> np.ndarray:
        """Decision values of sentences from their values at the landmarks."""
        return self.intercept + values @ self.weights

    def probability(self, top: np.ndarray) -> np.ndarray:
        """From the highest decision values of texts, one row each."""
        return 1 / (1 + np.exp(-np.clip(_evidence(top) @ self.slope + self.shift, -50, 50)))

    def texts(self, texts: Sequence[str | None], far: set[str]) -> np.ndarray:
        """The ``TOP`` highest decision values of each text's sentences.

        ``far``: parts without a near landmark, kept between calls.
        """
        own = [units(t) - far for t in texts]
        fresh = sorted(set().union(*own)) if own else []
        near = self.near(fresh)
        if len(far) + len(fresh) > 400_000:
            far.clear()
        far.update(w for w in fresh if w not in near)
        return np.array([self.highest(bags(t, found) if (found := {w: near[w] for w in p if w in near}) else []) for t, p in zip(texts, own, strict=True)])

    def highest(self, held: Sequence[np.ndarray]) -> np.ndarray:
        """The ``TOP`` highest decision values of a text from those of its sentences that hold near parts."""
        out = np.full(TOP, self.intercept)
        for k, v in enumerate(heapq.nlargest(TOP, self.decide(np.array(held)).tolist()) if held else []):
            out[k] = max(v, self.intercept) if k else v
        return out

    def words_probability(self, words: Sequence[str]) -> np.ndarray:
        """Probability of texts of one sentence with one part each."""
        top = np.full((len(words), TOP), self.intercept)
        near = self.near(list(words))
        for i, w in enumerate(words):
            if w in near:
                top[i, 0] = self.decide(near[w])
        return self.probability(top)


def bags(text: str, near: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Values at the landmarks of each sentence that holds a part of ``near``.

    Parts that cross the end of a sentence (letters spelt over several lines) stand alone.
    """
    out, left = [], set(near)
    for sentence in sentences(text):
        if own := units(sentence) & near.keys():
            out.append(np.maximum.reduce([near[w] for w in own]))
            left -= own
    return out + [near[w] for w in sorted(left)]


def variants(word: str, rng: np.random.Generator) -> list[str]:
    """Spaced, interrupted and stretched forms of a word."""
    i, j = (int(v) for v in rng.integers(1, len(word), 2))
    return ["-".join(word)[:WIDTH], word[:i] + "*x0"[int(rng.integers(3))] + word[i:], word[:j] + word[j - 1] + word[j:], word[:i] + "-" + word[i:]]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 600) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient steps."""
    x = np.hstack([z, np.ones((len(z), 1))])
    rate = 1 / (2 * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + ridge)
    w = v = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        g = -2 * x.T @ (weight * y * slack) + ridge * np.r_[v[:-1], 0]
        w_new = v - rate * g
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = w_new + (t - 1) / t_new * (w_new - w)
        w, t = w_new, t_new
    return w[:-1], float(w[-1])


STEMS = range(4, 11)  # lengths of word beginnings that are counted


def _log_choose_tail(toxic: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """Log of a bound (Chernoff) on the chance of that many toxic documents among n."""
    q = np.clip(toxic / n, 1e-12, 1 - 1e-12)
    kl = q * np.log(q / rate) + (1 - q) * np.log((1 - q) / (1 - rate))
    return np.where(q > rate, -n * kl, 0.0)


def _covering(candidates: Sequence[str], toxic: Sequence[set[str]], times: int = 3) -> list[str]:
    """Candidates in the order in which they explain most toxic texts.

    A text needs no further explanation once ``times`` stems are found in it,
    so words only found beside stronger ones (all those of a text that was
    copied, say) are left out.  A stem of a chosen one, or longer than one, adds
    nothing.
    """
    holds: dict[str, set[int]] = {c: set() for c in candidates}
    for i, own in enumerate(toxic):
        for c in own & holds.keys():
            holds[c].add(i)
    count, out = [0] * len(toxic), []
    rank = {c: k for k, c in enumerate(candidates)}
    while holds:
        gain = {c: sum(count[i] < times for i in own) for c, own in holds.items()}
        c = max(holds, key=lambda c: (gain[c], -rank[c]))
        if gain[c] < max(3, len(toxic) // 100):
            break
        c = max((d for d in holds if d.startswith(c) and gain[d] >= 0.8 * gain[c]), key=lambda d: (len(d), d))
        out.append(c)
        for i in holds[c]:
            count[i] += 1
        holds = {d: own for d, own in holds.items() if not d.startswith(c) and not c.startswith(d)}
    return out


def fit_sentences(stems: Sequence[str], toxic: np.ndarray, n: np.ndarray, rate: float, documents: Sequence[tuple[str | None, int]], max_stems: int = 60, max_forms: int = 1000, n_landmarks: int = 60, rounds: int = 3, seed: int = 0) -> Model:
    """Model from counts of stems (documents and toxic documents of each) and labelled texts."""
    rng = np.random.default_rng(seed)
    stems = np.array(stems, dtype=object)
    base = Model([], np.zeros(0), 0.0, np.zeros(TOP + 1), float(np.log(rate / (1 - rate))) if 0 < rate < 1 else 0.0)
    if not len(stems) or not 0 < rate < 1:
        return base
    tail = _log_choose_tail(toxic, n, rate)
    sure = np.flatnonzero((tail < np.log(0.2 / len(stems))) & (toxic >= 0.8 * n))
    sure = sorted(stems[sure].tolist(), key=dict(zip(stems.tolist(), zip(tail.tolist(), [-len(s) for s in stems], stems.tolist(), strict=True), strict=True)).get)
    parts = [units(t) for t, _ in documents]
    label = np.array([y for _, y in documents], float)
    found = _covering(sure, [{w[:k] for w in own for k in STEMS if len(w) >= k} for own, y in zip(parts, label, strict=True) if y])[:max_stems]
    if not found:
        return base
    clean = set().union(*(own for own, y in zip(parts, label, strict=True) if not y))
    insults = sorted(w for w in set().union(*(own for own, y in zip(parts, label, strict=True) if y)) - clean if w.startswith(tuple(found)))
    insults = sorted(set(rng.permutation(insults)[:max_forms].tolist()) | set(found))
    forms = insults + [v for w in insults for v in variants(w, rng)]
    every = sorted(set().union(*parts))

    def spread(pool: Sequence[str], m: int) -> list[str]:
        """Landmarks from a pool in order, none that another covers."""
        out: list[str] = []
        codes = coded(pool)
        self_k = raw_kernel(codes, codes)
        left = np.ones(len(pool), bool)
        while len(out) < m and left.any():
            i = int(np.argmax(left))
            out.append(pool[i])
            rows, k = kernel(codes, codes[i : i + 1], self_k[i : i + 1])
            left[rows[k[:, 0] > 0.85]] = False
            left[i] = False
        return out

    def values_of(words: Sequence[str], marks: list[str], known: dict[str, np.ndarray], before: int) -> dict[str, np.ndarray]:
        """Values of words at all ``marks``, of which ``known`` has the first ``before``."""
        new = Model(marks[before:], np.zeros(0), 0.0, [], 0.0).near(words) if len(marks) > before else {}
        return {w: np.r_[known.get(w, np.zeros(before)), new.get(w, np.zeros(len(marks) - before))] for w in {**known, **new}}

    landmarks = spread(found, n_landmarks)
    positive_marks = len(landmarks)
    every, all_forms, near, made, before = sorted(set().union(*parts)), sorted(set(forms)), {}, {}, 0
    while True:
        near, made = values_of(every, landmarks, near, before), values_of(all_forms, landmarks, made, before)
        own = Model(landmarks, np.zeros(0), 0.0, [], 0.0).near(landmarks)
        gram = np.array([own.get(w, np.zeros(len(landmarks))) for w in landmarks])
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > 1e-3 * values.max()
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        held = [bags(t or "", found) if (found := {w: near[w] for w in p if w in near}) else [] for (t, _), p in zip(documents, parts, strict=True)]
        shown = [made[w] for w in forms if w in made]
        negative = [v for b, y in zip(held, label, strict=True) if not y for v in b]
        toxic_bags = [np.array(b) for b, y in zip(held, label, strict=True) if y and b]
        if not shown or not toxic_bags:
            return base
        witness = [b[np.argmax(b[:, :positive_marks].sum(axis=1))] for b in toxic_bags]
        for _ in range(rounds):
            positive = witness + shown
            # The last row stands for all sentences without a near landmark.
            k = np.array(positive + negative + [np.zeros(len(landmarks))])
            y = np.r_[np.ones(len(positive)), -np.ones(len(negative) + 1)]
            rest = 0.25 if negative else 0.5
            weight = np.r_[np.full(len(witness), 0.25 / len(witness)), np.full(len(shown), 0.25 / len(shown)), np.full(len(negative), 0.25 / max(1, len(negative))), rest]
            w, intercept = _svm(k @ whiten, y, weight)
            model = Model(landmarks, whiten @ w, intercept, np.zeros(TOP + 1), 0.0)
            witness = [b[np.argmax(model.decide(b))] for b in toxic_bags]
        if before:
            break
        before = len(landmarks)
        scored = {w: float(model.decide(near[w])) for w in sorted(clean & near.keys())}
        hard = [w for w in sorted(scored, key=lambda w: (-scored[w], w)) if scored[w] > model.intercept + 1e-9][:max_forms]
        landmarks = landmarks + [w for w in (spread(hard, max(1, n_landmarks // 3)) if hard else []) if w not in landmarks]
    top = np.array([model.highest(b) for b in held])
    # Each text once more with its highest sentence alone, so that one clear insult is enough.
    alone = np.hstack([top[:, :1], np.full((len(top), TOP - 1), model.intercept)])
    model.slope, model.shift = _platt(np.vstack([top, alone]), np.r_[label, label])
    return model


def _platt(top: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Non-negative slopes and shift of a logistic line over clipped values, with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([_evidence(top), np.ones((len(y), 1))])
    w = np.r_[1.0, np.zeros(TOP), 0.0]
    ridge = np.r_[np.full(TOP + 1, 0.05), 0.0]
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (x * h[:, None]) + np.diag(ridge + 1e-6), x.T @ (p - target) + ridge * w)
        w = w - 0.5 * step
        w[:-1] = np.maximum(w[:-1], 0.0)
    return w[:-1], float(w[-1])


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, y) for each distinct word beginning of each text."""
    for batch in (part for whole in batches for part in slices(whole, 1, 1 << 20)):
        stems, ys = [], []
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {w[:k] for w in units(text) for k in STEMS if len(w) >= k}
            stems += own
            ys += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(ys, pa.int64())], ["stem", "y"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 4000, max_units: int = 60_000, max_texts: int = 3000, id_col: str = "doc_id", text_col: str = "text", **params) -> Model:
    """Fit on the labelled documents that are not held out."""
    sample = materialize(labelled(docs, labels, label, max_rows, id_col, text_col).select("y", "text", "id"), "toxic-sample")
    counted = sample.select(F.col("y").cast("long"), "text").mapInArrow(_stem_rows, "stem string, y long").groupBy("stem").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n"))
    table = counted.orderBy(F.desc("toxic"), F.desc("n"), "stem").limit(max_units).toPandas()
    documents = [(r["text"], int(r["y"])) for r in sample.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(max_texts).collect()]
    stats = sample.agg(F.sum("y"), F.count(F.lit(1))).first()
    rate = (stats[0] or 0) / stats[1] if stats[1] else 0.5
    return fit_sentences(table["stem"].tolist(), table["toxic"].to_numpy(float), table["n"].to_numpy(float), rate, documents, **params)


def _score(model):
    far: set[str] = set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            texts = batch.column(2).to_pylist()
            score = np.concatenate([model.value.probability(model.value.texts(texts[i : i + 512], far)) for i in range(0, len(texts), 512)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(trimmed(_score(shared)), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def worst_sentences(text: str | None, model: Model, top: int = 3) -> list[tuple[str, float]]:
    """The sentences of a text that score highest, for review."""
    own = sentences(text or "")
    values = model.probability(model.texts(own, set())) if own else np.zeros(0)
    order = np.argsort(-values, kind="stable")[:top]
    return [(own[i], float(values[i])) for i in order]
