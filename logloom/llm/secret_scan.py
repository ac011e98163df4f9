"""Secret scan: fixed patterns, and a battery of randomness tests.

Patterns give the base spans (``assign``, ``access``, ``hex``).  The method
adds ``random`` spans: stretches of key characters outside the base spans that
look random.  Maximal runs are cut at the edges of base spans and at ``=``
(padding aside); of each piece the whole, what remains without the plain words
and numbers at its ends, and the segments between ``/``, ``_`` and ``-`` are
candidates.  Where found candidates overlap, the one without plain ends goes
first, then the whole.  For each candidate

1. the encoding is inferred (the smallest alphabet that holds it),
2. three tests ask whether it fits a uniform draw from that alphabet: chi-squared
   over symbols, runs of character classes, and lag-one serial correlation of
   symbol numbers; all must pass at ``battery``,
3. a p-value asks whether ordinary text could look that random: the place of
   its chi-squared value among the letters-only candidates of the same length class
   in the whole corpus.  Discoveries are controlled by Benjamini-Hochberg at
   ``rate`` within each length class, so short runs, for which chance fits are
   common, need better values than long ones.

Corpus statistics come from all documents: sums per length class and counts of
p-values in fixed bins (a bounded table) reach the driver, never runs or texts.

Defined results: null counts as empty; spans are code points, end exclusive;
repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

# The three patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
_VALUE = re.compile(r"[^=]+(?:={1,2}\Z)?")  # what stands between signs, with padding at the end
_SEGMENT = re.compile(r"[^/_-]+")
_PLAIN = re.compile(r"[A-Z]?[a-z]+[0-9]*|[A-Z]+[0-9]*|[0-9]+")
_ALPHABETS = [
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("upper36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="),
]
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in _ALPHABETS]
#: Length classes by lower end, and lower ends of p-value bins (powers of ten, five to a decade).
LENGTHS = (20, 24, 32, 40, 64, 128)
P_BINS = 60


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def infer(run: str) -> tuple[str, dict[str, int]]:
    """Name and symbol numbers of the smallest alphabet that holds a run (padding aside)."""
    own = set(run.rstrip("="))
    for name, symbols, number in _SETS:
        if own <= symbols:
            return name, number
    return _SETS[-1][0], _SETS[-1][2]


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared(codes: np.ndarray, size: int) -> float:
    """Chi-squared of uniformity as a standard normal value (cube-root transform)."""
    counts = np.bincount(codes, minlength=size)
    x = float(((counts - len(codes) / size) ** 2).sum() * size / len(codes))
    d = size - 1
    return ((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))


def class_runs(run: str) -> float:
    """Two-sided p-value of the number of class changes, given how often each class occurs."""
    kinds = np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in run])
    n, share = len(kinds), np.bincount(kinds, minlength=4) / len(kinds)
    same = float((share**2).sum())
    changes, mean, var = float((kinds[1:] != kinds[:-1]).sum()), (n - 1) * (1 - same), (n - 1) * (1 - same) * same
    return 2 * upper_tail(abs(changes - mean) / math.sqrt(var)) if var > 1e-9 else 1.0


def serial(codes: np.ndarray) -> float:
    """Two-sided p-value of the correlation of each symbol with the next."""
    a, b = codes[:-1].astype(float), codes[1:].astype(float)
    if a.std() < 1e-9 or b.std() < 1e-9:
        return 0.0
    return 2 * upper_tail(abs(float(np.corrcoef(a, b)[0, 1])) * math.sqrt(len(a)))


def tests(run: str) -> tuple[str, float, float]:
    """Encoding, chi-squared as a normal value, and the least p-value of the battery."""
    name, number = infer(run)
    body = run.rstrip("=") or run
    codes = np.array([number.get(c, 0) for c in body])
    z = chi_squared(codes, len(number))
    return name, z, min(upper_tail(z), class_runs(body), serial(codes))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans to test, from left to right by piece; within a piece the preferred first."""
    edges, reach = [], 0  # the base spans as disjoint stretches
    for s, _, e in base:
        if e > reach:
            edges.append((max(s, reach), e))
            reach = e
    out, k = [], 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while k < len(edges) and edges[k][1] <= at:
            k += 1
        free, i = [], k
        while i < len(edges) and edges[i][0] < end:
            free.append((at, edges[i][0]))
            at = edges[i][1]
            i += 1
        for a, b in [*free, (at, end)]:
            if b - a < LEAST:
                continue
            after_base = a > m.start()
            for v in _VALUE.finditer(text[a:b]):
                low, high = a + v.start(), a + v.end()
                if after_base and low == a and text[low] in "/_-":
                    low += 1
                if high - low >= LEAST:
                    out += _pieces(text, low, high)
    return out


def _pieces(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """The piece without plain ends, the whole, and its segments, each once."""
    segments = [(low + m.start(), low + m.end()) for m in _SEGMENT.finditer(text[low:high])]
    plain = lambda s: _PLAIN.fullmatch(text, *s)
    i, j = 0, len(segments)
    while i < j and plain(segments[i]):
        i += 1
    while i < j and plain(segments[j - 1]):
        j -= 1
    spans = [(low, high), *segments]
    if 0 < j - i < len(segments):
        spans.insert(0, (segments[i][0] if i else low, segments[j - 1][1] if j < len(segments) else high))
    return [s for s in dict.fromkeys(spans) if s[1] - s[0] >= LEAST]


def disjoint(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans in the order of ``candidates``, those that meet none before them, sorted."""
    out: list[tuple[int, int]] = []
    for a, b in found:
        k = bisect.bisect(out, (a, b))
        if not (k and out[k - 1][1] > a) and not (k < len(out) and out[k][0] < b):
            out.insert(k, (a, b))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("encoding", pa.string()), ("z", pa.float64()), ("fit", pa.float64()), ("text", pa.bool_())]))
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        digest, spans, runs = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in base))
            spans.append(shown(base))
            digest.append(hashlib.sha256(spans[-1].encode()).hexdigest())
            own = []
            for a, b in candidates(text, base):
                name, z, fit = tests(text[a:b])
                own.append({"a": a, "b": b, "encoding": name, "z": z, "fit": fit, "text": text[a:b].isalpha()})
            runs.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(spans), pa.array(runs, kind)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "runs"])


def _length_class(length: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(LENGTHS):
        out = F.when(length >= low, i).otherwise(out)
    return out


def reference(runs: DataFrame, least: int = 30) -> list[tuple[float, float]]:
    """Mean and deviation of ordinary text's chi-squared value by length class.

    Classes with fewer than ``least`` letters-only runs take those of all
    classes, or mean 6 and deviation 1.5 where the corpus has none.
    """
    sums = {r["c"]: r for r in runs.filter("text").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q")).collect()}

    def moments(rows: list) -> tuple[float, float] | None:
        n = sum(r["n"] for r in rows)
        if n < least:
            return None
        mean = sum(r["s"] for r in rows) / n
        return mean, max(0.5, math.sqrt(max(0.0, sum(r["q"] for r in rows) / n - mean * mean)))

    whole = moments(list(sums.values())) or (6.0, 1.5)
    return [moments([sums[c]] if c in sums else []) or whole for c in range(len(LENGTHS))]


def _p_bin(z: Column, c: Column, means: list[tuple[float, float]]) -> Column:
    """Bin of the p-value that ordinary text is as uniform as ``z``: bin i is 10^-(i/5) and below."""
    out = F.lit(0)
    for i, (mean, deviation) in enumerate(means):
        # Bin edges as values of z, so that no distribution function is needed on the rows.
        edge = F.lit(0)
        for k in range(1, P_BINS + 1):
            edge = F.when(z <= mean + deviation * _normal_quantile(10 ** (-k / 5)), k).otherwise(edge)
        out = F.when(c == i, edge).otherwise(out)
    return out


def _normal_quantile(p: float) -> float:
    low, high = -40.0, 10.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if upper_tail(-mid) < p else (low, mid)
    return low


def discoveries(histogram: dict[int, int], rate: float) -> int:
    """Benjamini-Hochberg over binned p-values: the first bin whose runs are discoveries."""
    total = sum(histogram.values())
    for k in range(P_BINS + 1):  # from the largest p-values down
        found = sum(n for b, n in histogram.items() if b >= k)
        if found and 10 ** (-k / 5) * total <= rate * found:
            return k
    return P_BINS + 1


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", battery: float = 1e-3, rate: float = 0.01) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, base string, runs array<struct<a: long, b: long, encoding: string, z: double, fit: double, text: boolean>>"
    scanned = materialize(rows.mapInArrow(_scan, schema), "secret-scan")
    runs = scanned.select(F.explode("runs").alias("r")).select("r.*").withColumn("c", _length_class(F.col("b") - F.col("a")))
    means = reference(runs)
    binned = runs.withColumn("p", _p_bin(F.col("z"), F.col("c"), means)).groupBy("c", "p").count().collect()
    first = [discoveries({r["p"]: r["count"] for r in binned if r["c"] == c}, rate) for c in range(len(LENGTHS))]
    # The cut of each length class as a value of z.
    cuts = [means[c][0] + means[c][1] * _normal_quantile(10 ** (-k / 5)) if 0 < k <= P_BINS else math.inf if k == 0 else -math.inf for c, k in enumerate(first)]

    def secret(r: Column) -> Column:
        cut = F.lit(-math.inf)
        for low, z in zip(LENGTHS, cuts, strict=True):
            cut = F.when(r["b"] - r["a"] >= low, F.lit(z)).otherwise(cut)
        return (r["z"] <= cut) & (r["fit"] >= battery)

    extra = F.filter("runs", secret)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n = [], []
            for base, found in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                own = [(int(a), KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
                random = disjoint([(r["a"], r["b"]) for r in found])
                spans.append(shown(sorted(own + [(a, 3, b) for a, b in random])))
                n.append(len(random))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(spans), pa.array(n, pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    out = scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", extra.alias("extra"))
    return out.mapInArrow(merged, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
