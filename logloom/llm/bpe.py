"""Byte-level BPE: texts to token ids and back, as Spark columns.

Encoding takes a word (what the vocabulary's pattern splits a text into) as a
doubly linked list of symbols, one a byte.  A priority queue holds the merges
of neighbours by rank, then place; the best is carried out, which makes two new
neighbours, and entries whose symbols have changed meanwhile are skipped.  A
word of n bytes takes O(n log n) steps, so a word of megabytes ends as well.
Decoding concatenates the bytes of the vocabulary's strings.

Words repeat, so each task keeps the ids of words it has met in a table of
bounded size.  Nothing is shuffled.

Defined results: null and empty texts have no ids and decode to the empty text;
repeated rows are rows of their own; an empty table gives an empty result; other
columns are ignored; a null id is a null of the result.  The special strings of
the vocabulary are one id wherever they stand in a text.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, trimmed

#: White space of the vocabulary's pattern, which has no control characters beyond TAB..CR.
_SPACE = r"[^\S\x1c-\x1f]"
#: Runs of white space that are more than one blank or line end between two words.
_RUNS = re.compile(rf"({_SPACE}{{2,}}|\A{_SPACE}|{_SPACE}\Z)")
# The vocabulary's pattern for text of Latin letters, ASCII digits and marks with one blank or line end between
# words; these characters are of one kind in every version of Unicode.
_LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARKS = r"!-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[{_LATIN}0-9{_MARKS} \n]*")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[{_MARKS}]+|\n")
_GAPS = ("  ", "\n\n", " \n", "\n ")
_SHIFT = 32


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """What is left of ``symbols`` (changed in place) when no merge applies.

    ``ranks``: rank of a pair, given as ``left << 32 | right``; ``made``: the
    symbol that the merge of a rank gives.  An entry of the queue is a rank and
    a place in one number; it is stale unless the pair at that place still has
    that rank.
    """
    n, get = len(symbols), ranks.get
    shift = n.bit_length()
    mask = (1 << shift) - 1
    rank_at = [get(a << _SHIFT | b, -1) for a, b in pairwise(symbols)]
    queue = [r << shift | i for i, r in enumerate(rank_at) if r >= 0]
    if not queue:
        return symbols
    heapify(queue)
    rank_at.append(-1)
    ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        entry = heappop(queue)
        i, rank = entry & mask, entry >> shift
        if rank_at[i] != rank:
            continue
        j, new = ahead[i], made[rank]
        symbols[i], symbols[j], rank_at[j] = new, -1, -1
        ahead[i] = k = ahead[j]
        if k < n:
            behind[k] = i
            rank_at[i] = r = get(new << _SHIFT | symbols[k], -1)
            if r >= 0:
                heappush(queue, r << shift | i)
        else:
            rank_at[i] = -1
        k = behind[i]
        if k >= 0:
            rank_at[k] = r = get(symbols[k] << _SHIFT | new, -1)
            if r >= 0:
                heappush(queue, r << shift | k)
    return [s for s in symbols if s >= 0]


class _Words(dict):
    """Ids by word, found when first asked for.

    When ``most`` are held, those not asked for since the last time go.
    """

    def __init__(self, find, most: int, longest: int = 40):
        self.find, self.most, self.longest, self.older = find, most, longest, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.find(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("a byte-level BPE vocabulary without normalizer, prefixes and suffixes is needed")
        added = spec["added_tokens"]
        if any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("special strings that take blanks with them are not supported")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left] << _SHIFT | ids[right]] = rank
            self.made.append(ids[left + right])
        letters = byte_alphabet()
        self._symbol = {c: ids[c] for c in letters}
        self._byte = [ids[c] for c in letters]
        value = {c: b for b, c in enumerate(letters)}
        strings = ids | self.special
        self.strings = np.full(1 + max(strings.values()), b"", object)
        for text, i in strings.items():
            self.strings[i] = bytes(value[c] for c in text) if all(c in value for c in text) else text.encode()
        self._pieces = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._known, self._chunks = _Words(self._merged, 400_000), _Words(self._word, 50_000)

    def _merged(self, word: str) -> bytes:
        """Ids of one word of the pattern, as 32-bit numbers."""
        return array("I", merge([self._byte[b] for b in word.encode()], self.ranks, self.made)).tobytes()

    def _word(self, text: str) -> bytes:
        """Ids of a text that the vocabulary's pattern has to split."""
        symbol = self._symbol
        return b"".join(array("I", merge([symbol[c] for c in piece], self.ranks, self.made)).tobytes() for piece, _ in self._pieces(text))

    def _stretch(self, text: str, out: list[bytes]) -> None:
        """Words with one blank or line end between them; a blank may come first."""
        if _PLAIN.fullmatch(text):
            out.extend(map(self._known.__getitem__, _WORD.findall(text)))
            return
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(self._known["\n"])
            if _PLAIN.fullmatch(line):
                out.extend(map(self._known.__getitem__, _WORD.findall(line)))
            else:  # what stands between blanks is split without a look at the rest
                first, *rest = line.split(" ")
                out.extend(self._chunks[c] for c in ([first] if first else []) + [" " + c for c in rest])

    def _plain(self, text: str, out: list[bytes]) -> None:
        """A text without special strings.

        Of a run of white space before a word, the last character is a word of
        its own or, if it is a blank, begins the next; all before is one word.
        """
        if _PLAIN.fullmatch(text) and not any(g in text for g in _GAPS) and text[0] not in " \n" and text[-1] not in " \n":
            out.extend(map(self._known.__getitem__, _WORD.findall(text)))  # the common case, which has no such run
            return
        parts, spaced = _RUNS.split(text), False
        for i in range(0, len(parts), 2):
            if parts[i]:
                self._stretch(" " + parts[i] if spaced else parts[i], out)
            if i + 1 < len(parts):
                run, ends = parts[i + 1], i + 3 >= len(parts) and not parts[i + 2]
                spaced = run[-1] == " " and not ends
                for word in (run,) if ends else (run[:-1],) if spaced else (run[:-1], run[-1]):
                    if word:
                        out.append(self._chunks[word])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        out: list[bytes] = []
        if text and self.special and any(s in text for s in self.special):
            for part in self._split.split(text):
                if part in self.special:
                    out.append(array("I", [self.special[part]]).tobytes())
                elif part:
                    self._plain(part, out)
        elif text:
            self._plain(text, out)
        return np.frombuffer(b"".join(out), np.uintc)

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become the replacement character."""
        return b"".join(self.strings[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return str(path)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.uintc)]).astype(np.int32)))


def _coder(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for part in (p for batch in batches for p in slices(batch, 1, 2 << 20)):
            rows = [known.encode(t) for t in part.column(1).to_pylist()]
            texts = [pa.array([known.decode(r) for r in rows], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(rows), *texts], ["doc_id", "ids"] + ["decoded"] * decoded)

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                texts = [None if ids is None else known.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts."""
    return _texts(docs, id_col, text_col).mapInArrow(trimmed(_coder(_path(path), False)), "doc_id long, ids array<int>")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, decoded) of rows with ids; null ids decode to null."""
    small_batches(rows.sparkSession)
    given = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return given.mapInArrow(trimmed(_decoder(_path(path))), "doc_id long, decoded string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): whole texts encoded, and what their ids decode to, in one pass."""
    return _texts(docs, id_col, text_col).mapInArrow(trimmed(_coder(_path(path), True)), "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip``."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
