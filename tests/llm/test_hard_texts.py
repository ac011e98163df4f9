"""Texts and groups on which a careless method takes time without end."""

import random
import re
import time

import pytest

from logloom.llm import language_id as L
from logloom.llm import near_dedup as N
from logloom.llm import packing as P
from logloom.llm import toxicity as T


def spelt_slowly(text):
    """The definition: the leftmost longest runs of four or more single characters from blank to blank."""
    out, i = [], 0
    starts = [k for k in range(len(text)) if k == 0 or text[k - 1].isspace()]
    for s in starts:
        if s < i:
            continue
        best, k, letters = None, s, ""
        while k < len(text) and text[k].isalnum():
            letters += text[k]
            if k + 1 == len(text) or text[k + 1].isspace():
                best = (k + 1, letters)
            j = k + 1
            while j < len(text) and (text[j].isspace() or text[j] in ".*_-"):
                j += 1
            if j == k + 1:
                break
            k = j
        if best and len(best[1]) >= 4:
            out.append(best[1])
            i = best[0]
    return out


def test_spelt_words_by_definition():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("ab1 -_.*\n!") for _ in range(rng.randint(0, 24)))
        assert list(T.spelt(text)) == spelt_slowly(text), repr(text)
    assert list(T.spelt("x i d i o t y")) == ["xidioty"] and list(T.spelt("say i-d-i-o-t now")) == ["idiot"]


@pytest.mark.parametrize("text", ["a b " + "_" * 500_000 + "!", "a b " + "_" * 500_000 + ":", "a- " * 300_000 + "zz", "a_" * 400_000, "a b" + " " * 500_000 + "c!", ". " * 400_000, "a." * 300_000 + "!", "- _ * " * 150_000, "ab" * 400_000, "a b c d " * 100_000])
def test_units_take_time_in_proportion(text):
    began = time.time()
    T.units(text)
    assert time.time() - began < 6


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("run", [1, 2, 50, 98, 99, 100, 101, 150, 1000, 9_999, 10_000, 20_000])
@pytest.mark.parametrize("blank", [" ", "\n", " \n", "\t "])
def test_ids_and_time_of_white_space(paths, run, blank):
    unit = (blank * run)[:run] + "x"
    text = "word " + unit * max(1, 160_000 // len(unit))
    want = P._exact(paths[0]).encode(text, add_special_tokens=False).ids
    P.token_ids("x" + " " * 200, *paths, 2)  # both libraries are loaded
    began = time.time()
    assert P.token_ids(text, *paths, 2).tolist() == [*want, 2]
    assert time.time() - began < 2


def test_languages_whose_ids_repeat_are_learned(spark):
    for doc_id in (1, 2, 3):
        rows = [(doc_id, f"zug qux {i} zzyzx", "xx") for i in range(3000)] + [(10 + i, f"the cat and {i} dogs", "en") for i in range(390)]
        model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert model.languages == ["en", "xx"]


def test_tables_are_sized_before_they_are_made(monkeypatch):
    import numpy as np

    rng = random.Random(1)
    found = []
    for k in range(6):
        text = "".join(rng.choice("abcdefgh"[k % 3 :] + "ijk ") for _ in range(4000))
        found.append(np.unique(L.grams(text.encode(), 3), return_counts=True))
    names = [f"l{k}" for k in range(6)]
    whole = L.ContextTrees(names, found, 3, 4)
    assert whole.cost.nbytes + whole.row_of.nbytes <= L.table_bytes(found, 3)
    made = []
    real = L.ContextTrees
    monkeypatch.setattr(L, "ContextTrees", lambda *a: made.append(real(*a)) or made[-1])
    limit = L.table_bytes(found[:3], 3)
    blocks = L._tables(names, found, 3, 4, limit)
    assert [b.languages for b in blocks] == [names[:3], names[3:]] or len(blocks) > 1
    assert all(b.cost.nbytes + b.row_of.nbytes <= limit for b in made)
    probe = b"abcdefgh ijk hgfedcba"
    assert np.allclose(np.concatenate([b.code_length(probe) for b in blocks]), whole.code_length(probe))


def near_misses(n, words=60, edits=5, seed=0):
    """Copies of one text with other words in some places: all share much, none reaches the threshold with another."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(words), edits):
            own[k] = f"x{i}q{k}"
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("words,edits", [(2, 5), (5, 5)])
def test_near_misses_hardly_meet(spark, words, edits, monkeypatch):
    """The pairs that reach a comparison grow with the group, not with its square."""
    met = {}
    real = N._verified

    def counting(pairs, *args, **kwargs):
        met[n] = met.get(n, 0) + pairs.count()
        return real(pairs, *args, **kwargs)

    monkeypatch.setattr(N, "_verified", counting)
    for n in (300, 900):
        rows = near_misses(n, edits=edits)
        got = {r["doc_id"]: r["component_id"] for r in N.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), words=words).collect()}
        sets = {i: set(zip(*(t.split()[k:] for k in range(words)), strict=False)) for i, t in rows[:40]}
        linked = any(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)
        assert linked or all(c == i for i, c in got.items())
    assert met[900] < 6 * max(met[300], 300)
    assert re.match(r"w0|x", rows[0][1])
