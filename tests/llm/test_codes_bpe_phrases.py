import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from logloom.llm import bpe as B
from logloom.llm import collocations as C
from logloom.llm import vector_codes as V

# Vector codes -------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """The contract, with Python's whole numbers and every distance computed."""
    kept = [(i, [math.floor(x * 4096) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), a in zip(kept, at, strict=True) if a[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    final = [[near(v, p) for p in range(parts)] for _, v, _ in kept]
    by_label = Counter()
    for (_, _, label), f in zip(kept, final, strict=True):
        by_label[label] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[label], sha) for (i, _, label), f in zip(kept, final, strict=True)), key=repr)


def coded(spark, rows, **params):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return sorted((tuple(r) for r in V.codes(df, **params).collect()), key=repr)


@pytest.mark.parametrize("seed,scale", [(0, 0.1), (1, 3.0), (2, 0.0004)])
def test_codes_match_brute_force(spark, seed, scale):
    rng = np.random.default_rng(seed)
    rows = [(int(i) * 7 % 1009, [float(x) for x in np.float32(v)], [None, 1, 2][i % 3]) for i, v in enumerate(rng.normal(0, scale, (150, 16)))]
    rows += [(5000 + i, rows[0][1], None) for i in range(40)]  # repeated vectors, ties
    rows += [(6000, None, 1), (6001, [None] * 16, 1), (6002, [math.nan] + [0.0] * 15, 1), (6003, [math.inf] + [0.0] * 15, 2), (None, [0.5] * 16, 2), (3, [0.25] * 16, 2)]
    assert coded(spark, rows) == brute_codes(rows)


def test_codes_of_few_and_odd_rows(spark):
    rows = [(1, [0.5] * 8, 1), (2, [-0.1] * 8, None), (2, [-0.1] * 8, None)]
    assert coded(spark, rows) == brute_codes(rows)
    huge = [(i, [float(np.float32(1e9 + 64 * i))] * 8, 1) for i in range(20)]  # squares beyond 64 bits
    assert coded(spark, huge, entries=4) == brute_codes(huge, entries=4)
    assert coded(spark, rows + [(9, [1.0] * 3, 1), (10, [], 1)]) == brute_codes(rows)  # other lengths are left out
    assert coded(spark, [(1, None, 1)]) == []
    assert coded(spark, []) == []
    with pytest.raises(ValueError):
        coded(spark, [(1, [1.0] * 9, 1)])
    clash = spark.createDataFrame([(1, [0.5] * 8, 1, "a", "b")], "vec_id long, embedding array<float>, label int, code string, error string")
    assert V.codes(clash).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and V.codes(clash).count() == 1


@pytest.mark.parametrize("entries", [1, 16, 100])
def test_slices_find_the_nearest_entry_and_compare_few(entries):
    rng = np.random.default_rng(entries)
    book, x = rng.integers(-1000, 1000, (entries, 4)), rng.integers(-1500, 1500, (3000, 4))
    book[entries // 2] = book[0]  # a tie
    code, far, compared = V.Slices.of(book).nearest(x)
    all_far = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (far == all_far.min(1)).all() and (code == all_far.argmin(1)).all()
    if entries == 100:
        assert compared < 0.5 * len(x) * entries


# BPE -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return B.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts():
    rng = random.Random(5)
    alphabet = list("ab cd  e\n\n\t\r.,'sS19") + ["é", "ß", "中", "文", " ", " ", "\x1c", "\x85", "̀", "🙂", "\U00031350", "ͯ", "²", "'re", "'ll", " <|endoftext|>", "<|endoftext|", "the ", " and", "\x00"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    out += [" ", "\n", "  ", " a", "a ", "a  b", "a \n b", "\n\na", "a\n\n", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", " <|endoftext|> ", "a\tb c", "é" * 300, "don't I'll we've 'tis"]
    return out


def test_ids_and_texts_equal_the_library(vocabulary, library):
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert list(vocabulary.encode(text)) == want, repr(text)
        assert vocabulary.decode(want) == library.decode(want, skip_special_tokens=False) == text


def test_parts_of_characters_decode_as_the_library_does(vocabulary, library):
    ids = vocabulary.encode("🙂 中文 é")
    for a in range(len(ids)):
        for b in range(a, len(ids) + 1):
            assert vocabulary.decode(ids[a:b]) == library.decode(ids[a:b], skip_special_tokens=False)


def test_merges_in_order_of_rank_then_place():
    rng = random.Random(1)

    def run(symbols, table):
        return B.merge(list(symbols), {a << 32 | b: r for r, ((a, b), _) in enumerate(table)}, [m for _, m in table])

    assert run([1] * 5, [((1, 1), 2), ((2, 1), 3), ((2, 2), 4)]) == [2, 3]
    for _ in range(500):
        pairs = dict.fromkeys((rng.randrange(12), rng.randrange(12)) for _ in range(25))
        table = [(p, 6 + r % 7) for r, p in enumerate(pairs)]
        rank = {p: r for r, (p, _) in enumerate(table)}
        given = [rng.randrange(6) for _ in range(rng.randint(0, 25))]
        want = list(given)
        while best := min(((rank[p], i) for i, p in enumerate(zip(want, want[1:], strict=False)) if p in rank), default=None):
            want[best[1] : best[1] + 2] = [table[best[0]][1]]
        assert run(given, table) == want


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000 + "x", ("x" + " " * 999) * 300, "\n" * 200_000, "ab\t" * 100_000, "中" * 100_000])
def test_long_runs_end_soon(vocabulary, text):
    began = time.time()
    assert vocabulary.decode(vocabulary.encode(text)) == text
    assert time.time() - began < 20


def test_bpe_columns(spark, library):
    rows = [(1, "Hello world.\nIt's <|endoftext|>", "x"), (2, None, "y"), (3, "", None), (None, "one two", "z"), (1, "again", "q"), (7, "long word " * 30_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    got = {(r["doc_id"], r["decoded"]): r["ids"] for r in B.round_trip(df).collect()}
    assert got == {(i, t or ""): library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    back = B.decode(B.encode(df))
    assert sorted(r["decoded"] for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
    told = {r["doc_id"]: r for r in B.digests(B.round_trip(df.filter("doc_id in (2, 7)"))).collect()}
    ids = library.encode(rows[5][1], add_special_tokens=False).ids
    assert (told[7]["n_tokens"], told[7]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert told[7]["decoded_sha256"] == hashlib.sha256(rows[5][1].encode()).hexdigest()
    assert (told[2]["n_tokens"], told[2]["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert B.round_trip(df.limit(0)).count() == 0


def test_word_table_is_bounded():
    words = B._Words(lambda w: bytes([len(w)]), most=10, longest=5)
    assert [words[str(i)] for i in range(100)] == [bytes([len(str(i))]) for i in range(100)]
    assert words["x" * 50] == b"2" and len(words) <= 10 and len(words.older) <= 10


# Collocations ---------------------------------------------------------------------


def brute_phrases(rows, least, longest=5, top=2000):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    own = {p: a for p, a in counts.items() if a >= least}
    out = []
    for (lang, words), a in own.items():
        if len(words) < 2:
            continue
        inside = any(x[0] == lang and len(x[1]) > len(words) and 100 * b >= 100 * a and any(x[1][i : i + len(words)] == words for i in range(len(x[1]))) for x, b in own.items())
        if not inside:
            score, _, left, right = min((1000 * a * total[lang] // (own[lang, words[:k]] * own[lang, words[k:]]), k, own[lang, words[:k]], own[lang, words[k:]]) for k in range(1, len(words)))
            out.append((lang, -score, -a, " ".join(words), left, right, total[lang]))
    ranked, rank = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out, key=lambda r: (r[0], r[1], r[2], r[3].encode())):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase, -a, left, right, n, -score))
    return sorted(ranked)


def phrase_rows(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["The", "THE", "é", "a\x01", "a", "\x02"]
    fixed = ["of the best of the best", "New York city hall", "x y z u v w"]
    out = []
    for _ in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        out.append((rng.choice(["en", "en", "en", "de", None]), "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for w in words)))
    return out + [("en", None), (None, ""), ("fr", "rare words only"), ("und", "New York city hall " * 30)]


@pytest.mark.parametrize("seed,least,parts,params", [(0, 5, 1, {}), (1, 8, 7, {"log_bits": 8}), (2, 3, 40, {"top": 7}), (3, 5, 11, {"longest": 3})])
def test_phrases_match_brute_force(spark, seed, least, parts, params):
    rows = phrase_rows(seed)
    df = spark.createDataFrame([(i, t, lang, "z") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string").repartition(4)
    got = sorted(tuple(r) for r in C.collocations(df, least=least, parts=parts, **params).collect())
    known = {k: v for k, v in params.items() if k != "log_bits"}
    assert got == brute_phrases(rows, least, **known) and got


def test_one_word_that_begins_most_phrases(spark):
    rng = random.Random(9)
    rows = [("en", f"hot w{rng.randrange(30)} v{rng.randrange(4)}. ") for _ in range(3000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in C.collocations(df, least=4, parts=16).collect()) == brute_phrases(rows, 4)
    counts = C.frequent(df, least=4)
    placed = C._dealt(counts.selectExpr("lang", "split(phrase, ' ') as key", "n", "a", "cast(null as array<long>) as counts", "0L as wider"), 16)
    per_part = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(per_part) > 8 and max(per_part) < 0.25 * sum(per_part)


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).count() == 0
    assert C.collocations(spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")).count() == 0


def test_counts_beyond_64_bits():
    assert C.lowest_cut(3 * 10**9, 10**13, [4 * 10**9], [5 * 10**9]) == (1000 * 3 * 10**9 * 10**13 // (20 * 10**18), 4 * 10**9, 5 * 10**9)
    assert C.lowest_cut(100, 1000, [200, 100], [100, 200]) == (2500, 200, 200)
