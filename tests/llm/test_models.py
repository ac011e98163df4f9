"""Classifiers, language identification, secret scan and neighbours."""

import math
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import ann as A
from logloom.llm import language_id as G
from logloom.llm import quality as Q
from logloom.llm import secret_scan as S
from logloom.llm import toxicity as X
from logloom.llm.common import crc_of, held_out

EDGE = [(900_001, None), (900_002, ""), (900_003, "\n\t "), (900_004, "word " * 30_000), (900_005, "w" * 300_000), (900_005, "twice"), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, held_out string").repartition(3)


def prose(rng, n):
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def test_held_out(spark):
    rows = {r["id"]: r["h"] for r in spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert all(h == (crc_of(i) % 5 == 0) for i, h in rows.items())


def test_quality(spark):
    rng = random.Random(0)
    rows = [(i, prose(rng, 60) if i % 4 else " ".join(w + "###" for w in prose(rng, 40).split())) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(1, None), (None, 1), (3, 1)], "doc_id long, quality int")
    df = frame(spark, rows + EDGE)
    model = Q.fit(df, labels)
    out = {r["doc_id"]: r for r in Q.score(df, model).collect()}
    assert all(out[i]["predicted"] == int(i % 4 > 0) for i in range(300) if out[i]["held_out"])
    assert all(0 <= r["score"] <= 1 for r in out.values())
    kept = Q.apply(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} >= {i for i in range(300) if i % 4}
    features = Q.with_features(df.select("doc_id", "text"), "text", ["doc_id"]).toPandas()
    got = Q.with_features(df.select("doc_id", "text"), "text", ["doc_id"]).select(model.score().alias("s")).toPandas()["s"].to_numpy()
    assert np.allclose(sorted(got), sorted(model.predict(features[list(Q.FEATURES)].to_numpy(float))))
    none = Q.fit(df, labels.limit(0))
    assert {r["score"] for r in Q.score(df, none).collect()} == {0.5} and Q.score(df.limit(0), none).count() == 0


def brute_features(t):
    """The statistics of a text, counted in plain Python."""
    import re
    import unicodedata

    kind = [unicodedata.category(c) for c in t]
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = t.split("\n")
    common = sum(c in ".,;:!?'\"()-" for c in t)
    symbols = sum(k[0] not in "LN" and c not in " \t\n\x0b\f\r" for c, k in zip(t, kind, strict=True))
    part = lambda a, b: a / max(b, 1)
    kinds = len(set(words))
    return [
        math.log1p(len(t)), math.log1p(len(words)), part(symbols - common, len(t)), part(common, len(t)), part(sum(k == "Lu" for k in kind), len(t)), part(sum(k[0] == "N" for k in kind), len(t)),
        part(t.count("!"), len(words)), part(sum(map(len, words)), len(words)), part(kinds, len(words)), math.log1p(kinds) / math.log1p(max(len(words), 1)), part(len(words), kinds),
        part(len(set(lines)), len(lines)), part(len(words), len(lines)),
    ]


def test_quality_statistics_follow_the_definition(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abC É9²!?.,-(\"' \n\t$€~\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", "x", "\n\n"]
    rows = Q.with_features(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", ["i"]).collect()
    for r in rows:
        assert [r[n] for n in Q.FEATURES] == pytest.approx(brute_features(texts[r["i"]]), abs=1e-12), texts[r["i"]]


def test_lasso_drops_noise():
    rng = np.random.default_rng(0)
    z = rng.random((400, 20))
    y = (z[:, 3] > 0.5).astype(float)
    _, w = Q.lasso_logistic(z, y, 0.02)
    assert w[3] > 1 and (np.abs(np.delete(w, 3)) < 0.3).all()


def test_toxicity(spark):
    rng = random.Random(1)
    insults = ["blorfing", "krunkle", "vexaroo"]
    rows = []
    for i in range(400):
        text = prose(rng, 50)
        if i % 5 == 0:
            words = text.split()
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(insults)
            text = " ".join(words)
        rows.append((i, text))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    df = frame(spark, rows + EDGE + [(800_000, prose(rng, 40) + " kru-nkle you b.l.o.r.f.i.n.g"), (800_001, prose(rng, 40) + " v e x a r o o krunxkle")])
    model = X.fit(df, labels)
    out = {r["doc_id"]: r for r in X.score(df, model).collect()}
    assert all(out[i]["predicted"] == int(i % 5 == 0) for i in range(400))
    assert out[800_000]["predicted"] == out[800_001]["predicted"] == 1
    assert all(out[i]["predicted"] == 0 and 0 <= out[i]["score"] <= 1 for i, _ in EDGE)
    assert X.worst_sentences("Fine words here. You krunkle blorfing thing.", model, 1)[0][0].startswith("You")
    none = X.fit(df, labels.limit(0))
    assert {round(r["score"], 6) for r in X.score(df, none).collect()} == {0.5} and X.score(df.limit(0), none).count() == 0


def test_toxic_parts_of_words():
    model = X.Model(["idiot"], np.ones(1), -0.5, np.zeros(X.TOP + 1), 0.0)
    highest = lambda text: model.texts([text], set())[0, 0]
    bare = highest("idiot")
    for text in ["great,idiot", "really/idiot", "kind\u2014idiot", "what...idiot", "a_idiot_b", "idiot,great", "https://example.com/some/longer/path/idiot/page", "great,id-iot"]:
        assert highest(f"so {text} there") == pytest.approx(bare), text
    for at in range(56):  # at every offset of a word of 60 characters
        word = "q" * at + "idiot" + "q" * (55 - at)
        assert highest(word) >= highest("idiot" + "q" * min(10, 55 - at)) - 1e-9 > model.intercept, at
    for at in range(8):  # inside a word, less than at its start, more than nothing
        assert model.intercept < highest("q" * at + "idiot" + "q" * (7 - at)) <= bare + 1e-9, at
    assert highest("i d i o t they said") > model.intercept
    assert "fck" in X.units("oh fck, no") and X.units("ab, c d") == set()


def brute_kernel(s, t):
    """Sum over all common subsequences of P characters, by definition."""
    import itertools

    total = 0.0
    for i in itertools.combinations(range(len(s)), X.P):
        for j in itertools.combinations(range(len(t)), X.P):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += X.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def lcs(s, t):
    d = [[0] * (len(t) + 1) for _ in range(len(s) + 1)]
    for i, a in enumerate(s):
        for j, b in enumerate(t):
            d[i + 1][j + 1] = d[i][j] + 1 if a == b else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_subsequence_kernel():
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(30)]
    a, b = X.coded(words[:15]), X.coded(words[15:])
    got = X.raw_kernel(a, b)
    for k in range(15):
        assert got[k] == pytest.approx(brute_kernel("^" + words[k], "^" + words[15 + k]))
    lengths = X.common_lengths(a, b)
    assert all(lengths[i, j] == lcs("^" + words[i], "^" + words[15 + j]) for i in range(15) for j in range(15))


def brute_values(part, landmarks):
    """Kernel values of a part with each landmark, by definition."""
    s, out = "^" + part, []
    for mark in landmarks:
        t = "^" + mark
        if lcs(s, t) < max(X.P, math.ceil(X.SUPPORT * len(t))):
            out.append(0.0)
            continue
        starts = [0] + [o for o in range(2, len(s)) if s[o] in t[1:4]]
        stretches = [(s[o : o + len(t) + X.SLACK], X.INNER if o else 1.0) for o in starts]
        stretches = [(u, f) for u, f in stretches if sum(c in t for c in u) >= max(X.P, math.ceil(X.SUPPORT * len(t))) - (f < 1)]
        out.append(0.0 if not stretches else max(f * brute_kernel(u, t) / math.sqrt(max(1e-300, brute_kernel(u, u) * brute_kernel(t, t))) for u, f in stretches))
    return out


def test_scores_follow_the_definition():
    rng = random.Random(6)
    landmarks = ["abcab", "bcca", "cabba"]
    weights = np.array([1.2, 0.7, -0.4])
    model = X.Model(landmarks, weights, -0.3, [1.0, 0.5, 0.25, 0.4], -0.2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() + rng.choice(["", "", ".", "!\n", "-" + word()]) for _ in range(rng.randint(1, 8))) for _ in range(60)] + ["", None, "abcab", "abcab", "a b c a b"]
    got = model.probability(model.texts(texts, set()))
    for text, p in zip(texts, got, strict=True):
        values = {u: np.array(brute_values(u, landmarks)) for u in X.units(text)}
        values = {u: v for u, v in values.items() if v.any() or any(lcs("^" + u, "^" + m) >= max(X.P, math.ceil(X.SUPPORT * (len(m) + 1))) for m in landmarks)}
        rows, left = [], set(values)
        for sentence in X.sentences(text or ""):
            own = X.units(sentence) & values.keys()
            left -= own
            if own:
                rows.append(np.max([values[u] for u in own], axis=0))
        rows += [values[u] for u in left]
        top = sorted((float(r @ weights) - 0.3 for r in rows), reverse=True)[: X.TOP]
        top = [max(v, -0.3) if k else v for k, v in enumerate(top)] + [-0.3] * (X.TOP - len(top))
        assert p == pytest.approx(model.probability(np.array([top]))[0]), text


def ppm_bits(text, sample, order, min_count=0):
    """Code length by walking the counts byte by byte."""
    data, bits = G.fold(text), 0.0
    seen: dict = {}
    for t in sample:
        s = [256] * order + list(G.fold(t))
        for i in range(order, len(s)):
            for o in range(order + 1):
                seen.setdefault(tuple(s[i - o : i]), {}).setdefault(s[i], 0)
                seen[tuple(s[i - o : i])][s[i]] += 1
    seen = {c: n for c, n in seen.items() if not c or sum(n.values()) >= min_count}
    s = [256] * order + list(data)
    for i in range(order, len(s)):
        out: set = set()
        o = order
        while tuple(s[i - o : i]) not in seen:
            o -= 1
        while True:
            counts = {b: n for b, n in seen[tuple(s[i - o : i])].items() if b not in out}
            total = sum(counts.values()) + len(counts)
            if s[i] in counts:
                bits -= math.log2(counts[s[i]] / total)
                break
            if counts:
                bits -= math.log2(len(counts) / total)
            out |= counts.keys()
            if o == 0:
                bits += math.log2(max(1, 256 - len(out)))
                break
            o -= 1
    return bits


def test_language_code_lengths_are_exact():
    samples = [["the cat sat on the mat", "a hat"], ["le chat est là", "été"]]
    per = []
    for own in samples:
        grams = np.concatenate([G.grams(G.fold(t), 3) for t in own])
        per.append(np.unique(grams, return_counts=True))
    for min_count in (0, 4):
        trees = G.ContextTrees(["en", "fr"], per, 3, min_count)
        for text in ["the hat", "là été", "zzz \U0001f600 q", "a", "THE CAT"]:
            got = trees.code_length(G.fold(text))
            assert got == pytest.approx([ppm_bits(text, s, 3, min_count) for s in samples], rel=1e-5)


def test_language(spark):
    rng = random.Random(0)
    make = lambda pieces: " ".join("".join(rng.choice(pieces) for _ in range(rng.randint(1, 3))) for _ in range(30))
    kinds = {"aa": ["the", "ing", "and", "tion"], "bb": ["le", "eau", "ent", "où"], "cc": ["der", "ung", "sch", "ö"]}
    rows = [(i, make(kinds[k]), k) for i in range(150) for k in [sorted(kinds)[i % 3]]]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(i, t, None, "x") for i, t in EDGE] + [(700, "123 !?", "aa", "y")], "doc_id long, text string, lang string, lang_pred string")
    trees = G.train(df.filter(~held_out(df["doc_id"])), min_count=0)
    out = {r["doc_id"]: r for r in G.predict(df, trees).collect()}
    assert all(out[i]["lang_pred"] == k for i, _, k in rows)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900_001, 900_002, 900_003, 700)) and all(0 <= r["score"] <= 1 for r in out.values())
    nothing = G.train(df.limit(0))
    assert {r["lang_pred"] for r in G.predict(df, nothing).collect()} == {"und"} and G.predict(df.limit(0), trees).count() == 0
    small = df.filter("doc_id < 40 or doc_id >= 700").cache()
    one = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in G.predict(small, trees).collect()}
    known = df.filter(~held_out(df["doc_id"]))
    for params in ({"block_languages": 2}, {"block_bytes": 1}):
        several = G.train(known, min_count=0, **params)
        assert len(several.blocks) > 1 and several.languages == trees.languages
        assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in G.predict(small, several).collect()} == one
    # With the settings of the query, against the definition.
    usual = G.train(known)
    got = {r["doc_id"]: r["lang_pred"] for r in G.predict(small, usual).collect()}
    texts = {k: [t for i, t, own in rows if own == k and crc_of(i) % 5] for k in kinds}
    for i, t, _ in rows[:10]:
        assert got[i] == min(sorted(kinds), key=lambda k: ppm_bits(t, texts[k], 3, 4))


def test_base_spans():
    assert S.shown(S.base_spans("token=key token: abcdefgh")) == "assign:10:25"
    assert S.shown(S.base_spans("token=token:abcdefghij")) == ""  # the short match takes the second word with it
    assert S.shown(S.base_spans('API-KEY apikey = "a1b2c3d4e5"')) == "assign:8:28"
    assert S.shown(S.base_spans("é AKIA" + "A1" * 8)) == "access:2:22" and S.base_spans("AKIA" + "A" * 11) == []
    assert S.shown(S.base_spans("secret=" + "0a" * 16)) == "assign:0:39,hex:7:39"
    assert S.base_spans("ſecret=abcdefghij") == []  # letters in either case are ASCII letters


def test_secrets(spark):
    rng = random.Random(7)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    rows = [(i, prose(rng, 40) + " " + "".join(rng.choice(["internation", "alization", "thoughtful", "ness"]) for _ in range(4))) for i in range(200)]
    planted = {300 + i: key(40, string.ascii_letters + string.digits) for i in range(20)}
    rows += [(i, f"{prose(rng, 10)} {k} {prose(rng, 5)}") for i, k in planted.items()]
    df = frame(spark, rows + EDGE + [(500, "password = hunter2hunter2")])
    out = {r["doc_id"]: r for r in S.scan(df).collect()}
    found = sum(f"random:{t.index(planted[i])}:{t.index(planted[i]) + 40}" in out[i]["spans"] for i, t in rows if i in planted)
    assert found >= 18 and sum(out[i]["n_random"] for i in range(200)) == 0
    assert out[500]["spans"] == "assign:0:25" and out[500]["n_assign"] == 1 and out[900_001]["spans"] == ""
    assert S.scan(df.limit(0)).count() == 0


def test_secrets_beside_names_and_paths(spark):
    rng = random.Random(11)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    base62 = string.ascii_letters + string.digits
    before = ["aws_secret_access_key=", "AWS_SECRET_ACCESS_KEY=", "storage_account_connection_key=", "config/keys/production/", "stripe_live_", "AKIA" + "Q7" * 8 + "/"]
    plain = ["storage_account_connection_string", "path/to/some/ordinary/folder", "internationalization", "thoughtful_considerations"]
    rows = [(i, prose(rng, 20) + " " + " ".join(plain)) for i in range(200)]
    planted = {300 + i: (before[i % 6], key(40, base62)) for i in range(60)}
    rows += [(i, f"{prose(rng, 5)} {p}{k} {prose(rng, 5)}") for i, (p, k) in planted.items()]
    out = {r["doc_id"]: r for r in S.scan(frame(spark, rows)).collect()}
    hit = dict.fromkeys(before, 0)
    for i, t in rows:
        if i in planted:
            p, k = planted[i]
            hit[p] += f"random:{t.index(k)}:{t.index(k) + 40}" in out[i]["spans"]
    assert all(n >= 8 for n in hit.values()), hit
    assert sum(out[i]["n_random"] for i in range(200)) == 0


def test_battery_follows_the_definitions():
    rng = random.Random(3)
    alphabet = string.ascii_letters + string.digits + "+/"
    pvalues = []
    for _ in range(600):
        run = "".join(rng.choice(alphabet) for _ in range(rng.randint(40, 90)))
        number = {c: i for i, c in enumerate(alphabet)}
        codes = np.array([number[c] for c in run])
        # Chi-squared from its definition, then the cube-root transform to a normal value.
        expected = len(run) / 64
        x = sum((run.count(c) - expected) ** 2 / expected for c in alphabet)
        assert S.chi_squared(codes, 64) == pytest.approx(((x / 63) ** (1 / 3) - (1 - 2 / 567)) / math.sqrt(2 / 567))
        # Runs: changes of class between neighbours against what independent draws would show.
        kind = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "+" for c in run]
        same = sum((kind.count(k) / len(kind)) ** 2 for k in set(kind))
        changes = sum(a != b for a, b in zip(kind, kind[1:]))
        z = (changes - (len(kind) - 1) * (1 - same)) / math.sqrt((len(kind) - 1) * (1 - same) * same)
        assert S.class_runs(run) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
        a, b = codes[:-1] - codes[:-1].mean(), codes[1:] - codes[1:].mean()
        r = (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())
        assert S.serial(codes) == pytest.approx(math.erfc(abs(r) * math.sqrt(len(a)) / math.sqrt(2)))
        pvalues.append((S.upper_tail(S.chi_squared(codes, 64)), S.class_runs(run), S.serial(codes)))
    # Uniform draws are rejected about as often as the level says.
    assert all(0.01 <= share <= 0.11 for share in (np.array(pvalues) < 0.05).mean(axis=0))
    assert min(S.tests("abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz")[2], S.tests("a1" * 30)[2]) < 1e-3


def test_secret_candidates():
    got = lambda t: [t[a:b] for a, b in S.candidates(t, S.base_spans(t))]
    k = "Xy7" * 8
    assert got(f"NAME={k}==") == [k + "=="] and got(f"a={k}=b") == [k]
    assert got(f"a/b/{k}/c") == [k, f"a/b/{k}/c"] and got(f"AKIA{'A1' * 8}/{k}") == [k]
    assert got("secret=" + k) == [] and S.disjoint([(5, 9), (0, 12), (9, 12)]) == [(5, 9), (9, 12)]


def test_discoveries_follow_the_definition():
    assert S.discoveries({}, 0.01) == S.P_BINS + 1 and S.discoveries({0: 100}, 0.01) == S.P_BINS + 1
    assert S.discoveries({0: 90, 40: 10}, 0.01) <= 40
    # Bin k holds p <= 10^-(k/5): 10^-3 * 100 <= 0.01 * 10, and not at 10^-2.8.
    assert S.discoveries({0: 90, 40: 10}, 0.01) == 15


def vectors(spark, seed=0, n=1500, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[100:400] = x[100]  # a vector that many rows share
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(5000, None, "x"), (5050, [0.0] * dim, "x"), (5100, [float("nan")] * dim, "x"), (5150, [1.0] * (dim - 1) + [None], "x"), (5200, [], "x"), (5250, [1.0] * 3, "x"), (None, [1.0] * dim, "x"), (7, x[7].tolist(), "x")]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, query string").repartition(3)


@pytest.mark.parametrize("params", [{}, {"block_rows": 60}])
def test_neighbours(spark, params):
    x, df = vectors(spark)
    out = A.search(df, df.filter("vec_id % 50 = 0"), **params).collect()
    got: dict = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 50)) and all(len(v) == 5 for v in got.values())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, own in got.items():
        score = u @ u[q]
        score[q] = -9
        exact = sorted(range(len(x)), key=lambda i: (-round(score[i], 12), i))[:5]
        hit += len({i for i, _ in own} & set(exact))
        assert all(abs(s - score[i]) < 1e-12 for i, s in own) and [s for _, s in own] == sorted((s for _, s in own), reverse=True)
    assert hit / (5 * len(got)) >= 0.9
    assert [i for i, _ in got[150]] == [100, 101, 102, 103, 104]  # ties go to the smaller id


def test_comparisons_fall_behind_exact_search(spark):
    share = []
    for n in (400, 4000):
        x = np.random.default_rng(1).standard_normal((n, 32))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        out = A.search(df, df.filter("vec_id % 50 = 0"), tables=8).cache()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = u[::50] @ u.T
        near[np.arange(len(near)), np.arange(0, n, 50)] = -9
        exact = {(50 * i, int(j)) for i, row in enumerate(near) for j in np.argsort(-row)[:5]}
        assert len(exact & {(r["query_id"], r["vec_id"]) for r in out.collect()}) >= 0.88 * len(exact)
        share.append(out.select("query_id", "compared").distinct().agg(F.avg("compared")).first()[0] / n)
    assert share[1] < 0.8 * share[0] and share[1] < 0.5, share


def test_bucket_chances_and_cut():
    model = A.Tables(np.random.default_rng(2).standard_normal((1, 8, 16)), 0.6, 0.8, 3)
    x = np.random.default_rng(3).standard_normal((1, 16))
    x /= np.linalg.norm(x)
    logs = model.logs(0, x)
    chance = np.exp(A.sums(logs[0]))
    assert abs(chance.sum() - 1) < 1e-9 and abs(chance[chance >= np.exp(model.least(logs)[0])].sum() - 0.8) < 0.06
    # Neighbours at that cosine fall into the visited buckets as often as promised.
    u = np.random.default_rng(4).standard_normal((4000, 16))
    u -= (u @ x.T) * x
    y = 0.6 * x + 0.8 * u / np.linalg.norm(u, axis=1, keepdims=True)
    hit = A.sums(logs[0])[A.numbers(model.bits(0, y))] >= model.least(logs)[0]
    assert abs(hit.mean() - 0.8) < 0.08


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    out = A.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(1, 0.0), (2, -1.0)]
    assert A.search(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_repeated_ids(spark):
    """Copies and further vectors of one vec_id leave room for the other neighbours."""
    rng = np.random.default_rng(3)
    x = np.ones((40, 8)) + 0.1 * rng.standard_normal((40, 8))
    near = x[0] + 0.001 * rng.standard_normal((60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[0].tolist())] * 6 + [(9, v.tolist()) for v in near]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = A.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    v = np.array([r[1] for r in rows])
    score = v @ x[0] / np.linalg.norm(v, axis=1) / np.linalg.norm(x[0])
    best: dict = {}
    for (i, _), s in zip(rows, score.tolist(), strict=True):
        if i:
            best[i] = max(s, best.get(i, -9))
    assert [r["vec_id"] for r in out] == sorted(best, key=best.get, reverse=True)[:5]
    # Ids whose rows fill the nearest buckets do not end the search.
    few = spark.createDataFrame([(1, [1.0, 0.001 * i]) for i in range(30)] + [(0, [1.0, 0.0])] + [(i, [-1.0, 0.1 * i]) for i in range(2, 6)], "vec_id long, embedding array<double>")
    assert {r["vec_id"] for r in A.search(few, few.filter("vec_id = 0")).collect()} == {1, 2, 3, 4, 5}
