"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann as _ann
from . import bpe as _bpe
from . import collocations as _phrases
from . import exact_dedup as _exact
from . import language_id as _language
from . import line_dedup as _lines
from . import mixing as _mixing
from . import near_dedup as _near
from . import packing as _packing
from . import quality as _quality
from . import secret_scan as _secrets
from . import toxicity as _toxicity
from . import vector_codes as _codes
from .common import held_out, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.by_source(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _toxicity.score(docs, _toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.scan(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return _ann.search(rows, rows.filter("vec_id % 50 = 0"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _quality.score(docs, _quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _language.predict(docs, _language.train(docs.filter(~held_out(F.col("doc_id")))))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.near_classes(table(spark, sf_dir, "documents"), words=2)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes.codes(table(spark, sf_dir, "embeddings"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe.digests(_bpe.round_trip(table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases.collocations(table(spark, sf_dir, "documents"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Assignments and floored means, round by round."""

    def nearest(books: str) -> str:
        distances = f"SELECT v.rn, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::HUGEINT AS d FROM v JOIN {books} b USING (p)"
        return f"SELECT rn, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM ({distances}) GROUP BY rn, p"

    steps = []
    for k in range(rounds):
        steps.append(f"""a{k} AS MATERIALIZED ({nearest(f"b{k}")}),
m{k} AS (
  SELECT p, e, list(s ORDER BY i) AS x FROM (
    SELECT p, e, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS s FROM (
      SELECT a.p, a.e, generate_subscripts(v.x, 1) AS i, unnest(v.x)::HUGEINT AS y FROM a{k} a JOIN v USING (rn, p)
    ) GROUP BY p, e, i
  ) GROUP BY p, e
), b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x::HUGEINT[], b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (p, e)
)""")
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::HUGEINT) AS x
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT rn, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM k, range({parts}) t(p)
), b0 AS (SELECT p, rn - 1 AS e, x FROM v WHERE rn <= {entries}),
{", ".join(steps)},
f AS ({nearest(f"b{rounds}")}),
r AS (SELECT rn, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY rn),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM k JOIN r USING (rn), h
"""


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_ann": op7_ann,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_bpe": op12_bpe,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op1_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source
), o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS k FROM s),
c AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, sum(source_size) OVER () AS total
  FROM o
), f AS (SELECT * FROM c WHERE (total - capped) * w <= 3 * source_size * open_w ORDER BY k LIMIT 1),
t AS (
  SELECT c.source, c.source_size, CASE WHEN c.k < f.k THEN (3 * c.source_size)::DOUBLE
         ELSE ((f.total - f.capped) * c.w)::DOUBLE / f.open_w::DOUBLE END AS target FROM c, f
), q AS (SELECT *, floor(target)::BIGINT AS quota FROM t),
x AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.quota,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-0:' || d.doc_id), d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE size * (quota // source_size)
            + greatest(0, least(size, quota % source_size - before)) END::BIGINT AS taken
FROM x
""",
    "op2_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
""",
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), k AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (k.keeper <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k.keeper IS NULL OR k.keeper = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY l.doc_id
""",
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(t) = 1 THEN t
         ELSE list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  SELECT a AS doc_id, b AS reach FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles,
       least(d.doc_id, coalesce(min(r.reach), d.doc_id)) AS component_id,
       d.doc_id <= coalesce(min(r.reach), d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
""",
    "op11_vector_codes": _codes_sql(),
    "op13_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS t FROM p),
n AS (SELECT lang, sum(len(t))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(t) - k + 2), lambda i: array_to_string(t[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 6) o(k)),
f AS MATERIALIZED (SELECT lang, k AS order_, phrase, count(*)::HUGEINT AS c FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (
  SELECT f.lang, f.phrase, f.order_, f.c AS a, n.n, cut, array_to_string(string_split(f.phrase, ' ')[1:cut], ' ') AS head,
         array_to_string(string_split(f.phrase, ' ')[cut + 1:], ' ') AS rest
  FROM f JOIN n USING (lang), range(1, 5) o(cut) WHERE f.order_ > cut
), s AS (
  SELECT c.lang, c.phrase, c.a, c.n, x.c AS l, y.c AS r, cut, (1000 * c.a * c.n) // (x.c * y.c) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT DISTINCT lang, inner_ AS phrase FROM (
    SELECT lang, c, unnest([array_to_string(string_split(phrase, ' ')[2:], ' '), array_to_string(string_split(phrase, ' ')[:-2], ' ')]) AS inner_ FROM f WHERE order_ > 2
  ) j WHERE c >= (SELECT f.c FROM f WHERE f.lang = j.lang AND f.phrase = j.inner_)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
       n::BIGINT AS n, score::BIGINT AS score
FROM b ANTI JOIN i USING (lang, phrase) QUALIFY rank <= 2000
""",
}
