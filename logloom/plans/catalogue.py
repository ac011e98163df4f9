"""Named queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.config import MinerConfig
from logloom.functions import masking, normalize, similarity, template, tokens
from logloom.operators import consensus as co
from logloom.operators import evaluate as ev
from logloom.operators import extract as ex
from logloom.operators import match as mt
from logloom.operators import merge as mg
from logloom.operators import mine as mi
from logloom.operators import tree as tr
from logloom.scratch import fresh_path
from logloom.sources import lines as src
from logloom.sources import model as snapshots
from logloom.streaming import mine_stream as ms
from logloom.streaming.snapshots import ModelTable

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Lines that SQL can follow ----------------------------------------------------

#: With five levels every event type has a leaf, and any two lines of a leaf agree in four of six tokens.
DEEP = MinerConfig(depth=5)


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(F.col("event_id").alias("msg_id"), F.concat(F.lit("event "), "event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" value "), k).alias("line"), "event_type", F.col("user_id").cast("string").alias("u"), k.alias("k"))


_EV = """e AS (
  SELECT event_id AS msg_id, event_type, user_id::VARCHAR AS u, json_extract_string(props, '$.k') AS k FROM events
)"""

_RUNNING = _EV + """, r AS (
  SELECT *, count(*) OVER w AS cluster_size, min(u) OVER w <> max(u) OVER w AS uv, min(k) OVER w <> max(k) OVER w AS kv
  FROM e WINDOW w AS (PARTITION BY event_type ORDER BY msg_id)
), c AS (
  SELECT *, lag(uv) OVER p AS puv, lag(kv) OVER p AS pkv,
         'event ' || event_type || ' user ' || CASE WHEN uv THEN '<*>' ELSE u END || ' value ' || CASE WHEN kv THEN '<*>' ELSE k END AS template_mined
  FROM r WINDOW p AS (PARTITION BY event_type ORDER BY msg_id)
), m AS (
  SELECT *, CASE WHEN cluster_size = 1 THEN 'cluster_created' WHEN uv <> puv OR kv <> pkv THEN 'cluster_template_changed' ELSE 'none' END AS change_type,
         count(*) FILTER (cluster_size = 1) OVER (ORDER BY msg_id) AS cluster_count,
         dense_rank() OVER (ORDER BY (SELECT min(x.msg_id) FROM e x WHERE x.event_type = c.event_type)) AS cluster_id
  FROM c
)"""

_MODEL = _EV + """, g AS (
  SELECT event_type, min(msg_id) AS first, count(*) AS size,
         'event ' || event_type || ' user ' || CASE WHEN count(DISTINCT u) = 1 THEN min(u) ELSE '<*>' END
         || ' value ' || CASE WHEN count(DISTINCT k) = 1 THEN min(k) ELSE '<*>' END AS template
  FROM e GROUP BY event_type
), model AS (SELECT *, row_number() OVER (ORDER BY first) AS cluster_id FROM g)"""


def _shown(model: DataFrame, *by: str) -> DataFrame:
    return model.select(*by, "cluster_id", F.array_join("template_tokens", " ").alias("template"), "size")


@query(f"WITH {_MODEL} SELECT cluster_id, template, size FROM model")
def mine_clusters(spark, sf_dir):
    return _shown(mi.clusters(mi.mine(_event_lines(spark, sf_dir), DEEP)))


@query(f"WITH {_RUNNING} SELECT msg_id, change_type, cluster_id, cluster_size, template_mined, cluster_count FROM m WHERE msg_id >= 500")
def mine_resumed(spark, sf_dir):
    """A model of the first 500 lines is stored, read again, and taken up for the others."""
    rows = _event_lines(spark, sf_dir)
    model = snapshots.from_json(spark, snapshots.to_json(mi.clusters(mi.mine(rows.filter("msg_id < 500"), DEEP))))
    return mi.mine(rows.filter("msg_id >= 500"), DEEP, model=model)


@query(f"WITH {_RUNNING} SELECT msg_id, change_type, cluster_id, cluster_size, template_mined, cluster_count FROM m")
def mine_rows(spark, sf_dir):
    return mi.mine(_event_lines(spark, sf_dir), DEEP)


@query(f"WITH {_RUNNING} SELECT change_type, count(*) AS n FROM m GROUP BY change_type")
def mine_change_counts(spark, sf_dir):
    return mi.mine(_event_lines(spark, sf_dir), DEEP).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS total_size FROM events")
def mine_total_size(spark, sf_dir):
    return mi.clusters(mi.mine(_event_lines(spark, sf_dir), DEEP)).agg(F.sum("size").alias("total_size"))


@query(f"""WITH {_EV} SELECT row_number() OVER (ORDER BY min(msg_id)) AS cluster_id, count(*) AS size,
  event_type || ' user ' || CASE WHEN count(DISTINCT u) = 1 THEN min(u) ELSE '<*>' END || ' value ' || CASE WHEN count(DISTINCT k) = 1 THEN min(k) ELSE '<*>' END AS template
  FROM e GROUP BY event_type""")
def mine_jaccard(spark, sf_dir):
    rows = _event_lines(spark, sf_dir).withColumn("line", F.expr("substring(line, 7)"))
    return _shown(mi.clusters(mi.mine(rows, MinerConfig(engine="jaccard"))))


@query("""SELECT row_number() OVER (ORDER BY min(o_orderkey)) AS cluster_id, count(*) AS size,
  'status ' || o_orderstatus || ' of ' || o_orderpriority AS template FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def mine_exact_threshold(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("msg_id"), F.concat(F.lit("status "), "o_orderstatus", F.lit(" of "), "o_orderpriority").alias("line"))
    return _shown(mi.clusters(mi.mine(rows, MinerConfig(sim_th=1.0))))


@query("""WITH l AS (SELECT o_orderkey AS id, len(string_split(o_orderpriority, ' ')) AS n, string_split('order ' || o_orderstatus || ' ' || o_orderpriority, ' ') AS t FROM orders),
  p AS (SELECT n, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM l),
  c AS (SELECT n, i, CASE WHEN count(DISTINCT tok) = 1 THEN min(tok) ELSE '<*>' END AS tok FROM p GROUP BY n, i)
  SELECT row_number() OVER (ORDER BY first) AS cluster_id, template, size FROM
  (SELECT n, string_agg(tok, ' ' ORDER BY i) AS template FROM c GROUP BY n) JOIN (SELECT n, min(id) AS first, count(*) AS size FROM l GROUP BY n) USING (n)""")
def mine_flat_tree(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("msg_id"), F.concat(F.lit("order "), "o_orderstatus", F.lit(" "), "o_orderpriority").alias("line"))
    return _shown(mi.clusters(mi.mine(rows, MinerConfig(sim_th=0.0, depth=3))))


@query(f"""WITH {_EV}, r AS (SELECT *, lag(event_type) OVER (ORDER BY msg_id) IS DISTINCT FROM event_type AS new FROM e),
  s AS (SELECT *, sum(new::INT) OVER (ORDER BY msg_id) AS cluster_id FROM r)
  SELECT msg_id, cluster_id::BIGINT AS cluster_id, 1::BIGINT AS cluster_count, row_number() OVER (PARTITION BY cluster_id ORDER BY msg_id) AS cluster_size FROM s""")
def mine_max_clusters(spark, sf_dir):
    """One live cluster: every change of event type evicts the last one."""
    out = mi.mine(_event_lines(spark, sf_dir), MinerConfig(depth=5, max_clusters=1))
    return out.select("msg_id", "cluster_id", "cluster_count", "cluster_size")


@query(f"""WITH {_EV}, r AS (SELECT *, lag(event_type) OVER (ORDER BY msg_id) IS DISTINCT FROM event_type AS new FROM e),
  s AS (SELECT *, sum(new::INT) OVER (ORDER BY msg_id) AS cluster_id FROM r)
  SELECT msg_id, cluster_id::BIGINT AS cluster_id, 1::BIGINT AS cluster_count, row_number() OVER (PARTITION BY cluster_id ORDER BY msg_id) AS cluster_size FROM s""")
def mine_bound_in_blocks(spark, sf_dir):
    """The same bound, with the lines cut into blocks that are folded at the same time."""
    out = mi.mine(_event_lines(spark, sf_dir), MinerConfig(depth=5, max_clusters=1), block_rows=1_500)
    return out.select("msg_id", "cluster_id", "cluster_count", "cluster_size")


@query(f"""WITH {_EV.replace("event_type, user_id", "strftime(ts, '%Y-%m-%d') AS d, event_type, user_id")}, r AS (
  SELECT *, count(*) OVER w AS cluster_size, min(d) OVER w <> max(d) OVER w AS dv, min(u) OVER w <> max(u) OVER w AS uv, min(k) OVER w <> max(k) OVER w AS kv
  FROM e WINDOW w AS (PARTITION BY event_type ORDER BY msg_id)
), c AS (
  SELECT *, lag(dv) OVER p AS pdv, lag(uv) OVER p AS puv, lag(kv) OVER p AS pkv,
         CASE WHEN dv THEN '<*>' ELSE d END || ' event ' || event_type || ' user ' || CASE WHEN uv THEN '<*>' ELSE u END || ' value ' || CASE WHEN kv THEN '<*>' ELSE k END AS template_mined
  FROM r WINDOW p AS (PARTITION BY event_type ORDER BY msg_id)
) SELECT msg_id, template_mined, cluster_size, dense_rank() OVER (ORDER BY (SELECT min(x.msg_id) FROM e x WHERE x.event_type = c.event_type)) AS cluster_id,
         CASE WHEN cluster_size = 1 THEN 'cluster_created' WHEN dv <> pdv OR uv <> puv OR kv <> pkv THEN 'cluster_template_changed' ELSE 'none' END AS change_type FROM c""")
def mine_dated_in_blocks(spark, sf_dir):
    """Lines that begin with a date share their way through the tree: one group, folded in blocks."""
    day = _t(spark, sf_dir, "events").select(F.col("event_id").alias("msg_id"), F.date_format("ts", "yyyy-MM-dd").alias("d"))
    rows = _event_lines(spark, sf_dir).join(day, "msg_id").withColumn("line", F.concat_ws(" ", "d", "line"))
    return mi.mine(rows, MinerConfig(depth=6), block_rows=1_000).select("msg_id", "template_mined", "cluster_size", "cluster_id", "change_type")


@query(f"""WITH {_EV} SELECT row_number() OVER (ORDER BY min(msg_id)) AS cluster_id, count(*) AS size,
  'event ' || event_type || ' user ' || CASE WHEN count(DISTINCT u) = 1 THEN min(u) ELSE '<*>' END || ' value ' || CASE WHEN count(DISTINCT k) = 1 THEN min(k) ELSE '<*>' END AS template
  FROM e GROUP BY event_type""")
def pool_consensus(spark, sf_dir):
    """One model of eight instances that each saw an eighth of the lines."""
    return _shown(co.of_pool(mi.mine(_event_lines(spark, sf_dir), DEEP, instances=8), task_rows=10, fan_in=2))


@query(f"""WITH {_EV} SELECT msg_id % 4 AS instance, count(*) AS total_lines, count(DISTINCT event_type) AS cluster_count FROM e GROUP BY 1""")
def pool_stats(spark, sf_dir):
    return mi.pool_stats(mi.mine(_event_lines(spark, sf_dir), DEEP, instances=4))


@query(f"""WITH {_EV} SELECT msg_id % 4 AS instance, row_number() OVER (PARTITION BY msg_id % 4 ORDER BY min(msg_id)) AS cluster_id, count(*) AS size,
  'event ' || event_type || ' user ' || CASE WHEN count(DISTINCT u) = 1 THEN min(u) ELSE '<*>' END || ' value ' || CASE WHEN count(DISTINCT k) = 1 THEN min(k) ELSE '<*>' END AS template
  FROM e GROUP BY msg_id % 4, event_type""")
def pool_clusters(spark, sf_dir):
    return _shown(mi.clusters(mi.mine(_event_lines(spark, sf_dir), DEEP, instances=4), ["instance"]), "instance")


@query(f"WITH {_RUNNING} SELECT msg_id, change_type, cluster_id AS local_id, cluster_size, template_mined FROM m")
def stream_mine(spark, sf_dir):
    """All events as a stream of files, folded in keyed state, read back from the sink."""
    schema = _t(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    line = F.concat(F.lit("event "), "event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" value "), F.get_json_object("props", "$.k"))
    out = ms.mine_stream(e.select(F.col("event_id").alias("msg_id"), line.alias("line")), DEEP)
    base = fresh_path(spark, "stream")
    started = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").select("msg_id", "change_type", "local_id", "cluster_size", "template_mined")


@query(f"WITH {_RUNNING} SELECT msg_id, change_type, cluster_id, cluster_size, template_mined FROM m")
def stream_numbered(spark, sf_dir):
    """Results of a stream in batches of a file, with clusters numbered over all root keys as batches come."""
    rows = _event_lines(spark, sf_dir).select("msg_id", "line")
    base = fresh_path(spark, "stream-model")
    top = rows.agg(F.max("msg_id")).first()[0] or 0
    for k in range(4):  # files that come one after the other
        rows.filter(F.floor(F.col("msg_id") * 4 / (top + 1)) == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema("msg_id long, line string").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    table = ModelTable(spark, f"{base}/model")
    table.start(ms.mine_stream(stream, DEEP), f"{base}/state").awaitTermination()
    return table.results().select("msg_id", "change_type", "cluster_id", "cluster_size", "template_mined")


# Masks, tokens, normalizers ----------------------------------------------------

_MARKED = r"regexp_replace(text, '([^A-Za-z0-9])', chr(1) || '\1' || chr(2), 'g')"
_IPS = rf"regexp_replace({_MARKED}, '(^|\x02)[0-9]{{1,3}}(?:\x01\.\x02[0-9]{{1,3}}){{3}}($|\x01)', '\1<IP>\2', 'g')"


def _nums(marked: str) -> str:
    return rf"replace(replace(regexp_replace({marked}, '(^|\x02)(?:\x01[-+]\x02)?[0-9]+($|\x01)', '\1<NUM>\2', 'g'), chr(1), ''), chr(2), '')"


def _masked(df: DataFrame, masks) -> DataFrame:
    return df.select("doc_id", masking.mask(F.col("text"), masks).alias("masked"))


@query(f"SELECT doc_id, {_nums(_MARKED)} AS masked FROM documents")
def mask_num(spark, sf_dir):
    return _masked(_t(spark, sf_dir, "documents"), [masking.NUM])


@query(f"""WITH a AS (SELECT doc_id, replace(replace({_IPS}, chr(1), ''), chr(2), '') AS text FROM documents)
  SELECT doc_id, {_nums(_MARKED)} AS masked FROM a""")
def mask_ip_num(spark, sf_dir):
    return _masked(_t(spark, sf_dir, "documents"), masking.DEFAULT)


@query()
def mask_extended(spark, sf_dir):
    return _masked(_t(spark, sf_dir, "documents"), masking.EXTENDED)


_WS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_SPLIT = f"list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '')"


@query(f"SELECT conv_id, turn, len({_SPLIT}) AS n, array_to_string({_SPLIT}, '|') AS tokens FROM conversations")
def tokenize(spark, sf_dir):
    t = tokens.tokenize(F.col("text"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(t).cast("long").alias("n"), F.array_join(t, "|").alias("tokens"))


@query(f"SELECT page_id, array_to_string({_SPLIT.replace('text', chr(39).join(['replace(replace(url, ', '/', ', ', ' ', '), ', '.', ', ', ' ', ')']))}, '|') AS tokens FROM pages")
def tokenize_delimiters(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(tokens.tokenize(F.col("url"), ("/", ".")), "|").alias("tokens"))


@query(f"SELECT n::BIGINT AS n, count(*) AS docs FROM (SELECT len({_SPLIT}) AS n FROM documents) GROUP BY n")
def token_count_hist(spark, sf_dir):
    n = F.size(tokens.tokenize(F.col("text"))).cast("long")
    return _t(spark, sf_dir, "documents").groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("docs"))


@query(f"SELECT doc_id, len(list_filter({_SPLIT}, lambda x: regexp_matches(x, '[0-9]')))::BIGINT AS with_digits FROM documents")
def has_numbers(spark, sf_dir):
    own = F.filter(tokens.tokenize(F.col("text")), tokens.has_digit)
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(own).cast("long").alias("with_digits"))


@query(f"""WITH {_EV} SELECT msg_id, '6#' || CASE WHEN regexp_matches(u, '^[0-9]+$') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(k, '^[0-9]+$') THEN 1 ELSE 0 END AS root_key FROM e""")
def param_binning_key(spark, sf_dir):
    t = tokens.tokenize(masking.mask(F.col("line"), [masking.NUM]))
    return _event_lines(spark, sf_dir).select("msg_id", tokens.root_key(t, binning=True).alias("root_key"))


@query(f"WITH {_EV} SELECT msg_id, 'event ' || event_type || ' user ' || regexp_replace(u, '[0-9]+', '<*>', 'g') || ' value ' || regexp_replace(k, '[0-9]+', '<*>', 'g') AS line FROM e")
def normalize_substitute(spark, sf_dir):
    t = normalize.substitute(tokens.tokenize(F.col("line")), [("[0-9]+", "${paramStr}")])
    return _event_lines(spark, sf_dir).select("msg_id", F.array_join(t, " ").alias("line"))


@query(f"WITH {_EV} SELECT msg_id, 'event ' || event_type || ' by ' || u || ' value ' || k AS line FROM e")
def normalize_collapse(spark, sf_dir):
    t = normalize.collapse(tokens.tokenize(F.col("line")), [(" user ([0-9]+) ", " by   $1 ")])
    return _event_lines(spark, sf_dir).select("msg_id", F.array_join(t, " ").alias("line"))


def _order_lines(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("msg_id"), F.concat(F.lit("customer order placed by "), F.col("o_custkey").cast("string")).alias("line"))


@query("SELECT o_orderkey AS msg_id, 'customer<*>order placed<*>by ' || o_custkey AS line FROM orders")
def fusion(spark, sf_dir):
    """Learned on all lines, then applied to them."""
    rows = _order_lines(spark, sf_dir).withColumn("tokens", tokens.tokenize(F.col("line")))
    learned = normalize.learn_fusion(rows.select("msg_id", "tokens"))
    return rows.select("msg_id", F.array_join(learned(F.col("tokens")), " ").alias("line"))


# Similarity and templates -------------------------------------------------------

_PAIRS = """p AS (
  SELECT a.p_partkey AS id, [CASE WHEN a.p_partkey % 3 = 0 THEN '<*>' ELSE string_split(a.p_name, ' ')[1] END, string_split(a.p_name, ' ')[2], a.p_type] AS t,
         string_split(b.p_name, ' ') || [b.p_type] AS m
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
)"""


def _pairs(spark, sf_dir) -> DataFrame:
    a = _t(spark, sf_dir, "part")
    first = F.when(F.col("p_partkey") % 3 == 0, "<*>").otherwise(F.split("p_name", " ")[0])
    t = a.select(F.col("p_partkey").alias("id"), F.array(first, F.split("p_name", " ")[1], F.col("p_type")).alias("t"))
    m = a.select((F.col("p_partkey") - 1).alias("id"), F.concat(F.split("p_name", " "), F.array("p_type")).alias("m"))
    return t.join(m, "id")


def _scored(df: DataFrame, score) -> DataFrame:
    return df.withColumn("s", score).select("id", F.round("s.similarity", 9).alias("similarity"), F.col("s.param_count").cast("long").alias("param_count"))


_PC = "len(list_filter(t, lambda x: x = '<*>'))"
_EQ = "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = m[i] AND t[i] <> '<*>'))"


@query(f"WITH {_PAIRS} SELECT id, round({_EQ} / 3.0::DOUBLE, 9) AS similarity, {_PC} AS param_count FROM p")
def sim_position(spark, sf_dir):
    return _scored(_pairs(spark, sf_dir), similarity.position(F.col("t"), F.col("m")))


@query(f"WITH {_PAIRS} SELECT id, round(({_EQ} + {_PC}) / 3.0::DOUBLE, 9) AS similarity, {_PC} AS param_count FROM p")
def sim_position_params(spark, sf_dir):
    return _scored(_pairs(spark, sf_dir), similarity.position(F.col("t"), F.col("m"), include_params=True))


@query(f"WITH {_PAIRS}, q AS (SELECT *, {_PC} AS pc, (3 - {_PC} - {_EQ}) / (3 - {_PC})::DOUBLE AS r FROM p) SELECT id, round(CASE WHEN r <= 0.5 THEN 1 - r ELSE 0 END, 9) AS similarity, pc AS param_count FROM q")
def sim_diff_ratio(spark, sf_dir):
    return _scored(_pairs(spark, sf_dir), similarity.diff_ratio(F.col("t"), F.col("m"), max_ratio=0.5))


_OWN = "list_distinct(list_filter(t, lambda x: x <> '<*>'))"
_OTHER = "list_distinct(list_filter(list_transform(range(1, 4), lambda i: CASE WHEN t[i] = '<*>' THEN NULL ELSE m[i] END), lambda x: x IS NOT NULL))"
_J = "least(1.3::DOUBLE * (len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE), 1.0)"


@query(f"WITH {_PAIRS}, q AS (SELECT *, {_OWN} AS a, {_OTHER} AS b FROM p) SELECT id, round({_J}, 9) AS similarity, {_PC} AS param_count FROM q")
def sim_jaccard_index(spark, sf_dir):
    return _scored(_pairs(spark, sf_dir), similarity.jaccard_index(F.col("t"), F.col("m")))


@query(f"WITH {_PAIRS}, q AS (SELECT *, list_distinct(t) AS a, CASE WHEN {_PC} > 0 THEN {_OTHER} ELSE list_distinct(m) END AS b FROM p) SELECT id, round({_J}, 9) AS similarity, {_PC} AS param_count FROM q")
def sim_jaccard_engine(spark, sf_dir):
    return _scored(_pairs(spark, sf_dir), similarity.jaccard_engine(F.col("t"), F.col("m")))


@query(f"""WITH {_PAIRS}, q AS (SELECT *, list_filter(t, lambda x: x <> '<*>') AS w FROM p),
  d AS (SELECT *, list_distinct(list_filter([least(w[1], w[2]) || '|' || greatest(w[1], w[2]), least(w[1], w[3]) || '|' || greatest(w[1], w[3]), least(w[2], w[3]) || '|' || greatest(w[2], w[3])], lambda x: x IS NOT NULL)) AS a,
        list_distinct([least(m[1], m[2]) || '|' || greatest(m[1], m[2]), least(m[1], m[3]) || '|' || greatest(m[1], m[3]), least(m[2], m[3]) || '|' || greatest(m[2], m[3])]) AS b FROM q),
  f AS (SELECT *, len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE AS s FROM d)
  SELECT id, round(CASE WHEN s >= 0.3 THEN s ELSE 0 END, 9) AS similarity, {_PC} AS param_count FROM f""")
def sim_term_pairs(spark, sf_dir):
    return _scored(_pairs(spark, sf_dir), similarity.term_pairs(F.col("t"), F.col("m"), least=0.3))


@query(f"""WITH {_PAIRS}, q AS (SELECT *, {_PC} AS pc, {_EQ} AS eq FROM p), r AS (SELECT *, (3 - pc - eq) / (3 - pc)::DOUBLE AS d FROM q)
  SELECT id, round(CASE WHEN d <= 0.3 THEN 1 - d WHEN pc > 0 THEN 0 ELSE eq / 3.0::DOUBLE END, 9) AS similarity, CASE WHEN d <= 0.3 OR pc > 0 OR eq > 0 THEN pc ELSE 0 END AS param_count FROM r""")
def sim_chain(spark, sf_dir):
    t, m = F.col("t"), F.col("m")
    return _scored(_pairs(spark, sf_dir), similarity.chain(similarity.diff_ratio(t, m), similarity.position(t, m)))


@query(f"WITH {_PAIRS} SELECT id, array_to_string(list_transform(range(1, 4), lambda i: CASE WHEN t[i] = m[i] THEN t[i] ELSE '<*>' END), ' ') AS template FROM p")
def template_full(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.array_join(template.template(F.col("m"), F.col("t")), " ").alias("template"))


@query("""WITH s AS (SELECT p_partkey AS id, p_brand AS a, lead(p_brand) OVER (ORDER BY p_partkey) AS b FROM part),
  l AS (SELECT *, list_max(list_transform(range(0, least(length(a), length(b)) + 1), lambda k: CASE WHEN a[:k] = b[:k] THEN k ELSE 0 END)) AS p FROM s WHERE b IS NOT NULL AND a <> b),
  m AS (SELECT *, list_max(list_transform(range(0, least(length(a), length(b)) - p + 1), lambda k: CASE WHEN right(a, k) = right(b, k) THEN k ELSE 0 END)) AS x FROM l)
  SELECT id, CASE WHEN (p >= 2 OR x >= 2) THEN a[:p] || '<*>' || right(a, x) END AS template FROM m""")
def template_affix(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    both = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_brand").alias("b")), "id").filter("a <> b")
    return both.select("id", template.affix(F.col("a"), F.col("b")).alias("template"))


@query("""WITH s AS (SELECT p_partkey AS id, p_brand AS a, lead(p_brand) OVER (ORDER BY p_partkey) AS b FROM part),
  l AS (SELECT *, list_max(list_transform(range(0, least(length(a), length(b)) + 1), lambda k: CASE WHEN a[:k] = b[:k] THEN k ELSE 0 END)) AS p FROM s WHERE b IS NOT NULL),
  m AS (SELECT *, list_max(list_transform(range(0, least(length(a), length(b)) - p + 1), lambda k: CASE WHEN right(a, k) = right(b, k) THEN k ELSE 0 END)) AS x FROM l)
  SELECT id, CASE WHEN a = b THEN b ELSE a[:p] || '<*>' || right(a, x) END AS template_token,
         CASE WHEN a = b THEN '' ELSE a[p + 1:length(a) - x] || '|' || b[p + 1:length(b) - x] END AS extracted,
         round(CASE WHEN a = b THEN 1.0 ELSE least(0.6 + 0.3 * ((p + x) / ((length(a) + length(b)) / 2.0)), 0.95) END::DOUBLE, 9) AS confidence,
         CASE WHEN a = b THEN 'exact' ELSE 'affix' END AS strategy FROM m""")
def template_results(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    both = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_brand").alias("b")), "id")
    r = both.withColumn("r", template.parameterize(F.col("a"), F.col("b"), least_affix=2))
    return r.select("id", "r.template_token", F.array_join("r.extracted", "|").alias("extracted"), F.round("r.confidence", 9).alias("confidence"), "r.strategy")


@query("SELECT count(*) AS fitting FROM part WHERE p_brand LIKE 'Brand#_%'")
def template_validate(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.filter(template.fits(F.lit("Brand#<*>"), F.col("p_brand"))).agg(F.count(F.lit(1)).alias("fitting"))


@query("""SELECT a.o_orderkey AS id, CASE WHEN strftime(a.o_orderdate, '%Y-%m-%d') = strftime(b.o_orderdate, '%Y-%m-%d') THEN NULL ELSE '<*>-<*>-<*>' END AS template
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""")
def template_regex(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    both = o.select(F.col("o_orderkey").alias("id"), day.alias("a")).join(o.select((F.col("o_orderkey") - 1).alias("id"), day.alias("b")), "id")
    return both.select("id", template.regex(F.col("a"), F.col("b"), [(r"^(\d{4})-(\d{2})-(\d{2})$", 3, "${paramStr}-${paramStr}-${paramStr}")]).alias("template"))


@query(f"""WITH {_PAIRS}, q AS (SELECT id, t, m || ['tail'] AS m FROM p)
  SELECT id, array_to_string(list_transform(m, lambda x: CASE WHEN list_contains(t, x) THEN x ELSE '<*>' END), ' ') AS template FROM q""")
def template_sets(spark, sf_dir):
    longer = F.concat(F.col("m"), F.array(F.lit("tail")))
    return _pairs(spark, sf_dir).select("id", F.array_join(template.template_of_sets(longer, F.col("t")), " ").alias("template"))


# Lookup, extraction, merge, metrics, snapshots ------------------------------------


def _lookup_lines(spark, sf_dir) -> DataFrame:
    odd = F.col("msg_id") % 3 == 0
    return _event_lines(spark, sf_dir).select("msg_id", F.when(odd, F.concat(F.lit("event refund user "), "u", F.lit(" value 1"))).otherwise(F.col("line")).alias("line"))


_MATCHED = f"WITH {_MODEL} SELECT e.msg_id, CASE WHEN e.msg_id % 3 <> 0 THEN m.cluster_id END AS cluster_id FROM e JOIN model m USING (event_type)"


def _matched(spark, sf_dir, strategy: str) -> DataFrame:
    model = mi.clusters(mi.mine(_event_lines(spark, sf_dir), DEEP))
    return mt.match(_lookup_lines(spark, sf_dir), model, DEEP, strategy)


@query(_MATCHED)
def match_always(spark, sf_dir):
    return _matched(spark, sf_dir, "always")


@query(_MATCHED)
def match_never(spark, sf_dir):
    return _matched(spark, sf_dir, "never")


@query(_MATCHED)
def match_fallback(spark, sf_dir):
    return _matched(spark, sf_dir, "fallback")


@query("SELECT count(*) AS unmatched FROM events WHERE event_id % 3 = 0")
def match_unmatched(spark, sf_dir):
    return _matched(spark, sf_dir, "always").filter("cluster_id is null").agg(F.count(F.lit(1)).alias("unmatched"))


def _templated(spark, sf_dir) -> DataFrame:
    return _event_lines(spark, sf_dir).select("msg_id", "line", F.lit("event <*> user <NUM> value <NUM>").alias("template"))


@query(f"WITH {_EV} SELECT msg_id, event_type || ':*;' || u || ':NUM;' || k || ':NUM' AS params FROM e")
def extract_exact(spark, sf_dir):
    out = ex.extract(_templated(spark, sf_dir), MinerConfig(masks=masking.DEFAULT))
    return out.select("msg_id", F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["value"], p["mask_name"])), ";").alias("params"))


@query(f"WITH {_EV} SELECT msg_id, event_type || ';' || u || ';' || k AS params FROM e")
def extract_values(spark, sf_dir):
    return ex.values(_templated(spark, sf_dir)).select("msg_id", F.array_join("values", ";").alias("params"))


@query(f"""WITH {_EV}, p AS (SELECT msg_id, unnest([event_type, u, k]) AS value, unnest(['*', 'NUM', 'NUM']) AS mask_name, unnest([0, 1, 2]) AS place FROM e) SELECT msg_id, place, value, mask_name FROM p""")
def extract_by_table_function(spark, sf_dir):
    """Parameters as rows, by a table function in SQL."""
    ex.register(spark, MinerConfig(masks=masking.DEFAULT))
    return spark.sql("SELECT e.msg_id, p.place, p.value, p.mask_name FROM {e} e, LATERAL extract_parameters(e.template, e.line) p", e=_templated(spark, sf_dir))


@query(f"""WITH {_EV} SELECT count(*) AS messages, count(DISTINCT event_type) AS templates, count(DISTINCT event_type) AS clusters, 1.0::DOUBLE AS group_accuracy, 1.0::DOUBLE AS template_accuracy FROM e""")
def eval_log_file(spark, sf_dir):
    """From a folder with a structured log (header with blanks and quotes) to the scores of its mined clusters."""
    e = _event_lines(spark, sf_dir)
    template = F.concat(F.lit("event "), "event_type", F.lit(" user <*> value <*>"))
    line = F.concat(F.col("msg_id").cast("string"), F.lit(', "'), "line", F.lit('" ,'), template)
    folder = fresh_path(spark, "log-file")
    header = spark.createDataFrame([('LineId, "Content" , EventTemplate',)], "value string")
    header.union(e.select(line.alias("value"))).coalesce(1).write.text(f"{folder}/log")
    rows = src.read_structured(spark, f"{folder}/log")
    truth = rows.select(F.col("line_no").alias("msg_id"), F.col("template").alias("template_id"), F.split("template", " ").alias("template_tokens"))
    mined = mi.mine(rows.select(F.col("line_no").alias("msg_id"), F.col("content").alias("line")), DEEP.with_(masks=(masking.NUM,)))
    parsed = mined.select("msg_id", "cluster_id", F.split("template_mined", " ").alias("template_tokens"))
    return ev.evaluate(truth, parsed).select("messages", "templates", "clusters", "group_accuracy", "template_accuracy")


@query(f"""WITH {_MODEL} SELECT min(cluster_id) AS cluster_id, CASE WHEN count(*) > 1 THEN 'event <*> user <*> value <*>' ELSE min(template) END AS template,
  sum(size)::BIGINT AS size FROM model GROUP BY (cluster_id - 1) // 2""")
def merge_position_diff(spark, sf_dir):
    """Pairs merge; a template that differs only where the other has its wildcard is left alone."""
    return _shown(mg.merge(mi.clusters(mi.mine(_event_lines(spark, sf_dir), DEEP)))[0])


@query(f"""WITH {_MODEL} SELECT cluster_id AS old_id, 1::BIGINT AS cluster_id, CASE WHEN count(*) OVER () > 1 THEN 'event <*> user <*> value <*>' ELSE template END AS template FROM model""")
def merge_shared_affix(spark, sf_dir):
    model = mi.clusters(mi.mine(_event_lines(spark, sf_dir), DEEP))
    merged, moved = mg.merge(model, [mg.shared_affix(3)], by_length=False)
    return moved.join(_shown(merged), "cluster_id").select("old_id", "cluster_id", "template")


@query("""WITH o AS (SELECT *, string_split('order ' || o_orderstatus || ' ' || o_orderpriority, ' ') AS t FROM orders), n AS (
  SELECT len(t) AS n, CASE WHEN count(DISTINCT t[2]) > 1 THEN '<*>' ELSE min(t[2]) END AS s, CASE WHEN count(DISTINCT t[3]) > 1 THEN '<*>' ELSE min(t[3]) END AS p, min(t[4]) AS e FROM o GROUP BY len(t))
  SELECT 1::BIGINT AS cluster_id, 'order ' || CASE WHEN a.s <> b.s AND a.s <> '<*>' AND b.s <> '<*>' THEN '<*>' ELSE b.s END || ' '
    || CASE WHEN a.p <> b.p AND a.p <> '<*>' AND b.p <> '<*>' THEN '<*>' ELSE b.p END || ' ' || b.e AS template, (SELECT count(*) FROM orders) AS size
  FROM n a, n b WHERE a.n = 3 AND b.n = 4""")
def merge_affix_lengths(spark, sf_dir):
    """Templates of unequal length: the longer one stays, its constants beside wildcards of the other too."""
    o = _t(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("msg_id"), F.concat(F.lit("order "), "o_orderstatus", F.lit(" "), "o_orderpriority").alias("line"))
    model = mi.clusters(mi.mine(rows, MinerConfig(sim_th=0.0, depth=3)))
    return _shown(mg.merge(model, [mg.shared_affix(1)], by_length=False)[0])


@query(f"""WITH {_EV}, g AS (SELECT event_type, row_number() OVER (ORDER BY min(msg_id)) AS cluster_id FROM e GROUP BY event_type)
  SELECT e.msg_id, g.cluster_id FROM e JOIN g USING (event_type)""")
def match_jaccard(spark, sf_dir):
    """Every line is found in the model of all lines by the set engine (root keys: event types)."""
    rows = _event_lines(spark, sf_dir).withColumn("line", F.expr("substring(line, 7)"))
    config = MinerConfig(engine="jaccard")
    return mt.match(rows, mi.clusters(mi.mine(rows, config)), config, "fallback")


def _truth_and_parsed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = _event_lines(spark, sf_dir)
    truth = e.select("msg_id", F.col("event_type").alias("template_id"), F.array(F.lit("event"), "event_type", F.lit("<*>")).alias("template_tokens"))
    cluster = F.when(F.length("k") == 1, F.lit("short")).otherwise(F.substring("event_type", 1, 1))
    return truth, e.select("msg_id", cluster.alias("cluster_id"), F.array(F.lit("event"), F.when(F.length("k") == 1, F.lit("<*>")).otherwise(F.col("event_type")), F.lit("<NUM>")).alias("template_tokens"))


_CELLS = _EV + """, x AS (
  SELECT msg_id, event_type AS t, CASE WHEN length(k) = 1 THEN 'short' ELSE event_type[1:1] END AS c, CASE WHEN length(k) = 1 THEN '<*>' ELSE event_type END AS w FROM e
), n AS (SELECT t, c, count(*) AS b FROM x GROUP BY t, c), nt AS (SELECT t, count(*) AS n FROM x GROUP BY t),
nc AS (SELECT c, count(*) AS n, min(msg_id) AS first, arg_min(w, msg_id) AS w FROM x GROUP BY c)"""


@query(f"""WITH {_CELLS}, b AS (SELECT n.*, nc.n AS cn, nt.n AS tn, row_number() OVER (PARTITION BY n.t ORDER BY b DESC, first) AS r FROM n JOIN nc USING (c) JOIN nt USING (t)),
  s AS (SELECT sum(b) / sum(tn)::DOUBLE AS ga, avg(b / cn::DOUBLE) AS p, avg(b / tn::DOUBLE) AS q FROM b WHERE r = 1)
  SELECT round(ga, 9) AS group_accuracy, round(2 * p * q / (p + q), 9) AS f1_group_accuracy FROM s""")
def eval_groups(spark, sf_dir):
    return ev.group_scores(*_truth_and_parsed(spark, sf_dir)).select(F.round("group_accuracy", 9).alias("group_accuracy"), F.round("f1_group_accuracy", 9).alias("f1_group_accuracy"))


@query(f"""WITH {_CELLS}, h AS (SELECT t, max(CASE WHEN t = w THEN 3 ELSE 2 END) AS hit FROM nt, nc GROUP BY t),
  s AS (SELECT sum(hit) / (3.0 * count(*))::DOUBLE AS pta, avg(hit / 3.0::DOUBLE) AS f FROM h) SELECT round(pta, 9) AS template_accuracy, round(f, 9) AS f1_template_accuracy FROM s""")
def eval_templates(spark, sf_dir):
    return ev.template_scores(*_truth_and_parsed(spark, sf_dir)).select(F.round("template_accuracy", 9).alias("template_accuracy"), F.round("f1_template_accuracy", 9).alias("f1_template_accuracy"))


@query(f"""WITH {_CELLS}, a AS (SELECT t, max(b) AS m, sum(b) AS n FROM n GROUP BY t), d AS (SELECT c, max(b) AS m, sum(b) AS n FROM n GROUP BY c),
  f AS (SELECT sum(m) / sum(n)::DOUBLE AS ga, avg(m / n::DOUBLE) AS p FROM a), g AS (SELECT avg(m / n::DOUBLE) AS r FROM d),
  h AS (SELECT sum(b * (1 + CASE WHEN n.t = nc.w THEN 1 ELSE 0 END)) / (3.0 * sum(b))::DOUBLE AS pta FROM n JOIN nc USING (c))
  SELECT round(ga, 9) AS group_accuracy, round(2 * p * r / (p + r), 9) AS f1_group_accuracy, round(pta, 9) AS template_accuracy, round(pta, 9) AS f1_template_accuracy FROM f, g, h""")
def eval_compact(spark, sf_dir):
    out = ev.evaluate_compact(*_truth_and_parsed(spark, sf_dir))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(f"WITH {_CELLS} SELECT count(*) AS messages, count(DISTINCT t) AS templates, count(DISTINCT c) AS clusters FROM x")
def eval_counts(spark, sf_dir):
    return ev.evaluate(*_truth_and_parsed(spark, sf_dir)).select("messages", "templates", "clusters")


@query(f"WITH {_MODEL} SELECT cluster_id, template, size FROM model")
def snapshot_roundtrip(spark, sf_dir):
    model = mi.clusters(mi.mine(_event_lines(spark, sf_dir), DEEP))
    return _shown(snapshots.from_json(spark, snapshots.to_json(model, compress=True)))


@query("SELECT o_orderkey AS id, 'a \"b\"' AS level, o_orderstatus || ',' || o_orderpriority || ',' || o_custkey AS content, 'T' AS template FROM orders")
def csv_reconcile(spark, sf_dir):
    """Content with unquoted commas among quoted fields."""
    o = _t(spark, sf_dir, "orders")
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(',"a ""b""", '), "o_orderstatus", F.lit(", "), "o_orderpriority", F.lit(" ,"), F.col("o_custkey").cast("string"), F.lit(",T"))
    f = src.reconcile(src.csv_fields(line), 4, 2)
    return o.select(f.alias("f")).select(F.col("f")[0].cast("long").alias("id"), F.col("f")[1].alias("level"), F.col("f")[2].alias("content"), F.col("f")[3].alias("template"))


@query(f"""WITH {_MODEL} SELECT '6' AS root_key, cluster_id - 1 AS rank, 'event ' || event_type AS path, cluster_id::VARCHAR AS cluster_ids FROM model""")
def tree_nodes(spark, sf_dir):
    out = tr.nodes(mi.clusters(mi.mine(_event_lines(spark, sf_dir), DEEP)), DEEP)
    return out.select("root_key", "rank", F.array_join("path", " ").alias("path"), F.array_join(F.col("cluster_ids").cast("array<string>"), ",").alias("cluster_ids"))


@query(f"WITH {_MODEL} SELECT count(*) AS clusters, sum(size)::BIGINT AS size FROM model WHERE length(template) > 0")
def clusters_of_length(spark, sf_dir):
    model = mi.clusters(mi.mine(_event_lines(spark, sf_dir), DEEP))
    return mi.of_length(mi.of_first_token(model, "event"), 6).agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("size"))


@query("""SELECT 'status ' || o_orderstatus || ' ' || o_orderpriority AS template, row_number() OVER (ORDER BY min(o_orderkey)) AS template_id
  FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def dataset_template_ids(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("line_no"), F.concat(F.lit("status "), "o_orderstatus", F.lit(" "), "o_orderpriority").alias("template"))
    return src.template_ids(rows).select("template", F.col("template_id").cast("long").alias("template_id"))


@query("SELECT page_id, trim(line) AS line FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages) WHERE trim(line) <> ''")
def clean_lines(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("value"))
    return src.clean(rows).select("page_id", "line")
