"""Queries for text, retrieval, graphs, bitemporal logs, identity and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.functions import market as m
from quillon.operators import calendar as cal, graph as g, identity as idn, text as tx
from quillon.plans.base import events, rounded, table
from quillon.sources import scratch

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 50), c AS (SELECT doc_id, n, text, unnest(range(CAST(greatest(ceil((n - 1500) / 1300e0), 0) AS BIGINT) + 1)) AS i FROM d)
 SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, trim(substr(text, i * 1300 + 1, 1500), ' ') AS chunk_text FROM c WHERE trim(substr(text, i * 1300 + 1, 1500), ' ') <> ''""")
def txt01_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "chunk_index", "chunk_text")


_SECTIONS = [(r"(?i)<title>.*?(?=</title>)", "title"), (r"(?i)<nav>.*?(?=</nav>)", "nav"), (r"(?i)<article>.*?(?=</article>|$)", "article")]


@query(r"""WITH t AS (SELECT page_id, html, regexp_extract(html, '(?is)<title>.*?</title>') AS t, regexp_extract(html, '(?is)<nav>.*?</nav>') AS n, regexp_extract(html, '(?is)<article>.*') AS a, regexp_extract(html, '(?is)<article>.*?</article>') AS b FROM pages),
 s AS (SELECT page_id, 'title' AS section, left(t, greatest(length(t) - 8, 0)) AS x FROM t UNION ALL SELECT page_id, 'nav', left(n, greatest(length(n) - 6, 0)) FROM t
 UNION ALL SELECT page_id, 'article', CASE WHEN b <> '' THEN left(b, length(b) - 10) ELSE a END FROM t), k AS (SELECT page_id, section, substr(trim(x, ' '), 1, 50000) AS section_text FROM s WHERE length(substr(trim(x, ' '), 1, 50000)) >= 50)
 SELECT * FROM k UNION ALL SELECT page_id, 'full_document', substr(html, 1, 100000) FROM pages WHERE page_id NOT IN (SELECT page_id FROM k)""")
def txt02_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns, with the caps and the least length of the filings' ingestion."""
    return tx.sections(table(spark, sf_dir, "pages"), "html", _SECTIONS, 50_000, least=50, fallback_cap=100_000).select("page_id", "section", "section_text")


@query(r"""SELECT page_id, regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?is)<table\b.*?</table\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' '), '(?i)table of contents', '', 'g') AS text FROM pages""")
def txt03_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


_LEXICON = {"positive": ["the", "and", "la"], "negative": ["of", "de", "to"], "uncertainty": ["in", "is"]}


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z\-'']*[a-z]|[a-z]') AS w FROM documents), c AS (SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words,
 CAST(len(list_intersect(list_distinct(w), ['the', 'and', 'la'])) AS INTEGER) AS positive, CAST(len(list_intersect(list_distinct(w), ['of', 'de', 'to'])) AS INTEGER) AS negative, CAST(len(list_intersect(list_distinct(w), ['in', 'is'])) AS INTEGER) AS uncertainty FROM w)
 SELECT *, round(round((positive - negative) / CAST(greatest(n_words, 1) AS DOUBLE), 8), 6) AS score FROM c""")
def txt04_05_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tx.lexicon_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _LEXICON).drop("text"))


@query(r"""WITH w AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z\-'']*[a-z]|[a-z]')) AS s FROM documents), p AS (SELECT *, lag(s) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM w)
 SELECT doc_id, CASE WHEN len(s) > 0 AND len(b) > 0 THEN round(round(len(list_intersect(s, b)) / CAST(len(s) AS DOUBLE), 8), 6) END AS similarity FROM p""")
def txt06_set04_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tx.similarity_to_previous(table(spark, sf_dir, "documents"), "source", [F.col("doc_id")], "text")
    return rounded(out.select("doc_id", "similarity"))


@query("""WITH f AS (SELECT label, vec_id % 5 AS part, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT label, part, i, avg(CAST(x AS DOUBLE)) AS v FROM f GROUP BY ALL), v AS (SELECT label, part, list(v ORDER BY i) AS v FROM a GROUP BY ALL),
 p AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY part) AS b FROM v) SELECT label, part, round(list_cosine_similarity(v, b), 6) AS cosine, CASE WHEN list_cosine_similarity(v, b) > 0.95 THEN 'high_consistency' WHEN list_cosine_similarity(v, b) > 0.85 THEN 'moderate_consistency'
 WHEN list_cosine_similarity(v, b) > 0.7 THEN 'notable_shift' WHEN b IS NOT NULL THEN 'significant_shift' END AS shift FROM p""")
def txt08_tone_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("part", F.col("vec_id") % 5)
    pooled = tx.mean_pooled(e, ["label", "part"], "embedding")
    return rounded(tx.tone_shift(pooled, "label", "part", "embedding").select("label", "part", "cosine", "shift"))


_BM25 = r"""q0 AS (SELECT item_id, unnest(string_split_regex(lower(text), '\s+')) AS term FROM benchmark), q AS (SELECT item_id, term, count(*) AS qf FROM q0 WHERE term <> '' GROUP BY ALL),
 t0 AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS term FROM documents), t AS (SELECT doc_id, term, count(*) AS tf FROM t0 WHERE term <> '' GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS len FROM t GROUP BY doc_id),
 n AS (SELECT count(*) AS n, avg(coalesce(len, 0)) AS a FROM documents LEFT JOIN l USING (doc_id)), df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
 s AS (SELECT q.item_id, t.doc_id, sum(q.qf * ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / a))) AS score FROM q JOIN t USING (term) JOIN df USING (term) JOIN l USING (doc_id) CROSS JOIN n GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


def _bm25(spark: SparkSession, sf_dir: str, top: int) -> DataFrame:
    """Every benchmark item is a query."""
    return tx.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", top)


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10")
def ret01_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_bm25(spark, sf_dir, 10).withColumn("rank", F.col("rank").cast("long")), 5)


_DENSE = """dq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), ds AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM dq CROSS JOIN embeddings),
 dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM ds)"""


def _dense(spark: SparkSession, sf_dir: str, top: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return tx.dense_top_k(e, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "embedding", "query_id", top)


@query(f"WITH {_DENSE} SELECT query_id, vec_id, round(score, 5) AS score, rank FROM dr WHERE rank <= 10")
def ret02_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_dense(spark, sf_dir, 10).withColumn("rank", F.col("rank").cast("long")), 5)


@query(f"""WITH {_BM25}, k AS (SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 20), o AS (SELECT q.item_id, t.doc_id, row_number() OVER (PARTITION BY q.item_id ORDER BY count(*) DESC, t.doc_id) AS rank FROM q JOIN t USING (term) GROUP BY q.item_id, t.doc_id),
 f AS (SELECT item_id, doc_id, sum(CASE WHEN doc_id % 10 = 0 THEN 2e0 ELSE 1e0 END / (60 + rank)) AS score FROM (SELECT item_id, doc_id, rank FROM k UNION ALL SELECT * FROM o WHERE rank <= 20) GROUP BY ALL),
 w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM f)
 SELECT 'hybrid_rrf' AS mode, item_id, doc_id, round(score, 5) AS score, rank FROM w WHERE rank <= 10 UNION ALL SELECT 'fallback', item_id, doc_id, round(score, 5), rank FROM k WHERE rank <= 10""")
def ret03_04_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and the number of terms held, fused with a boost; and the one leg that is there."""
    k = _bm25(spark, sf_dir, 20)
    other = tx.coordination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 20)
    both = tx.hybrid(k, other, "hybrid_rrf", "item_id", "doc_id", 10, F.col("doc_id") % 10 == 0)
    one = tx.hybrid(k, None, "hybrid_rrf", "item_id", "doc_id", 10)
    part = lambda df, mode: df.select(F.lit(mode).alias("mode"), "item_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))
    return part(both, "hybrid_rrf").unionByName(part(one, "fallback"))


@query(f"""WITH {_DENSE}, top AS (SELECT query_id, vec_id, rank FROM dr WHERE rank <= 10), gold AS (SELECT query_id, vec_id FROM dr WHERE rank IN (1, 4, 15)), p AS (SELECT g.query_id, t.rank FROM gold g LEFT JOIN top t USING (query_id, vec_id))
 SELECT query_id, round(count(rank) / 3e0, 6) AS recall, round(coalesce(1e0 / min(rank), 0), 6) AS mrr, round(coalesce(sum(1 / log2(rank + 1)) / (1 + 1 / log2(3) + 1 / log2(4)), 0), 6) AS ndcg FROM p GROUP BY query_id""")
def rev01_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scratch.cut(_dense(spark, sf_dir, 15))  # read as ranking and as gold
    return rounded(tx.ranking_metrics(r.where("rank <= 10"), r.where("rank in (1, 4, 15)"), "query_id", "vec_id", 10))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    n = g.nodes([("region", t("region"), "r_regionkey", "r_name"), ("nation", t("nation"), "n_nationkey", "n_name"), ("customer", t("customer").where("c_custkey % 10 <> 0"), "c_custkey", "c_name")])
    e = g.edges([
        ("in_region", t("nation"), "nation", F.col("n_nationkey"), "region", F.col("n_regionkey")),
        ("lives_in", t("customer"), "customer", F.col("c_custkey"), "nation", F.col("c_nationkey")),
    ])
    return n, e


def _sql_id(kind: str, key: str) -> str:
    return f"sha256('{len(kind)}:{kind};' || length(CAST({key} AS VARCHAR)) || ':' || CAST({key} AS VARCHAR) || ';')"


_GRAPH = f"""n AS (SELECT 'region' AS node_type, {_sql_id('region', 'r_regionkey')} AS node_id, CAST(r_name AS VARCHAR) AS label FROM region UNION ALL SELECT 'nation', {_sql_id('nation', 'n_nationkey')}, n_name FROM nation
 UNION ALL SELECT 'customer', {_sql_id('customer', 'c_custkey')}, c_name FROM customer WHERE c_custkey % 10 <> 0),
 e AS (SELECT 'in_region' AS edge_type, {_sql_id('nation', 'n_nationkey')} AS src, {_sql_id('region', 'n_regionkey')} AS dst FROM nation UNION ALL SELECT 'lives_in', {_sql_id('customer', 'c_custkey')}, {_sql_id('nation', 'c_nationkey')} FROM customer)"""


@query(f"""WITH {_GRAPH} SELECT 'node' AS kind, node_type AS type, node_id AS id, label AS info FROM n UNION ALL
 SELECT CASE WHEN src IN (SELECT node_id FROM n) THEN 'edge' ELSE 'rejected' END, edge_type, src || dst, CASE WHEN src IN (SELECT node_id FROM n) THEN '' ELSE 'src_missing' END FROM e""")
def kgr01_04_graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    good, bad = g.split_dangling(e, n)
    part = lambda d, kind, info: d.select(F.lit(kind).alias("kind"), F.col("edge_type").alias("type"), F.concat("src", "dst").alias("id"), info.alias("info"))
    out = n.select(F.lit("node").alias("kind"), F.col("node_type").alias("type"), F.col("node_id").alias("id"), F.col("label").alias("info"))
    return out.unionByName(part(good, "edge", F.lit(""))).unionByName(part(bad, "rejected", F.col("reason")))


@query(f"""WITH {_GRAPH}, s AS (SELECT node_id, label FROM n WHERE node_type = 'nation' AND length(label) > 0 AND label IN (SELECT n_name FROM nation WHERE n_nationkey < 4)) SELECT s.label AS start, 'out' AS direction, o.label FROM s JOIN e ON e.src = s.node_id JOIN n o ON o.node_id = e.dst
 UNION ALL SELECT s.label, 'in', o.label FROM s JOIN e ON e.dst = s.node_id JOIN n o ON o.node_id = e.src""")
def kgq01_04_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    s = n.where("node_type = 'nation' and cast(key as int) < 4")
    hop = g.neighbours(e, n, s)
    return hop.join(s.select(F.col("node_id").alias("start"), F.col("label").alias("name")), "start").select(F.col("name").alias("start"), "direction", "label")


_FACTS = "f AS (SELECT event_id, user_id AS entity, event_type AS concept, ts AS accepted, CAST(round(value / 25) AS BIGINT) AS value FROM events)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.col("user_id").alias("entity"), F.col("event_type").alias("concept"), F.col("ts").alias("accepted"), F.round(F.col("value") / 25).cast("long").alias("value"))


@query(f"""WITH {_FACTS}, p AS (SELECT event_id AS newer, value, lag(event_id) OVER w AS older, lag(value) OVER w AS before FROM f WINDOW w AS (PARTITION BY entity, concept ORDER BY accepted, event_id))
 SELECT newer, older FROM p WHERE older IS NOT NULL AND value <> before""")
def kgr03_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.supersession(_facts(spark, sf_dir), ["entity", "concept"], ["accepted", "event_id"], "event_id", "value")


@query(f"""WITH {_FACTS}, k AS (SELECT * FROM f WHERE accepted <= (SELECT min(ts) + INTERVAL 10 DAY FROM events)), r AS (SELECT *, row_number() OVER (PARTITION BY entity, concept ORDER BY accepted DESC, event_id DESC) AS n FROM k)
 SELECT r.entity, r.concept, r.event_id, r.value, a.versions, a.restated FROM r JOIN (SELECT entity, concept, count(*) AS versions, count(DISTINCT value) > 1 AS restated FROM k GROUP BY ALL) a USING (entity, concept) WHERE n = 1""")
def kgq02_03_latest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    limit = f.agg((F.min("accepted") + F.expr("INTERVAL 10 DAYS")).alias("_limit"))
    known = f.join(F.broadcast(limit)).where("accepted <= _limit").drop("_limit")  # one row
    out = g.latest_facts(known, ["entity", "concept"], ["accepted", "event_id"])
    return out.select("entity", "concept", "event_id", "value", "versions", "restated")


_LOG = """log AS (SELECT event_id, user_id AS entity, event_type AS attribute, CAST(round(value) AS BIGINT) AS value, ts - INTERVAL 5 DAY AS valid_from, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 9 DAY END AS valid_to, ts AS recorded_at,
 CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 1 DAY END AS public_at, CASE WHEN event_id % 2 = 0 THEN lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END AS supersedes FROM events), t AS (SELECT min(ts) + INTERVAL 20 DAY AS k, min(ts) + INTERVAL 16 DAY AS b FROM events)"""


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, F.Column, F.Column]:
    e = events(spark, sf_dir)
    n, ts = F.col("event_id"), F.col("ts")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    days = lambda k: F.expr(f"INTERVAL {k} DAYS")
    log = e.select(
        "event_id", F.col("user_id").alias("entity"), F.col("event_type").alias("attribute"), F.round("value").cast("long").alias("value"), (ts - days(5)).alias("valid_from"),
        F.when(n % 3 == 0, ts + days(9)).alias("valid_to"), ts.alias("recorded_at"), F.when(n % 4 != 0, ts + days(1)).alias("public_at"), F.when(n % 2 == 0, F.lag("event_id").over(w)).alias("supersedes"),
    )
    first = e.agg(F.min("ts").alias("t")).first().t
    import datetime

    return log, F.lit(first + datetime.timedelta(days=16)), F.lit(first + datetime.timedelta(days=20))


@query(f"""WITH {_LOG}, i AS (SELECT l.*, (SELECT min(o.recorded_at) FROM log o WHERE o.supersedes = l.event_id) AS system_to FROM log l), s AS (SELECT i.* FROM i, t WHERE recorded_at <= k AND (system_to IS NULL OR k < system_to) AND valid_from <= b AND (valid_to IS NULL OR b < valid_to)),
 r AS (SELECT *, row_number() OVER (PARTITION BY entity, attribute ORDER BY valid_from DESC, recorded_at DESC, event_id DESC) AS n FROM s) SELECT entity, attribute, value, event_id FROM r WHERE n = 1""")
def bit01_02_system_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, business, knowledge = _log(spark, sf_dir)
    return g.resolve(log, business, knowledge, "system_replay")


@query(f"""WITH RECURSIVE {_LOG}, e AS (SELECT log.* FROM log, t WHERE public_at <= k AND recorded_at <= k), gone(id) AS (SELECT supersedes FROM e WHERE supersedes IS NOT NULL UNION SELECT l.supersedes FROM gone JOIN log l ON l.event_id = gone.id WHERE l.supersedes IS NOT NULL),
 s AS (SELECT e.* FROM e, t WHERE event_id NOT IN (SELECT id FROM gone) AND valid_from <= b AND (valid_to IS NULL OR b < valid_to)), r AS (SELECT *, row_number() OVER (PARTITION BY entity, attribute ORDER BY public_at DESC, valid_from DESC, recorded_at DESC, event_id DESC) AS n FROM s)
 SELECT entity, attribute, value, event_id FROM r WHERE n = 1""")
def bit02_public_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, business, knowledge = _log(spark, sf_dir)
    return g.resolve(log, business, knowledge, "public_as_of")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, ts DESC, event_type) AS n FROM events) SELECT user_id, event_type, event_id FROM r WHERE n = 1""")
def bit03_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.reconcile(events(spark, sf_dir), ["user_id"], "event_type", ["purchase", "signup"], "ts").select("user_id", "event_type", "event_id")


@query("""WITH a AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS s, count(DISTINCT CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END) AS p FROM orders GROUP BY 1)
 SELECT o_custkey, n, concat_ws(',', CASE WHEN s > 1 THEN 'conflict_o_orderstatus' END, CASE WHEN p = 0 THEN 'missing_urgent' END) AS issues FROM a WHERE s > 1 OR p = 0""")
def bit05_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("urgent", F.when(F.col("o_orderpriority").like("1%"), "urgent"))
    return g.conflicts(o, "o_custkey", ["o_orderstatus", "urgent"])


@query("""WITH i AS (SELECT event_id, user_id, CAST(ts AS DATE) AS s, CAST(ts AS DATE) + CAST(event_id % 4 AS INTEGER) AS e FROM events WHERE event_type = 'signup'),
 o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT DISTINCT user_id, s, e FROM i))
 SELECT user_id, CAST(s AS VARCHAR) AS s, CAST(e AS VARCHAR) AS e FROM o WHERE s < m""")
def bit06_07_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = events(spark, sf_dir).where("event_type = 'signup'").select("user_id", F.to_date("ts").alias("s"), F.date_add(F.to_date("ts"), (F.col("event_id") % 4).cast("int")).alias("e")).distinct()
    return g.overlaps(i, "user_id", "s", "e").select("user_id", F.col("s").cast("string").alias("s"), F.col("e").cast("string").alias("e"))


@query("""WITH c AS (SELECT source AS ticker, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY 1), m AS (SELECT DISTINCT source AS ticker, CAST(substr(source, 4) AS BIGINT) % 6 AS cik FROM documents), j AS (SELECT m.*, coalesce(c.n, 0) AS n_chunks FROM m LEFT JOIN c USING (ticker))
 SELECT ticker, cik, n_chunks, first_value(ticker) OVER (PARTITION BY cik ORDER BY n_chunks DESC, ticker) AS canonical FROM j""")
def cov01_idn01_canonical_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    counts = d.where("lang <> 'en'").groupBy(F.col("source").alias("ticker")).agg(F.count("*").alias("n_chunks"))
    mapping = d.select(F.col("source").alias("ticker"), (F.substring("source", 4, 10).cast("long") % 6).alias("cik")).distinct()
    return g.canonical_ticker(mapping, counts).select("ticker", "cik", "n_chunks", "canonical")


@query("""SELECT c_custkey, sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment)) AS dedup_hash, sha256(length(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey || ';' || length(c_name) || ':' || c_name || ';') AS node_id, md5(c_name) AS content_key, sha256(c_custkey || '||' || c_name || '||') AS record_key,
 lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, replace(upper(trim(lower(c_name))), '#', '-') AS ticker FROM customer""")
def idn02_05_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", m.dedup_hash(k, n, F.col("c_mktsegment")).alias("dedup_hash"), m.canonical_id(k, n).alias("node_id"), F.md5(n).alias("content_key"), idn.record_key(k, n, F.lit(None)).alias("record_key"),
        idn.padded_cik(k).alias("cik"), idn.normal_ticker(F.lower(n)).alias("ticker"),
    )


def _nth(month: int, weekday: int, n: int) -> str:
    """SQL for the n-th weekday (1: Monday) of a month of year y."""
    first = f"make_date(y, {month}, 1)"
    return f"{first} + CAST(({weekday} - isodow({first}) + 7) % 7 + {7 * (n - 1)} AS INTEGER)"


def _observed(day: str) -> str:
    return f"CASE isodow({day}) WHEN 6 THEN {day} - 1 WHEN 7 THEN {day} + 1 ELSE {day} END"


_SESSIONS = f"""ys AS (SELECT CAST(unnest(range((SELECT min(year(ts)) FROM events), (SELECT max(year(ts)) + 2 FROM events))) AS INTEGER) AS y),
 e1 AS (SELECT y, (19 * (y % 19) + y // 100 - y // 400 - (y // 100 - (y // 100 + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM ys), e2 AS (SELECT y, h, (32 + 2 * (y // 100 % 4) + 2 * (y % 100 // 4) - h - y % 100 % 4) % 7 AS l FROM e1), e3 AS (SELECT y, h + l - 7 * ((y % 19 + 11 * h + 22 * l) // 451) + 114 AS e FROM e2),
 closed AS (SELECT {_nth(1, 1, 3)} AS day FROM ys UNION SELECT {_nth(2, 1, 3)} FROM ys UNION SELECT make_date(y, CAST(e // 31 AS INTEGER), CAST(e % 31 + 1 AS INTEGER)) - 2 FROM e3 UNION SELECT make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) FROM ys
 UNION SELECT {_observed('make_date(y, 6, 19)')} FROM ys WHERE y >= 2022 UNION SELECT {_observed('make_date(y, 7, 4)')} FROM ys UNION SELECT {_nth(9, 1, 1)} FROM ys UNION SELECT {_nth(11, 4, 4)} FROM ys UNION SELECT {_observed('make_date(y, 12, 25)')} FROM ys
 UNION SELECT {_observed('make_date(y, 1, 1)')} FROM ys WHERE isodow(make_date(y, 1, 1)) <> 6), early AS (SELECT {_nth(11, 4, 4)} + 1 AS day FROM ys UNION SELECT make_date(y, 7, 3) FROM ys UNION SELECT make_date(y, 12, 24) FROM ys),
 sessions AS (SELECT day, timezone('UTC', timezone('America/New_York', day + INTERVAL 570 MINUTE)) AS open_ts, timezone('UTC', timezone('America/New_York', day + CASE WHEN day IN (SELECT day FROM early) THEN INTERVAL 780 MINUTE ELSE INTERVAL 960 MINUTE END)) AS close_ts
 FROM (SELECT CAST(unnest(generate_series((SELECT make_date(min(y), 1, 1) FROM ys), (SELECT make_date(max(y), 12, 31) FROM ys), INTERVAL 1 DAY)) AS DATE) AS day) WHERE isodow(day) <= 5 AND day NOT IN (SELECT day FROM closed))"""


def _sessions(spark: SparkSession, e: DataFrame) -> DataFrame:
    first, last = e.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    return cal.sessions(spark, first.year, last.year + 1)


@query(f"""WITH {_SESSIONS} SELECT CAST(d.day AS VARCHAR) AS day, s.day IS NOT NULL AS trading, isodow(d.day) <= 5 AS weekday FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d LEFT JOIN sessions s USING (day)""")
def cal02_04_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    open_days = _sessions(spark, e).select("day", F.lit(True).alias("trading"))
    d = e.select(F.to_date("ts").alias("day")).distinct().join(open_days, "day", "left")
    return d.select(F.col("day").cast("string").alias("day"), F.coalesce("trading", F.lit(False)).alias("trading"), cal.weekday(F.col("day")).alias("weekday"))


@query(f"""WITH {_SESSIONS}, p AS (SELECT e.event_id, e.ts, s.close_ts FROM events e ASOF LEFT JOIN sessions s ON e.ts >= s.close_ts), n AS (SELECT e.event_id, s.open_ts FROM events e ASOF LEFT JOIN sessions s ON e.ts < s.open_ts)
 SELECT p.event_id, epoch_us(p.close_ts) AS previous_close, epoch_us(n.open_ts) AS next_open FROM p JOIN n USING (event_id)""")
def cal01_03_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    out = cal.next_open(e.select("event_id", "ts"), _sessions(spark, e), "ts")
    return out.select("event_id", F.unix_micros("previous_close").alias("previous_close"), F.unix_micros("next_open").alias("next_open"))
