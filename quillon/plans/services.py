"""Queries for retrieval services and closed-market liquidity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.operators import perpetuals as pp, retrieval as rt
from quillon.plans.base import BARS, bars, events, rounded, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {BARS}, l AS (SELECT *, timezone('America/New_York', timezone('UTC', event_ts)) AS t FROM bars), m AS (SELECT *, extract(hour FROM t) * 60 + extract(minute FROM t) AS mi, dayofweek(t) AS d FROM l),
 w AS (SELECT *, (d = 5 AND mi >= 960) OR d IN (6, 0) OR (d = 1 AND mi < 570) AS weekend, CAST(t AS DATE) - CAST((d + 2) % 7 AS INTEGER) AS fri FROM m)
 SELECT symbol % 10 AS bucket, weekend, count(*) AS n_bars, count(*) FILTER (WHERE volume > 0) AS n_traded, sum(volume) AS volume, round(avg((high - low) / nullif(close, 0)), 6) AS mean_range, count(DISTINCT CASE WHEN weekend THEN fri END) AS n_weekends FROM w GROUP BY 1, 2""")
def agg22_cal05_closed_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pp.closed_liquidity(bars(spark, sf_dir).withColumn("bucket", F.col("symbol") % 10), "event_ts", "bucket"))


@query(f"""WITH {BARS}, l AS (SELECT symbol, timezone('America/New_York', timezone('UTC', event_ts)) AS t FROM bars), m AS (SELECT *, extract(hour FROM t) * 60 + extract(minute FROM t) AS mi, dayofweek(t) AS d FROM l),
 w AS (SELECT symbol, count(DISTINCT CAST(t AS DATE) - CAST((d + 2) % 7 AS INTEGER)) AS n FROM m WHERE (d = 5 AND mi >= 960) OR d IN (6, 0) OR (d = 1 AND mi < 570) GROUP BY symbol)
 SELECT symbol, n AS n_weekends, round(CASE WHEN n > 3 THEN tanh((1.959963984540054e0 + 0.8416212335729143e0) / sqrt(n - 3)) END, 6) AS detectable FROM w""")
def cal06_weekend_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pp.weekend_power(bars(spark, sf_dir), "event_ts", "symbol"))


@query("""SELECT conv_id, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS section_text, CAST(count(*) AS INTEGER) AS n_chunks FROM conversations GROUP BY conv_id, role""")
def txt07_09_section_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.section_rollup(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn", "text")


@query("""WITH i AS (SELECT doc_id, quality = 1 AS answerable, toxic = 1 AS answered, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS recall FROM labels), o AS (SELECT *, CASE WHEN answerable AND answered AND recall > 0 THEN 'hit' WHEN answerable AND answered THEN 'miss' WHEN answerable THEN 'wrong_abstention' WHEN answered THEN 'wrong_answer' ELSE 'right_abstention' END AS outcome FROM i)
 SELECT 'all' AS stratum, count(*) AS n, round(avg(recall), 6) AS recall FROM o UNION ALL SELECT 'outcome=' || outcome, count(*), round(avg(recall), 6) FROM o GROUP BY outcome""")
def rev02_stratified_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 1).alias("answered"), F.when(F.col("doc_id") % 3 == 0, 0.0).otherwise(1.0).alias("recall"))
    return rounded(rt.stratified(rt.score_items(i, "answered", "answerable", "recall"), ["outcome"], ["recall"]))


@query("""WITH k AS (SELECT * FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 15 DAY FROM events)) SELECT event_type, count(*) AS n, CAST(0 AS BIGINT) AS leaked FROM k GROUP BY event_type""")
def flt10_rev04_known_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.text import leakage

    e = events(spark, sf_dir)
    limit = e.agg((F.min("ts") + F.expr("INTERVAL 15 DAYS")).alias("as_of"))
    known = rt.known_at(e.join(F.broadcast(limit)), "ts", F.col("as_of"))  # limit: one row
    return known.groupBy("event_type").agg(F.count("*").alias("n"), leakage(known, "ts", "as_of").alias("leaked"))


@query("""WITH f AS (SELECT user_id, event_type, count(DISTINCT event_id % 2) AS n, max(event_id % 2) AS v FROM events GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS k FROM f WHERE n = 1)
 SELECT user_id, event_type, v FROM s WHERE k <= 5""")
def kgq05_propose_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = events(spark, sf_dir).withColumn("v", F.col("event_id") % 2)
    return rt.propose_questions(f, ["user_id"], "event_type", "v", 5).select("user_id", "event_type", "v")


@query("""SELECT doc_id, 'len2' AS model, CAST(length(text) AS DOUBLE) AS a FROM documents WHERE doc_id % 3 <> 0""")
def emb01_incremental_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upkeep of vectors, with a stand-in model."""
    d = table(spark, sf_dir, "documents")
    stored = d.where("doc_id % 3 = 0").select("doc_id", F.lit("len2").alias("model"))
    out = rt.embed_new(d, stored, "doc_id", "text", lambda texts: [[float(len(t)), 1.0] for t in texts], "len2")
    return out.select("doc_id", "model", F.col("vector")[0].cast("double").alias("a"))
