"""Queries for signals and outcomes, pair back-tests, interval joins, links and publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.functions import market as m
from quillon.operators import adjust, asof, outcomes as o, publication as p, relational as r, windows
from quillon.plans.base import DAILY, daily, events, rounded, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_W = "PARTITION BY symbol ORDER BY day"


def _days(df: DataFrame, *columns, digits: int = 6) -> DataFrame:
    return rounded(df.select("symbol", F.col("day").cast("string").alias("day"), *columns), digits)


@query(f"""WITH {DAILY}, s AS (SELECT symbol, day, CASE WHEN volume > 100 THEN 0.7e0 ELSE 0.3e0 END AS p, lead(close) OVER ({_W}) / nullif(close, 0) - 1 AS r FROM daily),
 b AS (SELECT *, CASE WHEN p >= 0.5 THEN 1e0 ELSE -1e0 END AS pos FROM s), t AS (SELECT *, abs(pos - coalesce(lag(pos) OVER ({_W}), pos)) / 2 AS turnover FROM b)
 SELECT symbol, CAST(day AS VARCHAR) AS day, pos AS position, turnover, round(pos * r, 6) AS gross_return, round(pos * r - turnover * 5 / 1e4, 6) AS net_return FROM t""")
def eva03_sco01_signal_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    s = daily(spark, sf_dir).withColumns({"p": F.when(F.col("volume") > 100, 0.7).otherwise(0.3), "r": m.safe_ratio(F.lead("close").over(w), F.col("close")) - 1})
    return _days(o.signal_backtest(s, "symbol", "day", "p", "r", 5.0), "position", "turnover", "gross_return", "net_return")


@query(f"""WITH {DAILY}, b AS (SELECT symbol, day, volume > 100 AS pos FROM daily), c AS (SELECT *, CASE WHEN lag(pos) OVER ({_W}) = pos THEN 0 ELSE 1 END AS c FROM b)
 SELECT symbol, CAST(sum(c) AS BIGINT) AS n_runs, round(count(*) / CAST(sum(c) AS DOUBLE), 6) AS mean_run FROM c GROUP BY symbol""")
def eva03_holding_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = daily(spark, sf_dir).withColumn("pos", F.col("volume") > 100)
    return rounded(o.holding_runs(b, "symbol", "day", "pos"))


@query(f"""WITH {DAILY}, r AS (SELECT *, close / nullif(lag(close) OVER ({_W}), 0) - 1 AS y FROM daily), k AS (SELECT * FROM r WHERE y IS NOT NULL) SELECT symbol, CAST(day AS VARCHAR) AS day,
 round(CASE WHEN count(y) OVER a = 5 THEN stddev_samp(y) OVER a END, 6) AS sigma5, round(CASE WHEN count(y) OVER b >= 8 THEN stddev_samp(y) OVER b END, 6) AS sigma20 FROM k WINDOW a AS ({_W} ROWS 4 PRECEDING), b AS ({_W} ROWS 19 PRECEDING)""")
def out01_frozen_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    c = daily(spark, sf_dir).withColumns({"trade_date": F.col("day"), "return_1d": m.safe_ratio(F.col("close"), F.lag("close").over(w)) - 1})
    return _days(o.frozen_sigma(c, 5, 20, 8), "sigma5", "sigma20")


@query(f"""WITH {DAILY}, e AS (SELECT symbol, day, lead(day, 2) OVER ({_W}) AS stop FROM daily), x AS (SELECT DISTINCT symbol, day AS ex_date FROM daily WHERE (symbol + dayofyear(day)) % 6 = 0)
 SELECT symbol, CAST(day AS VARCHAR) AS day, EXISTS (SELECT 1 FROM x WHERE x.symbol = e.symbol AND x.ex_date > e.day AND x.ex_date <= e.stop) AS masked FROM e""")
def jon17_out01_dividend_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    e = d.select("symbol", "day", F.lead("day", 2).over(Window.partitionBy("symbol").orderBy("day")).alias("stop"))
    x = d.where((F.col("symbol") + F.dayofyear("day")) % 6 == 0).select("symbol", F.col("day").alias("ex_date"))
    return _days(o.dividend_mask(e, x, "symbol", "day", "stop"), "masked")


@query(f"""WITH {DAILY}, t AS (SELECT symbol, day, lead(day) OVER ({_W}) AS outcome_ts, close AS entry_close, lead(close) OVER ({_W}) AS outcome_close, symbol % 5 = 0 AS masked, CASE WHEN symbol % 7 <> 0 THEN symbol % 3 END AS sigma, CASE WHEN volume > 60 THEN 'UP' END AS direction FROM daily)
 SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN outcome_ts > (SELECT min(day) + 20 FROM daily) THEN 'outcome_pending' WHEN outcome_ts IS NULL OR outcome_close IS NULL THEN 'missing_return' WHEN masked THEN 'ex_dividend_masked'
 WHEN sigma IS NULL THEN 'insufficient_sigma_history' WHEN sigma = 0 THEN 'missing_sigma' WHEN direction IS NULL THEN 'missing_direction' ELSE 'eligible' END AS eligibility FROM t""")
def out01_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    d, s = daily(spark, sf_dir), F.col("symbol")
    sigma = F.when(s % 7 != 0, s % 3)
    t = d.select(
        "symbol", "day", F.col("day").alias("entry_date"), F.lead("day").over(w).alias("outcome_ts"), F.col("close").alias("entry_close"), F.lead("close").over(w).alias("outcome_close"),
        (s % 5 == 0).alias("masked"), sigma.alias("sigma20"), sigma.alias("sigma_used"), F.when(F.col("volume") > 60, "UP").alias("direction"),
    )
    limit = d.agg(F.date_add(F.min("day"), 20).alias("_limit"))
    return _days(t.join(F.broadcast(limit)).withColumn("eligibility", o.eligibility(F.col("_limit"))), "eligibility")  # limit: one row


@query(f"""WITH {DAILY}, p AS (SELECT symbol, day, open AS a, low AS b, CASE WHEN volume > 100 THEN 1e0 ELSE -0.5e0 END AS wa, CASE WHEN volume > 100 THEN -1e0 ELSE 0.5e0 END AS wb FROM daily),
 x AS (SELECT *, a / nullif(lag(a) OVER w, 0) - 1 AS ra, b / nullif(lag(b) OVER w, 0) - 1 AS rb, coalesce(lag(wa) OVER w, 0) AS xa, coalesce(lag(wb) OVER w, 0) AS xb FROM p WINDOW w AS ({_W})),
 h AS (SELECT *, coalesce(lag(xa) OVER w, 0) AS ha, coalesce(lag(xb) OVER w, 0) AS hb FROM x WINDOW w AS ({_W}))
 SELECT symbol, CAST(day AS VARCHAR) AS day, round(ha * ra + hb * rb, 6) AS gross, round(abs(xa - ha) + abs(xb - hb), 6) AS traded,
 round(ha * ra + hb * rb - (abs(xa - ha) + abs(xb - hb)) * 5 / 1e4 - (greatest(-ha, 0) + greatest(-hb, 0)) * 0.8e0 / 1e4, 6) AS net FROM h WHERE ra IS NOT NULL AND rb IS NOT NULL""")
def rsk09_pair_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("volume") > 100
    d = daily(spark, sf_dir).select("symbol", "day", F.col("open").alias("open_a"), F.col("low").alias("open_b"), F.when(big, 1.0).otherwise(-0.5).alias("w_a"), F.when(big, -1.0).otherwise(0.5).alias("w_b"))
    return _days(o.pair_backtest(d, "symbol", "day", 5.0, 0.8), "gross", "traded", "net")


@query(f"""WITH {DAILY} SELECT symbol, CAST(day AS VARCHAR) AS day, round(close - lag(close, 7) OVER ({_W}), 6) AS change, round(CASE WHEN count(*) OVER w = 8 THEN avg(close) OVER w END, 6) AS mean, round(CASE WHEN count(*) OVER w = 8 THEN stddev_samp(close) OVER w END, 6) AS sd
 FROM daily WINDOW w AS ({_W} ROWS 7 PRECEDING)""")
def win17_window_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(o.change_from_window(daily(spark, sf_dir), "symbol", "day", "close", 8), "change", "mean", "sd")


@query(f"""WITH {DAILY}, z AS (SELECT symbol, day, CASE WHEN count(*) OVER w = 8 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END AS a, CASE WHEN count(*) OVER w = 8 THEN (volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0) END AS b
 FROM daily WINDOW w AS ({_W} ROWS 7 PRECEDING)) SELECT symbol, CAST(day AS VARCHAR) AS day, round((a + b) / 2, 5) AS score, CASE WHEN a IS NULL THEN NULL WHEN a > 0.5 THEN 'risk_on' WHEN a < -0.5 THEN 'risk_off' ELSE 'neutral' END AS label FROM z""")
def win19_crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = o.window_zscore(daily(spark, sf_dir), "symbol", "day", "close", 8, "a")
    d = o.window_zscore(d, "symbol", "day", "volume", 8, "b")
    score, label = o.crowding(F.col("a"), F.col("b"))
    return _days(d, F.round(score, 5).alias("score"), label.alias("label"))


@query(f"""WITH {DAILY}, q AS (SELECT symbol, day, lag(close) OVER ({_W}) / nullif(close, 0) AS ratio FROM daily), w AS (SELECT *, 1 / nullif(ratio, 0) AS inv, round(greatest(ratio, 1 / nullif(ratio, 0))) AS whole FROM q)
 SELECT symbol, CAST(day AS VARCHAR) AS day, round(CASE WHEN ratio > 1 THEN whole ELSE 1 / whole END, 6) AS suspected FROM w WHERE whole BETWEEN 2 AND 20 AND abs(greatest(ratio, inv) / whole - 1) <= 0.03""")
def win30_suspected_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(adjust.suspected_splits(daily(spark, sf_dir)), "suspected")


@query(f"""WITH {DAILY} SELECT symbol, CAST(day AS VARCHAR) AS day, round(open / nullif(lag(close) OVER w, 0), 6) AS overnight, round(lag(close) OVER w, 6) AS previous_close, CAST(lag(day) OVER w AS VARCHAR) AS previous_day,
 CAST(min(day) OVER (PARTITION BY symbol) AS VARCHAR) AS first_day, CAST(max(day) OVER (PARTITION BY symbol) AS VARCHAR) AS last_day FROM daily WINDOW w AS ({_W})""")
def win16_26_overnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, all_ = Window.partitionBy("symbol").orderBy("day"), Window.partitionBy("symbol")
    d = daily(spark, sf_dir)
    return _days(
        d, m.safe_ratio(F.col("open"), F.lag("close").over(w)).alias("overnight"), F.lag("close").over(w).alias("previous_close"), F.lag("day").over(w).cast("string").alias("previous_day"),
        F.min("day").over(all_).cast("string").alias("first_day"), F.max("day").over(all_).cast("string").alias("last_day"),
    )


@query("""WITH k AS (SELECT * FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 12 DAY FROM events)) SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM k) WHERE n = 1""")
def win29_latest_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    limit = e.agg((F.min("ts") + F.expr("INTERVAL 12 DAYS")).alias("_limit"))
    known = e.join(F.broadcast(limit)).where("ts <= _limit")  # one row
    return windows.latest(known, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("""WITH i AS (SELECT user_id, event_id AS interval_id, ts AS s, CASE WHEN event_id % 4 <> 0 THEN ts + to_days(CAST(event_id % 5 AS INTEGER)) END AS e FROM events WHERE event_type = 'signup')
 SELECT v.event_id, i.interval_id FROM events v JOIN i ON i.user_id = v.user_id AND v.ts >= i.s AND (i.e IS NULL OR v.ts < i.e) WHERE v.event_type = 'purchase'""")
def jon15_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    stop = F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.make_dt_interval((F.col("event_id") % 5).cast("int")))
    i = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("interval_id"), F.col("ts").alias("s"), stop.alias("e"))
    return asof.interval_join(e.where("event_type = 'purchase'"), i, ["user_id"], "ts", "s", "e", "inner").select("event_id", "interval_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def jon14_either_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")  # noqa: E741
    n = table(spark, sf_dir, "part").where("p_size = 7").select("p_partkey")
    return r.either_end(l, n, "l_partkey", "l_suppkey", "p_partkey").select("l_orderkey", "l_linenumber")


_FACTS = """f AS (SELECT event_id AS fact_id, user_id AS company, event_type AS metric, CAST(CAST(ts AS DATE) AS VARCHAR) AS period, event_id % 2 AS unit, CAST(event_id % 3 AS VARCHAR) AS dimensions, round(value, 0) AS value FROM events),
 c AS (SELECT event_id AS assertion, CASE WHEN user_id % 9 = 0 THEN -user_id ELSE user_id END AS company, event_type AS metric, CAST(CAST(ts AS DATE) AS VARCHAR) AS period, event_id % 4 % 3 AS unit, CAST(event_id % 7 % 3 AS VARCHAR) AS dimensions, round(value, 0) + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS value FROM events)"""


@query(f"""WITH {_FACTS}, j AS (SELECT f.fact_id, c.company IS NOT NULL AS k0, c.metric = f.metric AS k1, c.metric = f.metric AND c.period = f.period AS k2, c.metric = f.metric AND c.period = f.period AND c.unit = f.unit AS k3, c.dimensions AS d, f.dimensions AS fd, c.value = f.value AS v, c.assertion FROM f LEFT JOIN c ON c.company = f.company),
 a AS (SELECT fact_id, count(*) FILTER (WHERE k0) AS n0, count(*) FILTER (WHERE k1) AS n1, count(*) FILTER (WHERE k2) AS n2, count(*) FILTER (WHERE k3) AS n3, count(DISTINCT CASE WHEN k3 THEN d END) AS nd, count(*) FILTER (WHERE k3 AND d = fd) AS n4, count(*) FILTER (WHERE k3 AND d = fd AND v) AS n5,
 min(CASE WHEN k3 AND d = fd AND v THEN assertion END) AS found FROM j GROUP BY fact_id)
 SELECT fact_id, CASE WHEN n0 = 0 THEN 'cross_issuer' WHEN n1 = 0 THEN 'metric_mismatch' WHEN n2 = 0 THEN 'period_mismatch' WHEN n3 = 0 THEN 'unit_incompatible' WHEN nd > 1 THEN 'unknown_dimensions' WHEN n4 = 0 THEN 'dimensions_mismatch' WHEN n5 = 0 THEN 'value_mismatch' WHEN n5 > 1 THEN 'ambiguous' ELSE 'linked' END AS status,
 CASE WHEN n0 > 0 AND n1 > 0 AND n2 > 0 AND n3 > 0 AND nd <= 1 AND n4 > 0 AND n5 = 1 THEN found END AS assertion FROM a""")
def bit04_link_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a fact and, somewhat changed, as a candidate."""
    n, u, value = F.col("event_id"), F.col("user_id"), F.round("value", 0)
    e = events(spark, sf_dir).withColumn("period", F.to_date("ts").cast("string"))
    facts = e.select(n.alias("fact_id"), u.alias("company"), F.col("event_type").alias("metric"), "period", (n % 2).alias("unit"), (n % 3).cast("string").alias("dimensions"), value.alias("value"))
    cands = e.select(
        n.alias("assertion"), F.when(u % 9 == 0, -u).otherwise(u).alias("company"), F.col("event_type").alias("metric"), "period", (n % 4 % 3).alias("unit"),
        (n % 7 % 3).cast("string").alias("dimensions"), (value + F.when(n % 5 == 0, 1).otherwise(0)).alias("value"),
    )
    return p.link_facts(facts, cands)


@query("""WITH RECURSIVE a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 <> 0 THEN c_custkey - 1 END AS alias_of FROM customer), e(id, target, n) AS (SELECT id, alias_of, 1 FROM a WHERE alias_of IS NOT NULL UNION ALL SELECT e.id, a.alias_of, n + 1 FROM e JOIN a ON a.id = e.target WHERE a.alias_of IS NOT NULL)
 SELECT id, arg_max(target, n) AS target, FALSE AS cyclic FROM e GROUP BY id""")
def bit09_alias_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    a = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 17 != 0, k - 1).alias("alias_of"))
    return p.alias_targets(a)


@query("""SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE user_id % 4 <> 0 UNION ALL SELECT event_id, user_id, round(value * 2, 6) FROM events WHERE user_id % 4 = 0""")
def bit10_set05_subset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "value")
    rebuilt = e.withColumn("value", F.col("value") * 2)
    return rounded(p.merge_subset(e, rebuilt, e.where("user_id % 4 = 0"), "user_id"))


@query(r"""WITH n AS (SELECT doc_id, length(text) AS v, list_transform(regexp_extract_all(text, '-?\d[\d,]*(?:\.\d+)?'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)) AS l FROM documents)
 SELECT doc_id, CAST(len(l) AS INTEGER) AS n_numbers, coalesce(len(list_filter(l, lambda x: abs(x - v) <= 0.005 * v OR abs(x * 1e3 - v) <= 0.005 * v OR abs(x * 1e6 - v) <= 0.005 * v)) > 0, FALSE) AS cited FROM n""")
def kgr05_numeric_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("v"), p.numeric_citations(F.col("text")).alias("l"))
    return d.select("doc_id", F.size("l").alias("n_numbers"), p.cited(F.col("v"), F.col("l")).alias("cited"))


@query("""WITH o AS (SELECT *, sha256(length(CAST(user_id AS VARCHAR)) || ':' || user_id || ';' || length(event_type) || ':' || event_type || ';') AS series_key FROM events)
 SELECT series_key, arg_min(event_id, event_id) AS event_id, count(*) AS n_observations FROM o GROUP BY series_key""")
def fct01_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    keyed = e.select(p.fact_keys([F.col("value")], [F.col("user_id"), F.col("event_type")])["series_key"].alias("series_key"), "event_id")
    return p.distinct_observations(keyed, "series_key", [F.col("event_id")])


@query()
def mod01_logistic_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time split, the baseline fitted on the earlier part, and its scores on the later one."""
    w = Window.partitionBy("symbol").orderBy("day")
    d = daily(spark, sf_dir).withColumns({"r": m.safe_ratio(F.col("close"), F.lag("close").over(w)) - 1, "label": (F.lead("close").over(w) > F.col("close")).cast("int")}).where("label is not null")
    parts = o.reference_current(d, "day", 0.2)
    model = o.logistic_baseline(parts.where("side = 'reference'"), ["r", "volume"], "label")
    return _days(o.predict(model, parts.where("side = 'current'"), ["r", "volume"]), "label", "probability")
