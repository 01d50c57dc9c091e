"""Queries for validation, joins, aggregates, sets, DML, change events and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.functions import market as m
from quillon.operators import cdc, quality, relational as r
from quillon.plans.base import BARS, DAILY, bars, daily, events, rounded, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FAULTY = f"""{DAILY}, u AS (SELECT c_custkey AS symbol FROM customer WHERE c_mktsegment <> 'MACHINERY'), f AS (SELECT symbol, day, CASE WHEN dayofyear(day) % 23 <> 0 THEN open END AS open, CASE WHEN dayofyear(day) % 29 <> 0 THEN close END AS close,
 high * 0.97e0 AS high, low * 1.005e0 AS low, CASE WHEN dayofyear(day) % 7 = 0 THEN -volume WHEN dayofyear(day) % 11 <> 0 THEN volume END AS volume FROM daily WHERE symbol IN (SELECT symbol FROM u))"""


@query(f"""WITH {_FAULTY} SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'null_price' WHEN high < greatest(open, close) THEN 'high_below_open_close'
 WHEN low > least(open, close) THEN 'low_above_open_close' WHEN volume < 0 THEN 'negative_volume' ELSE 'valid' END AS reason FROM f""")
def flt01_02_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with missing prices and volumes, and prices on the wrong side, of a universe's symbols."""
    n = F.dayofyear("day")
    d = daily(spark, sf_dir).withColumns(
        {
            "open": F.when(n % 23 != 0, F.col("open")), "close": F.when(n % 29 != 0, F.col("close")), "high": F.col("high") * 0.97, "low": F.col("low") * 1.005,
            "volume": F.when(n % 7 == 0, -F.col("volume")).when(n % 11 != 0, F.col("volume")),
        }
    )
    universe = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("symbol"))
    valid, bad = r.split_valid(d, universe)
    out = valid.withColumn("reason", F.lit("valid")).unionByName(bad)
    return out.select("symbol", F.col("day").cast("string").alias("day"), "reason")


@query("""SELECT event_id, value > 20 AND CAST(ts AS DATE) >= DATE '1995-01-01' AS kept,
 CASE WHEN extract(hour FROM timezone('America/New_York', timezone('UTC', ts))) * 60 + extract(minute FROM timezone('America/New_York', timezone('UTC', ts))) BETWEEN 570 AND 960 THEN TRUE ELSE FALSE END AS regular,
 CAST(CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS ny_day,
 ts < max(ts) OVER (PARTITION BY user_id) - INTERVAL 15 MINUTE AS stale FROM events
 WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def flt03_06_session_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    universe = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    e = r.in_universe(events(spark, sf_dir), universe, "user_id")
    return e.select(
        "event_id",
        ((F.col("value") > 20) & (F.to_date("ts") >= F.lit("1995-01-01").cast("date"))).alias("kept"),
        m.regular_session(F.col("ts")).alias("regular"),
        m.ny_date(F.col("ts")).cast("string").alias("ny_day"),
        r.stale(F.col("ts"), F.max("ts").over(Window.partitionBy("user_id"))).alias("stale"),
    )


@query("""WITH q AS (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_discount END AS bid, CASE WHEN l_linenumber <> 2 THEN l_tax END AS ask FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE upper(l_returnflag) WHEN 'R' THEN 'C' WHEN 'A' THEN 'P' ELSE 'N/A' END AS option_right,
 round((bid + ask) / 2, 6) AS mid, round(ask - bid, 6) AS spread, round((ask - bid) / nullif((bid + ask) / 2, 0), 6) AS spread_pct,
 CASE WHEN bid IS NULL THEN FALSE WHEN ask IS NULL THEN NULL ELSE bid = ask END AS locked, CASE WHEN bid IS NULL OR ask IS NULL THEN FALSE ELSE bid > ask END AS crossed, round(l_quantity * l_extendedprice * 100, 4) AS notional FROM q""")
def flt07_prj01_02_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of which some lack the bid or the ask."""
    bid, ask = F.when(F.col("l_linenumber") != 3, F.col("l_discount")), F.when(F.col("l_linenumber") != 2, F.col("l_tax"))
    flag = F.when(F.col("l_returnflag") == "R", "call").when(F.col("l_returnflag") == "A", "Put").otherwise("n/a")
    return rounded(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            m.option_right(flag, other=True).alias("option_right"),
            ((bid + ask) / 2).alias("mid"),
            (ask - bid).alias("spread"),
            m.safe_ratio(ask - bid, (bid + ask) / 2).alias("spread_pct"),
            r.locked(bid, ask).alias("locked"),
            r.crossed(bid, ask).alias("crossed"),
            F.round(F.col("l_quantity") * F.col("l_extendedprice") * 100, 4).alias("notional"),
        )
    )


_CLASSES = [("brass|copper", "metal"), ("tin|steel", "alloy"), ("nickel", "nickel")]


@query("""SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE '%copper%' THEN 'metal' WHEN lower(p_type) LIKE '%tin%' OR lower(p_type) LIKE '%steel%' THEN 'alloy'
 WHEN lower(p_type) LIKE '%nickel%' THEN 'nickel' ELSE 'other' END AS asset_class, p_type LIKE 'S%' AND p_type NOT LIKE '%TIN' AS small FROM part""")
def flt08_09_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", r.classify(t, _CLASSES, "other").alias("asset_class"), (t.like("S%") & ~t.like("%TIN")).alias("small"))


@query(f"""WITH {BARS}, b AS (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 0 WHEN event_id % 37 = 0 THEN -close ELSE close END AS o, CASE WHEN event_id % 41 = 0 THEN 'NaN'::DOUBLE ELSE high END AS h, close AS c,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE low * (CASE WHEN event_id % 13 = 0 THEN 1.2e0 ELSE 1 END) END AS lo, CASE WHEN event_id % 17 = 0 THEN 'week' WHEN event_id % 43 = 0 THEN ' ' ELSE 'Minute' END AS span,
 CASE WHEN event_id % 19 = 0 THEN -volume WHEN event_id % 47 = 0 THEN NULL ELSE volume END AS vol, vwap, CASE WHEN event_id % 53 = 0 THEN ' ' ELSE CAST(symbol AS VARCHAR) END AS sym, event_id % 59 = 0 AS no_ts, CASE WHEN event_id % 61 = 0 THEN -1 END AS trades, event_id % 67 = 0 AS gone FROM bars),
 f AS (SELECT *, CASE WHEN NOT isnan(h) THEN h END AS hi FROM b), k AS (SELECT *, o IS NOT NULL AND hi IS NOT NULL AND lo IS NOT NULL AND c IS NOT NULL AS four FROM f), l AS (SELECT event_id, CASE WHEN gone THEN ['null_record'] ELSE list_sort(list_filter([
 CASE WHEN trim(sym) = '' THEN 'missing_symbol' END, CASE WHEN no_ts THEN 'invalid_event_ts' END, CASE WHEN trim(span) = '' THEN 'missing_timespan' END, CASE WHEN span = 'week' THEN 'unsupported_timespan' END, CASE WHEN hi IS NULL THEN 'invalid_high' END, CASE WHEN lo IS NULL THEN 'invalid_low' END,
 CASE WHEN four AND hi < lo THEN 'high_below_low' END, CASE WHEN four AND hi < greatest(o, c, lo) THEN 'high_below_components' END, CASE WHEN four AND lo > least(o, c, hi) THEN 'low_above_components' END, CASE WHEN four AND least(o, hi, lo, c) < 0 THEN 'negative_price' END,
 CASE WHEN vol < 0 THEN 'negative_volume' END, CASE WHEN trades < 0 THEN 'negative_trade_count' END, CASE WHEN vwap < lo OR vwap > hi THEN 'vwap_out_of_range' END], lambda x: x IS NOT NULL)) END AS l FROM k)
 SELECT event_id, array_to_string(l, ',') AS reasons, CAST(len(l) AS INTEGER) AS n FROM l""")
def flt12_udf01_reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with every kind of fault, prices of zero (no fault) and records that are missing."""
    n = F.col("event_id")
    b = bars(spark, sf_dir).withColumns(
        {
            "low": F.when(n % 11 != 0, F.col("low") * F.when(n % 13 == 0, 1.2).otherwise(1.0)),
            "open": F.when(n % 31 == 0, 0.0).when(n % 37 == 0, -F.col("close")).otherwise(F.col("close")),
            "high": F.when(n % 41 == 0, float("nan")).otherwise(F.col("high")),
            "timespan": F.when(n % 17 == 0, "week").when(n % 43 == 0, " ").otherwise("Minute"),
            "volume": F.when(n % 19 == 0, -F.col("volume")).when(n % 47 != 0, F.col("volume")),
            "symbol": F.when(n % 53 == 0, " ").otherwise(F.col("symbol").cast("string")),
            "event_ts": F.when(n % 59 != 0, F.col("event_ts")),
            "trade_count": F.when(n % 61 == 0, -1),
            "record": F.when(n % 67 != 0, F.lit("{}")),
        }
    )
    out = b.select("event_id", r.record_reasons(F.col("record")).alias("l"))
    return out.select("event_id", F.array_join("l", ",").alias("reasons"), F.size("l").alias("n"))


@query("""SELECT n_name, r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS n_customers, min(CAST(o_orderdate AS DATE))::VARCHAR AS first_day,
 max(CAST(o_orderdate AS DATE))::VARCHAR AS last_day, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS avg_f, round(sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice ELSE 0 END), 2) AS urgent
 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY n_name, r_name""")
def jon01_02_agg01_09_order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed by customer before any join, so the joins carry a row per customer."""
    o = table(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_orderdate").alias("d0"), F.max("o_orderdate").alias("d1"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("f"), F.count_if(F.col("o_orderstatus") == "F").alias("nf"),
        F.sum(F.when(F.col("o_orderpriority").like("1%"), F.col("o_totalprice")).otherwise(0.0)).alias("urgent"),
    )
    # Spark's own threshold decides on broadcasts here
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = per.join(c, F.col("o_custkey") == F.col("c_custkey")).join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "r_name").agg(
        F.sum("n").alias("n_orders"), F.round(F.sum("total"), 2).alias("total"), F.count("*").alias("n_customers"), F.to_date(F.min("d0")).cast("string").alias("first_day"),
        F.to_date(F.max("d1")).cast("string").alias("last_day"), F.round(F.sum("f") / F.nullif(F.sum("nf"), F.lit(0)), 4).alias("avg_f"), F.round(F.sum("urgent"), 2).alias("urgent"),
    )


@query("""SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without_orders,
 (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders,
 (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events))) AS left_only,
 (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders))) AS right_only,
 (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT o_custkey FROM orders))) AS common""")
def jon03_05_13_anti_semi_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    key = F.col("c_custkey") == F.col("k")
    a = c.join(o, key, "left_anti").agg(F.count("*").alias("without_orders"))
    s = c.join(o, key, "left_semi").agg(F.count("*").alias("with_orders"))
    both = r.orphans(o, events(spark, sf_dir).select(F.col("user_id").alias("k")), ["k"])
    return a.join(s).join(both)  # one row each


@query("""SELECT l_suppkey, round(sum(CASE WHEN n <= 5 THEN l_extendedprice END) / nullif(sum(l_extendedprice), 0), 6) AS share FROM
 (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS n FROM lineitem) GROUP BY l_suppkey""")
def agg03_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.top_share(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 5))


@query("""SELECT l_suppkey, round(sum(l_quantity * l_discount * 100), 4) AS exposure, round(max(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 4) AS r_max, round(max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 4) AS a_max,
 round(max(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END), 4) AS n_max, round(exp(sum(ln(1 + l_discount / 1e3))), 6) AS compounded FROM lineitem GROUP BY l_suppkey""")
def agg04_07_pivot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lambda flag: F.round(F.max(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice"))), 4)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum(F.col("l_quantity") * F.col("l_discount") * 100), 4).alias("exposure"),
        top("R").alias("r_max"), top("A").alias("a_max"), top("N").alias("n_max"),
        F.round(F.exp(F.sum(F.log(1 + F.col("l_discount") / 1e3))), 6).alias("compounded"),
    )


@query("""SELECT user_id, CAST(CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS session_day, round(arg_max(value, ts), 6) AS session_close, epoch_us(max(ts)) AS last_us FROM events GROUP BY ALL""")
def agg10_11_session_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("session_day", m.ny_date(F.col("ts")).cast("string"))
    out = e.groupBy("user_id", "session_day").agg(F.max_by("value", "ts").alias("session_close"), F.unix_micros(F.max("ts")).alias("last_us"))
    return rounded(out)


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1")
def agg12_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.duplicates(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kind = F.when(F.col("event_id") % 5 == 0, "delete").when(F.col("event_id") % 5 == 1, "update").otherwise("insert")
    return e.select("event_id", "user_id", "event_type", kind.alias("operation"), F.col("ts").alias("occurred_at"), F.col("props").alias("after_payload"), F.lit(None).cast("string").alias("before_payload"))


_OUTBOX = """o AS (SELECT event_id, user_id, event_type, CASE event_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' ELSE 'insert' END AS operation,
 ts AS occurred_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM events)"""


@query(f"""WITH {_OUTBOX} SELECT event_date, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, max(event_id) AS last_event_id,
 epoch_us(arg_max(occurred_at, event_id)) AS last_us FROM o GROUP BY event_date, event_type""")
def agg14_cdc_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cdc.parsed(_outbox(spark, sf_dir), {"k": "bigint"}).withColumn("user", F.col("user_id").cast("string"))
    out = cdc.activity(e, ["event_date", "event_type"], "user").withColumn("last_us", F.unix_micros("last_source_time"))
    return out.withColumn("event_date", F.col("event_date").cast("string")).drop("last_source_time")


@query(f"""WITH {_OUTBOX} SELECT event_date, k % 10 AS item, count(*) FILTER (WHERE operation = 'insert') AS additions, count(*) FILTER (WHERE operation = 'delete') AS removals,
 count(*) FILTER (WHERE operation = 'insert') - count(*) FILTER (WHERE operation = 'delete') AS net_change FROM o GROUP BY event_date, k % 10""")
def agg15_cdc_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cdc.parsed(_outbox(spark, sf_dir), {"k": "bigint"}).withColumn("item", F.col("after_k") % 10).withColumn("event_date", F.col("event_date").cast("string"))
    return cdc.additions_removals(e, ["event_date", "item"])


_STAGES = {"view": "discover", "click": "discover", "signup": "convert", "purchase": "pay"}


@query(f"""WITH {_OUTBOX} SELECT event_date, CASE event_type WHEN 'view' THEN 'discover' WHEN 'click' THEN 'discover' WHEN 'signup' THEN 'convert' WHEN 'purchase' THEN 'pay' END AS stage, count(*) AS n_events
 FROM o WHERE operation <> 'delete' AND event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1, 2""")
def agg16_cdc_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cdc.parsed(_outbox(spark, sf_dir), {"k": "bigint"})
    return cdc.funnel(e, F.col("event_type"), _STAGES).withColumn("event_date", F.col("event_date").cast("string"))


@query(f"""WITH {_OUTBOX} SELECT event_date, count(*) FILTER (WHERE event_type <> 'purchase') AS retrievals, count(*) FILTER (WHERE event_type = 'purchase') AS writes,
 count(*) FILTER (WHERE k % 3 = 0) AS successes, count(*) FILTER (WHERE k % 3 = 1) AS failures FROM o
 WHERE event_date IN (SELECT event_date FROM o WHERE event_id % 400 = 0) GROUP BY event_date""")
def agg17_18_cdc_usage_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cdc.parsed(_outbox(spark, sf_dir), {"k": "bigint"})
    e = cdc.affected(e, e.where("event_id % 400 = 0"))
    status = F.when(F.col("after_k") % 3 == 0, "OK").when(F.col("after_k") % 3 == 1, "error")
    return cdc.usage(e, F.col("event_type"), status, "^purchase$").withColumn("event_date", F.col("event_date").cast("string"))


@query("""WITH t AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0), s AS (SELECT c_custkey AS k, -c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0)
 SELECT 'upsert' AS op, k, round(v, 4) AS v FROM (SELECT * FROM t WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT * FROM s)
 UNION ALL SELECT 'insert_only', k, round(v, 4) FROM (SELECT * FROM t UNION ALL SELECT * FROM s WHERE k NOT IN (SELECT k FROM t))
 UNION ALL SELECT 'conditional', k, round(v, 4) FROM (SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NOT NULL AND (t.k % 5 = 0 OR s.k IS NULL) THEN t.v ELSE s.v END AS v FROM t FULL JOIN s ON t.k = s.k)
 UNION ALL SELECT 'replace', k, round(v, 4) FROM (SELECT * FROM t WHERE k % 7 NOT IN (SELECT k % 7 FROM s WHERE k < 30) UNION ALL SELECT * FROM s WHERE k < 30)
 UNION ALL SELECT 'stale', k, round(v, 4) FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = t.k AND s.v <> t.v)""")
def snk02_09_dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    t = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    s = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), (-F.col("c_acctbal")).alias("v"))
    part = lambda d: d.withColumn("p", F.col("k") % 7)
    found = {
        "upsert": r.upsert(t, s, ["k"]),
        "insert_only": r.insert_only(t, s, ["k"]),
        "conditional": r.conditional_update(t, s, ["k"], ["v"], F.col("k") % 5 == 0),
        "replace": r.replace_partitions(part(t), part(s.where("k < 30")), ["p"]).drop("p"),
        "stale": r.drop_stale_sessions(t, s, ["k"], "v"),
    }
    out = None
    for name, df in found.items():
        part_ = df.select(F.lit(name).alias("op"), "k", F.round("v", 4).alias("v"))
        out = part_ if out is None else out.unionByName(part_)
    return out


@query("""SELECT 'null_user' AS "check", count(*) FILTER (WHERE user_id IS NULL) AS violations FROM events UNION ALL SELECT 'not_positive', count(*) FILTER (WHERE value <= 1) FROM events
 UNION ALL SELECT 'wide_value', count(*) FILTER (WHERE value > 90) FROM events UNION ALL SELECT 'no_payload', count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) FROM events""")
def dq01_05_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"null_user": F.col("user_id").isNull(), "not_positive": F.col("value") <= 1, "wide_value": F.col("value") > 90, "no_payload": F.get_json_object("props", "$.k").isNull()}
    return quality.report(events(spark, sf_dir), checks)


@query("""WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id AS vintage, round(value, 0) AS v FROM events), stored AS (SELECT * FROM v WHERE vintage % 2 = 0), batch AS (SELECT * FROM v WHERE vintage % 2 = 1),
 held AS (SELECT user_id, day, arg_max(v, vintage) AS held FROM stored GROUP BY user_id, day)
 SELECT b.user_id, CAST(b.day AS VARCHAR) AS day, b.vintage, b.v FROM batch b LEFT JOIN held h USING (user_id, day) WHERE h.held IS NULL OR b.v <> h.held""")
def dq06_08_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = events(spark, sf_dir).select("user_id", F.to_date("ts").cast("string").alias("day"), F.col("event_id").alias("vintage"), F.round("value", 0).alias("v"))
    return quality.novel_vintages(v.where("vintage % 2 = 1"), v.where("vintage % 2 = 0"), ["user_id", "day"], "v", "vintage")


@query(f"""WITH {DAILY} SELECT symbol, CAST(day AS VARCHAR) AS day, round(100 * close / nullif(first_value(close) OVER (PARTITION BY symbol ORDER BY day), 0), 6) AS "index" FROM daily""")
def spr01_rebased_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.rebased(daily(spark, sf_dir), "symbol", "day", "close")
    return rounded(out.select("symbol", F.col("day").cast("string").alias("day"), "index"))


@query("""SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_partkey)) AS keys, CAST(0 AS BIGINT) AS null_keys, count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS duplicate_rows FROM lineitem""")
def bit08_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grain(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 25")
def srt01_flt11_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(25)
    return rounded(e.select("event_id", "user_id", "value"))


@query("""SELECT k, count(*) AS n FROM (SELECT c_custkey AS k FROM customer UNION SELECT user_id FROM events UNION SELECT s_suppkey FROM supplier) GROUP BY k
 UNION ALL SELECT -1, (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION ALL SELECT user_id FROM events))""")
def set01_02_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    one = c.unionByName(e).unionByName(s).distinct().withColumn("n", F.lit(1).cast("long"))
    return one.unionByName(c.unionByName(e).agg(F.lit(-1).cast("long").alias("k"), F.count("*").alias("n")))


@query("""SELECT n_name, r_name, p_brand, s.s_nationkey = c.c_nationkey AS domestic, count(*) AS n_lines, count(o_orderkey) AS n_orders, round(sum(l_extendedprice), 2) AS total FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer c ON c_custkey = o_custkey
 LEFT JOIN nation ON n_nationkey = c.c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier s ON s_suppkey = l_suppkey GROUP BY ALL""")
def jon02_snapshot_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven tables, joined from the left; lines are summed by (order, part, supplier) before the chain."""
    t = lambda name, *columns: table(spark, sf_dir, name).select(*columns)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("v"))
    out = (
        lines.join(t("orders", "o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(t("customer", "c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(t("nation", "n_nationkey", "n_name", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(t("region", "r_regionkey", "r_name"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .join(t("part", "p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"), "left")
        .join(t("supplier", "s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    )
    return out.groupBy("n_name", "r_name", "p_brand", (F.col("s_nationkey") == F.col("c_nationkey")).alias("domestic")).agg(
        F.sum("n").alias("n_lines"), F.coalesce(F.sum(F.when(F.col("o_orderkey").isNotNull(), F.col("n"))), F.lit(0)).alias("n_orders"), F.round(F.sum("v"), 2).alias("total")
    )


@query("""SELECT 'customer' AS kind, c_name AS name, c_acctbal AS amount, CAST(NULL AS BIGINT) AS size FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_name, NULL, p_size FROM part UNION ALL SELECT 'nation', n_name, NULL, NULL FROM nation""")
def set02_entity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four extractors, each with typed nulls for what it has not."""
    none, no_size = F.lit(None).cast("double"), F.lit(None).cast("long")
    part = lambda name, kind, label, amount, size: table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(label).alias("name"), amount.alias("amount"), size.alias("size"))
    out = part("customer", "customer", "c_name", F.col("c_acctbal"), no_size).unionByName(part("supplier", "supplier", "s_name", F.col("s_acctbal"), no_size))
    return out.unionByName(part("part", "part", "p_name", none, F.col("p_size").cast("long"))).unionByName(part("nation", "nation", "n_name", none, no_size))


@query("""WITH l AS (SELECT 'latest' AS shape, event_id, value FROM (SELECT * FROM events WHERE user_id = 1 ORDER BY ts DESC LIMIT 3)), r AS (SELECT 'range', event_id, value FROM events WHERE user_id IN (2, 3) AND event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20')
 SELECT shape, event_id, round(value, 6) AS value FROM l UNION ALL SELECT 'range', event_id, round(value, 6) FROM r""")
def flt11_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.sources import readers

    e = events(spark, sf_dir)
    import datetime as dt

    pick = lambda df, shape: df.select(F.lit(shape).alias("shape"), "event_id", "value")
    last = readers.read_latest(e, {"user_id": 1}, "ts", 3)
    span = readers.read_range(e, {"user_id": [2, 3], "event_type": ["click", "view"]}, "ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20))
    return rounded(pick(last, "latest").unionByName(pick(span, "range")))
