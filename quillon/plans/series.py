"""Queries over time series: rolling features, as-of joins, universe screens, adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.functions import market as m
from quillon.operators import adjust, asof, windows
from quillon.plans.base import BARS, DAILY, bars, daily, events, rounded, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {BARS}, s AS (SELECT *,
 close / nullif(lag(close, 1) OVER d, 0) - 1 AS r1, close / nullif(lag(close, 5) OVER d, 0) - 1 AS r5,
 close / nullif(lag(close, 15) OVER d, 0) - 1 AS r15, close / nullif(lag(close, 30) OVER d, 0) - 1 AS r30,
 CASE WHEN close / nullif(lag(close, 1) OVER d, 0) > 0 THEN ln(close / nullif(lag(close, 1) OVER d, 0)) END AS log_r1,
 max(high) OVER (PARTITION BY symbol, day ORDER BY event_ts ROWS UNBOUNDED PRECEDING) AS session_high,
 min(low) OVER (PARTITION BY symbol, day ORDER BY event_ts ROWS UNBOUNDED PRECEDING) AS session_low
 FROM bars WINDOW d AS (PARTITION BY symbol, day ORDER BY event_ts)), t AS (SELECT *,
 CASE WHEN r1 > 0 THEN r1 ELSE 0 END AS g, CASE WHEN r1 < 0 THEN -r1 ELSE 0 END AS l FROM s), u AS (SELECT *,
 avg(g) OVER w14 AS up, avg(l) OVER w14 AS down, avg(high - low) OVER w14 AS atr14, avg(volume) OVER w20 AS v20,
 stddev_samp(r1) OVER w5 AS rvol5, stddev_samp(r1) OVER w15 AS rvol15, stddev_samp(r1) OVER w30 AS rvol30
 FROM t WINDOW w5 AS (PARTITION BY symbol, day ORDER BY event_ts ROWS 4 PRECEDING),
 w14 AS (PARTITION BY symbol, day ORDER BY event_ts ROWS 13 PRECEDING), w15 AS (PARTITION BY symbol, day ORDER BY event_ts ROWS 14 PRECEDING),
 w20 AS (PARTITION BY symbol, day ORDER BY event_ts ROWS 19 PRECEDING), w30 AS (PARTITION BY symbol, day ORDER BY event_ts ROWS 29 PRECEDING))
SELECT event_id, symbol, round(r1, 6) AS r1, round(r5, 6) AS r5, round(r15, 6) AS r15, round(r30, 6) AS r30, round(log_r1, 6) AS log_r1,
 round(session_high, 6) AS session_high, round(session_low, 6) AS session_low, round(rvol5, 6) AS rvol5, round(rvol15, 6) AS rvol15,
 round(rvol30, 6) AS rvol30, round(atr14, 6) AS atr14,
 round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / nullif(down, 0)) END, 6) AS rsi14,
 round((close - vwap) / nullif(vwap, 0), 6) AS vwap_dev, round(volume / nullif(v20, 0), 6) AS rel_volume,
 round((close - session_high) / nullif(session_high, 0), 6) AS to_high, round((close - session_low) / nullif(session_low, 0), 6) AS to_low FROM u""")
def win05_12_bar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.bar_features(bars(spark, sf_dir))
    return rounded(out.drop("event_ts", "day", "close", "high", "low", "volume", "vwap", "event_type"))


@query("""SELECT event_id, user_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER
 (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def win01_dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    out = windows.latest(e, ["user_id", "event_type", "day"], [F.desc("ts"), F.desc("event_id")])
    return rounded(out.select("event_id", "user_id", "event_type", "value"))


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_latest FROM events""")
def win03_04_sequence_latest_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    return events(spark, sf_dir).select(
        "event_id",
        "user_id",
        (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("seq"),
        (F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))) == 1).alias("is_latest"),
    )


_DAYS = "PARTITION BY symbol ORDER BY day"


@query(f"""WITH {DAILY} SELECT symbol, CAST(day AS VARCHAR) AS day, round(CASE WHEN count(dollar_volume) OVER w = 20 THEN
 (dollar_volume - avg(dollar_volume) OVER w) / nullif(stddev_samp(dollar_volume) OVER w, 0) END, 6) AS z
 FROM daily WINDOW w AS ({_DAYS} ROWS 19 PRECEDING)""")
def win13_gated_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.trailing_zscore(daily(spark, sf_dir), ["symbol"], "day", "dollar_volume", 20, "z")
    return rounded(out.select("symbol", F.col("day").cast("string").alias("day"), "z"))


@query("""WITH o AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_discount, l_extendedprice,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(l_discount - 0.05), l_orderkey, l_linenumber) AS n_delta,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS n_open FROM lineitem)
 SELECT l_suppkey, max(CASE WHEN n_delta = 1 THEN l_orderkey END) AS nearest_key, round(max(CASE WHEN n_delta = 1 THEN l_extendedprice END), 6) AS nearest_price,
 max(CASE WHEN n_open = 1 THEN l_orderkey END) AS widest_key FROM o GROUP BY l_suppkey""")
def win14_15_nearest_and_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregate with ordered minima: no window and no sort of all lines."""
    near = F.min_by(F.struct("l_orderkey", "l_extendedprice"), F.struct(F.abs(F.col("l_discount") - 0.05), "l_orderkey", "l_linenumber"))
    wide = F.min_by("l_orderkey", F.struct(-F.col("l_quantity"), "l_orderkey", "l_linenumber"))
    out = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(near.alias("n"), wide.alias("widest_key"))
    return rounded(out.select("l_suppkey", F.col("n.l_orderkey").alias("nearest_key"), F.col("n.l_extendedprice").alias("nearest_price"), "widest_key"))


@query(f"""WITH {DAILY}, w AS (SELECT symbol, day, close, row_number() OVER ({_DAYS}) AS rn FROM daily)
 SELECT a.symbol, CAST(a.day AS VARCHAR) AS day, round(CASE WHEN count(*) = 10 THEN sum(CASE WHEN b.close < a.close THEN 1 ELSE 0 END) / 9e0 END, 6) AS pct
 FROM w a JOIN w b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 9 AND a.rn GROUP BY a.symbol, a.day""")
def win18_jon11_trailing_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.trailing_percentile(daily(spark, sf_dir), ["symbol"], "day", "close", 10, "pct")
    return rounded(out.select("symbol", F.col("day").cast("string").alias("day"), "pct"))


@query(f"""WITH {DAILY}, g AS (SELECT s.symbol, d.day FROM (SELECT DISTINCT symbol FROM daily) s CROSS JOIN (SELECT DISTINCT day FROM daily) d),
 f AS (SELECT g.symbol, g.day, daily.dollar_volume FROM g LEFT JOIN daily USING (symbol, day)), m AS (SELECT *,
 CASE WHEN count(dollar_volume) OVER w = 8 THEN quantile_cont(dollar_volume, 0.5) OVER w END AS median_volume,
 count(dollar_volume) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent
 FROM f WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)), r AS (SELECT *, row_number() OVER
 (PARTITION BY day ORDER BY median_volume DESC, symbol) AS rank FROM m WHERE recent >= 3 AND median_volume IS NOT NULL)
 SELECT symbol, CAST(day AS VARCHAR) AS day, round(median_volume, 6) AS median_volume, recent, rank FROM r WHERE rank <= 10""")
def win20_22_jon12_universe_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense grid, trailing exact median, recency and top 10 of each day. The calendar is a row per
    day; it is exploded onto each symbol from one array, so no product of tables is made."""
    d = daily(spark, sf_dir)
    days = d.select("day").distinct().agg(F.array_sort(F.collect_set("day")).alias("days"))
    grid = d.select("symbol").distinct().join(F.broadcast(days)).select("symbol", F.explode("days").alias("day"))
    dense = grid.join(d.select("symbol", "day", "dollar_volume"), ["symbol", "day"], "left")
    out = windows.universe_screen(dense, 8, 5, 3, 10)
    return rounded(out.select("symbol", F.col("day").cast("string").alias("day"), "median_volume", "recent", F.col("rank").cast("long").alias("rank")))


@query(f"""WITH {DAILY}, i AS (SELECT day, avg(close) AS wide, avg(close) FILTER (WHERE symbol % 3 = 0) AS narrow FROM daily GROUP BY day), r AS (SELECT *, wide / nullif(narrow, 0) AS ratio FROM i),
 f AS (SELECT day, ratio, CASE WHEN count(ratio) OVER w10 = 10 THEN avg(ratio) OVER w10 END AS sma, CASE WHEN count(ratio) OVER w15 = 15 THEN (ratio - avg(ratio) OVER w15) / nullif(stddev_samp(ratio) OVER w15, 0) END AS z,
 ratio / nullif(lag(ratio, 5) OVER o, 0) - 1 AS slope, wide / nullif(lag(wide, 5) OVER o, 0) - narrow / nullif(lag(narrow, 5) OVER o, 0) AS excess FROM r WINDOW o AS (ORDER BY day), w10 AS (ORDER BY day ROWS 9 PRECEDING), w15 AS (ORDER BY day ROWS 14 PRECEDING))
 SELECT CAST(day AS VARCHAR) AS day, round(ratio, 6) AS ratio, round(sma, 6) AS sma, round(z, 5) AS zscore, round(slope, 6) AS slope, round(excess, 6) AS excess,
 CASE WHEN ratio > sma AND slope > 0 THEN 'BROAD' WHEN ratio < sma AND slope < 0 THEN 'NARROW' ELSE 'MIXED' END AS regime FROM f""")
def win23_25_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global order over a row per day: the one place where a window without a key is right."""
    level = daily(spark, sf_dir).groupBy("day").agg(F.avg("close").alias("wide"), F.avg(F.when(F.col("symbol") % 3 == 0, F.col("close"))).alias("narrow"))
    out = windows.breadth_features(level, "day", "wide", "narrow", 10, 5, 15).withColumn("zscore", F.round("zscore", 5))
    return rounded(out.select(F.col("day").cast("string").alias("day"), "ratio", "sma", "zscore", "slope", "excess", "regime"))


@query(f"""WITH {DAILY}, s AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r FROM daily WINDOW w AS ({_DAYS}))
 SELECT symbol, CAST(day AS VARCHAR) AS day, round(close / nullif(lag(close, 5) OVER w, 0) - 1, 6) AS momentum,
 round(CASE WHEN count(r) OVER w5 = 5 THEN stddev_samp(r) OVER w5 END * sqrt(252), 6) AS realised_vol,
 round(close / nullif(max(close) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), 0) - 1, 6) AS drawdown,
 round(CASE WHEN NOT max(coalesce(r <= -1, FALSE)) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) THEN exp(sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING)) - 1 END, 6) AS total
 FROM s WINDOW w AS ({_DAYS}), w5 AS ({_DAYS} ROWS 4 PRECEDING)""")
def win27_28_momentum_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = windows.momentum_risk(daily(spark, sf_dir), 5)
    out = windows.cumulative_return(step, ["symbol"], "day", "r", "total")
    return rounded(out.select("symbol", F.col("day").cast("string").alias("day"), "momentum", "realised_vol", "drawdown", "total"))


@query("""WITH o AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click'),
 p AS (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
 SELECT o.event_id, p.event_id AS purchase_id, round(p.value, 6) AS purchase_value FROM o ASOF LEFT JOIN p ON o.user_id = p.user_id AND o.ts >= p.ts""")
def jon06_07_asof_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    p = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("available_ts"), F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    out = asof.asof_join(e.where("event_type = 'click'"), p, ["user_id"], "ts", "available_ts", ["purchase_id", "purchase_value"], ties=["purchase_id"])
    return rounded(out.select("event_id", "purchase_id", "purchase_value"))


@query("""WITH o AS (SELECT event_id, ts, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS k FROM events WHERE event_type = 'click'), p AS (SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS k, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY ALL)
 SELECT o.event_id, p.purchase_id FROM o ASOF LEFT JOIN p ON o.k = p.k AND o.ts >= p.ts""")
def jon06_07_asof_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that holds a third of all rows is dealt by day."""
    e = events(spark, sf_dir).withColumn("k", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    p = e.where("event_type = 'purchase'").select("k", F.col("ts").alias("available_ts"), F.col("event_id").alias("purchase_id"))
    return asof.asof_by_day(e.where("event_type = 'click'"), p, ["k"], "ts", "available_ts", ["purchase_id"]).select("event_id", "purchase_id")


@query("""WITH p AS (SELECT ts, max(event_id) AS signup_id FROM events WHERE event_type = 'signup' GROUP BY ts)
 SELECT o.event_id, p.signup_id FROM events o ASOF LEFT JOIN p ON o.ts >= p.ts""")
def jon08_asof_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    p = e.where("event_type = 'signup'").select(F.col("ts").alias("available_ts"), F.col("event_id").alias("signup_id"))
    return asof.asof_global(e, p, "ts", "available_ts", ["signup_id"]).select("event_id", "signup_id")


@query("""SELECT event_id, CASE WHEN lead(ts) OVER w <= ts + INTERVAL 1 DAY THEN round(lead(value) OVER w / nullif(value, 0) - 1, 6) END AS outcome
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def jon09_lab02_next_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.next_outcome(events(spark, sf_dir), ["user_id"], "ts", "value", "1 DAY")
    return rounded(out.select("event_id", (m.safe_ratio(F.col("next_value"), F.col("value")) - 1).alias("outcome")))


_SPLITS = """splits AS (SELECT DISTINCT p_size AS symbol, d.day AS ex_date, CASE WHEN p_size % 2 = 0 THEN 2e0 ELSE 5e-1 END AS split_ratio
 FROM part CROSS JOIN (SELECT DISTINCT day FROM daily) d WHERE (dayofyear(d.day) + p_size) % 9 = 0)"""


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    days = daily(spark, sf_dir).select("day").distinct()
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    pairs = sizes.join(F.broadcast(days.agg(F.collect_set("day").alias("days")))).select("p_size", F.explode("days").alias("ex_date"))
    return pairs.where((F.dayofyear("ex_date") + size) % 9 == 0).select(size.cast("long").alias("symbol"), "ex_date", F.when(size % 2 == 0, 2.0).otherwise(0.5).alias("split_ratio"))


@query(f"""WITH {DAILY}, {_SPLITS} SELECT d.symbol, CAST(d.day AS VARCHAR) AS day,
 round(coalesce((SELECT exp(sum(ln(split_ratio))) FROM splits s WHERE s.symbol = d.symbol AND s.ex_date > d.day), 1), 6) AS factor,
 round(close / coalesce((SELECT exp(sum(ln(split_ratio))) FROM splits s WHERE s.symbol = d.symbol AND s.ex_date > d.day), 1), 6) AS adj_close,
 round(volume * coalesce((SELECT exp(sum(ln(split_ratio))) FROM splits s WHERE s.symbol = d.symbol AND s.ex_date > d.day), 1), 6) AS adj_volume FROM daily d""")
def adj01_02_jon10_split_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = adjust.adjust_bars(daily(spark, sf_dir), _splits(spark, sf_dir))
    return rounded(out.select("symbol", F.col("day").cast("string").alias("day"), "factor", "adj_close", "adj_volume"))


@query(f"""WITH {DAILY}, {_SPLITS}, g AS (SELECT symbol, day, open / nullif(lag(close) OVER w, 0) AS gross, lag(day) OVER w AS previous_day FROM daily WINDOW w AS ({_DAYS})),
 b AS (SELECT g.*, s.split_ratio, abs(gross * coalesce(split_ratio, 1) - 1) AS err FROM g LEFT JOIN splits s ON s.symbol = g.symbol AND s.ex_date = g.day WHERE abs(gross - 1) >= 0.4)
 SELECT symbol, CAST(day AS VARCHAR) AS day, round(gross, 6) AS gross, CASE WHEN split_ratio IS NOT NULL AND err <= 0.03 THEN 'SPLIT_EXPLAINED' ELSE 'UNEXPLAINED_PENDING' END AS break_type,
 NOT (split_ratio IS NOT NULL AND err <= 0.03) AS masked FROM b""")
def adj03_04_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = adjust.classify_breaks(daily(spark, sf_dir), _splits(spark, sf_dir))
    return rounded(out.select("symbol", F.col("day").cast("string").alias("day"), "gross", "break_type", "masked"))
