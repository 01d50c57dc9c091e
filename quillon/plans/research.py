"""Queries for labels, evaluation, strategy, costs and pair risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.functions import market as m
from quillon.operators import research as x, strategy as st, windows
from quillon.plans.base import DAILY, daily, events, rounded, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _day(df: DataFrame, *columns, digits: int = 6) -> DataFrame:
    return rounded(df.select("symbol", F.col("day").cast("string").alias("day"), *columns), digits)


_W = "PARTITION BY symbol ORDER BY day"
_RET = f"""{DAILY}, r AS (SELECT symbol, day, close, dollar_volume, symbol % 7 AS grp, close / nullif(lag(close) OVER ({_W}), 0) - 1 AS y FROM daily),
 p AS (SELECT *, avg(y) OVER (PARTITION BY day) AS m, CASE WHEN y IS NOT NULL AND count(y) OVER g > 1 THEN (sum(y) OVER g - y) / (count(y) OVER g - 1) END AS f FROM r WINDOW g AS (PARTITION BY day, grp))"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns with the market's mean and the others' mean of a group."""
    w = Window.partitionBy("symbol").orderBy("day")
    r = daily(spark, sf_dir).select("symbol", "day", "close", "dollar_volume", (F.col("symbol") % 7).alias("grp")).withColumn("y", m.safe_ratio(F.col("close"), F.lag("close").over(w)) - 1)
    return st.leave_one_out_mean(r.withColumn("m", F.avg("y").over(Window.partitionBy("day"))), "day", "grp", "y", "f")


@query(f"""WITH {DAILY} SELECT symbol, CAST(day AS VARCHAR) AS day, round(lead(close, 3) OVER w / nullif(close, 0) - 1, 6) AS forward_return,
 CASE WHEN lead(close, 3) OVER w IS NOT NULL THEN CAST(lead(close, 3) OVER w / nullif(close, 0) - 1 > 0 AS INTEGER) END AS label, CAST(lead(day, 3) OVER w AS VARCHAR) AS label_end FROM daily WINDOW w AS ({_W})""")
def lab01_forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = x.forward_labels(daily(spark, sf_dir), ["symbol"], "day", "close", 3)
    return _day(out, "forward_return", "label", F.col("label_end").cast("string").alias("label_end"))


@query(f"""WITH {DAILY}, r AS (SELECT symbol, day, close, row_number() OVER ({_W}) AS rn, close / nullif(lag(close) OVER ({_W}), 0) - 1 AS r FROM daily),
 v AS (SELECT *, CASE WHEN count(r) OVER w = 5 THEN stddev_samp(r) OVER w END AS vol, count(*) OVER (PARTITION BY symbol) AS n FROM r WINDOW w AS ({_W} ROWS 4 PRECEDING)),
 e AS (SELECT * FROM v WHERE vol > 0 AND rn + 4 <= n AND close <> 0),
 h AS (SELECT e.symbol, e.day, e.close, e.rn, coalesce(min(f.rn - e.rn) FILTER (WHERE f.close / e.close - 1 >= e.vol), 5) AS u, coalesce(min(f.rn - e.rn) FILTER (WHERE f.close / e.close - 1 <= -e.vol), 5) AS d
 FROM e JOIN v f ON f.symbol = e.symbol AND f.rn BETWEEN e.rn + 1 AND e.rn + 4 GROUP BY ALL),
 k AS (SELECT *, CASE WHEN u < d THEN 1 WHEN d < u THEN -1 ELSE 0 END AS label, CASE WHEN u = d THEN 4 ELSE least(u, d) END AS hit FROM h)
 SELECT k.symbol, CAST(k.day AS VARCHAR) AS day, k.label, round(f.close / k.close - 1, 6) AS forward_return, CAST(f.day AS VARCHAR) AS label_end FROM k JOIN v f ON f.symbol = k.symbol AND f.rn = k.rn + k.hit""")
def lab04_triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = x.triple_barrier(daily(spark, sf_dir), ["symbol"], "day", "close", 4, 5)
    return _day(out, "label", "forward_return", F.col("label_end").cast("string").alias("label_end"))


@query(f"""WITH {DAILY}, s AS (SELECT symbol, day, lead(day, 3) OVER ({_W}) AS stop FROM daily), e AS (SELECT * FROM s WHERE stop IS NOT NULL),
 g AS (SELECT symbol, day AS t FROM e UNION SELECT symbol, stop FROM e), c AS (SELECT g.symbol, g.t, count(*) AS n FROM g JOIN e ON e.symbol = g.symbol AND g.t BETWEEN e.day AND e.stop GROUP BY ALL)
 SELECT e.symbol, CAST(e.day AS VARCHAR) AS day, round(avg(1e0 / c.n), 6) AS weight FROM e JOIN c ON c.symbol = e.symbol AND c.t BETWEEN e.day AND e.stop GROUP BY e.symbol, e.day""")
def lab05_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    e = daily(spark, sf_dir).select("symbol", "day", F.lead("day", 3).over(w).alias("stop")).where("stop is not null")
    return _day(x.uniqueness_weights(e, ["symbol"], "day", "stop"), "weight")


@query(f"""WITH {_RET}, n AS (SELECT *, y - avg(y) OVER g AS yy, dollar_volume - avg(dollar_volume) OVER g AS xx FROM p WHERE y IS NOT NULL WINDOW g AS (PARTITION BY day, grp))
 SELECT symbol, CAST(day AS VARCHAR) AS day, round(yy - coalesce(sum(xx * yy) OVER (PARTITION BY day) / nullif(sum(xx * xx) OVER (PARTITION BY day), 0), 0) * xx, 5) AS residual FROM n""")
def fea04_stg10_neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = x.neutralize(_panel(spark, sf_dir).where("y is not null"), "day", "y", "dollar_volume", "grp")
    return _day(out, "residual", digits=5)


@query(f"""WITH {DAILY}, t AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM daily)), q AS (SELECT *, CAST(floor((k - 1) * 4 / n) AS INTEGER) AS part FROM t),
 s AS (SELECT part, min(day) AS start, min(k) AS first FROM q GROUP BY part), d AS (SELECT d.symbol, d.day, lead(d.day, 2) OVER ({_W}) AS stop FROM daily d),
 f AS (SELECT s.part AS fold, q.part = s.part AS test, d.* FROM d JOIN q ON q.day = d.day JOIN s ON s.part BETWEEN 1 AND 3 AND q.part <= s.part WHERE q.part = s.part OR (q.k < s.first - 1 AND d.stop < s.start))
 SELECT fold, CASE WHEN test THEN 'test' ELSE 'train' END AS side, count(*) AS n, CAST(min(day) AS VARCHAR) AS low, CAST(max(day) AS VARCHAR) AS high FROM f GROUP BY ALL""")
def cv01_02_purged_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    d = daily(spark, sf_dir).select("symbol", "day", F.lead("day", 2).over(w).alias("stop"))
    out = x.walk_forward(d, "day", 3, end="stop", embargo=1)
    return out.groupBy("fold", "side").agg(F.count("*").alias("n"), F.min("day").cast("string").alias("low"), F.max("day").cast("string").alias("high"))


_SCORED = "s AS (SELECT user_id % 5 AS k, CAST(value > 50 AS INTEGER) AS y, (event_id * 37 % 100 + CASE WHEN value > 50 THEN 30 ELSE 0 END) / 130e0 AS p, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, value FROM events)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, v = F.col("event_id"), F.col("value")
    return events(spark, sf_dir).select((F.col("user_id") % 5).alias("k"), (v > 50).cast("int").alias("y"), ((n * 37 % 100 + F.when(v > 50, 30).otherwise(0)) / 130.0).alias("p"), F.to_date("ts").cast("string").alias("day"), "value")


@query(f"""WITH {_SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2e0 AS rk FROM s)
 SELECT k, count(*) AS n, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * sum(1 - y), 0), 6) AS auc, round(sum(CASE WHEN p >= 0.5 THEN y END) / nullif(count(*) FILTER (WHERE p >= 0.5), 0), 6) AS precision,
 round(sum(CASE WHEN p >= 0.5 THEN y END) / nullif(sum(y), 0), 6) AS recall, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1e0 ELSE 0 END), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier FROM r GROUP BY k""")
def eva01_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(x.binary_metrics(_scored(spark, sf_dir), ["k"], "y", "p"))


@query(f"""WITH {_SCORED}, r AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY p) + (count(*) OVER (PARTITION BY day, p) - 1) / 2e0 AS a, rank() OVER (PARTITION BY day ORDER BY value) + (count(*) OVER (PARTITION BY day, value) - 1) / 2e0 AS b FROM s)
 SELECT day, round(corr(a, b), 6) AS ic, count(*) AS n FROM r GROUP BY day HAVING count(*) >= 2""")
def eva02_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(x.rank_ic(_scored(spark, sf_dir), "day", "p", "value"))


@query(f"""WITH {_SCORED}, a AS (SELECT k, CAST(sum(y) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS n, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.5) AS p50 FROM s GROUP BY k)
 SELECT k, round((h / n + 3.8414588206941254e0 / (2 * n) - 1.959963984540054e0 * sqrt(h / n * (1 - h / n) / n + 3.8414588206941254e0 / (4 * n * n))) / (1 + 3.8414588206941254e0 / n), 6) AS low,
 round((h / n + 3.8414588206941254e0 / (2 * n) + 1.959963984540054e0 * sqrt(h / n * (1 - h / n) / n + 3.8414588206941254e0 / (4 * n * n))) / (1 + 3.8414588206941254e0 / n), 6) AS high, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM a""")
def agg20_eva05_wilson_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _scored(spark, sf_dir).groupBy("k").agg(F.sum("y").cast("double").alias("h"), F.count("*").cast("double").alias("n"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"))
    low, high = x.wilson(F.col("h"), F.col("n"))
    return rounded(a.select("k", low.alias("low"), high.alias("high"), "p50", "p95"))


@query(f"""WITH {_RET} SELECT symbol, CAST(day AS VARCHAR) AS day, round(m, 6) AS m, round(f, 6) AS f FROM p""")
def stg02_03_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(_panel(spark, sf_dir), "m", "f")


@query(f"""WITH {_RET}, o AS (SELECT *, y IS NOT NULL AND m IS NOT NULL AND f IS NOT NULL AS ok FROM p), z AS (SELECT symbol, day, y, m, f, count(*) OVER w AS cnt, sum(CASE WHEN ok THEN 1e0 ELSE 0 END) OVER w AS n,
 sum(CASE WHEN ok THEN m END) OVER w AS sm, sum(CASE WHEN ok THEN f END) OVER w AS sf, sum(CASE WHEN ok THEN y END) OVER w AS sy, sum(CASE WHEN ok THEN m * m END) OVER w AS smm, sum(CASE WHEN ok THEN f * f END) OVER w AS sff,
 sum(CASE WHEN ok THEN m * f END) OVER w AS smf, sum(CASE WHEN ok THEN m * y END) OVER w AS smy, sum(CASE WHEN ok THEN f * y END) OVER w AS sfy FROM o WINDOW w AS ({_W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
 c AS (SELECT *, smm - sm * sm / n AS cmm, sff - sf * sf / n AS cff, smf - sm * sf / n AS cmf, smy - sm * sy / n AS cmy, sfy - sf * sy / n AS cfy FROM z WHERE cnt = 12 AND n >= 10),
 b AS (SELECT *, (cmy * cff - cfy * cmf) / (cmm * cff - cmf * cmf) AS bm, (cfy * cmm - cmy * cmf) / (cmm * cff - cmf * cmf) AS bf FROM c WHERE abs(cmm * cff - cmf * cmf) > 1e-12 * cmm * cff)
 SELECT symbol, CAST(day AS VARCHAR) AS day, round(bm, 4) AS beta_market, round(bf, 4) AS beta_industry, round(y - ((sy - bm * sm - bf * sf) / n + bm * m + bf * f), 4) AS residual FROM b""")
def stg04_rolling_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.rolling_two_factor(_panel(spark, sf_dir), "symbol", "day", "y", "m", "f", 12, 10)
    return _day(out.where("beta_market is not null"), "beta_market", "beta_industry", "residual", digits=4)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _panel(spark, sf_dir).withColumn("residual", F.col("y") - F.col("m"))
    return st.s_score(p, "symbol", "day", "residual", 10, 3, 8)


@query(f"""WITH {_RET}, e AS (SELECT *, y - m AS residual FROM p), s AS (SELECT *, CASE WHEN count(residual) OVER w >= 8 THEN stddev_samp(residual) OVER w END AS sigma, CASE WHEN count(residual) OVER c = 3 THEN sum(residual) OVER c END AS cum_residual
 FROM e WINDOW w AS ({_W} ROWS 9 PRECEDING), c AS ({_W} ROWS 2 PRECEDING)) SELECT symbol, CAST(day AS VARCHAR) AS day, round(sigma, 5) AS sigma, round(cum_residual, 5) AS cum_residual, round(cum_residual / nullif(sigma * sqrt(3e0), 0), 5) AS s_score FROM s""")
def stg05_s_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(_scores(spark, sf_dir), "sigma", "cum_residual", "s_score", digits=5)


_SCORE_SQL = f"""{_RET}, e AS (SELECT *, y - m AS residual FROM p), sc AS (SELECT symbol, day, y, CASE WHEN count(residual) OVER c = 3 THEN sum(residual) OVER c END / nullif(CASE WHEN count(residual) OVER w >= 8 THEN stddev_samp(residual) OVER w END * sqrt(3e0), 0) AS s,
 row_number() OVER ({_W}) AS rn FROM e WINDOW w AS ({_W} ROWS 9 PRECEDING), c AS ({_W} ROWS 2 PRECEDING))"""


@query(f"""WITH RECURSIVE {_SCORE_SQL}, st AS (SELECT symbol, day, rn, CASE WHEN s <= -1 THEN 1 WHEN s >= 1 THEN -1 ELSE 0 END AS position, 0 AS held FROM sc WHERE rn = 1 UNION ALL
 SELECT n.symbol, n.day, n.rn, CASE WHEN st.position = 0 THEN CASE WHEN n.s <= -1 THEN 1 WHEN n.s >= 1 THEN -1 ELSE 0 END
 WHEN st.held + 1 >= 4 OR (st.position > 0 AND n.s > -0.3e0) OR (st.position < 0 AND n.s < 0.3e0) THEN 0 ELSE st.position END,
 CASE WHEN st.position = 0 OR st.held + 1 >= 4 OR (st.position > 0 AND n.s > -0.3e0) OR (st.position < 0 AND n.s < 0.3e0) THEN 0 ELSE st.held + 1 END
 FROM st JOIN sc n ON n.symbol = st.symbol AND n.rn = st.rn + 1) SELECT symbol, CAST(day AS VARCHAR) AS day, position FROM st""")
def stg06_signal_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(st.signal_positions(_scores(spark, sf_dir).select("symbol", "day", "s_score"), "symbol", "day", "s_score", 1.0, 0.3, 4), "position")


@query(f"""WITH {_RET}, w AS (SELECT *, CASE WHEN y > 0 THEN -1e-2 WHEN y < 0 THEN 1e-2 END AS weight FROM p), b AS (SELECT *, coalesce(lag(weight) OVER ({_W}), 0) AS before FROM w),
 d AS (SELECT day, sum(before * coalesce(y, 0)) AS gross, sum(abs(coalesce(weight, 0) - before) * 5 / 1e4 + greatest(-before, 0) * 0.03e0 / 252) AS cost, sum(abs(coalesce(weight, 0) - before)) / 2 AS turnover FROM b GROUP BY day)
 SELECT CAST(day AS VARCHAR) AS day, round(gross, 6) AS gross, round(cost, 6) AS cost, round(turnover, 6) AS turnover, round(gross - cost, 6) AS net, round(gross - 2 * cost, 6) AS net_stressed FROM d""")
def stg07_12_15_daily_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _panel(spark, sf_dir).withColumn("weight", F.when(F.col("y") > 0, -0.01).when(F.col("y") < 0, 0.01))
    out = st.daily_pnl(p, "symbol", "day", "weight", "y", 5.0, 0.03, stress=2.0)
    return rounded(out.withColumn("day", F.col("day").cast("string")))


@query(f"""WITH {DAILY}, i AS (SELECT day, avg(close) / 1e3 - 0.045e0 AS r FROM daily GROUP BY day), w AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS w FROM i),
 d AS (SELECT *, w / greatest(1, max(w) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM w), a AS (SELECT count(r) AS n, avg(r) AS mean, stddev_pop(r) AS sd, sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)) AS down,
 arg_max(w, day) AS fin, min(dd) AS max_drawdown, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0 END) AS hit_rate, sum(CASE WHEN r > 0 THEN r END) / nullif(-sum(CASE WHEN r < 0 THEN r END), 0) AS profit_factor FROM d)
 SELECT n, round(mean, 6) AS mean, round(max_drawdown, 6) AS max_drawdown, round(hit_rate, 6) AS hit_rate, round(profit_factor, 5) AS profit_factor, round(mean / nullif(sd, 0) * sqrt(252), 5) AS sharpe, round(mean / nullif(down, 0) * sqrt(252), 5) AS sortino,
 round(power(fin, 252e0 / n) - 1, 5) AS cagr, round((power(fin, 252e0 / n) - 1) / nullif(-max_drawdown, 0), 4) AS calmar FROM a""")
def stg16_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily(spark, sf_dir).groupBy("day").agg((F.avg("close") / 1e3 - 0.045).alias("r"))
    out = st.performance(r, "day", "r")
    five = lambda c: F.round(c, 5).alias(c)
    return rounded(out.select("n", "mean", "max_drawdown", "hit_rate", five("profit_factor"), five("sharpe"), five("sortino"), five("cagr"), F.round("calmar", 4).alias("calmar")))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (2.5e0 + 10 * power(greatest(l_extendedprice / 1e6, 0), 0.5)) / 1e4, 6) AS impact,
 round(greatest(least(l_quantity, 10) * 0.05e0 + greatest(least(l_quantity, 30) - 10, 0) * 0.03e0 + greatest(least(l_quantity, 1e9) - 30, 0) * 0.01e0, 0.35e0), 6) AS commission FROM lineitem""")
def stg13_14_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = [(10, 0.05), (30, 0.03), (1e9, 0.01)]
    return rounded(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            st.impact_cost(F.col("l_extendedprice"), F.lit(1e6), F.lit(5.0)).alias("impact"),
            st.tiered_commission(F.col("l_quantity"), tiers, 0.35).alias("commission"),
        )
    )


@query(f"""WITH RECURSIVE {_RET}, v AS (SELECT symbol, day, y, m, row_number() OVER ({_W}) AS rn FROM p WHERE y IS NOT NULL), t AS (
 SELECT symbol, day, rn, y AS mx, m AS my, y * y AS mxx, m * m AS myy, y * m AS mxy, 1e0 AS w2 FROM v WHERE rn = 1 UNION ALL
 SELECT v.symbol, v.day, v.rn, mx + k * (v.y - mx), my + k * (v.m - my), mxx + k * (v.y * v.y - mxx), myy + k * (v.m * v.m - myy), mxy + k * (v.y * v.m - mxy), (1 - k) * (1 - k) * w2 + k * k
 FROM t JOIN (SELECT *, 2e0 / 11 AS k FROM v) v ON v.symbol = t.symbol AND v.rn = t.rn + 1)
 SELECT symbol, CAST(day AS VARCHAR) AS day, round(sqrt(greatest(mxx - mx * mx, 0) / (1 - w2) * 252), 5) AS vol_a, round(sqrt(greatest(myy - my * my, 0) / (1 - w2) * 252), 5) AS vol_b,
 round(greatest(-1, least(1, (mxy - mx * my) / sqrt(greatest(mxx - mx * mx, 0) * greatest(myy - my * my, 0)))), 5) AS corr, round(mx, 6) AS mean_a, round(my, 6) AS mean_b,
 round(greatest(-1, least(1, (mxy - mx * my) / sqrt(greatest(mxx - mx * mx, 0) * greatest(myy - my * my, 0)))) * sqrt(greatest(mxx - mx * mx, 0)) * sqrt(greatest(myy - my * my, 0)) / (1 - w2) * 252, 4) AS cov FROM t WHERE rn >= 5""")
def rsk02_03_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _panel(spark, sf_dir).where("y is not null").select("symbol", "day", "y", "m")
    out = st.ewma(p, "symbol", "day", "y", "m", span=10, least=5)
    five = lambda c: F.round(c, 5).alias(c)
    return _day(out.where("vol_a is not null"), five("vol_a"), five("vol_b"), five("corr"), "mean_a", "mean_b", F.round("cov", 4).alias("cov"))


@query(f"""WITH {_RET}, v AS (SELECT symbol, day, CASE WHEN count(y) OVER w >= 5 THEN stddev_samp(y) OVER w * sqrt(252) END AS vol, y FROM p WINDOW w AS ({_W} ROWS 9 PRECEDING)), k AS (SELECT *, row_number() OVER ({_W}) AS rn FROM v WHERE vol IS NOT NULL),
 q AS (SELECT a.symbol, a.day, a.vol, CASE WHEN count(*) = 8 THEN sum(CASE WHEN b.vol <= a.vol THEN 1 ELSE 0 END) / 8e0 END AS pct FROM k a JOIN k b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 7 AND a.rn GROUP BY ALL)
 SELECT symbol, CAST(day AS VARCHAR) AS day, round(greatest(vol, 0.01e0), 6) AS vol, round(pct, 6) AS pct, CASE WHEN pct IS NULL THEN 'unknown' WHEN pct <= 1e0 / 3 THEN 'low' WHEN pct >= 2e0 / 3 THEN 'high' ELSE 'mid' END AS regime FROM q""")
def rsk04_08_vol_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.trailing(Window.partitionBy("symbol").orderBy("day"), 10)
    v = _panel(spark, sf_dir).withColumn("vol", F.when(F.count("y").over(w) >= 5, F.stddev_samp("y").over(w) * 252**0.5)).where("vol is not null")
    out = windows.trailing_percentile(v, ["symbol"], "day", "vol", 8, "pct", strict=False)
    return _day(out, F.greatest("vol", F.lit(0.01)).alias("vol"), "pct", st.regime(F.col("pct")).alias("regime"))


_SIZERS = ("equal_dollar", "inverse_vol", "covariance_aware", "vol_target")
_H = "greatest(0.2e0, least(5e0, a / b))"
_SPREAD = f"greatest(a * a + {_H} * {_H} * b * b - 2 * {_H} * c * a * b, 1e-6)"
_SCALE = f"least(0.1e0 / sqrt({_SPREAD}), 2e0 / (1 + {_H}))"


@query(f"""WITH e AS (SELECT l_orderkey, l_linenumber, l_discount - 0.05e0 AS s, greatest(l_discount * 2, 0.01e0) AS a, greatest(l_tax * 3, 0.01e0) AS b, greatest(-1, least(1, l_quantity / 25 - 1)) AS c FROM lineitem), z AS (SELECT *, {_H} AS h, {_SCALE} AS k FROM e)
 SELECT l_orderkey, l_linenumber, round(sign(s) * 0.5e0, 6) AS equal_dollar_a, round(-sign(s) * 0.5e0, 6) AS equal_dollar_b, round(sign(s) * (1 / a) / (1 / a + 1 / b), 6) AS inverse_vol_a, round(-sign(s) * (1 / b) / (1 / a + 1 / b), 6) AS inverse_vol_b,
 round(sign(s) * k, 6) AS covariance_aware_a, round(-sign(s) * h * k, 6) AS covariance_aware_b, round(s * k, 6) AS vol_target_a, round(-s * h * k, 6) AS vol_target_b FROM z""")
def rsk07_pair_sizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") - 0.05).alias("s"), (F.col("l_discount") * 2).alias("a"), (F.col("l_tax") * 3).alias("b"), (F.col("l_quantity") / 25 - 1).alias("c"))  # noqa: E741
    out = []
    for method in _SIZERS:
        wa, wb = st.pair_weights(F.col("s"), F.col("a"), F.col("b"), F.col("c"), method)
        out += [(wa + 0.0).alias(f"{method}_a"), (wb + 0.0).alias(f"{method}_b")]
    return rounded(l.select("l_orderkey", "l_linenumber", *out))


@query(f"""WITH RECURSIVE {_RET}, v AS (SELECT symbol, day, CASE WHEN y > 0 THEN -1e-2 WHEN y < 0 THEN 1e-2 ELSE 0 END AS w, coalesce(last_value(dollar_volume IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), 0) * 1e-2 / 9700 AS lim, row_number() OVER ({_W}) AS rn FROM p),
 t AS (SELECT symbol, day, rn, greatest(-lim, least(lim, w)) AS capped FROM v WHERE rn = 1 UNION ALL SELECT v.symbol, v.day, v.rn,
 (CASE WHEN capped * w > 0 THEN CASE WHEN abs(w) >= abs(capped) THEN capped ELSE w END ELSE 0 END) + greatest(-lim, least(lim, w - (CASE WHEN capped * w > 0 THEN CASE WHEN abs(w) >= abs(capped) THEN capped ELSE w END ELSE 0 END)))
 FROM t JOIN v ON v.symbol = t.symbol AND v.rn = t.rn + 1) SELECT symbol, CAST(day AS VARCHAR) AS day, round(capped, 6) AS capped FROM t""")
def stg09_adv_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _panel(spark, sf_dir).withColumn("weight", F.when(F.col("y") > 0, -0.01).when(F.col("y") < 0, 0.01).otherwise(0.0))
    return _day(st.capped_weights(p.select("symbol", "day", "weight", "dollar_volume"), "symbol", "day", "weight", "dollar_volume", 9700.0), "capped")


def _psi_sql(column: str) -> str:
    low = ", ".join(f"{i / 10}" for i in range(1, 10))
    binned = lambda side: f"(SELECT len(list_filter(e, lambda x: x < {column})) AS bin, count(*) AS n FROM d, (SELECT quantile_disc({column}, [{low}]) AS e FROM d WHERE event_id % 2 = 0) WHERE event_id % 2 = {side} GROUP BY 1)"
    share = lambda side: f"(coalesce({'pq'[side]}.n, 0) + 0.5e0) / ((SELECT count({column}) FROM d WHERE event_id % 2 = {side}) + 5)"
    return f"""SELECT '{column}' AS "column", sum(({share(1)} - {share(0)}) * ln({share(1)} / {share(0)})) AS psi FROM range(10) t(bin) LEFT JOIN {binned(0)} p USING (bin) LEFT JOIN {binned(1)} q USING (bin)"""


@query(f"""WITH d AS (SELECT event_id, value, value + event_id % 2 * 30 AS moved, user_id FROM events), a AS ({' UNION ALL '.join(_psi_sql(c) for c in ('value', 'moved', 'user_id'))})
 SELECT "column", round(psi, 6) AS psi, psi >= 0.2 AS drifted, round(avg(CASE WHEN psi >= 0.2 THEN 1e0 ELSE 0 END) OVER (), 6) AS share, avg(CASE WHEN psi >= 0.2 THEN 1e0 ELSE 0 END) OVER () >= 0.5 AS dataset_drift FROM a""")
def mon02_drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("moved", F.col("value") + F.col("event_id") % 2 * 30)
    return rounded(x.drift_report(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["value", "moved", "user_id"]))


@query()
def rev03_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 rounds over all events."""
    return rounded(x.bootstrap_mean(events(spark, sf_dir), ["event_type"], "value", ["event_id"]))


@query(f"""WITH {DAILY}, c AS (SELECT day, count(DISTINCT symbol) AS a, count(DISTINCT CAST(dayofyear(day) AS BIGINT)) AS b FROM daily GROUP BY day)
 SELECT 'symbol' AS "column", round(avg(CASE WHEN a <= 1 THEN 1e0 ELSE 0 END), 6) AS share, avg(CASE WHEN a <= 1 THEN 1e0 ELSE 0 END) >= 0.9 AS market_wide FROM c
 UNION ALL SELECT 'doy', round(avg(CASE WHEN b <= 1 THEN 1e0 ELSE 0 END), 6), avg(CASE WHEN b <= 1 THEN 1e0 ELSE 0 END) >= 0.9 FROM c""")
def fea03_market_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("doy", F.dayofyear("day"))
    return rounded(x.market_wide_columns(d, "day", ["symbol", "doy"]))
