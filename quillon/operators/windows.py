"""Rolling features over ordered series. Every operator shuffles once, by its key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from quillon.functions.market import positive_log, safe_ratio


def trailing(base: WindowSpec, rows: int, current: bool = True) -> WindowSpec:
    """The last `rows` rows, with or without the current one."""
    return base.rowsBetween(-(rows - 1), 0) if current else base.rowsBetween(-rows, -1)


def gated(value: Column, over: Column, window: WindowSpec, rows: int) -> Column:
    """value over window where all `rows` entries of `over` are there, else null."""
    return F.when(F.count(over).over(window) == rows, value.over(window))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def bar_features(bars: DataFrame) -> DataFrame:
    """Returns, log returns, session extremes, volatility, average range, RSI, VWAP deviation and
    relative volume of (symbol, day, event_ts, high, low, close, volume, vwap). RSI is 100 where the
    mean loss is 0, first bars included; averages are not gated on full windows."""
    day = Window.partitionBy("symbol", "day").orderBy("event_ts")
    running = day.rowsBetween(Window.unboundedPreceding, 0)
    c = F.col("close")
    back = lambda n: safe_ratio(c, F.lag("close", n).over(day)) - 1
    step = bars.withColumns(
        {f"r{n}": back(n) for n in (1, 5, 15, 30)}
        | {
            "log_r1": positive_log(safe_ratio(c, F.lag("close", 1).over(day))),
            "session_high": F.max("high").over(running),
            "session_low": F.min("low").over(running),
        }
    )
    gain = F.when(F.col("r1") > 0, F.col("r1")).otherwise(0.0)
    loss = F.when(F.col("r1") < 0, -F.col("r1")).otherwise(0.0)
    w14 = trailing(day, 14)
    up, down = F.avg(gain).over(w14), F.avg(loss).over(w14)
    return step.withColumns(
        {f"rvol{n}": F.stddev_samp("r1").over(trailing(day, n)) for n in (5, 15, 30)}
        | {
            "atr14": F.avg(F.col("high") - F.col("low")).over(w14),
            "rsi14": F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0)))),
            "vwap_dev": safe_ratio(c - F.col("vwap"), F.col("vwap")),
            "rel_volume": safe_ratio(F.col("volume"), F.avg("volume").over(trailing(day, 20))),
            "to_high": safe_ratio(c - F.col("session_high"), F.col("session_high")),
            "to_low": safe_ratio(c - F.col("session_low"), F.col("session_low")),
        }
    )


def trailing_zscore(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int, out: str) -> DataFrame:
    """(value - trailing mean) / trailing deviation, only where all rows of the window have a value."""
    w = trailing(Window.partitionBy(*keys).orderBy(order), rows)
    z = safe_ratio(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    return df.withColumn(out, F.when(F.count(value).over(w) == rows, z))


def trailing_percentile(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int, out: str, strict: bool = True) -> DataFrame:
    """Share of the window's values strictly below the current one among the others, or, not strict,
    at most the current one among all; only where the window is full. The window is an array of
    `rows` values, so the cost is linear in rows of data and no self-join is made."""
    w = trailing(Window.partitionBy(*keys).orderBy(order), rows)
    df = df.withColumn("_held", F.collect_list(value).over(w))
    v = F.col(value)
    below = F.size(F.filter("_held", (lambda x: x < v) if strict else (lambda x: x <= v))).cast("double")
    full = F.size("_held") == rows
    return df.withColumn(out, F.when(full, below / (rows - 1 if strict else rows))).drop("_held")


def trailing_median(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int, out: str) -> DataFrame:
    """Exact median of the `rows` rows before the current one, where all of them have a value."""
    w = trailing(Window.partitionBy(*keys).orderBy(order), rows, current=False)
    return df.withColumn(out, F.when(F.count(value).over(w) == rows, F.percentile(value, 0.5).over(w)))


def universe_screen(daily: DataFrame, rows: int, recent: int, least_recent: int, top: int) -> DataFrame:
    """The top symbols of each day by trailing median of dollar volume over the `rows` days before,
    with a value on least_recent of the last `recent` days. daily: symbol, day, dollar_volume, on a
    dense grid (null where a symbol did not trade). Ranks tie by symbol."""
    base = Window.partitionBy("symbol").orderBy("day")
    seen = F.count("dollar_volume").over(trailing(base, recent, current=False))
    step = trailing_median(daily, ["symbol"], "day", "dollar_volume", rows, "median_volume").withColumn("recent", seen)
    order = Window.partitionBy("day").orderBy(F.desc("median_volume"), "symbol")
    kept = step.where((F.col("recent") >= least_recent) & F.col("median_volume").isNotNull())
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def cumulative_return(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Compounded return so far; null from the first return of -1 or less on."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    poisoned = F.max(F.coalesce(F.col(value) <= -1, F.lit(False))).over(w)
    total = F.sum(F.when(F.col(value) > -1, F.log1p(F.col(value)))).over(w)
    return df.withColumn(out, F.when(~poisoned, F.exp(total) - 1))


def relative_performance(df: DataFrame, benchmark: str, day: str, value: str) -> DataFrame:
    """symbol's compounded return less the benchmark's, by day, where both have one; rows without a return play no part,
    and a return of -1 or less leaves nothing to compare from then on."""
    known = cumulative_return(df.where(F.col(value).isNotNull()), ["symbol"], day, value, "_total")
    base = known.where(F.col("symbol") == benchmark).select(day, F.col("_total").alias("_base"))
    return known.join(base, day).withColumn("relative", F.col("_total") - F.col("_base")).drop("_total", "_base")


def momentum_risk(df: DataFrame, rows: int = 20, year: int = 252) -> DataFrame:
    """Momentum, annualised volatility and drawdown of (symbol, day, close)."""
    base = Window.partitionBy("symbol").orderBy("day")
    step = df.withColumn("r", safe_ratio(F.col("close"), F.lag("close").over(base)) - 1)
    peak = F.max("close").over(base.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumns(
        {
            "momentum": safe_ratio(F.col("close"), F.lag("close", rows).over(base)) - 1,
            "realised_vol": gated(F.stddev_samp("r"), F.col("r"), trailing(base, rows), rows) * float(year) ** 0.5,
            "drawdown": safe_ratio(F.col("close"), peak) - 1,
        }
    )


def breadth_features(df: DataFrame, day: str, wide: str, narrow: str, rows: int = 50, back: int = 20, long: int = 252) -> DataFrame:
    """ratio (wide over narrow series), its mean over `rows` and z-score over `long` rows (null before the
    window is full of ratios), slope and excess return over `back` rows, and the breadth regime, of a
    market-wide table with a row per day (so its window has no key)."""
    order = Window.orderBy(day)
    step = df.withColumn("ratio", safe_ratio(F.col(wide), F.col(narrow)))
    ratio = F.col("ratio")
    back_return = lambda c: safe_ratio(F.col(c), F.lag(c, back).over(order)) - 1
    far = trailing(order, long)
    z = safe_ratio(ratio - F.avg(ratio).over(far), F.stddev_samp(ratio).over(far))
    step = step.withColumns(
        {
            "sma": gated(F.avg(ratio), ratio, trailing(order, rows), rows),
            "zscore": F.when(F.count(ratio).over(far) == long, z),
            "slope": back_return("ratio"),
            "excess": back_return(wide) - back_return(narrow),
        }
    )
    return step.withColumn("regime", breadth_regime(ratio, F.col("sma"), F.col("slope")))


def breadth_regime(ratio: Column, mean: Column, slope: Column) -> Column:
    """BROAD above the mean and rising, NARROW below it and falling, else MIXED, also where one is not
    known."""
    return F.when((ratio > mean) & (slope > 0), "BROAD").when((ratio < mean) & (slope < 0), "NARROW").otherwise("MIXED")
