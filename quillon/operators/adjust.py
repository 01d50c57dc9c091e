"""Corporate-action adjustment and data-quality breaks of daily bars (symbol, day, open, close, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.functions.market import safe_ratio

EXPLAINED, PENDING = "SPLIT_EXPLAINED", "UNEXPLAINED_PENDING"


def split_factors(days: DataFrame, splits: DataFrame) -> DataFrame:
    """(symbol, day, factor): the product of a symbol's split ratios with ex_date strictly after the
    day. Days and splits form one stream per symbol that is read once from the latest date back, so
    it is one shuffle and one sort and no inequality join."""
    day = days.select("symbol", "day", F.lit(0.0).alias("ln"), F.lit(0).alias("is_split"))
    split = splits.groupBy("symbol", F.col("ex_date").alias("day")).agg(F.sum(F.log("split_ratio")).alias("ln"))
    both = day.unionByName(split.withColumn("is_split", F.lit(1)))
    # from the latest date; on one date the day comes before the split, which it must not count
    later = Window.partitionBy("symbol").orderBy(F.desc("day"), "is_split").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("factor", F.exp(F.sum("ln").over(later))).where("is_split = 0").select("symbol", "day", "factor")


def adjust_bars(daily: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars with factor, adj_open, adj_high, adj_low, adj_close and adj_volume."""
    day = daily.withColumns({"_ln": F.lit(0.0), "_split": F.lit(0)})
    split = splits.groupBy("symbol", F.col("ex_date").alias("day")).agg(F.sum(F.log("split_ratio")).alias("_ln")).withColumn("_split", F.lit(1))
    both = day.unionByName(split, allowMissingColumns=True)
    later = Window.partitionBy("symbol").orderBy(F.desc("day"), "_split").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("factor", F.exp(F.sum("_ln").over(later))).where("_split = 0").drop("_ln", "_split")
    prices = {f"adj_{c}": F.col(c) / F.col("factor") for c in ("open", "high", "low", "close")}
    return out.withColumns(prices | {"adj_volume": F.col("volume") * F.col("factor")})


def classify_breaks(daily: DataFrame, splits: DataFrame, least: float = 0.4, tolerance: float = 0.03) -> DataFrame:
    """Overnight jumps of at least `least`, explained by a split of the same day or pending; pending
    ones are masked."""
    w = Window.partitionBy("symbol").orderBy("day")
    jumps = daily.select("symbol", "day", safe_ratio(F.col("open"), F.lag("close").over(w)).alias("gross")).where(F.abs(F.col("gross") - 1) >= least)
    same = splits.select("symbol", F.col("ex_date").alias("day"), "split_ratio")
    out = jumps.join(same, ["symbol", "day"], "left")
    fits = F.coalesce(F.abs(F.col("gross") * F.col("split_ratio") - 1) <= tolerance, F.lit(False))
    return out.withColumns({"break_type": F.when(fits, EXPLAINED).otherwise(PENDING), "masked": ~fits})


def mask_returns(returns: DataFrame, breaks: DataFrame, column: str = "return_1d") -> DataFrame:
    """Returns with null on masked days, and is_data_quality_break."""
    hit = breaks.where("masked").select("symbol", "day").distinct().withColumn("_hit", F.lit(True))
    out = returns.join(hit, ["symbol", "day"], "left").withColumn("is_data_quality_break", F.col("_hit").isNotNull())
    return out.withColumn(column, F.when(~F.col("is_data_quality_break"), F.col(column))).drop("_hit")


def merge_breaks(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored breaks (symbol, day, break_type, masked, reviewed_by, ...) after a new detection: a reviewed row stays
    as it is, even where the break is no longer found; others are replaced, and go where they are not found."""
    reviewed = stored.where("reviewed_by is not null")
    fresh = found.join(reviewed.select("symbol", "day"), ["symbol", "day"], "left_anti")
    return reviewed.unionByName(fresh, allowMissingColumns=True)


def action_universe(*parts: DataFrame) -> DataFrame:
    """(symbol) once each, in normal form, of all the tables that need corporate actions."""
    out = parts[0].select(F.col("symbol"))
    for p in parts[1:]:
        out = out.unionByName(p.select("symbol"))
    return out.select(F.nullif(F.upper(F.trim("symbol")), F.lit("")).alias("symbol")).where("symbol is not null").distinct()


def suspected_splits(daily: DataFrame, tolerance: float = 0.03, most: int = 20) -> DataFrame:
    """Days whose close is near a simple multiple or fraction of the close before."""
    w = Window.partitionBy("symbol").orderBy("day")
    ratio = safe_ratio(F.lag("close").over(w), F.col("close"))
    step = daily.withColumn("ratio", ratio)
    inverse = safe_ratio(F.lit(1.0), F.col("ratio"))
    whole = F.round(F.greatest("ratio", inverse))
    near = (whole.between(2, most)) & (F.abs(F.greatest("ratio", inverse) / whole - 1) <= tolerance)
    return step.where(near).withColumn("suspected", F.when(F.col("ratio") > 1, whole).otherwise(1 / whole))
