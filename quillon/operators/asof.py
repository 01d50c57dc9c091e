"""As-of, interval and range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.market import ny_date
from quillon.sources import scratch


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, columns: Sequence[str], ties: Sequence[str] = (), exact: bool = True, tolerance: str | None = None) -> DataFrame:
    """Each left row with `columns` (and right_ts) of the latest right row of its key at or before
    its time (before, if not exact), within the tolerance; nulls where there is none. Of right rows
    at one time the last in the order of ties counts.

    Both sides are put in one stream per key and read once in order: one shuffle by the key, one
    sort, no inequality join, so the cost is linear whatever the match counts."""
    carried = F.struct(F.col(right_ts).alias("_at"), *[F.col(c) for c in columns])
    order_ties = F.struct(*[F.col(c) for c in ties]) if ties else F.lit(None).cast("struct<_none:int>")
    r = right.where(F.col(right_ts).isNotNull()).select(*by, F.col(right_ts).alias("_ts"), F.lit(0 if exact else 1).alias("_side"), order_ties.alias("_tie"), carried.alias("_r"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_l"))
    l = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(1 if exact else 0).alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_l"))  # noqa: E741
    w = Window.partitionBy(*by).orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    joined = r.unionByName(l).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    found = F.col("_m")
    if tolerance is not None:
        found = F.when(F.col("_m._at") >= F.col("_ts") - F.expr(f"INTERVAL {tolerance}"), F.col("_m"))
    joined = joined.withColumn("_m", found)
    return joined.select("_l.*", F.col("_m._at").alias(right_ts), *[F.col(f"_m.{c}").alias(c) for c in columns])


def asof_by_day(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, columns: Sequence[str]) -> DataFrame:
    """As-of join for keys of which a few hold much of the rows; of right rows of a key at one time the
    largest values count.

    Both sides are joined as of within their key and day, and a row before the first value of its day takes
    the key's last one of the days before. So a hot key is dealt by day, and only a row per key and day goes
    through the window that carries values over."""
    day = lambda c: F.to_date(F.col(c))
    series = right.where(F.col(right_ts).isNotNull()).groupBy(*by, right_ts).agg(*[F.max(c).alias(c) for c in columns]).withColumn("_day", day(right_ts))
    per_day = series.groupBy(*by, "_day").agg(F.max_by(F.struct(right_ts, *columns), right_ts).alias("_v"))
    days = per_day.unionByName(left.select(*by, day(left_ts).alias("_day")).distinct().withColumn("_v", F.lit(None).cast(per_day.schema["_v"].dataType)))
    days = days.groupBy(*by, "_day").agg(F.max("_v").alias("_v"))
    before = F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    inside = asof_join(left.withColumn("_day", day(left_ts)), series, [*by, "_day"], left_ts, right_ts, columns)
    start = inside.join(days.select(*by, "_day", before.alias("_before")), [*by, "_day"], "left")
    found = F.col(right_ts).isNotNull()
    pick = lambda c: F.when(found, F.col(c)).otherwise(F.col(f"_before.{c}")).alias(c)
    return start.select(*left.columns, pick(right_ts), *[pick(c) for c in columns])


def asof_global(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, columns: Sequence[str]) -> DataFrame:
    """As-of join without a key, for a market-wide series: time itself is the key (see asof_by_day()), and
    only a row per day goes through a window without one."""
    return asof_by_day(left, right, [], left_ts, right_ts, columns)


#: Children of a node, levels, and microseconds of a leaf of the tree of time that interval_join() uses: its
#: root spans 1,914 years from 1014 on.
FAN, LEVELS, LEAF = 16, 6, 3_600_000_000


def _leaf(ts: Column) -> Column:
    """The leaf of an instant, within the tree."""
    at = F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(LEAF)) + FAN**LEVELS // 2
    return F.least(F.greatest(at, F.lit(0)), F.lit(FAN**LEVELS - 1))


def _node(level: int):
    return lambda n: F.struct(F.lit(level).alias("_level"), n.alias("_node"))


def _cover(first: Column, last: Column) -> Column:
    """The fewest nodes (level, node) whose leaves are exactly those from first to last: at each level the
    nodes inside whose parent is not inside, at most 2 * (FAN - 1) of them."""
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    parts = []
    for level in range(LEVELS + 1):
        size, wide = FAN**level, FAN ** (level + 1)
        a, b = F.ceil(first / size), F.floor((last + 1) / size) - 1
        up_a, up_b = F.ceil(first / wide), F.floor((last + 1) / wide) - 1
        inside = up_a <= up_b
        if level == LEVELS:
            inside = F.lit(False)
        left = span(a, F.when(inside, F.least(b, up_a * FAN - 1)).otherwise(b))
        right = F.when(inside, span(F.greatest(a, (up_b + 1) * FAN), b)).otherwise(F.array().cast("array<bigint>"))
        parts.append(F.transform(F.concat(left, right), _node(level)))
    return F.flatten(F.array(*parts))


def interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, start: str, end: str, how: str = "left") -> DataFrame:
    """Points with the half-open intervals [start, end) of their key that hold them; a null end is
    open, a null start or an empty interval holds nothing, null keys match nothing. how: inner or left.

    Time is a tree: an interval is cut into the fewest nodes that cover its leaves, a point is under one
    node of each level, and the two meet by an equi-join on (key, level, node). A pair meets in one node at
    most, so the work is the points, the intervals and the matches, not points times intervals of a key;
    a leaf's ends are compared exactly."""
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join {how}")
    keys = [f"_k{i}" for i in range(len(by))]
    extra = [c for c in intervals.columns if c not in by]
    numbered = points.withColumn("_row", F.monotonically_increasing_id())
    if how == "left":
        numbered = scratch.cut(numbered)  # the ids are read twice
    leaf = _leaf(F.col(at))
    p = numbered.where(F.col(at).isNotNull()).select(F.struct(*points.columns, "_row").alias("_p"), *[F.col(c).alias(k) for c, k in zip(by, keys)], F.explode(F.array(*[F.struct(F.lit(i).alias("_level"), F.floor(leaf / FAN**i).alias("_node")) for i in range(LEVELS + 1)])).alias("_n"))
    there = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    last = F.when(F.col(end).isNull(), F.lit(FAN**LEVELS - 1)).otherwise(_leaf(F.col(end)))
    i = there.select(F.struct(*extra).alias("_i"), *[F.col(c).alias(k) for c, k in zip(by, keys)], F.explode(_cover(_leaf(F.col(start)), last)).alias("_n"))
    flat = lambda df, name: df.select(name, *keys, "_n._level", "_n._node")
    here = (F.col(f"_p.{at}") >= F.col(f"_i.{start}")) & (F.col(f"_i.{end}").isNull() | (F.col(f"_p.{at}") < F.col(f"_i.{end}")))
    met = flat(p, "_p").join(flat(i, "_i"), [*keys, "_level", "_node"]).where(here).select("_p.*", *[F.col(f"_i.{c}").alias(c) for c in extra])
    if how == "inner":
        return met.drop("_row")
    alone = numbered.join(met.select("_row"), "_row", "left_anti")
    return met.unionByName(alone, allowMissingColumns=True).drop("_row")


def next_outcome(df: DataFrame, by: Sequence[str], ts: str, value: str, most: str) -> DataFrame:
    """Each row with the next row's time and value of its key, where that is within `most`."""
    w = Window.partitionBy(*by).orderBy(ts)
    close = F.lead(ts).over(w) <= F.col(ts) + F.expr(f"INTERVAL {most}")
    step = df.withColumns({"_t": F.when(close, F.lead(ts).over(w)), "_v": F.when(close, F.lead(value).over(w))})
    return step.withColumnsRenamed({"_t": f"next_{ts}", "_v": f"next_{value}"})


def snapshot_labels(df: DataFrame, by: Sequence[str], ts: str, ret: str, horizon_s: int = 1800, tolerance_s: int = 60) -> DataFrame:
    """label (1 if the next snapshot's return is positive, else 0) and label_ts, where the next snapshot of the
    key is horizon plus or minus tolerance away, on the same New York day, and has a return."""
    w = Window.partitionBy(*by).orderBy(ts)
    step = df.withColumns({"_t": F.lead(ts).over(w), "_r": F.lead(ret).over(w)})
    gap = (F.unix_micros("_t") - F.unix_micros(F.col(ts))) / 1e6
    good = gap.between(horizon_s - tolerance_s, horizon_s + tolerance_s) & (ny_date(F.col("_t")) == ny_date(F.col(ts))) & F.col("_r").isNotNull()
    return step.withColumns({"label": F.when(good, (F.col("_r") > 0).cast("double")), "label_ts": F.when(good, F.col("_t"))}).drop("_t", "_r")


def daily_close_pairs(df: DataFrame, closes: DataFrame, ts: str, most_days: int = 5) -> DataFrame:
    """Each prediction with its entry, the last close (symbol, trade_date, close, close_ts) known at ts, and its
    outcome, the symbol's next close, where that is at most so many days later; label 1 if it rose."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    ahead = closes.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("trade_date", "close", "close_ts")})
    carried = ["trade_date", "close", "next_trade_date", "next_close", "next_close_ts"]
    out = asof_join(df, ahead, ["symbol"], ts, "close_ts", carried)
    near = F.datediff("next_trade_date", "trade_date").between(1, most_days)
    keep = lambda c: F.when(near, F.col(c))
    return out.select(
        *df.columns, F.col("trade_date").alias("entry_trade_date"), F.col("close").alias("entry_close"), F.col("close_ts").alias("entry_close_ts"), keep("next_trade_date").alias("outcome_trade_date"),
        keep("next_close").alias("outcome_close"), keep("next_close_ts").alias("outcome_close_ts"), keep("next_close_ts").alias("label_ts"), F.when(near, (F.col("next_close") > F.col("close")).cast("double")).alias("label"),
    )


def assemble(bars: DataFrame, sources: Sequence[tuple[DataFrame, Sequence[str], str, Sequence[str]]], ts: str) -> DataFrame:
    """bars with the columns of each source (frame, keys, availability column, columns) as of ts, its availability,
    and max_available_ts, the latest of all. A source without keys is market-wide."""
    out, stamps = bars, []
    for i, (df, keys, stamp, columns) in enumerate(sources):
        name = f"source{i}_available_ts"
        named = df.withColumnRenamed(stamp, name)
        out = asof_join(out, named, keys, ts, name, columns) if keys else asof_global(out, named, ts, name, columns)
        stamps.append(F.col(name))
    return out.withColumn("max_available_ts", F.greatest(*stamps) if len(stamps) > 1 else stamps[0])


def last_before(df: DataFrame, by: Sequence[str], order: Column, column: str) -> Column:
    """The last value that is there at or before a row."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
