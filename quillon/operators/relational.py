"""Validation with quarantine, session and quote flags, set operations and idempotent DML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


# -- validation -------------------------------------------------------------------------------


#: The tokens of a quarantined bar, in the order of the rules.
QUARANTINE_TOKENS = ["null_price", "high_below_open_close", "low_above_open_close", "negative_volume"]
#: The tokens of a streamed bar's faults, and the time spans that are known.
REASON_TOKENS = [
    "missing_symbol", "invalid_event_ts", "missing_timespan", "unsupported_timespan", "invalid_open", "invalid_high", "invalid_low",
    "invalid_close", "high_below_low", "high_below_components", "low_above_components", "negative_price", "negative_volume",
    "negative_trade_count", "vwap_out_of_range",
]
TIMESPANS = ["minute", "hour", "day"]


def broken_rules() -> list[Column]:
    """For each of QUARANTINE_TOKENS whether a bar (open, high, low, close, volume) breaks the rule. A
    rule about a missing value is not broken."""
    prices = [F.col(n) for n in ("open", "high", "low", "close")]
    o, h, l, c = prices  # noqa: E741
    missing = o.isNull() | h.isNull() | l.isNull() | c.isNull()
    return [missing, h < F.greatest(o, c), l > F.least(o, c), F.col("volume") < 0]


def quarantine_reason() -> Column:
    """The first rule that a bar breaks; `unknown` where it breaks none, so that a bar quarantined for
    another cause has a reason as well."""
    reason = F.lit("unknown")
    for token, broken in reversed(list(zip(QUARANTINE_TOKENS, broken_rules()))):
        reason = F.when(broken, token).otherwise(reason)
    return reason


def split_valid(bars: DataFrame, universe: DataFrame | None = None, key: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with reason), of the universe's symbols alone if one is given. One
    expression decides both, so no row is in both or in neither."""
    bars = bars if universe is None else in_universe(bars, universe, key)
    bad = F.lit(False)
    for broken in broken_rules():
        bad = bad | F.coalesce(broken, F.lit(False))
    marked = bars.withColumn("_bad", bad)
    return marked.where("not _bad").drop("_bad"), marked.where("_bad").drop("_bad").withColumn("reason", quarantine_reason())


def finite(c: Column) -> Column:
    """A number that is neither null, NaN nor infinite; else null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def reason_codes() -> Column:
    """All rules a streamed bar breaks, as a sorted array of REASON_TOKENS; an empty array means valid. A
    number that is missing or not finite is invalid as a price and no fault as volume, vwap or trade
    count; a price of zero is none either. Rules between prices need all four."""
    o, h, l, c = (finite(F.col(n)) for n in ("open", "high", "low", "close"))  # noqa: E741
    vwap, volume, trades = (finite(F.col(n)) for n in ("vwap", "volume", "trade_count"))
    blank = lambda n: F.col(n).isNull() | (F.trim(F.col(n).cast("string")) == "")
    span = F.lower(F.trim("timespan"))
    all_four = o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()
    broken = [
        blank("symbol"), F.col("event_ts").isNull(), blank("timespan"), ~blank("timespan") & ~span.isin(*TIMESPANS), o.isNull(), h.isNull(), l.isNull(),
        c.isNull(), all_four & (h < l), all_four & (h < F.greatest(o, c, l)), all_four & (l > F.least(o, c, h)), all_four & (F.least(o, h, l, c) < 0),
        volume < 0, trades < 0, (vwap < l) | (vwap > h),
    ]
    return F.array_sort(F.array_compact(F.array(*[F.when(rule, token) for token, rule in zip(REASON_TOKENS, broken)])))


def record_reasons(record: Column) -> Column:
    """reason_codes() of a record column's fields (select them first as columns); a record that is null as
    a whole has the one reason `null_record`."""
    return F.when(record.isNull(), F.array(F.lit("null_record"))).otherwise(reason_codes())


def stale(ts: Column, batch_ts: Column, minutes: int = 15) -> Column:
    return ts < batch_ts - F.expr(f"INTERVAL {minutes} MINUTES")


def locked(bid: Column, ask: Column) -> Column:
    """Bid and ask are one. Without a bid it is not locked; with a bid and no ask it is not known (null)."""
    return bid.isNotNull() & (bid == ask)


def crossed(bid: Column, ask: Column) -> Column:
    """The bid is above the ask; not so where either is missing."""
    return bid.isNotNull() & ask.isNotNull() & (bid > ask)


def classify(value: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern (a case-insensitive alternation) found in value."""
    out = None
    for pattern, label in rules:
        hit = value.rlike(f"(?i){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


#: Words in the upper-cased name of a futures market and the class they put it in, in order; a market
#: with none of them is `other`.
MARKET_CLASSES = [
    ("equity_index", ["S&P", "E-MINI", "NASDAQ", "DOW JONES", "DJIA", "RUSSELL", "MSCI", "NIKKEI", "VIX"]),
    ("rate", ["UST", "SOFR", "FED FUNDS", "ERIS", "EURO SHORT TERM RATE"]),
    ("crypto", ["BITCOIN", "ETHER"]),
    ("fx", ["DOLLAR", "POUND", "YEN", "FRANC", "PESO", "REAL", "RAND", "XRATE", "USD INDEX"]),
    ("commodity", ["COMMODITY"]),
]


def market_class(name: Column) -> Column:
    """The class of a futures market by its name; a missing name is `other`."""
    upper, out = F.upper(name), F.lit("other")
    for label, words in reversed(MARKET_CLASSES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.coalesce(F.contains(upper, F.lit(w)), F.lit(False))
        out = F.when(hit, label).otherwise(out)
    return out


# -- joins and sets ---------------------------------------------------------------------------


def in_universe(df: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    return df.join(universe.select(key), key, "left_semi")


def new_rows(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a batch whose key the target lacks, once each."""
    return batch.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def orphans(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(side, n): how many keys each side has that the other lacks, in one aggregate over both."""
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    seen = both.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.agg(F.count_if(F.col("r") == 0).alias("left_only"), F.count_if(F.col("l") == 0).alias("right_only"), F.count_if(F.col("l") + F.col("r") == 2).alias("common"))


def either_end(edges: DataFrame, nodes: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    """Edges with either end among nodes: two equi-joins instead of one with OR, each edge once."""
    n = nodes.select(F.col(key).alias("_node")).distinct()
    hit_src = edges.join(n, edges[src] == n["_node"], "left_semi")
    hit_dst = edges.join(n, edges[dst] == n["_node"], "left_semi")
    return hit_src.unionByName(hit_dst).distinct()


def overlap_ratio(current: Column, previous: Column) -> Column:
    """Share of the current set that the previous one has; null for an empty current set."""
    return F.size(F.array_intersect(current, previous)) / F.nullif(F.size(F.array_distinct(current)), F.lit(0))


# -- DML on tables without MERGE --------------------------------------------------------------


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows replace target rows of their key; others stay. Twice is as once. Keys are compared
    null-safe."""
    hit = F.lit(True)
    for k in keys:
        hit = hit & target[k].eqNullSafe(source[k])
    return target.join(source, hit, "left_anti").unionByName(source)


def reconcile_to_source(target: DataFrame, source: DataFrame, keys: Sequence[str], within: Column | None = None) -> DataFrame:
    """Upsert that also deletes target rows whose key the source lacks: with `within` (a condition on the
    target), only the rows it holds for can be deleted. Keys are compared null-safe. With no source row,
    the whole range goes."""
    hit = F.lit(True)
    for k in keys:
        hit = hit & target[k].eqNullSafe(source[k])
    kept = target.join(source, hit, "left_anti")
    spared = kept.where(~F.coalesce(within, F.lit(False))) if within is not None else kept.limit(0)
    return spared.unionByName(source)


def insert_only(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first write of a key wins."""
    return target.unionByName(new_rows(source, target, keys))


def conditional_update(target: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str], unless: Column) -> DataFrame:
    """Upsert that leaves target rows alone where `unless` (over their columns) holds."""
    t, s = target.withColumns({"_t": F.lit(True), "_keep": F.coalesce(unless, F.lit(False))}), source.withColumn("_s", F.lit(True))
    both = t.alias("t").join(s.alias("s"), list(keys), "full_outer")
    pick = lambda c: F.when(F.col("_keep") | F.col("_s").isNull(), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    rest = [F.col(f"t.{c}") for c in target.columns if c not in keys and c not in values]
    return both.select(*keys, *[pick(c) for c in values], *rest)


def replace_partitions(target: DataFrame, source: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Target with the partitions that source has replaced by it."""
    return target.join(source.select(*partition).distinct(), list(partition), "left_anti").unionByName(source)


def drop_stale_sessions(target: DataFrame, source: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """Target rows without those whose key source has with another stamp."""
    s = source.select(*keys, F.col(stamp).alias("_stamp")).distinct()
    hit = F.lit(True)
    for k in keys:
        hit = hit & (target[k] == s[k])
    return target.join(s, hit & (target[stamp] != s["_stamp"]), "left_anti")


def with_columns_of(df: DataFrame, other: DataFrame) -> DataFrame:
    """df with the columns of other that it lacks, as nulls of their type."""
    lack = {f.name: F.lit(None).cast(f.dataType) for f in other.schema if f.name not in df.columns}
    return df.withColumns(lack) if lack else df


def schema_difference(df: DataFrame, expected: DataFrame) -> tuple[list[str], list[str]]:
    """(missing, extra) columns by name and type."""
    have, want = set(df.dtypes), set(expected.dtypes)
    return sorted(f"{n}:{t}" for n, t in want - have), sorted(f"{n}:{t}" for n, t in have - want)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def top_share(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Share of the k largest values of each key in its total. Only k values of a key are held."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value))
    top = df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).groupBy(*keys).agg(F.sum(value).alias("_top"))
    total = df.groupBy(*keys).agg(F.sum(value).alias("_all"))
    return top.join(total, list(keys)).select(*keys, (F.col("_top") / F.nullif(F.col("_all"), F.lit(0.0))).alias("share"))
