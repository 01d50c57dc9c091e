"""Labels, neutralisation, cross-validation and evaluation over long frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.market import safe_ratio
from quillon.operators.windows import trailing


def forward_labels(df: DataFrame, by: Sequence[str], ts: str, close: str, horizon: int) -> DataFrame:
    """forward_return, label (1 if it is positive) and label_end of the row `horizon` rows on."""
    w = Window.partitionBy(*by).orderBy(ts)
    ahead = safe_ratio(F.lead(close, horizon).over(w), F.col(close)) - 1
    step = df.withColumns({"forward_return": ahead, "label_end": F.lead(ts, horizon).over(w)})
    return step.withColumn("label", F.when(F.col("forward_return").isNotNull(), (F.col("forward_return") > 0).cast("int")))


def triple_barrier(df: DataFrame, by: Sequence[str], ts: str, close: str, horizon: int, vol_rows: int, up: float = 1.0, down: float = 1.0) -> DataFrame:
    """label 1 / -1 for the barrier touched first within `horizon` rows, 0 for neither; barriers are
    multiples of the trailing deviation of returns. Rows without a full path or a positive deviation
    are left out. The path is an array of `horizon` closes: no self-join."""
    w = Window.partitionBy(*by).orderBy(ts)
    step = df.withColumn("_r", safe_ratio(F.col(close), F.lag(close).over(w)) - 1)
    full = F.count("_r").over(trailing(w, vol_rows)) == vol_rows
    step = step.withColumns(
        {
            "vol": F.when(full, F.stddev_samp("_r").over(trailing(w, vol_rows))),
            "_path": F.collect_list(F.struct(F.col(close).alias("c"), F.col(ts).alias("t"))).over(w.rowsBetween(1, horizon)),
        }
    ).where((F.col("vol") > 0) & (F.size("_path") == horizon) & (F.col(close) != 0))
    step = step.withColumn("_moves", F.transform("_path", lambda x: safe_ratio(x["c"], F.col(close)) - 1))
    first = lambda hit: F.coalesce(F.array_position(F.transform("_moves", hit), True), F.lit(0))
    step = step.withColumns({"_u": first(lambda x: x >= up * F.col("vol")), "_d": first(lambda x: x <= -down * F.col("vol"))})
    never = horizon + 1
    step = step.withColumns({"_u": F.when(F.col("_u") == 0, never).otherwise(F.col("_u")), "_d": F.when(F.col("_d") == 0, never).otherwise(F.col("_d"))})
    hit = F.when(F.col("_u") == F.col("_d"), horizon).otherwise(F.least("_u", "_d")).cast("int")
    label = F.when(F.col("_u") < F.col("_d"), 1).when(F.col("_d") < F.col("_u"), -1).otherwise(0)
    out = step.withColumns({"label": label, "_hit": hit})
    return out.withColumns({"forward_return": F.element_at("_moves", F.col("_hit")), "label_end": F.element_at("_path", F.col("_hit"))["t"]}).drop("_r", "_path", "_moves", "_u", "_d", "_hit")


def uniqueness_weights(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """weight: the mean, over the key's start and end times within a label's span, of one over the
    number of spans open there. Counts come from running sums of starts and ends; a span's mean is a
    difference of two prefix sums, so nothing is joined by range."""
    ends = df.select(*by, F.col(start).alias("_t"), F.lit(1).alias("_s"), F.lit(0).alias("_e")).unionByName(df.select(*by, F.col(end).alias("_t"), F.lit(0).alias("_s"), F.lit(1).alias("_e")))
    grid = ends.groupBy(*by, "_t").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"))
    w = Window.partitionBy(*by).orderBy("_t")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_open", F.sum("_s").over(upto) - F.coalesce(F.sum("_e").over(before), F.lit(0)))
    grid = grid.withColumns({"_inv": F.sum(1.0 / F.col("_open")).over(upto), "_own": 1.0 / F.col("_open"), "_n": F.row_number().over(w)}).select(*by, "_t", "_inv", "_own", "_n")
    a = grid.withColumnsRenamed({"_t": start, "_inv": "_inv0", "_own": "_own0", "_n": "_n0"})
    b = grid.withColumnsRenamed({"_t": end, "_inv": "_inv1", "_own": "_own1", "_n": "_n1"})
    out = df.join(a, [*by, start]).join(b, [*by, end])
    mean = (F.col("_inv1") - F.col("_inv0") + F.col("_own0")) / (F.col("_n1") - F.col("_n0") + 1)
    return out.withColumn("weight", mean).drop("_inv0", "_own0", "_n0", "_inv1", "_own1", "_n1")


def market_wide_columns(df: DataFrame, ts: str, columns: Sequence[str], least: float = 0.9) -> DataFrame:
    """(column, share, market_wide): in what share of timestamps a column has one value."""
    per = df.groupBy(ts).agg(*[F.countDistinct(c).alias(c) for c in columns])
    one = per.agg(*[F.avg((F.col(c) <= 1).cast("double")).alias(c) for c in columns])
    stacked = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {stacked}) as (column, share)").withColumn("market_wide", F.col("share") >= least)


def neutralize(df: DataFrame, ts: str, value: str, beta: str, group: str, out: str = "residual") -> DataFrame:
    """The least-squares residual of value on beta and group dummies, per timestamp, without an
    intercept. Demeaning by group takes the dummies out exactly, which leaves a ratio of two sums: no
    Python and no matrix. One value for a group leaves 0."""
    g = Window.partitionBy(ts, group)
    step = df.withColumns({"_y": F.col(value) - F.avg(value).over(g), "_x": F.col(beta) - F.avg(beta).over(g)})
    t = Window.partitionBy(ts)
    slope = F.coalesce(safe_ratio(F.sum(F.col("_x") * F.col("_y")).over(t), F.sum(F.col("_x") * F.col("_x")).over(t)), F.lit(0.0))
    return step.withColumn(out, F.col("_y") - slope * F.col("_x")).drop("_x", "_y")


def walk_forward(df: DataFrame, ts: str, folds: int, end: str | None = None, embargo: int = 0) -> DataFrame:
    """(fold, side, ...): expanding splits over the ranks of timestamps: fold f tests the f-th of
    folds + 1 equal parts on what lies before. With `end`, training rows whose label span reaches
    into the test part are purged; `embargo` timestamps before it stay out, too."""
    stamps = df.select(ts).distinct()
    order = Window.orderBy(ts)  # a row per timestamp
    ranked = stamps.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy()))
    ranked = ranked.withColumn("_part", F.floor((F.col("_k") - 1) * (folds + 1) / F.col("_n")).cast("int"))
    starts = ranked.groupBy("_part").agg(F.min(ts).alias("_start"), F.min("_k").alias("_first"))
    rows = df.join(ranked.select(ts, "_k", "_part"), ts)
    fold = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")
    both = rows.select("*", fold).where(F.col("_part") <= F.col("fold")).join(F.broadcast(starts.withColumnRenamed("_part", "fold")), "fold")
    test = F.col("_part") == F.col("fold")
    keep = F.col("_k") < F.col("_first") - embargo
    if end is not None:
        keep = keep & (F.col(end) < F.col("_start"))
    return both.where(test | keep).withColumn("side", F.when(test, "test").otherwise("train")).drop("_k", "_part", "_start", "_first")


def average_rank(value: Column, by: Sequence[str]) -> Column:
    """Ranks from 1, ties getting their mean."""
    w = Window.partitionBy(*by)
    low = F.rank().over(w.orderBy(value))
    return low + (F.count("*").over(w.partitionBy(*by, value)) - 1) / 2.0


def binary_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str, cut: float = 0.5, outcome: str | None = None) -> DataFrame:
    """AUC (pairs in the right order, ties halved), precision, recall, accuracy, Brier score and, with a
    numeric outcome, the rank correlation of score and outcome, for each key.

    Rows are counted by (key, score) before anything is ordered, so a window reads a row per different
    score. The rank correlation needs the rows themselves."""
    y, p = F.col(label), F.col(score)
    up = (p >= cut).cast("int")
    per = df.groupBy(*keys, score).agg(
        F.sum(y).alias("_y"), F.sum(1 - y).alias("_x"), F.sum(up * y).alias("_uy"), F.sum(up).alias("_u"), F.sum((up == y).cast("double")).alias("_ok"),
        F.sum((p - y) * (p - y)).alias("_b"), F.count("*").alias("_n"),
    )
    below = F.coalesce(F.sum("_x").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_pairs", F.col("_y") * (below + F.col("_x") / 2.0))
    n1, n0 = F.sum("_y"), F.sum("_x")
    out = per.groupBy(*keys).agg(
        (F.sum("_pairs") / F.nullif((n1 * n0).cast("double"), F.lit(0.0))).alias("auc"),
        (F.sum("_uy") / F.nullif(F.sum("_u"), F.lit(0))).alias("precision"),
        (F.sum("_uy") / F.nullif(n1, F.lit(0))).alias("recall"),
        (F.sum("_ok") / F.sum("_n")).alias("accuracy"),
        (F.sum("_b") / F.sum("_n")).alias("brier"),
        F.sum("_n").alias("n"),
    )
    if outcome is None:
        return out
    ranked = df.withColumns({"_a": average_rank(p, keys), "_b": average_rank(F.col(outcome), keys)})
    ic = ranked.groupBy(*keys).agg(F.corr("_a", "_b").alias("rank_ic"))
    return out.join(ic, list(keys)).withColumn("rank_ic", F.when(~F.isnan("rank_ic"), F.col("rank_ic")))


def ic_summary(daily: DataFrame, ic: str = "ic") -> DataFrame:
    """One row: days, mean, deviation and t value of a daily rank correlation."""
    one = daily.agg(F.count(ic).alias("days"), F.avg(ic).alias("mean"), F.stddev_samp(ic).alias("sd"))
    return one.withColumn("t", safe_ratio(F.col("mean") * F.sqrt("days"), F.col("sd")))


def rank_ic(df: DataFrame, ts: str, score: str, outcome: str) -> DataFrame:
    """Spearman correlation of score and outcome per timestamp with two rows or more."""
    step = df.withColumns({"_a": average_rank(F.col(score), [ts]), "_b": average_rank(F.col(outcome), [ts])})
    per = step.groupBy(ts).agg(F.corr("_a", "_b").alias("ic"), F.count("*").alias("n")).where("n >= 2")
    return per.withColumn("ic", F.when(~F.isnan("ic"), F.col("ic")))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """keys and, for each name -> share, the least value at or below which that share of the key's values lies,
    exactly; nulls play no part, and a key of nulls alone has nulls.

    Rows are counted by (key, value) before anything is ordered, so a window reads a row per different value."""
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_c"))
    own = Window.partitionBy(*keys)
    counts = counts.withColumns({"_to": F.sum("_c").over(own.orderBy(F.col(value).asc_nulls_first())), "_n": F.sum("_c").over(own)})
    # a decimal share, so that the rank is not one too high where it is whole
    reached = lambda share: (F.col("_c") > 0) & (F.col("_to") >= F.lit(Decimal(str(share))) * F.col("_n"))
    return counts.groupBy(*keys).agg(*[F.min(F.when(reached(share), F.col(value))).alias(name) for name, share in shares.items()])


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval for hits out of n."""
    p = hits / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)


def drift_report(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10, least: float = 0.2, dataset: float = 0.5) -> DataFrame:
    """(column, psi, drifted, share, dataset_drift): the population stability index of each column over
    the reference's quantiles (shares smoothed by half a row a bin; nulls play no part), whether it is
    `least` or more, the share of columns for which it is, and whether that is `dataset` or more.

    All columns' edges are one row; each side is read once, and a row per column and bin is shuffled."""
    cuts = [i / bins for i in range(1, bins)]
    edges = reference.agg(*[F.percentile_approx(c, cuts, 10_000).alias(f"_e{i}") for i, c in enumerate(columns)])

    def counted(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*columns).join(F.broadcast(edges))  # one row
        place = lambda i, c: F.size(F.filter(f"_e{i}", lambda e: e < F.col(c)))
        each = F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), place(i, c)).alias("bin")) for i, c in enumerate(columns)])
        return rows.select(F.inline(each)).where("bin is not null").groupBy("column", "bin").agg(F.count("*").alias(name))

    both = counted(reference, "p").join(counted(current, "q"), ["column", "bin"], "full_outer")
    every = both.sparkSession.createDataFrame([(c, i) for c in columns for i in range(bins)], "column string, bin int")
    all_bins = every.join(both, ["column", "bin"], "left").fillna(0, ["p", "q"])  # a row per column and bin
    per = Window.partitionBy("column")
    share = lambda c: (F.col(c) + 0.5) / (F.sum(c).over(per) + 0.5 * bins)
    one = all_bins.select("column", share("p").alias("a"), share("q").alias("b")).groupBy("column").agg(F.sum((F.col("b") - F.col("a")) * F.log(F.col("b") / F.col("a"))).alias("psi"))
    flagged = one.withColumn("drifted", F.col("psi") >= least)
    part = F.avg(F.col("drifted").cast("double")).over(Window.partitionBy())  # a row per column
    return flagged.withColumn("share", part).withColumn("dataset_drift", F.col("share") >= dataset)


def _poisson_table() -> np.ndarray:
    """The weight of a row in a bootstrap round by the highest 16 bits of a hash: Poisson with mean 1."""
    steps = np.cumsum(np.exp(-1.0) / np.array([factorial(k) for k in range(9)], dtype=float))
    return np.searchsorted(steps, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def bootstrap_weights(rows: np.ndarray, rounds: np.ndarray, seed: int) -> np.ndarray:
    """(rows, rounds): how often each row counts in each round, from a hash of both (64-bit finaliser)."""
    with np.errstate(over="ignore"):
        x = rows[:, None] ^ (rounds[None, :] + np.uint64(seed) * np.uint64(1 << 32) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return _poisson_table()[x >> np.uint64(48)]


def bootstrap_mean(df: DataFrame, keys: Sequence[str], value: str, row: Sequence[str], rounds: int = 10_000, seed: int = 7) -> DataFrame:
    """(keys, low, high): 95 % percentile interval of each key's mean. A row counts in a round as often as
    a hash of its identity (the columns `row`) and the round says, Poisson with mean 1; so the interval
    does not depend on how rows are dealt, and rounds are sums that combine before they are shuffled. Rows
    without a value play no part."""
    step = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value), F.xxhash64(*row).alias("_h"))
    numbers = np.arange(rounds, dtype=np.uint64)

    def partial(batches):
        table = {}
        for pdf in batches:
            for key, rows in pdf.groupby(list(keys), sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                held = table.setdefault(key, np.zeros((2, rounds)))
                for s in range(0, len(rows), 64):
                    part = rows[s : s + 64]
                    weight = bootstrap_weights(pdf["_h"].to_numpy().astype(np.int64).view(np.uint64)[part], numbers, seed)
                    held[0] += weight.sum(axis=0)
                    held[1] += pdf[value].to_numpy()[part] @ weight.astype(np.float64)
            if len(table) * rounds > 4_000_000:  # many keys: their sums so far go on
                yield from flushed(table)
        yield from flushed(table)

    def flushed(table):
        for key, (w, s) in table.items():
            yield pd.DataFrame({**{k: [v] * rounds for k, v in zip(keys, key)}, "_round": np.arange(rounds), "_w": w, "_s": s})
        table.clear()

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    sums = step.mapInPandas(partial, f"{fields}, _round int, _w double, _s double")
    means = sums.groupBy(*keys, "_round").agg((F.sum("_s") / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_m"))
    return means.groupBy(*keys).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))
