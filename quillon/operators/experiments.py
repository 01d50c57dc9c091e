"""Compositions: the residual signal from prices to positions, its regime gate and the choice of a holding time, pair
sizers against costs, the model study over purged folds, and bundles of metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.market import safe_ratio
from quillon.operators import outcomes, research, strategy
from quillon.operators.windows import trailing
from quillon.sources import scratch


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# -- the residual strategy --------------------------------------------------------------------


def residual_signal(prices: DataFrame, members: DataFrame | None, breaks: DataFrame | None, industries: DataFrame, window: int = 60, lookback: int = 5, least: int = 50) -> DataFrame:
    """(symbol, day, industry, valuation, y, m, f, residual, sigma, cum_residual, s_score, ...) of prices (symbol,
    day, close) with a market row per day in column `market`: returns without fill, null outside the day's
    members (symbol, day) and on masked breaks (symbol, day); the others' industry mean; the lagged
    two-factor residual and its s-score. valuation is the return that positions earn, null on breaks
    alone."""
    w = Window.partitionBy("symbol").orderBy("day")
    returns = prices.withColumns({"valuation": safe_ratio(F.col("close"), F.lag("close").over(w)) - 1, "m": safe_ratio(F.col("market"), F.lag("market").over(w)) - 1})
    if breaks is not None:
        hit = breaks.select("symbol", "day").distinct().withColumn("_break", F.lit(True))
        returns = returns.join(hit, ["symbol", "day"], "left")
        returns = returns.withColumn("valuation", F.when(F.col("_break").isNull(), F.col("valuation"))).drop("_break")
    y = F.col("valuation")
    if members is not None:
        inside = members.select("symbol", "day").distinct().withColumn("_in", F.lit(True))
        returns = returns.join(inside, ["symbol", "day"], "left")
        y = F.when(F.col("_in"), y)
    known = industries.select("symbol", "industry")
    panel = returns.withColumn("y", y).drop("_in").join(known, "symbol", "left").withColumn("industry", F.coalesce("industry", F.lit("__unknown__")))
    panel = strategy.leave_one_out_mean(panel, "day", "industry", "y", "f")
    fitted = strategy.rolling_two_factor(panel, "symbol", "day", "y", "m", "f", window, least)
    return strategy.s_score(fitted, "symbol", "day", "residual", window, lookback, least)


def positions_by_hold(scored: DataFrame, holds: Sequence[int], entry: float = 2.5, leave: float = 0.5) -> DataFrame:
    """scored with hold and position, once for each longest holding time."""
    return union([strategy.signal_positions(scored, "symbol", "day", "s_score", entry, leave, h).withColumn("hold", F.lit(h)) for h in holds])


def gated(positions: DataFrame, regimes: DataFrame, regime: str = "NARROW") -> DataFrame:
    """Positions that are flat on days of another regime (day, regime) or of none."""
    on = regimes.where(F.col("regime") == regime).select("day").distinct().withColumn("_on", F.lit(1))
    out = positions.join(on, "day", "left")
    return out.withColumn("position", F.when(F.col("_on").isNotNull(), F.col("position")).otherwise(0)).drop("_on")


def sharpe(ret: Column, year: int = 252) -> Column:
    """Annualised mean over population deviation; null without one."""
    return safe_ratio(F.avg(ret), F.stddev_pop(ret)) * float(year) ** 0.5


def ablation(positions: DataFrame, regimes: DataFrame, bps: float, borrow: float = 0.0) -> DataFrame:
    """(variant, hold, days, gross, net, turnover, sharpe) of positions (symbol, day, hold, position,
    valuation), as they are and gated by the regime; equal weights of one unit gross a day."""
    variants = union([positions.withColumn("variant", F.lit("base")), gated(positions, regimes).withColumn("variant", F.lit("gated"))])
    book = variants.withColumn("weight", F.coalesce(safe_ratio(F.col("position").cast("double"), F.sum(F.abs("position")).over(Window.partitionBy("variant", "hold", "day")).cast("double")), F.lit(0.0)))
    daily = pnl_by(book, ["variant", "hold"], bps, borrow)
    return daily.groupBy("variant", "hold").agg(F.count("*").alias("days"), F.sum("gross").alias("gross"), F.sum("net").alias("net"), F.avg("turnover").alias("turnover"), sharpe(F.col("net")).alias("sharpe"))


def pnl_by(book: DataFrame, keys: Sequence[str], bps: float, borrow: float = 0.0, year: int = 252) -> DataFrame:
    """gross, cost, net and turnover by keys and day: yesterday's weight earns today's valuation."""
    before = F.coalesce(F.lag("weight").over(Window.partitionBy(*keys, "symbol").orderBy("day")), F.lit(0.0))
    step = book.withColumn("_b", before).withColumn("_t", F.abs(F.col("weight") - F.col("_b")))
    out = step.groupBy(*keys, "day").agg(
        F.sum(F.col("_b") * F.coalesce("valuation", F.lit(0.0))).alias("gross"),
        F.sum(F.col("_t") * bps / 1e4 + F.greatest(-F.col("_b"), F.lit(0.0)) * borrow / year).alias("cost"),
        (F.sum("_t") / 2).alias("turnover"),
    )
    return out.withColumn("net", F.col("gross") - F.col("cost"))


def walk_forward_hold(daily: DataFrame, folds: int, embargo: int) -> DataFrame:
    """(fold, hold, day, net): on each fold's test days the net return of the holding time whose Sharpe ratio
    over the fold's training days is highest (ties: the shortest), of daily (hold, day, net)."""
    parts = research.walk_forward(daily, "day", folds, embargo=embargo)
    trained = parts.where("side = 'train'").groupBy("fold", "hold").agg(sharpe(F.col("net")).alias("_s"))
    best = trained.groupBy("fold").agg(F.max_by("hold", F.struct(F.coalesce("_s", F.lit(float("-inf"))), -F.col("hold"))).alias("hold"))
    return parts.where("side = 'test'").join(best, ["fold", "hold"]).select("fold", "hold", "day", "net")


# -- pairs ------------------------------------------------------------------------------------


def estimate_pair(panel: DataFrame, by: str, day: str, span: int = 20, least: int = 10, windows: Sequence[int] = (5, 20, 60), least_rolling: int = 5, percentile: int = 252, year: int = 252, positive: bool = True) -> DataFrame:
    """panel (open_a, close_a, open_b, close_b) with simple returns, weighted vols, correlation and covariance,
    rolling vols of each window, overnight and intraday vols of the shortest window but one, and the share of
    the last `percentile` vols of A that are not above the current one. Prices that are not positive have no
    return; unless `positive`, they are values like others, and only a ratio to zero has none."""
    w = Window.partitionBy(by).orderBy(day)
    ok = lambda c: F.when(F.col(c) > 0, F.col(c)) if positive else F.col(c)
    ratio = lambda a, b: safe_ratio(a, b) - 1
    step = panel.withColumns(
        {f"r_{x}": ratio(ok(f"close_{x}"), F.lag(ok(f"close_{x}")).over(w)) for x in "ab"}
        | {f"on_{x}": ratio(ok(f"open_{x}"), F.lag(ok(f"close_{x}")).over(w)) for x in "ab"}
        | {f"id_{x}": ratio(ok(f"close_{x}"), ok(f"open_{x}")) for x in "ab"}
    )
    step = strategy.ewma(step, by, day, "r_a", "r_b", span, least, year)
    vol = lambda c, n: F.when(F.count(c).over(trailing(w, n)) >= least_rolling, F.stddev_samp(c).over(trailing(w, n))) * float(year) ** 0.5
    middle = sorted(windows)[min(1, len(windows) - 1)]
    step = step.withColumns(
        {f"rvol_{n}_{x}": vol(f"r_{x}", n) for n in windows for x in "ab"}
        | {f"overnight_vol_{x}": vol(f"on_{x}", middle) for x in "ab"}
        | {f"intraday_vol_{x}": vol(f"id_{x}", middle) for x in "ab"}
    )
    held = F.collect_list("vol_a").over(trailing(w, percentile))
    below = F.size(F.filter(held, lambda v: v <= F.col("vol_a"))).cast("double")
    return step.withColumn("vol_pct_a", F.when(F.col("vol_a").isNotNull() & (F.size(held) == percentile), below / percentile))


def cost_bps(notional: Column, adv: Column, commission: float = 1.0, spread: float = 2.0, slippage: float = 5.0, cap: float = 0.01) -> Column:
    """Per-side cost in basis points: commission, half the spread, and slippage in proportion to the share of
    volume up to the cap; an unknown volume counts as all of it."""
    part = F.least(F.when(adv > 0, notional / adv).otherwise(1.0), F.lit(cap))
    return F.lit(commission) + spread / 2 + slippage * part / cap


def borrow_rate(bucket: Column, rates: Mapping[str, float]) -> Column:
    """Daily borrow rate of a liquidity bucket; null for one that is not known."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), bucket)


def reference_signal(close: str, by: str, day: str, mode: str, lookback: int) -> Column:
    """momentum (sign of the return over lookback), reversal (its negative), momentum_z (hyperbolic tangent of
    that return over its deviation) or constant; 0 where it is not known."""
    w = Window.partitionBy(by).orderBy(day)
    ratio = safe_ratio(F.col(close), F.lag(close, lookback).over(w)) - 1
    if mode == "constant":
        return F.lit(1.0)
    if mode not in ("momentum", "reversal"):
        raise ValueError(f"unknown signal mode {mode}")
    return F.coalesce(F.signum(ratio) * (1 if mode == "momentum" else -1), F.lit(0.0)) + 0.0


def varies_in_magnitude(mode: str) -> bool:
    return {"momentum": False, "reversal": False, "constant": False, "momentum_z": True}[mode]


def momentum_z(df: DataFrame, close: str, by: str, day: str, lookback: int, out: str = "signal") -> DataFrame:
    w = Window.partitionBy(by).orderBy(day)
    step = df.withColumn("_r", safe_ratio(F.col(close), F.lag(close, lookback).over(w)) - 1)
    return step.withColumn(out, F.coalesce(F.tanh(safe_ratio(F.col("_r"), F.stddev_samp("_r").over(trailing(w, lookback)))), F.lit(0.0))).drop("_r")


def compare_sizers(panel: DataFrame, by: str, day: str, methods: Sequence[str], costs: Sequence[float], borrow_bps: float, tail: float, year: int = 252) -> DataFrame:
    """(variant, cost_bps, ...) metrics of each sizer at each flat per-side cost over the last `tail` share of days,
    of panel (open_a, open_b, signal, vol_a, vol_b, corr). The variants are rows of one frame, so all are
    back-tested in one pass; a pair's days count by their place in its own history."""
    weights = []
    for method in methods:
        wa, wb = strategy.pair_weights(F.col("signal"), F.col("vol_a"), F.col("vol_b"), F.col("corr"), method)
        weights.append(F.struct(F.lit(method).alias("variant"), wa.alias("w_a"), wb.alias("w_b")))
    rows = panel.select(by, day, "open_a", "open_b", F.inline(F.array(*weights))).withColumn("_key", F.concat_ws("\x1f", F.col(by).cast("string"), "variant"))
    tested = outcomes.pair_backtest(rows, "_key", day, 0.0, borrow_bps)
    own = Window.partitionBy("_key")
    tested = tested.withColumns({"_i": F.row_number().over(own.orderBy(day)) - 1, "_n": F.count("*").over(own)})
    start = F.least(F.floor(F.col("_n") * (1 - tail)), F.col("_n") - 1)
    late = tested.where(F.col("_i") >= start).withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    late = late.withColumn("_cost", F.col("traded") * F.col("cost_bps") / 1e4)
    per_day = late.groupBy("variant", "cost_bps", day).agg(
        F.sum("gross").alias("gross"), F.sum(F.col("gross") - F.col("_cost") - F.col("borrow")).alias("net"), F.sum("_cost").alias("cost"), F.sum("borrow").alias("borrow"), F.sum("traded").alias("traded")
    )
    return per_day.groupBy("variant", "cost_bps").agg(
        F.count("*").alias("n_days"), sharpe(F.col("net"), year).alias("oos_sharpe"), F.sum("net").alias("net_pnl_total"), F.sum("cost").alias("cost_total"), F.sum("borrow").alias("borrow_cost_total"),
        (F.stddev_pop("gross") * float(year) ** 0.5).alias("realized_vol_gross"), (F.avg("traded") / 2).alias("turnover_avg"),
    )


# -- models -----------------------------------------------------------------------------------


def encoded(df: DataFrame, booleans: Sequence[str] = (), categories: Mapping[str, Sequence[str]] | None = None, numbers: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """df with numeric columns for a model, and their names: truth values as 0 and 1 (missing: 0), a column
    per category that is named (missing and others: all 0), numbers with 0 where missing or NaN. The
    categories are given, so training and scoring rows have the same columns."""
    cols: dict[str, Column] = {}
    for c in booleans:
        cols[f"{c}_flag"] = F.coalesce(F.col(c), F.lit(False)).cast("double")
    for c, values in (categories or {}).items():
        cols |= {f"{c}_{v}": F.coalesce((F.col(c).cast("string") == str(v)).cast("double"), F.lit(0.0)) for v in values}
    for c in numbers:
        cols[f"{c}_number"] = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return df.withColumns(cols), list(cols)


def boosted_trees(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None, rounds: int = 20, depth: int = 3, seed: int = 42):
    """A fitted pipeline of gradient-boosted trees: the challenger."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)
    if weight:
        gbt = gbt.setWeightCol(weight)
    for param, name in ((gbt.probabilityCol, "_p"), (gbt.predictionCol, "_y"), (gbt.rawPredictionCol, "_r")):
        gbt.set(param, name)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), gbt]).fit(train)


def study(matrix: DataFrame, arms: Mapping[str, Sequence[str]], models: Mapping[str, Callable], ts: str, end: str, label: str, folds: int, embargo: int, key: Sequence[str]) -> DataFrame:
    """(arm, model, key, ts, label, probability): out-of-fold scores of each arm of features and each model over
    purged, embargoed expanding folds, rows weighted by the mean uniqueness of their label spans (symbol, ts, end).
    A model is fit(train, features, label, weight) -> transformer; each fit is a distributed job, their number is
    arms times models times folds. No feature may be known after ts: see quality.point_in_time_checks()."""
    weighted = matrix.join(research.uniqueness_weights(matrix.select("symbol", ts, end), ["symbol"], ts, end).select("symbol", ts, "weight"), ["symbol", ts])
    parts = scratch.cut(research.walk_forward(weighted, ts, folds, end=end, embargo=embargo))  # read by every fit
    out = []
    for fold in range(1, folds + 1):
        rows = parts.where(F.col("fold") == fold).drop("fold")
        train, test = rows.where("side = 'train'"), rows.where("side = 'test'")
        for arm, features in arms.items():
            for name, fit in models.items():
                model = fit(train, features, label, "weight")
                scored = outcomes.probabilities(model.transform(test))
                out.append(scored.select(F.lit(arm).alias("arm"), F.lit(name).alias("model"), *key, ts, label, "probability"))
    return union(out)


def evaluation_bundle(predictions: DataFrame, keys: Sequence[str], ts: str, label: str, probability: str, ret: str, bps: float, latency_ms: str | None = None, trials: int = 4) -> DataFrame:
    """One row per key of predictive metrics (with the daily rank correlation's mean, deviation and t), of the
    signal's back-test (mean net return, hit rate, Sharpe ratio, deflated Sharpe z of the equal-weighted portfolio
    by time) and, with a latency column, its p50 and p95, both exact."""
    metrics = research.binary_metrics(predictions, keys, label, probability, outcome=ret)
    daily = research.rank_ic(predictions.withColumn("_t", F.struct(*keys, ts)), "_t", probability, ret)
    ic = daily.select(*[F.col(f"_t.{k}").alias(k) for k in keys], "ic").groupBy(*keys).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_sd"), safe_ratio(F.avg("ic") * F.sqrt(F.count("ic")), F.stddev_samp("ic")).alias("ic_t"))
    position = F.when(F.col(probability) >= 0.5, 1.0).otherwise(-1.0)
    port = predictions.withColumn("_r", position * F.col(ret)).groupBy(*keys, ts).agg(F.avg("_r").alias("_r"))
    per = port.groupBy(*keys).agg(F.count("_r").alias("_n"), F.avg("_r").alias("gross_mean"), F.avg((F.col("_r") > 0).cast("double")).alias("hit_rate"), sharpe(F.col("_r")).alias("sharpe"), safe_ratio(F.avg("_r"), F.stddev_pop("_r")).alias("_s"), F.skewness("_r").alias("_g"), (F.kurtosis("_r") + 3).alias("_k"))
    per = per.withColumn("deflated_sharpe", outcomes.deflated_sharpe(F.col("_s"), F.col("_n"), trials, F.col("_g"), F.col("_k"))).withColumn("net_mean", F.col("gross_mean") - bps / 1e4).drop("_s", "_n", "_g", "_k")
    out = metrics.join(ic, list(keys), "left").join(per, list(keys), "left")
    if latency_ms:
        times = research.exact_quantiles(predictions, keys, latency_ms, {"latency_p50": 0.5, "latency_p95": 0.95})
        out = out.join(times, list(keys), "left")
    return out


def drift_summary(report: DataFrame, prediction_report: DataFrame, reference_rows: int, current_rows: int, source: str) -> dict:
    """The monitoring document: per-feature flags, their share and the dataset's flag, for features and for
    predictions, from reports of research.drift_report() (a row per column)."""

    def block(df: DataFrame) -> dict:
        rows = sorted(df.collect(), key=lambda r: r.column)  # a row per column
        if not rows:
            raise ValueError("a drift report without columns")
        return {"per_feature_drift": {r.column: r.drifted for r in rows}, "n_features": len(rows), "n_drifted_features": sum(r.drifted for r in rows), "share_of_drifted_features": rows[0].share, "dataset_drift": rows[0].dataset_drift}

    return {"source": source, "windows": {"reference_rows": reference_rows, "current_rows": current_rows}, "feature_drift": block(report), "prediction_drift": block(prediction_report)}


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, if it has all the columns of a feature frame."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"feature frame is missing required columns: {missing}")
    return df
