"""Signals, their outcomes and back-tests, the logistic baseline, and pair back-tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.market import canonical_id, safe_ratio
from quillon.operators.windows import trailing


def signal_rows(scored: DataFrame, model: str, horizon: str) -> DataFrame:
    """Signals with a deterministic id and direction UP from a probability of one half on."""
    p = F.col("probability")
    return scored.withColumns(
        {
            "signal_id": canonical_id(F.col("symbol"), F.lit(model), F.lit(horizon), F.unix_micros("prediction_ts")),
            "direction": F.when(p >= 0.5, "UP").when(p < 0.5, "DOWN"),
            "model_version": F.lit(model),
            "horizon": F.lit(horizon),
        }
    )


def frozen_sigma(closes: DataFrame, short: int = 20, long: int = 252, least_long: int = 60) -> DataFrame:
    """Closes with the deviations of the last `short` and `long` returns known there. Computed once a
    close and then joined as of a signal, so no history is read per signal."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    known = closes.where("return_1d is not null")
    s, l = trailing(w, short), trailing(w, long)  # noqa: E741
    return known.withColumns(
        {
            f"sigma{short}": F.when(F.count("return_1d").over(s) == short, F.stddev_samp("return_1d").over(s)),
            f"sigma{long}": F.when(F.count("return_1d").over(l) >= least_long, F.stddev_samp("return_1d").over(l)),
        }
    )


def dividend_mask(rows: DataFrame, dividends: DataFrame, key: str, entry: str, outcome: str) -> DataFrame:
    """Adds masked: an ex-date of the key in (entry, outcome]. A signal's dates are counted through
    running sums of ex-dates, not joined by range."""
    ex = dividends.select(F.col(key), F.col("ex_date").alias("_d")).distinct().withColumn("_x", F.lit(1))
    points = rows.select(key, F.col(entry).alias("_d")).unionByName(rows.select(key, F.col(outcome).alias("_d"))).distinct().withColumn("_x", F.lit(0))
    both = points.unionByName(ex).groupBy(key, "_d").agg(F.max("_x").alias("_x"))
    upto = Window.partitionBy(key).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.where("_d is not null").select(key, "_d", F.sum("_x").over(upto).alias("_n"))
    a = counted.withColumnsRenamed({"_d": entry, "_n": "_n0"})
    b = counted.withColumnsRenamed({"_d": outcome, "_n": "_n1"})
    out = rows.join(a, [key, entry], "left").join(b, [key, outcome], "left")
    return out.withColumn("masked", F.coalesce(F.col("_n1") > F.col("_n0"), F.lit(False))).drop("_n0", "_n1")


def eligibility(as_of: Column) -> Column:
    """The first reason, in order, that an outcome does not count; else eligible."""
    c = F.col
    return (
        F.when(c("entry_date").isNull() | (c("outcome_ts") > as_of), "outcome_pending")
        .when(c("outcome_ts").isNull() | c("entry_close").isNull() | c("outcome_close").isNull(), "missing_return")
        .when(c("masked"), "ex_dividend_masked")
        .when(c("sigma20").isNull(), "insufficient_sigma_history")
        .when(c("sigma_used") == 0, "missing_sigma")
        .when(c("direction").isNull(), "missing_direction")
        .otherwise("eligible")
    )


def summarize_outcomes(ledger: DataFrame, keys: Sequence[str], date: str, hit: str, z: str, least_n: int = 100, least_dates: int = 60, rho: float = 0.2) -> DataFrame:
    """A row per key of a ledger with `eligibility`: n eligible rows, their dates, the effective number (rows of one date
    are taken to be correlated by rho), hits (`hit` above 0), whether that is enough, and if so the hit rate with a
    Wilson interval over the effective number, and median and mean of z; and how many rows each reason excluded."""
    from quillon.operators.research import wilson

    good = F.col("eligibility") == "eligible"
    reasons = ledger.where(~good).groupBy(*keys, "eligibility").agg(F.count("*").alias("_c"))
    excluded = reasons.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("eligibility", "_c")))).alias("excluded"))  # a row per reason
    one = ledger.groupBy(*keys).agg(
        F.count_if(good).alias("n"), F.countDistinct(F.when(good, F.col(date))).alias("dates"), F.count_if(good & (F.col(hit) > 0)).alias("hits"),
        F.percentile(F.when(good, F.col(z)), 0.5).alias("_median"), F.avg(F.when(good, F.col(z))).alias("_mean"),
    )
    n_eff = F.when(F.col("dates") > 0, F.col("n") / (1 + (F.col("n") / F.col("dates") - 1) * rho)).otherwise(0.0)
    one = one.withColumn("n_eff", n_eff).withColumn("sufficient", (F.col("n") >= least_n) & (F.col("dates") >= least_dates) & (F.col("n_eff") >= least_n))
    rate = F.col("hits") / F.nullif(F.col("n"), F.lit(0))
    low, high = wilson(rate * F.col("n_eff"), F.nullif(F.col("n_eff"), F.lit(0.0)))
    told = {"hit_rate": rate, "low": F.greatest(low, F.lit(0.0)), "high": F.least(high, F.lit(1.0)), "median_z": F.col("_median"), "mean_z": F.col("_mean")}
    one = one.withColumns({name: F.when(F.col("sufficient"), c) for name, c in told.items()})
    return one.join(excluded, list(keys), "left").drop("_median", "_mean")


def signal_backtest(df: DataFrame, by: str, ts: str, probability: str, ret: str, bps: float) -> DataFrame:
    """position, turnover, gross and net return of each signal row."""
    w = Window.partitionBy(by).orderBy(ts)
    step = df.withColumn("position", F.when(F.col(probability) >= 0.5, 1.0).otherwise(-1.0))
    step = step.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.col("position"))) / 2)
    step = step.withColumn("gross_return", F.col("position") * F.col(ret))
    return step.withColumn("net_return", F.col("gross_return") - F.col("turnover") * bps / 1e4)


def holding_runs(df: DataFrame, by: str, ts: str, position: str) -> DataFrame:
    """(by, n_runs, mean_run): lengths of equal positions in a row, from the number of changes."""
    w = Window.partitionBy(by).orderBy(ts)
    change = F.coalesce((F.col(position) != F.lag(position).over(w)).cast("int"), F.lit(1))
    per = df.withColumn("_c", change).groupBy(by).agg(F.sum("_c").alias("n_runs"), F.count("*").alias("_n"))
    return per.select(by, "n_runs", (F.col("_n") / F.col("n_runs")).alias("mean_run"))


def portfolio(df: DataFrame, ts: str, ret: str) -> DataFrame:
    """The mean return across symbols by time."""
    return df.groupBy(ts).agg(F.avg(ret).alias(ret))


def deflated_sharpe(sharpe: Column, n: Column, trials: int, skew: Column, kurtosis: Column) -> Column:
    """z of a per-period Sharpe ratio against the best of `trials` ratios of no skill. The variance
    across trials is taken as that of one estimate, which makes it a rough guide only."""
    import math
    from statistics import NormalDist

    q, e = NormalDist().inv_cdf, 0.5772156649015329
    best = (1 - e) * q(1 - 1 / trials) + e * q(1 - 1 / (trials * math.e)) if trials > 1 else 0.0
    spread = F.sqrt((1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / (n - 1))
    return (sharpe - spread * best) / F.nullif(spread, F.lit(0.0))


def reference_current(df: DataFrame, ts: str, share: float) -> DataFrame:
    """Adds side: the last `share` of different times is current, what is before reference."""
    stamps = df.select(ts).distinct()
    ranked = stamps.withColumn("_r", F.percent_rank().over(Window.orderBy(ts)))  # a row per timestamp
    out = df.join(ranked, ts)
    return out.withColumn("side", F.when(F.col("_r") >= 1 - share, "current").otherwise("reference")).drop("_r")


def logistic_baseline(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None, penalty: float = 0.01):
    """A fitted pipeline: missing values as 0, standard scaling, ridge logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    model = LogisticRegression(featuresCol="_s", labelCol=label, regParam=penalty, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r")
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_s", withMean=True), model.setWeightCol(weight) if weight else model]
    return Pipeline(stages=stages).fit(train.fillna(0.0, list(features)))


def predict(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with probability."""
    return probabilities(model.transform(df.fillna(0.0, list(features))))


def probabilities(transformed: DataFrame) -> DataFrame:
    """A model's output with probability instead of its vectors."""
    from pyspark.ml.functions import vector_to_array

    return transformed.withColumn("probability", vector_to_array("_p")[1]).drop("_x", "_s", "_p", "_y", "_r")


def outcome_ledger(signals: DataFrame, as_of: Column, floor: float = 1e-4) -> DataFrame:
    """signals (direction, entry_close, outcome_close, sigma20, sigma252, masked, entry_date, outcome_ts) with
    raw and signed return, the sigma that is used (the short one, else the long one, not below the floor), z
    and the first reason against it; z only where that is none."""
    raw = safe_ratio(F.col("outcome_close"), F.col("entry_close")) - 1
    side = F.when(F.col("direction") == "UP", 1).when(F.col("direction") == "DOWN", -1)
    step = signals.withColumns({"raw_return": raw, "signed_return": raw * side, "sigma_used": F.coalesce(F.greatest("sigma20", F.when(F.col("sigma20").isNotNull(), F.lit(floor))), F.col("sigma252"))})
    step = step.withColumn("eligibility", eligibility(as_of))
    return step.withColumn("z", F.when(F.col("eligibility") == "eligible", safe_ratio(F.col("signed_return"), F.col("sigma_used"))))


def pair_backtest(df: DataFrame, by: str, day: str, bps: float, borrow_bps: float) -> DataFrame:
    """gross, cost, borrow and net of (open_a, open_b, w_a, w_b), open to open: a weight is executed
    one row after it is set and earns from the row after that."""
    w = Window.partitionBy(by).orderBy(day)
    zero = F.lit(0.0)
    step = df.withColumns({f"r_{x}": safe_ratio(F.col(f"open_{x}"), F.lag(f"open_{x}").over(w)) - 1 for x in "ab"} | {f"x_{x}": F.coalesce(F.lag(f"w_{x}").over(w), zero) for x in "ab"})
    step = step.withColumns({f"h_{x}": F.coalesce(F.lag(f"x_{x}").over(w), zero) for x in "ab"})
    traded = F.abs(F.col("x_a") - F.col("h_a")) + F.abs(F.col("x_b") - F.col("h_b"))
    short = F.greatest(-F.col("h_a"), zero) + F.greatest(-F.col("h_b"), zero)
    step = step.withColumns({"gross": F.col("h_a") * F.col("r_a") + F.col("h_b") * F.col("r_b"), "traded": traded, "cost": traded * bps / 1e4, "borrow": short * borrow_bps / 1e4})
    return step.withColumn("net", F.col("gross") - F.col("cost") - F.col("borrow")).where("r_a is not null and r_b is not null")


def change_from_window(df: DataFrame, by: str, day: str, value: str, rows: int) -> DataFrame:
    """Change over `rows` rows, and mean and deviation of the window where it has that many rows."""
    base = Window.partitionBy(by).orderBy(day)
    w = trailing(base, rows)
    full = F.count("*").over(w) == rows
    return df.withColumns({"change": F.col(value) - F.lag(value, rows - 1).over(base), "mean": F.when(full, F.avg(value).over(w)), "sd": F.when(full, F.stddev_samp(value).over(w))})


def window_zscore(df: DataFrame, by: str, day: str, value: str, rows: int, out: str) -> DataFrame:
    """Distance from the window's mean in its deviations, where the window has that many rows."""
    step = change_from_window(df, by, day, value, rows)
    return step.withColumn(out, safe_ratio(F.col(value) - F.col("mean"), F.col("sd"))).drop("change", "mean", "sd")


def crowding(speculators: Column, managers: Column, cut: float = 0.5) -> tuple[Column, Column]:
    """(score, label) of two z-scores: their mean; risk_on where the first is above the cut, risk_off
    where it is below minus the cut, else neutral, null where it is not known."""
    label = F.when(speculators > cut, "risk_on").when(speculators < -cut, "risk_off").when(speculators.isNotNull(), "neutral")
    return (speculators + managers) / 2.0, label
