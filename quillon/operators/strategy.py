"""Residual reversion, execution, costs, performance and pair risk, on long frames
(symbol, day, ...). Recursions run per symbol in date order; everything else is columns."""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite, sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.market import safe_ratio
from quillon.operators.recursion import carried
from quillon.operators.windows import trailing


def leave_one_out_mean(df: DataFrame, day: str, group: str, value: str, out: str) -> DataFrame:
    """The mean of the others of a group on a day; null for a group of one."""
    w = Window.partitionBy(day, group)
    n = F.count(value).over(w)
    return df.withColumn(out, F.when(F.col(value).isNotNull() & (n > 1), (F.sum(value).over(w) - F.col(value)) / (n - 1)))


def rolling_two_factor(df: DataFrame, by: str, day: str, y: str, m: str, f: str, window: int, least: int) -> DataFrame:
    """alpha, beta_market, beta_industry and residual of y on [1, m, f], fitted on the `window` rows
    before, of which at least `least` have all three. Nine windowed sums and a closed-form 3 x 3
    solution: one shuffle and no Python. A singular fit is null."""
    base = Window.partitionBy(by).orderBy(day)
    w = trailing(base, window, current=False)
    ok = F.col(y).isNotNull() & F.col(m).isNotNull() & F.col(f).isNotNull()
    z = lambda e: F.sum(F.when(ok, e)).over(w)
    Y, M, X = F.col(y), F.col(m), F.col(f)
    step = df.withColumns(
        {
            "_n": F.sum(ok.cast("double")).over(w), "_m": z(M), "_f": z(X), "_y": z(Y), "_mm": z(M * M), "_ff": z(X * X),
            "_mf": z(M * X), "_my": z(M * Y), "_fy": z(X * Y), "_rows": F.count("*").over(w),
        }
    )
    n = F.col("_n")
    # centred sums: two equations in the slopes
    cmm, cff, cmf = F.col("_mm") - F.col("_m") * F.col("_m") / n, F.col("_ff") - F.col("_f") * F.col("_f") / n, F.col("_mf") - F.col("_m") * F.col("_f") / n
    cmy, cfy = F.col("_my") - F.col("_m") * F.col("_y") / n, F.col("_fy") - F.col("_f") * F.col("_y") / n
    det = cmm * cff - cmf * cmf
    enough = (F.col("_rows") == window) & (n >= least)
    step = step.withColumn("_det", F.when(enough & (F.abs(det) > 1e-12 * cmm * cff), det))
    step = step.withColumns({"beta_market": (cmy * cff - cfy * cmf) / F.col("_det"), "beta_industry": (cfy * cmm - cmy * cmf) / F.col("_det")})
    step = step.withColumn("alpha", (F.col("_y") - F.col("beta_market") * F.col("_m") - F.col("beta_industry") * F.col("_f")) / n)
    out = step.withColumn("residual", Y - (F.col("alpha") + F.col("beta_market") * M + F.col("beta_industry") * X))
    return out.drop("_n", "_m", "_f", "_y", "_mm", "_ff", "_mf", "_my", "_fy", "_rows", "_det")


def s_score(df: DataFrame, by: str, day: str, residual: str, window: int, cumulative: int, least: int) -> DataFrame:
    """sigma (trailing, current row included), cumulative residual and their ratio."""
    base = Window.partitionBy(by).orderBy(day)
    w, c = trailing(base, window), trailing(base, cumulative)
    sigma = F.when(F.count(residual).over(w) >= least, F.stddev_samp(residual).over(w))
    total = F.when(F.count(residual).over(c) == cumulative, F.sum(residual).over(c))
    step = df.withColumns({"sigma": sigma, "cum_residual": total})
    return step.withColumn("s_score", safe_ratio(F.col("cum_residual"), F.col("sigma") * sqrt(cumulative)))


def signal_positions(df: DataFrame, by: str, day: str, score: str, entry: float = 2.5, leave: float = 0.5, most_hold: int = 5) -> DataFrame:
    """Desired position (1, -1, 0) by day: enter long at or below -entry and short at or above entry
    when flat; leave a long above -leave, a short below leave, any after most_hold rows. A missing
    score keeps the position but counts as held."""

    def step(state: tuple[int, int], v: float | None) -> tuple[tuple[int, int], tuple[int]]:
        pos, held = state
        known = v is not None and isfinite(v)
        if pos:
            held += 1
            gone = known and (v > -leave if pos > 0 else v < leave)
            if gone or held >= most_hold:
                pos, held = 0, 0
        elif known and abs(v) >= entry:
            pos, held = (1 if v < 0 else -1), 0
        return (pos, held), (pos,)

    return carried(df, [by], [day], [score], {"position": "int"}, lambda: (0, 0), step)


def capped_weights(df: DataFrame, by: str, day: str, weight: str, adv: str, capital: float, share: float = 0.01) -> DataFrame:
    """Weights whose daily increases away from zero are capped at a share of average daily volume
    (carried forward); moves toward zero are free. A change of side closes freely and opens capped."""

    def step(state: tuple[float, float], target: float | None, volume: float | None) -> tuple[tuple[float, float], tuple[float]]:
        prev, known = state
        target = 0.0 if target is None else target
        known = known if volume is None else volume
        limit = max(share * known / capital, 0.0)
        if prev * target > 0:
            base = prev if abs(target) >= abs(prev) else target
        else:
            base = 0.0
        now = base + min(max(target - base, -limit), limit)
        return (now, known), (now,)

    return carried(df, [by], [day], [weight, adv], {"capped": "double"}, lambda: (0.0, 0.0), step)


def projected(df: DataFrame, day: str, weight: str, beta: str, group: str) -> DataFrame:
    """Weights made neutral per day to dollars, beta and industry (least-squares projection). Industry
    dummies span the constant, so weights that sum to 0 in every industry sum to 0."""
    from quillon.operators.research import neutralize

    return neutralize(df, day, weight, beta, group, out="neutral")


def book(df: DataFrame, day: str, weight: str, beta: str, group: str, cap: float | None = None, gross: float = 1.0) -> DataFrame:
    """`neutral`: the projection of the names that are held (weight not 0), a missing beta counting as 1, each
    clipped at the cap, then scaled to `gross` a day, unless only rounding is left of it; names not held stay at 0."""
    held = df.where(F.col(weight) != 0).withColumn("_beta", F.coalesce(F.nanvl(F.col(beta).cast("double"), F.lit(1.0)), F.lit(1.0)))
    out = projected(held, day, weight, "_beta", group).drop("_beta")
    if cap is not None:
        out = out.withColumn("neutral", F.least(F.greatest("neutral", F.lit(-cap)), F.lit(cap)))
    total = F.sum(F.abs("neutral")).over(Window.partitionBy(day))
    out = out.withColumn("neutral", F.col("neutral") * F.when(total > 1e-9, gross / total).otherwise(1.0))
    flat = df.where(F.coalesce(F.col(weight) == 0, F.lit(True))).withColumn("neutral", F.lit(0.0))
    return out.unionByName(flat)


def beta_neutral(df: DataFrame, day: str, weight: str, beta: str, out: str) -> DataFrame:
    """Weights less their projection on beta, per day; a missing beta counts as 1."""
    w = Window.partitionBy(day)
    step = df.withColumn("_beta", F.coalesce(F.nanvl(F.col(beta).cast("double"), F.lit(1.0)), F.lit(1.0)))
    slope = safe_ratio(F.sum(F.col(weight) * F.col("_beta")).over(w), F.sum(F.col("_beta") * F.col("_beta")).over(w))
    return step.withColumn(out, F.col(weight) - F.coalesce(slope, F.lit(0.0)) * F.col("_beta")).drop("_beta")


def liquid(df: DataFrame, volume: str, least: float) -> DataFrame:
    return df.where(F.col(volume) > least)


def demeaned(df: DataFrame, day: str, group: str, weight: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(weight) - F.avg(weight).over(Window.partitionBy(day, group)))


def unit_gross(df: DataFrame, day: str, weight: str, out: str) -> DataFrame:
    total = F.sum(F.abs(weight)).over(Window.partitionBy(day))
    return df.withColumn(out, F.col(weight) * F.when(total > 0, 1 / total).otherwise(1.0))


def daily_pnl(df: DataFrame, by: str, day: str, weight: str, ret: str, bps: float, borrow: float = 0.0, year: int = 252, stress: float | None = None) -> DataFrame:
    """gross, cost, net and turnover by day: yesterday's weight earns today's return; a traded unit
    costs bps, a short one borrow a year. With stress, also net_stressed, the net at so many times the costs."""
    w = Window.partitionBy(by).orderBy(day)
    before = F.coalesce(F.lag(weight).over(w), F.lit(0.0))
    step = df.withColumns({"_b": before, "_t": F.abs(F.coalesce(F.col(weight), F.lit(0.0)) - before)})
    return step.groupBy(day).agg(
        F.sum(F.col("_b") * F.coalesce(F.col(ret), F.lit(0.0))).alias("gross"),
        F.sum(F.col("_t") * bps / 1e4 + F.greatest(-F.col("_b"), F.lit(0.0)) * borrow / year).alias("cost"),
        (F.sum("_t") / 2).alias("turnover"),
    ).withColumn("net", F.col("gross") - F.col("cost")).withColumns({} if stress is None else {"net_stressed": F.col("gross") - stress * F.col("cost")})


def performance(df: DataFrame, day: str, ret: str, ddof: int = 0, year: int = 252) -> DataFrame:
    """One row: n, mean, Sharpe, Sortino, CAGR, worst drawdown, Calmar, hit rate and profit factor of
    a daily return series (a row per day)."""
    order = Window.orderBy(day)
    r = F.col(ret)
    step = df.withColumn("_w", F.exp(F.sum(F.log1p(r)).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    peak = F.greatest(F.lit(1.0), F.max("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    step = step.withColumn("_d", F.col("_w") / peak - 1)
    sd = F.stddev_samp(r) if ddof else F.stddev_pop(r)
    one = step.agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), sd.alias("sd"), F.sqrt(F.avg(F.when(r < 0, r * r).otherwise(0.0))).alias("_down"),
        F.max_by("_w", day).alias("_end"), F.min("_d").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("hit_rate"),
        (F.sum(F.when(r > 0, r)) / F.nullif(-F.sum(F.when(r < 0, r)), F.lit(0.0))).alias("profit_factor"),
    )
    root = sqrt(year)
    one = one.withColumns({"sharpe": safe_ratio(F.col("mean"), F.col("sd")) * root, "sortino": safe_ratio(F.col("mean"), F.col("_down")) * root, "cagr": F.pow("_end", year / F.col("n")) - 1})
    return one.withColumn("calmar", safe_ratio(F.col("cagr"), -F.col("max_drawdown"))).drop("_down", "_end", "sd")


def performance_report(df: DataFrame, day: str, ret: str, year: int = 252, least: int = 252) -> DataFrame:
    """One row of a periodic return series: total return, yearly mean and volatility, the ratios of performance() on
    sample deviations with a 95 % interval of the Sharpe ratio (returns taken as independent), average win and loss and
    their ratio, and sample_state. Below `least` observations the ratios and the interval are null."""
    one = performance(df.where(F.col(ret).isNotNull() & ~F.isnan(ret)), day, ret, ddof=1, year=year)
    r = F.col(ret)
    more = df.where(r.isNotNull() & ~F.isnan(ret)).agg(
        (F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"), (F.avg(r) * year).alias("annualized_return"), (F.stddev_samp(r) * sqrt(year)).alias("annualized_volatility"),
        F.avg(F.when(r > 0, r)).alias("average_win"), (-F.avg(F.when(r < 0, r))).alias("average_loss"),
    )
    out = one.crossJoin(more)  # one row each
    enough = F.col("n") >= least
    half = 1.959963984540054 * F.sqrt((1 + 0.5 * F.pow(F.col("sharpe") / sqrt(year), 2)) / F.col("n")) * sqrt(year)
    out = out.withColumns({"payoff_ratio": safe_ratio(F.col("average_win"), F.col("average_loss")), "sample_state": F.when(enough, "ok").otherwise("insufficient_sample")})
    out = out.withColumns({"sharpe_low": F.when(enough, F.col("sharpe") - half), "sharpe_high": F.when(enough, F.col("sharpe") + half)})
    return out.withColumns({c: F.when(enough, F.col(c)) for c in ("sharpe", "sortino", "calmar")})


def impact_cost(notional: Column, adv: Column, spread_bps: Column, coefficient: float = 10.0, power: float = 0.5) -> Column:
    """Half the spread plus a power-law impact, in dollars; no impact is known without volume."""
    share = F.greatest(safe_ratio(notional, adv), F.lit(0.0))
    return notional * (spread_bps / 2 + coefficient * F.pow(share, F.lit(power))) / 1e4


def tiered_commission(shares: Column, tiers: Sequence[tuple[float, float]], least: float) -> Column:
    """Per-share commission whose rate falls as the order grows; tiers: (shares up to, rate)."""
    total, below = F.lit(0.0), 0.0
    for top, rate in tiers:
        total = total + F.greatest(F.least(shares, F.lit(float(top))) - below, F.lit(0.0)) * rate
        below = float(top)
    return F.greatest(total, F.lit(least))


# -- pair risk --------------------------------------------------------------------------------


def ewma(df: DataFrame, by: str, day: str, a: str, b: str, span: int = 20, least: int = 10, year: int = 252) -> DataFrame:
    """mean_a, mean_b, vol_a, vol_b (annualised), corr and cov (annualised) of two return series by
    exponentially weighted moments with weight 1 - alpha a row (not adjusted): bias-corrected variances, a
    correlation of the uncorrected moments (0 where one is degenerate), their product as covariance, and
    nulls before `least` rows with both returns. Other rows carry the estimates on."""
    alpha = 2.0 / (span + 1)
    names = ("mean_a", "mean_b", "vol_a", "vol_b", "corr", "cov")

    def step(state: tuple, u: float | None, v: float | None) -> tuple:
        n, mx, my, mxx, myy, mxy, w2 = state
        if u is not None and v is not None and isfinite(u) and isfinite(v):
            k = alpha if n else 1.0
            mx, my = mx + k * (u - mx), my + k * (v - my)
            mxx, myy, mxy = mxx + k * (u * u - mxx), myy + k * (v * v - myy), mxy + k * (u * v - mxy)
            w2 = (1 - k) ** 2 * w2 + k * k  # the sum of squared weights
            n += 1
            state = n, mx, my, mxx, myy, mxy, w2
        if n < least:
            return state, (None,) * 6
        va, vb = max(mxx - mx * mx, 0.0), max(myy - my * my, 0.0)
        sd, fix = sqrt(va * vb), year / (1 - w2)
        corr = min(max((mxy - mx * my) / sd, -1.0), 1.0) if sd > 1e-12 else 0.0
        vol_a, vol_b = sqrt(va * fix), sqrt(vb * fix)
        return state, (mx, my, vol_a, vol_b, corr, corr * vol_a * vol_b)

    return carried(df, [by], [day], [a, b], dict.fromkeys(names, "double"), lambda: (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), step)


def pair_weights(signal: Column, vol_a: Column, vol_b: Column, corr: Column, method: str, target_vol: float = 0.1, max_gross: float = 2.0, gross: float = 1.0, floor: float = 0.01, hedge_low: float = 0.2, hedge_high: float = 5.0, variance_floor: float = 1e-6, cap: float = 1.0) -> tuple[Column, Column]:
    """(w_a, w_b) of the long-A short-B spread by one of four sizers; zero where an estimate is not
    finite."""
    a, b = F.greatest(vol_a, F.lit(floor)), F.greatest(vol_b, F.lit(floor))
    h = F.greatest(F.lit(hedge_low), F.least(F.lit(hedge_high), a / b))
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr))
    variance = F.greatest(a * a + h * h * b * b - 2 * h * rho * a * b, F.lit(variance_floor))
    scale = F.least(F.lit(target_vol) / F.sqrt(variance), F.lit(max_gross) / (1 + h))
    side, g = F.signum(signal), min(gross, max_gross)
    if method == "equal_dollar":
        wa, wb = side * (g / 2), side * (-g / 2)
    elif method == "inverse_vol":
        wa, wb = side * g * (1 / a) / (1 / a + 1 / b), side * -g * (1 / b) / (1 / a + 1 / b)
    elif method == "covariance_aware":
        wa, wb = side * scale, -side * h * scale
    elif method == "vol_target":
        alpha = F.greatest(F.lit(-cap), F.least(F.lit(cap), signal))
        size = scale / F.greatest(F.lit(1.0), F.abs(alpha))
        wa, wb = alpha * size, -alpha * h * size
    else:
        raise ValueError(f"unknown sizer {method}")
    ok = F.lit(True)
    for c in (signal, vol_a, vol_b, corr):
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(ok, wa).otherwise(0.0), F.when(ok, wb).otherwise(0.0)


def regime(percentile: Column, low: float = 1 / 3, high: float = 2 / 3) -> Column:
    return F.when(percentile.isNull(), "unknown").when(percentile <= low, "low").when(percentile >= high, "high").otherwise("mid")
