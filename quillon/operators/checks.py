"""The named data-quality checks of the bar, filing and report tables and of corporate actions. Each table is
aggregated once for all its checks; a row per check comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.operators.quality import report
from quillon.operators.relational import broken_rules


def point_in_time_report(options: DataFrame, filings: DataFrame, positions: DataFrame, features: DataFrame, matrix: DataFrame, bars: DataFrame, raw_positions: DataFrame) -> DataFrame:
    """(check, violations), eight of them: availability stamps of the option, filing and position features
    (information_available_ts); minute features (feature_ts) known one minute after; matrix rows without
    a feature_snapshot_id; bars out of range or without a price; positions without a market_code."""
    absent = lambda c: F.col(c).isNull()
    missing, high, low, volume = broken_rules()
    late = F.col("information_available_ts") != F.col("feature_ts") + F.expr("INTERVAL 1 MINUTE")
    parts = [
        report(options, {"options_available_ts_missing": absent("information_available_ts")}),
        report(filings, {"filings_available_ts_missing": absent("information_available_ts")}),
        report(positions, {"positions_available_ts_missing": absent("information_available_ts")}),
        report(features, {"bar_features_not_one_minute_later": late}),
        report(matrix, {"matrix_snapshot_id_missing": absent("feature_snapshot_id")}),
        report(bars, {"bars_out_of_range": high | low | volume, "bars_price_missing": missing}),
        report(raw_positions, {"positions_market_code_missing": absent("market_code")}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeated_keys(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """(check, violations): how many keys there are more than once."""
    per = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per.agg(F.count_if(F.col("_n") > 1).alias("violations")).select(F.lit(name).alias("check"), "violations")


def corporate_action_report(actions: DataFrame, adjusted: DataFrame, breaks: DataFrame) -> DataFrame:
    """(check, violations), ten of them, of actions (symbol, ex_date, source, split_ratio), adjusted bars
    (symbol, event_date, cumulative_split_ratio, price_adjustment_factor, adj_close, return_1d,
    is_data_quality_break) and breaks (symbol, event_date, classification, split_error)."""
    c = F.col
    bad = lambda name: c(name).isNull() | (c(name) <= 0)
    masked = c("is_data_quality_break")
    parts = [
        repeated_keys(actions, "actions_repeated_keys", "symbol", "ex_date", "source"),
        repeated_keys(adjusted, "adjusted_repeated_keys", "symbol", "event_date"),
        repeated_keys(breaks, "breaks_repeated_keys", "symbol", "event_date"),
        report(actions, {"split_ratio_not_positive": bad("split_ratio")}),
        report(
            adjusted,
            {
                "factor_not_positive": bad("cumulative_split_ratio") | bad("price_adjustment_factor"),
                "adjusted_price_not_positive": bad("adj_close"),
                "factor_product_not_one": F.abs(c("price_adjustment_factor") * c("cumulative_split_ratio") - 1.0) > 0.001,
                "masked_return_present": masked & c("return_1d").isNotNull(),
                "masked_return_zero": masked & (c("return_1d") == 0.0),
            },
        ),
        report(breaks, {"explained_error_too_large": (c("classification") == "SPLIT_EXPLAINED") & (c("split_error") > 0.03)}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
