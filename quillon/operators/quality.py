"""Data-quality checks: one aggregate for all checks of a table, a row per check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


class QualityError(ValueError):
    """A check that must hold does not."""


def report(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check, violations) of each named condition that marks a bad row: one pass over df."""
    one = df.agg(*[F.count_if(cond).alias(name) for name, cond in checks.items()])
    names = list(checks)
    stacked = ", ".join(f"'{n}', `{n}`" for n in names)
    return one.selectExpr(f"stack({len(names)}, {stacked}) as (check, violations)")


def require(df: DataFrame, checks: Mapping[str, Column]) -> None:
    bad = [f"{r['check']}: {r['violations']}" for r in report(df, checks).where("violations > 0").collect()]
    if bad:
        raise QualityError("; ".join(bad))


def point_in_time_checks(prediction: str, available: Sequence[str], features: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """No availability after the prediction, and a stamp wherever a source's features are there."""
    checks = {f"{a}_after_prediction": F.col(a) > F.col(prediction) for a in available}
    for stamp, columns in features.items():
        some = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
        checks[f"{stamp}_missing"] = some & F.col(stamp).isNull()
    return checks


def revision_conflicts(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a batch whose key the target has already."""
    return batch.join(target.select(*keys).distinct(), list(keys), "left_semi")


def novel_vintages(batch: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, vintage: str) -> DataFrame:
    """Batch rows whose value differs, null-safe, from the latest stored vintage of their key."""
    held = stored.groupBy(*keys).agg(F.max_by(value, vintage).alias("_held"), F.lit(True).alias("_is"))
    out = batch.join(held, list(keys), "left")
    return out.where(F.col("_is").isNull() | ~F.col(value).eqNullSafe(F.col("_held"))).drop("_held", "_is")


def latest_vintage(df: DataFrame, keys: Sequence[str], vintage: str, ties: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(vintage), *[F.desc(t) for t in ties])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rebased(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Values as an index that is 100 on the key's first day."""
    first = F.first(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("index", 100 * F.col(value) / F.nullif(first, F.lit(0.0)))


def grain(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(rows, keys, null_keys, duplicate_rows) of a declared grain."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(null.cast("int")).alias("null"))
    return per.agg(
        F.sum("n").alias("rows"), F.count("*").alias("keys"), F.sum(F.col("null") * F.col("n")).cast("long").alias("null_keys"), F.sum(F.col("n") - 1).alias("duplicate_rows")
    )


def ordered(df: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    """df with _row, its rows' places by day in each key; an error, when it is computed, where a day is missing or
    there twice."""
    w = Window.partitionBy(*by).orderBy(day)
    bad = F.col(day).isNull() | F.coalesce(F.lag(day).over(w) == F.col(day), F.lit(False))
    place = F.row_number().over(w)
    return df.withColumn("_row", F.when(bad, F.raise_error(F.concat(F.lit(f"{day} is missing or repeated: "), F.coalesce(F.col(day).cast("string"), F.lit("null"))))).otherwise(place))


def yield_curve(df: DataFrame, day: str, series: str, value: str, tenors: Mapping[str, str]) -> DataFrame:
    """A row per day with a column for each tenor (name -> series id) and, with y2 and y10 among them, spread_10s2s."""
    out = df.groupBy(day).agg(*[F.max(F.when(F.col(series) == s, F.col(value))).alias(n) for n, s in tenors.items()])
    return out.withColumn("spread_10s2s", F.col("y10") - F.col("y2")) if {"y2", "y10"} <= set(tenors) else out
