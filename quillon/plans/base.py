"""The driver's tables under the names the operators use, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts as an instant."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute-like bars: a user is a symbol, a value a close."""
    v, n = F.col("value"), F.col("event_id")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("symbol"),
        F.col("ts").alias("event_ts"),
        F.to_date("ts").alias("day"),
        v.alias("close"),
        (v * (1 + (n % 5) / 1e2)).alias("high"),
        (v * (1 - (n % 3) / 1e2)).alias("low"),
        (n % 100 + 1).cast("double").alias("volume"),
        (v * (1 + (n % 7 - 3) / 1e3)).alias("vwap"),
        "event_type",
        "event_id",
    )


BARS = """bars AS (SELECT user_id AS symbol, ts AS event_ts, CAST(ts AS DATE) AS day, value AS close,
 value * (1 + (event_id % 5) / 1e2) AS high, value * (1 - (event_id % 3) / 1e2) AS low,
 CAST(event_id % 100 + 1 AS DOUBLE) AS volume, value * (1 + (event_id % 7 - 3) / 1e3) AS vwap, event_type, event_id FROM events)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each symbol: first, highest, lowest and last close, volume, dollar volume."""
    b = bars(spark, sf_dir)
    return b.groupBy("symbol", "day").agg(
        F.min_by("close", "event_ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "event_ts").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.col("close") * F.col("volume")).alias("dollar_volume"),
    )


DAILY = BARS + """, daily AS (SELECT symbol, day, arg_min(close, event_ts) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, event_ts) AS close, sum(volume) AS volume, sum(close * volume) AS dollar_volume FROM bars GROUP BY symbol, day)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
