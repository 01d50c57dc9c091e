"""Markets that never close against an exchange that does: session membership of bars, weekend
windows and liquidity while the exchange is closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.functions.market import NEW_YORK
from quillon.operators.calendar import minimum_detectable


def weekends(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(weekend_id, start, end): Friday 16:00 to Monday 09:30 New York, a row per week."""
    days = spark.sql("SELECT explode(sequence(date(:a), date(:b), interval 1 day)) AS d", args={"a": first, "b": last}).where("dayofweek(d) = 6")
    at = lambda d, clock: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", d.cast("string"), F.lit(clock))), NEW_YORK)
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("weekend_id"), at(F.col("d"), "16:00:00").alias("start"), at(F.date_add("d", 3), "09:30:00").alias("end"))


def weekend_of(ts: Column) -> Column:
    """The weekend_id that holds an instant, or null; half-open, from its local weekday and minute, so
    no join is needed."""
    local = F.from_utc_timestamp(ts, NEW_YORK)
    minute = F.hour(local) * 60 + F.minute(local)
    day = F.dayofweek(local)  # 1 is Sunday
    friday = F.to_date(local) - F.pmod(day + 1, F.lit(7)).cast("int")
    inside = ((day == 6) & (minute >= 960)) | day.isin(7, 1) | ((day == 2) & (minute < 570))
    return F.when(inside, F.date_format(friday, "yyyy-MM-dd"))


def closed_liquidity(bars: DataFrame, ts: str, by: str) -> DataFrame:
    """Bars, traded ones, volume and mean range of each key, while the exchange is closed for a
    weekend and otherwise; and how many weekends there are."""
    step = bars.withColumn("weekend_id", weekend_of(F.col(ts)))
    return step.groupBy(by, F.col("weekend_id").isNotNull().alias("weekend")).agg(
        F.count("*").alias("n_bars"),
        F.count_if(F.col("volume") > 0).alias("n_traded"),
        F.sum("volume").alias("volume"),
        F.avg((F.col("high") - F.col("low")) / F.nullif(F.col("close"), F.lit(0.0))).alias("mean_range"),
        F.countDistinct("weekend_id").alias("n_weekends"),
    )


def weekend_power(bars: DataFrame, ts: str, by: str) -> DataFrame:
    """Weekends with data of each key and the smallest correlation they can tell from 0."""
    step = bars.withColumn("weekend_id", weekend_of(F.col(ts))).where("weekend_id is not null")
    per = step.groupBy(by).agg(F.countDistinct("weekend_id").alias("n_weekends"))
    return per.withColumn("detectable", minimum_detectable(F.col("n_weekends")))
