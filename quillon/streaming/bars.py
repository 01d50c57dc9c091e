"""The streaming path: typed bars, watermark and dedup, quarantine, per-bar features, sliding windows
and latency percentiles. Every function maps a DataFrame to a DataFrame and runs on a stream or a
batch alike; only run() and run_windowed() start queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillon.functions import market as m
from quillon.operators.relational import reason_codes

WATERMARK, WINDOW, SLIDE = "5 minutes", "15 minutes", "1 minute"
#: run_windowed() deals out windows by symbol and blocks of so many window lengths, to as many tasks as leave
#: each about so many windows.
BLOCK, TASK_WINDOWS = 4, 100_000
#: With several stateful steps allowed, late rows are judged by the watermark of a micro-batch before.
MULTIPLE = "spark.sql.streaming.statefulOperator.allowMultiple"


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of Parquet files, the oldest first, with a load time; with files_per_batch, so many files
    make a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("bronze_ts", F.current_timestamp())


def typed(raw: DataFrame) -> DataFrame:
    """Casts that give null instead of failing, normal symbols and spans, the availability time, the
    reasons against a bar and its hash. All native, so the stream stays in generated code."""
    step = raw.withColumns(
        {
            "symbol": m.normalized_symbol(F.col("symbol")),
            "timespan": F.lower(F.trim("timespan")),
            "event_ts": F.col("event_ts").cast("timestamp"),
            **{c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close", "volume", "vwap")},
            "trade_count": F.col("trade_count").try_cast("long"),
        }
    )
    iso = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return step.withColumns(
        {
            "information_available_ts": m.bar_available(F.col("event_ts"), F.col("timespan")),
            "dedup_hash": m.dedup_hash(F.col("symbol"), iso, F.col("timespan"), separator="\x1f"),
            "reasons": reason_codes(),
        }
    )


def valid(bars: DataFrame) -> DataFrame:
    """Valid bars, each (symbol, event_ts, timespan) once; state is dropped behind the watermark."""
    kept = bars.where(F.size("reasons") == 0).drop("reasons")
    return kept.withWatermark("event_ts", WATERMARK).dropDuplicates(["symbol", "event_ts", "timespan"])


def quarantined(bars: DataFrame) -> DataFrame:
    return bars.where(F.size("reasons") > 0)


def latest_features(bars: DataFrame, unchanged: float | None = None) -> DataFrame:
    """Stateless features of each bar; `unchanged` is the return of one that opens and closes at zero."""
    c = F.col
    still = F.when(c("close") == c("open"), F.lit(unchanged).cast("double"))
    return bars.withColumns(
        {
            "intrabar_return": F.coalesce(m.safe_ratio(c("close") - c("open"), c("open")), still),
            "bar_range": m.safe_ratio(c("high") - c("low"), c("close")),
            "close_vs_vwap": m.safe_ratio(c("close") - c("vwap"), c("vwap")),
            "is_up_bar": c("close") > c("open"),
            "gold_processed_ts": F.current_timestamp(),
        }
    )


def _summary() -> list[Column]:
    """The aggregates of a window's bars."""
    return [
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.stddev_samp("close").alias("close_std"),
        F.avg("close").alias("close_avg"),
        F.count("*").alias("n_bars"),
        F.max("information_available_ts").alias("information_available_ts"),
        F.max("bronze_ts").alias("completed_ts"),
    ]


def windowed(bars: DataFrame, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """Sliding aggregates of a watermarked stream, emitted once their window is behind the watermark. As a
    stream its state has a row for each window; run_windowed() keeps the bars instead."""
    w = F.window("event_ts", window, slide)
    return bars.groupBy("symbol", w).agg(*_summary()).select("symbol", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "high", "low", "close_std", "close_avg", "n_bars", "information_available_ts", "completed_ts")


def latency(paths: dict[str, DataFrame], watermark: str = WATERMARK) -> DataFrame:
    """p50 and p95 seconds from the last ingest to processing, by path and minute of processing, of
    streams (or batches) name -> frame with ingest_ts and processed_ts. A minute comes out once it lies
    behind the watermark of all the streams together."""
    out = None
    for name, df in paths.items():
        part = df.select(F.lit(name).alias("path"), "processed_ts", (F.unix_micros("processed_ts") - F.unix_micros("ingest_ts")).alias("us"))
        out = part if out is None else out.unionByName(part)
    w = F.window("processed_ts", "1 minute")
    agg = out.withWatermark("processed_ts", watermark).groupBy("path", w).agg(F.percentile_approx("us", [0.5, 0.95]).alias("p"), F.count("*").alias("n"))
    return agg.select("path", F.col("window.start").alias("minute"), (F.col("p")[0] / 1e6).alias("p50"), (F.col("p")[1] / 1e6).alias("p95"), "n")


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append", continuous: str | None = None, strict: bool = False, each: Callable[[DataFrame, int], None] | None = None):
    """Writes Parquet, exactly once. Without `continuous` all that is there, and stops; with it (a trigger
    interval such as "1 minute") the running query is returned. With `each`, that gets every micro-batch and
    its number and writes it instead; one that was cut off comes again under its number.

    By default Spark judges late rows by the watermark of one micro-batch before, so some that are behind the
    watermark still count. With `strict` every row behind it is dropped; the plan may then have no stateful
    step after an aggregate."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", path)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    conf = df.sparkSession.conf
    before = conf.get(MULTIPLE)
    conf.set(MULTIPLE, "false" if strict else before)
    try:
        query = writer.start()  # with a session of its own, so the setting stays with it
    finally:
        conf.set(MULTIPLE, before)
    if not continuous:
        query.awaitTermination()
    return query


def _ended(bars: DataFrame, after: int | None, until: int, length: int, step: int, tasks: int) -> DataFrame:
    """windowed() of a batch, of the windows that end after `after` and not after `until` (microseconds, as
    are length and step). The bars are dealt out, not their windows: by symbol and block of windows, so that
    no task has a whole symbol."""
    down = lambda x, n: x - F.pmod(x, F.lit(n))
    us, block, start = F.unix_micros("event_ts"), F.col("block"), F.col("start")
    low, high, size = down(us - length, step) + step, down(us, step), -(-length // step) * step * BLOCK
    dealt = bars.withColumn("block", F.explode(F.sequence(down(low, size), down(high, size), F.lit(size)))).repartition(tasks, "symbol", "block")
    # explode keeps the partitioning, which the expansion of F.window does not
    shared = dealt.withColumn("start", F.explode(F.sequence(F.greatest(low, block), F.least(high, block + (size - step)), F.lit(step))))
    ended = (start <= until - length) & (F.lit(True) if after is None else start > after - length)
    out = shared.where(ended).groupBy("symbol", "block", "start").agg(*_summary()).withColumns({"window_start": F.timestamp_micros(start), "window_end": F.timestamp_micros(start + length)})
    return out.select("symbol", "window_start", "window_end", "high", "low", "close_std", "close_avg", "n_bars", "information_available_ts", "completed_ts")


def _discard(spark: SparkSession, *folders: str) -> None:
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, folders):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_windowed(bars: DataFrame, path: str, checkpoint: str, window: str = WINDOW, slide: str = SLIDE, watermark: str = WATERMARK, continuous: str | None = None):
    """Writes windowed() of the stream valid(), with every row behind the watermark dropped.

    A bar lies in window / slide windows, so a state of windows is many times the bars. Here a micro-batch
    keeps the bars of windows still open, and aggregates the windows that have come behind the watermark
    since the one before it. It writes folders of its own, anew if it comes again."""
    spark, kept = bars.sparkSession, f"{checkpoint}/bars"
    length, step, delay = spark.sql("SELECT " + ", ".join(f"unix_micros(timestamp_micros(0) + INTERVAL {x})" for x in (window, slide, watermark))).first()
    rows = bars.select("symbol", "event_ts", "high", "low", "close", "information_available_ts", "bronze_ts")
    us = F.unix_micros("event_ts")

    def each(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{kept}/new/{i}")
        new = spark.read.schema(rows.schema).parquet(f"{kept}/new/{i}")
        old = spark.read.schema(rows.schema).parquet(f"{kept}/open/{i - 1}") if i else new.limit(0)
        # the latest bar is always among those kept, so the watermark, in whole milliseconds, is read off them
        both = old.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True)))
        seen, latest, n = both.agg(F.max(F.when(~F.col("new"), us)), F.max(us), F.count_if("new")).first()
        before, now = (None if x is None else x // 1000 * 1000 - delay for x in (seen, latest))
        table = both.drop("new")
        tasks = max(spark.sparkContext.defaultParallelism, n * -(-length // step) // TASK_WINDOWS)
        ended = table.where("false") if now is None else table
        _ended(ended, before, now or 0, length, step, tasks).write.mode("overwrite").parquet(f"{path}/batch={i}")
        still = table if now is None else table.where(us > now - length)
        still.write.mode("overwrite").parquet(f"{kept}/open/{i}")
        _discard(spark, f"{kept}/new/{i}", f"{kept}/open/{i - 2}")

    return run(rows, path, checkpoint, continuous=continuous, strict=True, each=each)
