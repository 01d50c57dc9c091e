"""Queries that run the streaming path to the end of its input, and the serving layer."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.operators import serving, windows
from quillon.functions import market as m
from quillon.plans.base import BARS, DAILY, bars, daily, rounded, table
from quillon.sources import scratch
from quillon.streaming import bars as st

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Files of the landing folder; rows of every LATE-th id come two files late, of every AGAIN-th one twice.
FILES, LATE, AGAIN = 3, 50, 20
ROW_GROUP = 1 << 20


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """A landing folder of events in FILES files, in order of time, but for late and repeated rows; all
    rows are there."""
    folder = f"{scratch.folder(spark)}/landing"
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = e.agg(F.min("us"), F.max("us")).first()
    n = F.col("event_id")
    part = F.floor((F.col("us") - low) * FILES / F.lit(max(1, high - low + 1))).cast("int")
    due = F.when((n % LATE == 0) & (part + 2 < FILES), part + 2).otherwise(part)
    rows = e.withColumn("due", F.explode(F.when(n % AGAIN == 0, F.array(due, due)).otherwise(F.array(due)))).drop("us")
    # a row group goes to one task, so small ones let all tasks read a file
    out = rows.repartitionByRange(FILES, "due").sortWithinPartitions("due").write.option("parquet.block.size", ROW_GROUP)
    out.partitionBy("due").parquet(folder)
    # the stream reads the oldest file first, whichever was written first
    now = int(time.time() * 1000)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i in range(FILES):
        for status in store.globStatus(path(f"{folder}/due={i}/*.parquet")):
            store.setTimes(status.getPath(), now - 10_000 * (FILES - i), -1)
    return folder


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed events as a stream of bars, a file a micro-batch, some rows faulty, late or twice there."""
    raw = st.source(spark, _landed(spark, sf_dir), spark.read.parquet(f"{sf_dir}/events.parquet").schema, 1)
    n, v = F.col("event_id"), F.col("value")
    cols = {
        "symbol": F.concat(F.lit(" u"), F.col("user_id").cast("string")), "event_ts": F.col("ts"), "timespan": F.when(n % 17 == 0, "week").otherwise("MINUTE"), "open": v.cast("string"),
        "high": v.cast("string"), "low": F.when(n % 11 != 0, v).cast("string"), "close": v.cast("string"), "volume": F.lit("1"), "vwap": v.cast("string"), "trade_count": F.lit("x"),
    }
    return raw.select("event_id", "bronze_ts", *[c.alias(k) for k, c in cols.items()])


_LANDED = f"""p AS (SELECT *, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * {FILES}::HUGEINT / greatest(1, (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events))) AS INTEGER) AS part FROM events),
 l AS (SELECT *, event_id % {LATE} = 0 AND part + 2 < {FILES} AS late FROM p), landed AS (SELECT * FROM l UNION ALL SELECT * FROM l WHERE event_id % {AGAIN} = 0)"""
_VALID = f"""{_LANDED}, v AS (SELECT event_id, 'U' || user_id AS symbol, ts AS event_ts, value, late FROM landed WHERE event_id % 17 <> 0 AND event_id % 11 <> 0)"""


@query(f"""WITH {_LANDED}, r AS (SELECT event_id, 'U' || user_id AS symbol, array_to_string(list_filter([CASE WHEN event_id % 11 = 0 THEN 'invalid_low' END, CASE WHEN value < 0 AND event_id % 11 <> 0 THEN 'negative_price' END,
 CASE WHEN event_id % 17 = 0 THEN 'unsupported_timespan' END], lambda x: x IS NOT NULL), ',') AS reasons FROM landed) SELECT * FROM r WHERE reasons <> ''""")
def str01_04_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantine keeps no state, so late and repeated rows are all there."""
    base = scratch.folder(spark)
    out = st.quarantined(st.typed(_stream(spark, sf_dir))).select("event_id", "symbol", F.array_join("reasons", ",").alias("reasons"))
    st.run(out, f"{base}/out", f"{base}/log")
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(f"""WITH {_VALID}, k AS (SELECT DISTINCT symbol, event_ts, value FROM v WHERE NOT late), w AS (SELECT symbol, time_bucket(INTERVAL 1 MINUTE, event_ts) - to_minutes(CAST(o AS BIGINT)) AS s, value, event_ts FROM k, range(15) r(o))
 SELECT symbol, epoch_us(s) AS start_us, round(max(value), 6) AS high, round(min(value), 6) AS low, round(avg(value), 6) AS close_avg, round(coalesce(stddev_samp(value), -1), 5) AS close_std, count(*) AS n_bars, epoch_us(s) + 900000000 AS end_us, epoch_us(max(event_ts)) + 60000000 AS available_us, TRUE AS completed FROM w
 WHERE s + INTERVAL 15 MINUTE <= (SELECT max(event_ts) FROM k) - INTERVAL 5 MINUTE GROUP BY symbol, s""")
def str03_05_08_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermark, dedup and sliding windows over several micro-batches: a row that comes two files late
    is behind the watermark and dropped, a repeated one counts once, and a window is there once it lies
    behind the watermark."""
    base = scratch.folder(spark)
    kept = st.valid(st.typed(_stream(spark, sf_dir)))
    st.run_windowed(kept, f"{base}/out", f"{base}/log")
    got = spark.read.schema(st.windowed(kept).schema).parquet(f"{base}/out")
    return rounded(
        got.select(
            "symbol", F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), "high", "low", "close_avg", F.round(F.coalesce("close_std", F.lit(-1.0)), 5).alias("close_std"),
            "n_bars", F.unix_micros("information_available_ts").alias("available_us"), (F.col("completed_ts") <= F.current_timestamp()).alias("completed"),
        )
    )


@query(f"""WITH {_VALID} SELECT event_id, CAST(0 AS DOUBLE) AS intrabar_return, FALSE AS is_up_bar, epoch_us(event_ts) + 60000000 AS available_us, sha256(symbol || chr(31) || strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%fZ') || chr(31) || 'minute') AS dedup_hash FROM v""")
def str02_06_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch.folder(spark)
    out = st.latest_features(st.typed(_stream(spark, sf_dir)).where("size(reasons) = 0"), unchanged=0.0)
    out = out.select("event_id", "intrabar_return", "is_up_bar", F.unix_micros("information_available_ts").alias("available_us"), "dedup_hash")
    st.run(out, f"{base}/out", f"{base}/log")
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(f"""WITH {_LANDED}, e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'velocity' ELSE 'windowed' END AS path, ts, event_id % 97 AS s FROM landed WHERE NOT late), g AS (SELECT path, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, s FROM e)
 SELECT path, epoch_us(minute) AS minute_us, CAST(quantile_disc(s, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(s, 0.95) AS DOUBLE) AS p95, count(*) AS n FROM g
 WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM e) - INTERVAL 5 MINUTE GROUP BY path, minute""")
def str07_agg13_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams over the landed files, in several micro-batches: late rows are dropped, and the last
    minutes are still open."""
    landed = _landed(spark, sf_dir)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema

    def path(side: int) -> DataFrame:
        e = st.source(spark, landed, schema, 1).where(F.col("event_id") % 2 == side).withColumn("processed_ts", F.col("ts").cast("timestamp"))
        return e.withColumn("ingest_ts", F.timestamp_micros(F.unix_micros("processed_ts") - (F.col("event_id") % 97) * 1_000_000))

    base = scratch.folder(spark)
    out = st.latency({"velocity": path(0), "windowed": path(1)})
    st.run(out, f"{base}/out", f"{base}/log", strict=True)
    got = spark.read.schema(out.schema).parquet(f"{base}/out")
    return got.select("path", F.unix_micros("minute").alias("minute_us"), "p50", "p95", "n")


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = windows.momentum_risk(daily(spark, sf_dir), 5)
    return step.withColumnRenamed("r", "return_1d")


_VIEW = f"{DAILY}, view AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) - 1 AS return_1d FROM daily)"


def _range(spark: SparkSession, sf_dir: str) -> tuple[dt.date, dt.date]:
    low, high = bars(spark, sf_dir).agg(F.min("day"), F.max("day")).first()
    return low, high


@query(f"""WITH {_VIEW} SELECT 'trend' AS kind, symbol, CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS period, round(sum(volume), 6) AS value FROM view WHERE symbol IN (1, 2, 3) GROUP BY ALL
 UNION ALL SELECT 'aggregate', symbol, '', round(avg(close), 6) FROM view WHERE symbol IN (4, 5, 6) GROUP BY ALL
 UNION ALL SELECT 'rank', symbol, CAST(row_number() OVER (ORDER BY c DESC, symbol) AS VARCHAR), round(c, 6) FROM (SELECT symbol, arg_max(close, day) AS c FROM view WHERE symbol IN (7, 8, 9, 10) GROUP BY symbol)
 UNION ALL SELECT 'compound', symbol, '', round(exp(sum(ln(1 + return_1d))) - 1, 6) FROM view WHERE symbol IN (1, 2) AND return_1d > -1 GROUP BY ALL""")
def nlq01_05_compiled_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = _range(spark, sf_dir)
    view = _view(spark, sf_dir)
    ask = lambda metric, op, names, **k: serving.compile_intent(serving.Intent(metric, op, names, low, high, **k), view)
    row = lambda df, kind, period, value: df.select(F.lit(kind).alias("kind"), "symbol", period.alias("period"), F.col(value).cast("double").alias("value"))
    a = row(ask("volume", "trend", ("1", "2", "3"), grouping="week"), "trend", F.col("period").cast("string"), "volume")
    b = row(ask("price", "aggregate", ("4", "5", "6")), "aggregate", F.lit(""), "close")
    c = row(ask("price", "rank", ("7", "8", "9", "10"), grouping="ticker"), "rank", F.col("rank").cast("string"), "close")
    d = row(ask("return", "aggregate", ("1", "2"), aggregation="compound"), "compound", F.lit(""), "return_1d")
    return rounded(a.unionByName(b).unionByName(c).unionByName(d))


@query(f"""WITH {BARS}, b AS (SELECT event_id, symbol, event_ts, close, high, low, vwap, close * 0.99e0 + (event_id % 3) / 1e2 AS open, lag(event_id) OVER (PARTITION BY symbol ORDER BY event_ts) AS previous FROM bars)
 SELECT event_id, epoch_us(event_ts) + 60000000 AS information, previous, round((close - open) / nullif(open, 0), 6) AS intrabar_return, round((high - low) / nullif(close, 0), 6) AS bar_range, round((close - vwap) / nullif(vwap, 0), 6) AS close_vs_vwap, close > open AS is_up_bar FROM b""")
def prj03_udf04_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("open", F.col("close") * 0.99 + F.col("event_id") % 3 / 1e2)
    w = Window.partitionBy("symbol").orderBy("event_ts")
    out = st.latest_features(b.withColumn("previous", F.lag("event_id").over(w)))
    out = out.withColumn("information", F.unix_micros(m.bar_available(F.col("event_ts"), F.lit("minute"))))
    return rounded(out.select("event_id", "information", "previous", "intrabar_return", "bar_range", "close_vs_vwap", "is_up_bar"))
