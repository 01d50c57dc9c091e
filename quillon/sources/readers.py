"""Readers of the files the engine is fed with. Schemas are declared; fields that cannot be read are
null, never a failure."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MINUTE_SCHEMA = "ticker string, volume string, open string, close string, high string, low string, window_start string, transactions string"
#: Symbol, expiry (yyMMdd), right and strike in thousandths of an option ticker.
OPTION = r"^O:([A-Z]+\d*?)(\d{6})([CP])(\d{8})$"


def read_table(spark: SparkSession, path: str, predicate: str | None = None, limit: int | None = None) -> DataFrame:
    """Parquet with the predicate pushed to the scan, and only then a limit."""
    df = spark.read.parquet(path)
    df = df.where(predicate) if predicate else df
    return df.limit(limit) if limit is not None else df


def read_sql(spark: SparkSession, sql: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """SQL with named parameters, which are bound, never pasted."""
    return spark.sql(sql, args=dict(args or {}))


def read_latest(df: DataFrame, keys: Mapping[str, object], order: str, n: int = 1) -> DataFrame:
    """The last n rows of a key by `order`: the filter goes to the scan, and only n rows of a task leave it."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.where(F.col(order).isNotNull()).orderBy(F.desc(order)).limit(n)


def read_range(df: DataFrame, keys: Mapping[str, Sequence[object]], at: str, start: object, end: object) -> DataFrame:
    """Rows of any of the keys' values with start <= at < end, in order."""
    for name, values in keys.items():
        df = df.where(F.col(name).isin(*values))
    return df.where((F.col(at) >= F.lit(start)) & (F.col(at) < F.lit(end))).orderBy(*keys, at)


def nanos(ts: Column) -> Column:
    return F.timestamp_micros((ts.try_cast("bigint") / 1000).cast("bigint"))


def bar_files(spark: SparkSession, path: str, tickers: DataFrame | None = None, daily: bool = False) -> DataFrame:
    """Bars of (compressed) CSV files; rows without a time go; of given tickers (column ticker) only."""
    raw = spark.read.csv(path, header=True, schema=MINUTE_SCHEMA)
    num = {c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close", "volume")}
    df = raw.withColumns(num | {"event_ts": nanos(F.col("window_start")), "trade_count": F.col("transactions").try_cast("bigint")})
    df = df.where("event_ts is not null").drop("window_start", "transactions").withColumnRenamed("ticker", "symbol")
    if tickers is not None:
        df = df.join(tickers.select(F.col("ticker").alias("symbol")).distinct(), "symbol", "left_semi")
    return df.withColumns({"event_date": F.to_date("event_ts"), "event_year": F.year("event_ts")}) if daily else df


def option_symbols(df: DataFrame, symbol: str) -> DataFrame:
    """underlying, expiry, right and strike of option tickers; malformed ones go."""
    part = lambda i: F.regexp_extract(symbol, OPTION, i)
    out = df.where(F.col(symbol).rlike(OPTION)).withColumns(
        {"underlying": part(1), "expiry": F.try_to_date(part(2), "yyMMdd"), "right": part(3), "strike": part(4).try_cast("double") / 1000}
    )
    return out.where("expiry is not null")


def snapshot_records(df: DataFrame, json: str) -> DataFrame:
    """Quote, greeks and provider time of option snapshots; the quote's time, else the trade's, else
    the ingest time."""
    schema = "ticker string, bid double, ask double, open_interest bigint, greeks struct<delta: double, gamma: double, theta: double, vega: double>, quote_ts bigint, trade_ts bigint, ingest_ts timestamp"
    r = df.withColumn("_r", F.from_json(json, schema))
    when = F.coalesce(nanos(F.col("_r.quote_ts").cast("string")), nanos(F.col("_r.trade_ts").cast("string")), F.col("_r.ingest_ts"))
    return r.select("_r.ticker", "_r.bid", "_r.ask", "_r.open_interest", "_r.greeks.*", when.alias("provider_ts"))


def cot_report(df: DataFrame) -> DataFrame:
    """Clean lower-case column names, report_date and its release six days on at 15:30 New York."""
    import re

    clean = [re.sub(r"_+", "_", re.sub(r"\W+", "_", c)).strip("_").lower() for c in df.columns]
    df = df.toDF(*clean)
    date = next(c for c in clean if c.startswith("report_date"))
    day = F.try_to_date(F.col(date), "yyyy-MM-dd")
    release = F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_add(day, 6).cast("string"), F.lit(" 15:30:00"))), "America/New_York")
    return df.withColumns({"report_date": day, "release_ts": release})


def series_csv(spark: SparkSession, path: str, series_id: str, vintage: Column | None = None) -> DataFrame:
    """(series_id, observation_date, value[, vintage_ts]) of a two-column CSV; a full stop is no value and
    goes."""
    raw = spark.read.csv(path, header=True)
    date, value = raw.columns[:2]
    out = raw.select(F.lit(series_id).alias("series_id"), F.try_to_date(F.col(date)).alias("observation_date"), F.col(value).try_cast("double").alias("value"))
    out = out.where("observation_date is not null and value is not null")
    return out if vintage is None else out.withColumn("vintage_ts", vintage)


def fetch_windows(spark: SparkSession, first: str, last: str, days: int, overlap: int) -> DataFrame:
    """(start, end) date windows of so many days that overlap by `overlap`, from first to last."""
    step = max(1, days - overlap)
    starts = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"INTERVAL {step} DAYS"))).alias("start")
    return spark.range(1).select(starts).withColumn("end", F.least(F.date_add("start", days - 1), F.lit(last).cast("date")))


def split_pages(df: DataFrame, json: str) -> DataFrame:
    """(symbol, ex_date, split_ratio) of provider pages; ratios that are not positive, not finite or
    one go."""
    schema = "results array<struct<execution_date: string, split_from: double, split_to: double, ticker: string>>"
    rows = df.select(F.explode(F.from_json(json, schema)["results"]).alias("r"))
    ratio = F.col("r.split_to") / F.nullif(F.col("r.split_from"), F.lit(0.0))
    out = rows.select(F.col("r.ticker").alias("symbol"), F.try_to_date(F.col("r.execution_date")).alias("ex_date"), ratio.alias("split_ratio"))
    return out.where("symbol is not null and ex_date is not null and split_ratio > 0 and split_ratio <> 1 and not isnan(split_ratio) and split_ratio < double('infinity')")


def fetch_pages(fetch: Callable[[str], str], first: str, most: int = 1000) -> list[str]:
    """The bodies of a paged answer, following next_url; an error if a page repeats or there are more than
    `most`. Fetching is the caller's: a network client, or files in tests."""
    import json

    bodies, seen, url = [], set(), first
    while url:
        if url in seen or len(bodies) == most:
            raise ValueError(f"paging does not end at {url}")
        seen.add(url)
        bodies.append(fetch(url))
        url = json.loads(bodies[-1]).get("next_url")
    return bodies


def aggregate_pages(df: DataFrame, symbol: str, json: str) -> DataFrame:
    """Bars of stored answers of an aggregates service (symbol, body): t in milliseconds, o, h, l, c, v, vw, n; bars
    without a time go."""
    schema = "results array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double, vw: double, n: bigint>>"
    rows = df.select(F.col(symbol).alias("symbol"), F.inline(F.from_json(json, schema)["results"]))
    named = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vw": "vwap", "n": "trade_count"}
    return rows.where("t is not null").withColumn("event_ts", F.timestamp_millis("t")).drop("t").withColumnsRenamed(named)


def in_batches(rows: Iterable, size: int, flush: Callable[[list], None], most: int | None = None) -> int:
    """Passes rows on in lists of at most `size`, the last one shorter, and stops after `most` lists; returns how
    many rows were passed on. A failed flush passes its error on, with nothing after it flushed."""
    held, done, n = [], 0, 0
    for row in rows:
        held.append(row)
        if len(held) == size:
            flush(held)
            held, done, n = [], done + 1, n + size
            if most is not None and done == most:
                return n
    if held:
        flush(held)
    return n + len(held)


def company_facts(df: DataFrame, key: str, json: str) -> DataFrame:
    """A row per entry of nested company facts: taxonomy -> concept -> unit -> entries."""
    entry = "struct<end: string, val: double, accn: string, fy: int, fp: string, form: string, filed: string, start: string>"
    schema = f"facts map<string, map<string, struct<label: string, units: map<string, array<{entry}>>>>>"
    a = df.select(key, F.explode(F.from_json(json, schema)["facts"]).alias("taxonomy", "_c"))
    b = a.select(key, "taxonomy", F.explode("_c").alias("concept", "_v"))
    c = b.select(key, "taxonomy", "concept", F.col("_v.label").alias("label"), F.explode("_v.units").alias("unit", "_e"))
    return c.select(key, "taxonomy", "concept", "label", "unit", F.inline("_e"))


def submissions(df: DataFrame, key: str, json: str) -> DataFrame:
    """A registrant of its raw payload: names, tickers, former names with dates, and the payload's
    SHA-256. A payload that is missing or not JSON is a miss."""
    schema = "cik string, name string, sic string, tickers array<string>, exchanges array<string>, formerNames array<struct<name: string, `from`: string, `to`: string>>"
    r = df.withColumn("_r", F.from_json(json, schema))
    former = F.transform("_r.formerNames", lambda x: F.struct(x["name"].alias("name"), F.to_date(F.substring(x["from"], 1, 10)).alias("valid_from"), F.to_date(F.substring(x["to"], 1, 10)).alias("valid_to")))
    return r.select(key, F.sha2(F.col(json), 256).alias("payload_sha256"), F.when(F.col(json).isNull() | F.col("_r.cik").isNull(), "miss").otherwise("ok").alias("status"), "_r.cik", "_r.name", "_r.sic", "_r.tickers", former.alias("former_names"))


def candles(df: DataFrame, json: str) -> DataFrame:
    # open and close time differ in case alone, so fields are read by path
    at = lambda k: F.get_json_object(json, f"$.{k}")
    num = [at(k).try_cast("double").alias(name) for k, name in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))]
    millis = lambda k: F.timestamp_millis(at(k).try_cast("bigint"))
    return df.select(at("s").alias("symbol"), millis("t").alias("open_ts"), millis("T").alias("close_ts"), *num, at("n").try_cast("int").alias("trade_count"))


def funding_rates(df: DataFrame, json: str) -> DataFrame:
    """(symbol, funding_ts, funding_rate, premium) of a venue's funding history, an array a row."""
    schema = "array<struct<coin: string, fundingRate: string, premium: string, time: bigint>>"
    r = df.select(F.explode(F.from_json(json, schema)).alias("r"))
    out = r.select(F.col("r.coin").alias("symbol"), F.timestamp_millis("r.time").alias("funding_ts"), F.col("r.fundingRate").try_cast("double").alias("funding_rate"), F.col("r.premium").try_cast("double").alias("premium"))
    return out.where("symbol is not null and funding_ts is not null and funding_rate is not null")


def bucket_listing(df: DataFrame, xml: str) -> DataFrame:
    """(key, size, modified, next) of a bucket's listing pages; next is the page's continuation token, null on the
    last one."""
    one = lambda c, tag: F.nullif(F.regexp_extract(c, f"<{tag}>([^<]*)</{tag}>", 1), F.lit(""))
    page = df.select(one(F.col(xml), "NextContinuationToken").alias("next"), F.explode(F.regexp_extract_all(F.col(xml), F.lit("(?s)<Contents>(.*?)</Contents>"), F.lit(1))).alias("_c"))
    return page.select(one(F.col("_c"), "Key").alias("key"), one(F.col("_c"), "Size").try_cast("bigint").alias("size"), one(F.col("_c"), "LastModified").try_cast("timestamp").alias("modified"), "next").where("key is not null")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is not JSON is null in every field and goes."""
    df = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.where("_bad is null").drop("_bad")


def undelivered(outbox: DataFrame, delivered: DataFrame, n: int, claimed: DataFrame | None = None) -> DataFrame:
    """The oldest n events that are neither delivered nor claimed by another run (event_id)."""
    rest = outbox.join(delivered.select("event_id").distinct(), "event_id", "left_anti")
    if claimed is not None:
        rest = rest.join(claimed.select("event_id").distinct(), "event_id", "left_anti")
    return rest.orderBy("event_id").limit(n)


def from_config(spark: SparkSession, rows: Sequence[Mapping[str, object]], schema: str, view: str | None = None) -> DataFrame:
    """A small relation of configuration rows, registered as a view if named."""
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    if view:
        df.createOrReplaceTempView(view)
    return df


def config_rows(text: str) -> list[dict[str, str]]:
    """Rows of a YAML list of flat mappings with plain values (`- key: value` and further `key: value` lines);
    anything else is an error. Comments and blank lines are left out, quotes around values taken off."""
    rows: list[dict[str, str]] = []
    for number, line in enumerate(text.splitlines(), 1):
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        new = body.startswith("- ")
        key, colon, value = body[2:].partition(":") if new else body.strip().partition(":")
        if not colon or not (new or (line[:1].isspace() and rows)):
            raise ValueError(f"line {number} is not `key: value` in a list: {line!r}")
        if new:
            rows.append({})
        if key.strip() in rows[-1]:
            raise ValueError(f"line {number} repeats {key.strip()}")
        rows[-1][key.strip()] = value.strip().strip("\"'")
    return rows


def literal_relation(spark: SparkSession, rows: Sequence[Sequence[object]], schema: str) -> DataFrame:
    """VALUES as a relation, folded into the plan."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def synthetic_matrix(spark: SparkSession, symbols: int, days: int, seed: int) -> DataFrame:
    """(symbol, day, close, volume, feature, label) test rows that depend on the seed, symbol and day alone."""
    u = lambda k: F.pmod(F.xxhash64("symbol", "day", F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1e6
    grid = spark.range(symbols).select(F.concat(F.lit("S"), F.col("id")).alias("symbol"), F.explode(F.sequence(F.lit("2020-01-01").cast("date"), F.date_add(F.lit("2020-01-01").cast("date"), days - 1))).alias("day"))
    return grid.select("symbol", "day", (50 + 100 * u(1)).alias("close"), (1000 * u(2)).alias("volume"), u(3).alias("feature"), (u(3) + 0.3 * u(4) > 0.65).cast("int").alias("label"))
