"""Operators on hand-made rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import adjust, asof, calendar, graph, identity, outcomes, perpetuals, publication, quality, relational as r, research, retrieval, serving, strategy, text, windows
from quillon.sources import readers, sinks


def rows(df, *order):
    return [tuple(x) for x in df.orderBy(*order).collect()]


def test_asof_never_sees_the_future(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1), (None, 3)], "k string, t long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 11, "y"), ("b", 2, "z"), ("a", None, "n")], "k string, rt long, v string")
    got = rows(asof.asof_join(left, right, ["k"], "t", "rt", ["v"]), "k", "t")
    assert got == [(None, 3, None, None), ("a", 5, 5, "x"), ("a", 10, 5, "x"), ("b", 1, None, None)]
    got = rows(asof.asof_join(left, right, ["k"], "t", "rt", ["v"], exact=False), "k", "t")
    assert got[1] == ("a", 5, None, None)


def test_asof_global(spark):
    left = spark.range(0, 100).select((F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(hours=F.col("id").cast("int"))).alias("t"), "id")
    right = left.where("id % 7 = 3").select(F.col("t").alias("rt"), F.col("id").alias("v"))
    got = rows(asof.asof_global(left, right, "t", "rt", ["v"]).select("id", "v"), "id")
    assert got == [(i, None if i < 3 else (i - 3) // 7 * 7 + 3) for i in range(100)]


def test_upsert_twice_is_once(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k long, v string")
    s = spark.createDataFrame([(2, "B"), (None, "N"), (3, "c")], "k long, v string")
    once = r.upsert(t, s, ["k"])
    assert rows(once, "k") == [(None, "N"), (1, "a"), (2, "B"), (3, "c")]
    assert rows(r.upsert(once, s, ["k"]), "k") == rows(once, "k")
    assert rows(r.insert_only(t.where("k is not null"), s.where("k is not null"), ["k"]), "k") == [(1, "a"), (2, "b"), (3, "c")]


def test_conditional_update_keeps_reviewed(spark):
    t = spark.createDataFrame([(1, "a", "me"), (2, "b", None)], "k long, v string, reviewed_by string")
    s = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    got = rows(r.conditional_update(t, s, ["k"], ["v"], F.col("reviewed_by").isNotNull()), "k")
    assert got == [(1, "a", "me"), (2, "y", None), (3, "z", None)]


def test_split_factor_is_strictly_later(spark):
    days = spark.createDataFrame([("a", dt.date(2024, 1, d), 10.0, 10.0, 10.0, 10.0, 1.0) for d in (1, 2, 3)], "symbol string, day date, open double, high double, low double, close double, volume double")
    splits = spark.createDataFrame([("a", dt.date(2024, 1, 2), 2.0), ("a", dt.date(2024, 1, 3), 5.0)], "symbol string, ex_date date, split_ratio double")
    got = [round(x.factor, 9) for x in adjust.adjust_bars(days, splits).orderBy("day").collect()]
    assert got == [10.0, 5.0, 1.0]
    assert [round(x.factor, 9) for x in adjust.split_factors(days, splits).orderBy("day").collect()] == got


def test_state_machine(spark):
    scores = [-3.0, -1.0, -0.2, None, 3.0, 2.0, None, None, None, None, -3.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(scores)], "symbol string, day int, s double")
    got = [x.position for x in strategy.signal_positions(df, "symbol", "day", "s").orderBy("day").collect()]
    assert got == [1, 1, 0, 0, -1, -1, -1, -1, -1, 0, 1]


def test_adv_cap(spark):
    df = spark.createDataFrame([("s", 0, 0.5, 10.0), ("s", 1, 0.5, None), ("s", 2, -0.5, 10.0), ("s", 3, 0.0, 0.0)], "symbol string, day int, w double, adv double")
    got = [round(x.capped, 9) for x in strategy.capped_weights(df, "symbol", "day", "w", "adv", 1.0, 0.02).orderBy("day").collect()]
    assert got == [0.2, 0.4, -0.2, 0.0]


def test_neutralize_matches_least_squares(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"t": 1, "g": rng.integers(0, 3, 40), "b": rng.normal(size=40), "v": rng.normal(size=40)})
    got = research.neutralize(spark.createDataFrame(pdf), "t", "v", "b", "g").toPandas().sort_values(["b"])
    pdf = pdf.sort_values("b")
    x = np.column_stack([pdf.b, pd.get_dummies(pdf.g).to_numpy(float)])
    want = pdf.v - x @ np.linalg.lstsq(x, pdf.v, rcond=None)[0]
    assert np.allclose(got.residual.to_numpy(), want.to_numpy())


def test_calendar():
    assert calendar.easter(2024) == dt.date(2024, 3, 31) and calendar.easter(2025) == dt.date(2025, 4, 20)
    closed = calendar.closures(2024)
    assert {dt.date(2024, 1, 1), dt.date(2024, 3, 29), dt.date(2024, 6, 19), dt.date(2024, 11, 28), dt.date(2024, 12, 25)} <= closed and len(closed) == 10
    assert dt.date(2021, 12, 31) not in calendar.closures(2021) and dt.date(2021, 12, 31) not in calendar.closures(2022)
    assert calendar.early_closes(2024) == {dt.date(2024, 7, 3), dt.date(2024, 11, 29), dt.date(2024, 12, 24)}
    assert calendar.lookback(dt.date(2024, 1, 2), 1) == dt.date(2023, 12, 29)


def test_sessions(spark):
    cal = calendar.sessions(spark, 2024, 2024)
    assert cal.count() == 252
    ts = spark.createDataFrame([(1, dt.datetime(2024, 7, 3, 18, 0)), (2, dt.datetime(2024, 7, 3, 15, 0))], "i long, ts timestamp")
    got = calendar.next_open(ts, cal, "ts").orderBy("i").collect()
    assert [x.in_session for x in got] == [False, True]
    assert got[0].previous_close == dt.datetime(2024, 7, 3, 17, 0) and got[0].next_open == dt.datetime(2024, 7, 5, 13, 30)


def test_policy_and_ranges():
    day = dt.date(2024, 5, 15)
    ask = lambda **k: serving.Intent(**{"metric": "price", "operation": "trend", "entities": ("A",), "start": dt.date(2024, 1, 1), "end": day, **k})
    assert serving.classify(ask(), serving.Bounds(), day).level == serving.CHEAP
    assert serving.classify(ask(metric="x"), serving.Bounds(), day).reasons == ("pair_not_registered",)
    assert "unadjusted_corporate_action" in serving.classify(ask(), serving.Bounds(splits=(("A", dt.date(2024, 2, 2)),)), day).reasons
    assert "future_date" in serving.classify(ask(end=dt.date(2030, 1, 1)), serving.Bounds(), day).reasons
    assert serving.relative_range("Last  Month", day) == (dt.date(2024, 4, 1), dt.date(2024, 4, 30))
    assert serving.relative_range("last quarter", day) == (dt.date(2024, 1, 1), dt.date(2024, 3, 31))
    assert serving.relative_range("last 5 days", day) == (dt.date(2024, 5, 11), day)
    assert serving.relative_range("sometime", day) is None
    with pytest.raises(ValueError):
        serving.normal_text("x; drop table")
    assert serving.resolve_aliases(["Ａpple", "zzz"], {"APPLE": "AAPL"}) == (["AAPL"], ["zzz"])


def test_quarantine_tokens(spark):
    """The first broken rule, in order; a bar without a symbol is no bar of the universe; a missing volume
    is no fault; a bar quarantined for no rule of these is unknown."""
    rows = [("A", 1.0, 0.5, 0.7, 0.8, -1.0), ("A", None, 0.5, 0.7, 0.8, -1.0), ("A", 1.0, 1.5, 1.2, 1.4, -1.0), ("A", 1.0, 1.5, 0.5, 1.0, -1.0), ("A", 1.0, 1.0, 1.0, 1.0, None), (None, 1.0, 0.5, 0.7, 0.8, 1.0), ("Z", 1.0, 0.5, 0.7, 0.8, 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, open double, high double, low double, close double, volume double")
    universe = spark.createDataFrame([("A",)], "symbol string")
    valid, bad = r.split_valid(bars, universe)
    assert [x.volume for x in valid.collect()] == [None]
    assert sorted(x.reason for x in bad.collect()) == ["high_below_open_close", "low_above_open_close", "negative_volume", "null_price"]
    assert valid.withColumn("reason", r.quarantine_reason()).first().reason == "unknown"


def test_reason_codes(spark):
    """One fault at a time on a valid bar, as strings or numbers that are not finite, and several at once."""
    good = {"symbol": "AAPL", "event_ts": dt.datetime(2024, 1, 2), "open": 100.0, "high": 101.0, "low": 99.0, "close": 100.5, "volume": 1000.0, "vwap": 100.4, "trade_count": 42, "timespan": "minute"}
    nan = float("nan")
    cases = [
        ({}, []), ({"symbol": " "}, ["missing_symbol"]), ({"symbol": None}, ["missing_symbol"]), ({"event_ts": None}, ["invalid_event_ts"]), ({"timespan": None}, ["missing_timespan"]),
        ({"timespan": " "}, ["missing_timespan"]), ({"timespan": "week"}, ["unsupported_timespan"]), ({"timespan": " Hour "}, []), ({"open": None}, ["invalid_open"]), ({"close": nan}, ["invalid_close"]),
        ({"high": float("inf")}, ["invalid_high"]), ({"low": nan, "volume": -1.0}, ["invalid_low", "negative_volume"]), ({"high": 98.0}, ["high_below_components", "high_below_low", "low_above_components", "vwap_out_of_range"]),
        ({"low": 0.0, "open": 0.0}, []), ({"low": -1.0}, ["negative_price"]), ({"low": 100.2}, ["low_above_components"]), ({"volume": None, "vwap": None, "trade_count": None}, []),
        ({"volume": nan}, []), ({"trade_count": -1}, ["negative_trade_count"]), ({"vwap": 102.0}, ["vwap_out_of_range"]), ({"high": 100.4}, ["high_below_components"]),
    ]
    schema = "i int, symbol string, event_ts timestamp, open double, high double, low double, close double, volume double, vwap double, trade_count long, timespan string"
    df = spark.createDataFrame([(i, *{**good, **c}.values()) for i, (c, _) in enumerate(cases)], schema)
    assert [x.l for x in df.select("i", r.reason_codes().alias("l")).orderBy("i").collect()] == [want for _, want in cases]
    gone = df.withColumn("record", F.when(F.col("i") > 0, "{}"))
    assert gone.where("i = 0").select(r.record_reasons(F.col("record")).alias("l")).first().l == ["null_record"]


def test_quote_flags(spark):
    rows = [(1.0, 1.0), (2.0, 1.0), (1.0, 2.0), (None, 1.0), (1.0, None), (None, None)]
    df = spark.createDataFrame(rows, "bid double, ask double")
    got = [(x.l, x.c) for x in df.select(r.locked(F.col("bid"), F.col("ask")).alias("l"), r.crossed(F.col("bid"), F.col("ask")).alias("c")).collect()]
    assert got == [(True, False), (False, True), (False, False), (False, False), (None, False), (False, False)]


def test_regime_and_labels(spark):
    rows = [(2.0, 1.0, 0.1), (2.0, 1.0, -0.1), (0.5, 1.0, -0.1), (0.5, 1.0, 0.1), (1.005, 1.0, 0.1), (2.0, None, 0.1), (2.0, 1.0, None)]
    df = spark.createDataFrame(rows, "r double, m double, s double")
    assert [x.v for x in df.select(windows.breadth_regime(F.col("r"), F.col("m"), F.col("s")).alias("v")).collect()] == ["BROAD", "MIXED", "NARROW", "MIXED", "BROAD", "MIXED", "MIXED"]
    score, label = outcomes.crowding(F.col("a"), F.col("b"))
    z = spark.createDataFrame([(0.6, 1.0), (0.5, 0.0), (-0.6, None), (None, 1.0)], "a double, b double")
    assert [(x.s, x.l) for x in z.select(score.alias("s"), label.alias("l")).collect()] == [(0.8, "risk_on"), (0.25, "neutral"), (None, "risk_off"), (None, None)]
    cos = spark.createDataFrame([(0.96,), (0.95,), (0.85,), (0.7,), (-1.0,), (None,)], "c double")
    assert [x.l for x in cos.select(text.tone_label(F.col("c")).alias("l")).collect()] == ["high_consistency", "moderate_consistency", "notable_shift", "significant_shift", "significant_shift", None]


def test_interval_join_is_brute_force(spark):
    """Random, long, open, empty and touching intervals, at hours' ends too, against pairs one by one."""
    rng = np.random.default_rng(3)
    base = dt.datetime(2023, 12, 31, 20)
    at = lambda m: base + dt.timedelta(minutes=int(m), microseconds=int(rng.integers(0, 2)))
    points = [(int(rng.integers(0, 3)), i, at(rng.choice([rng.integers(0, 90_000), 60 * rng.integers(0, 1500)]))) for i in range(300)] + [(None, 900, at(5)), (1, 901, None)]
    spans = []
    for i in range(120):
        a = rng.choice([rng.integers(0, 90_000), 60 * rng.integers(0, 1500)])
        long = rng.choice([0, 1, 60, 61, 1440, 30_000, -5])
        spans.append((int(rng.integers(0, 3)), i, at(a), None if i % 11 == 0 else at(a + long)))
    spans += [(0, 500, dt.datetime(1700, 1, 1), dt.datetime(2900, 1, 1)), (None, 501, at(0), None), (1, 502, None, at(9))]
    p, s = spark.createDataFrame(points, "k int, p int, t timestamp"), spark.createDataFrame(spans, "k int, i int, a timestamp, b timestamp")
    want = sorted((pi, ii) for pk, pi, t in points for ik, ii, a, b in spans if None not in (pk, t, ik, a) and pk == ik and a <= t and (b is None or t < b))
    got = asof.interval_join(p, s, ["k"], "t", "a", "b", "inner")
    assert sorted((x.p, x.i) for x in got.collect()) == want and len(want) > 500
    left = asof.interval_join(p, s, ["k"], "t", "a", "b").collect()
    assert sorted((x.p, -1 if x.i is None else x.i) for x in left) == sorted(want + [(q[1], -1) for q in points if q[1] not in {w[0] for w in want}])


def test_reconcile_deletes_what_the_source_lacks(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (9, "d")], "k int, v string")
    s = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k int, v string")
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(r.reconcile_to_source(t, s, ["k"])) == rows(s)
    assert rows(r.reconcile_to_source(t, s, ["k"], F.col("k") < 5)) == rows(s.unionByName(t.where("k = 9")))
    once = r.reconcile_to_source(t, s, ["k"], F.col("k") < 5)
    assert rows(r.reconcile_to_source(once, s, ["k"], F.col("k") < 5)) == rows(once)


def test_long_chains_of_corrections(spark):
    """A chain of 3,000 links, of which the last is public, corrects all before it."""
    n = 3000
    log = spark.range(n).select(
        F.col("id").alias("event_id"), F.lit("e").alias("entity"), F.lit("a").alias("attribute"), F.col("id").cast("string").alias("value"), F.lit(0).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"),
        F.col("id").alias("recorded_at"), F.when((F.col("id") == 0) | (F.col("id") == n - 1), F.col("id")).alias("public_at"), F.when(F.col("id") > 0, F.col("id") - 1).alias("supersedes"),
    )
    at = lambda k: [x.value for x in graph.resolve(log, F.lit(5), F.lit(k), "public_as_of").collect()]
    assert at(n) == [str(n - 1)] and at(n - 2) == ["0"]
    ring = spark.createDataFrame([(1, 3, 5), (2, 1, 6), (3, 2, 7), (4, 1, 8), (5, None, 9)], "event_id long, supersedes long, recorded_at long")
    assert sorted(x.event_id for x in graph.correction_cycles(ring).collect()) == [1, 2, 3, 4]
    assert graph.correction_cycles(log).count() == 0


def test_bootstrap_does_not_depend_on_partitions(spark):
    """Against loops over the same weights, and after other dealings."""
    rng = np.random.default_rng(0)
    rows = [(i, "ab"[i % 2], float(v)) for i, v in enumerate(rng.normal(50, 5, 200))] + [(999, "a", None)]
    df = spark.createDataFrame(rows, "i long, k string, v double")
    got = {x.k: (x.low, x.high) for x in research.bootstrap_mean(df, ["k"], "v", ["i"], 400).collect()}
    again = {x.k: (x.low, x.high) for x in research.bootstrap_mean(df.repartition(7), ["k"], "v", ["i"], 400).collect()}
    ids = {x.i: x.h for x in df.select("i", F.xxhash64("i").alias("h")).collect()}
    for k in "ab":
        part = [(ids[i], v) for i, g, v in rows if g == k and v is not None]
        w = research.bootstrap_weights(np.array([h for h, _ in part], dtype=np.int64).view(np.uint64), np.arange(400, dtype=np.uint64), 7)
        means = [sum(w[r, j] * part[r][1] for r in range(len(part))) / w[:, j].sum() for j in range(400)]
        assert np.allclose(got[k], np.quantile(means, [0.025, 0.975])) and np.allclose(got[k], again[k])
    w = research.bootstrap_weights(np.arange(3000, dtype=np.uint64) * np.uint64(977), np.arange(200, dtype=np.uint64), 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.3


def test_ewma_against_pandas(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=60), rng.normal(size=60)
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("t", 0, 1.0, 1.0)], "s string, d int, a double, b double")
    got = strategy.ewma(df.repartition(3), "s", "d", "a", "b").where("s = 's'").orderBy("d").toPandas()
    e = lambda v: pd.Series(v).ewm(span=20, adjust=False, min_periods=10)
    assert np.allclose(got.mean_a, e(x).mean(), equal_nan=True) and np.allclose(got.vol_b, np.sqrt(e(y).var() * 252), equal_nan=True)
    corr = (e(x * y).mean() - e(x).mean() * e(y).mean()) / np.sqrt(e(x).var(bias=True) * e(y).var(bias=True))
    assert np.allclose(got["corr"], corr, equal_nan=True) and np.allclose(got["cov"], corr * got.vol_a * got.vol_b, equal_nan=True)


def test_metrics_with_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 2)), float(rng.integers(0, 5)) / 4, float(rng.normal())) for _ in range(120)]
    df = spark.createDataFrame([(1, *x) for x in rows], "k int, y int, p double, o double")
    got = research.binary_metrics(df, ["k"], "y", "p", outcome="o").first()
    pairs = [(a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a in rows for b in rows if a[0] == 1 and b[0] == 0]
    assert abs(got.auc - np.mean(pairs)) < 1e-12
    ranks = [pd.Series([x[i] for x in rows]).rank() for i in (1, 2)]
    assert abs(got.rank_ic - np.corrcoef(*ranks)[0, 1]) < 1e-9


def test_public_corrections_follow_hidden_links(spark):
    log = spark.createDataFrame(
        [(1, "e", "a", "old", 0, None, 1, 1, None), (2, "e", "a", "mid", 0, None, 2, None, 1), (3, "e", "a", "new", 0, None, 3, 3, 2)],
        "event_id long, entity string, attribute string, value string, valid_from long, valid_to long, recorded_at long, public_at long, supersedes long",
    )
    at = lambda k, view: [x.value for x in graph.resolve(log, F.lit(5), F.lit(k), view).collect()]
    assert at(2, "public_as_of") == ["old"] and at(3, "public_as_of") == ["new"]
    assert at(2, "system_replay") == ["mid"] and at(9, "system_replay") == ["new"]


def test_text_parts(spark):
    df = spark.createDataFrame([(1, "x" * 49), (2, "y" * 1500), (3, "z" * 1501), (4, None)], "i long, t string")
    assert [(x.i, x.chunk_index, len(x.chunk_text)) for x in text.chunks(df, "t").orderBy("i", "chunk_index").collect()] == [(2, 0, 1500), (3, 0, 1500), (3, 1, 201)]
    page = spark.createDataFrame([("<p>a&amp;b</p><script>no</script><table><tr>t</tr></table> c <!-- x -->",)], "h string")
    assert page.select(text.html_text(F.col("h")).alias("t")).first().t == "a&b c"


def test_readers(spark, tmp_path):
    sym = spark.createDataFrame([("O:SPY240119C00450000",), ("bad",)], "s string")
    got = readers.option_symbols(sym, "s").collect()
    assert [(x.underlying, x.expiry, x.right, x.strike) for x in got] == [("SPY", dt.date(2024, 1, 19), "C", 450.0)]
    page = spark.createDataFrame([('{"results":[{"execution_date":"2024-01-02","split_from":1,"split_to":2,"ticker":"A"},{"execution_date":"2024-01-02","split_from":1,"split_to":1,"ticker":"B"},{"split_from":0,"split_to":2,"ticker":"C"}]}',)], "j string")
    assert [(x.symbol, x.split_ratio) for x in readers.split_pages(page, "j").collect()] == [("A", 2.0)]
    facts = spark.createDataFrame([("1", '{"facts":{"us-gaap":{"Cash":{"label":"c","units":{"USD":[{"end":"2024-01-01","val":5,"accn":"x"}]}}}}}')], "cik string, j string")
    assert [(x.taxonomy, x.concept, x.unit, x.val) for x in readers.company_facts(facts, "cik", "j").collect()] == [("us-gaap", "Cash", "USD", 5.0)]
    p = str(tmp_path / "t")
    assert sinks.written_rows(spark.range(7), p) == 7
    assert sinks.missing_keys(spark.range(9), p, ["id"]).count() == 2
    part = spark.createDataFrame([(1, "a"), (2, "b")], "v long, p string")
    q = str(tmp_path / "q")
    sinks.overwrite(part, q, ["p"])
    sinks.overwrite_partitions(spark.createDataFrame([(9, "a")], "v long, p string"), q, ["p"])
    assert sorted(x.v for x in spark.read.parquet(q).collect()) == [2, 9]


def test_identity(spark):
    df = spark.createDataFrame([("brk.b", "320193", "0000320193-24-000001", "1.50")], "t string, c string, a string, d string")
    got = df.select(identity.normal_ticker(F.col("t")), identity.padded_cik(F.col("c")), identity.accession(F.col("a")), identity.exact_decimal(F.col("d")).cast("double")).first()
    assert tuple(got) == ("BRK-B", "0000320193", "0000320193-24-000001", 1.5)
    assert df.select(identity.unicode_normal(F.lit(" ﬁ  x"))).first()[0] == "fi x"


def test_quality(spark):
    df = spark.createDataFrame([(1, 2, None), (3, 2, 1.0)], "pred long, avail long, f double")
    checks = quality.point_in_time_checks("pred", ["avail"], {"avail": ["f"]})
    assert {x["check"]: x.violations for x in quality.report(df, checks).collect()} == {"avail_after_prediction": 1, "avail_missing": 0}
    with pytest.raises(quality.QualityError):
        quality.require(df, checks)


def test_trailing_median_needs_a_full_window(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 1, 3, 9])], "symbol string, day int, v double")
    got = [x.m for x in windows.trailing_median(df, ["symbol"], "day", "v", 3, "m").orderBy("day").collect()]
    assert got == [None, None, None, 3.0]


def test_log_and_edge_issues(spark):
    log = spark.createDataFrame([(1, 5, None), (1, 6, None), (2, 3, 1), (3, 9, 77)], "event_id long, recorded_at long, supersedes long")
    assert {x.issue: x.n for x in graph.log_issues(log).collect()} == {"duplicate_id": 1, "dangling": 1, "before_original": 1, "cycle": 0}
    nodes = spark.createDataFrame([("a", "company"), ("b", "filing")], "node_id string, node_type string")
    edges = spark.createDataFrame([("1", "filed", "a", "b"), ("2", "filed", "b", "a"), ("3", "filed", "a", "z"), ("4", "odd", "a", "b")], "edge_id string, edge_type string, src string, dst string")
    got = {x.edge_id: x.issue for x in publication.edge_issues(edges, nodes, [("filed", "company", "filing")]).collect()}
    assert got == {"2": "endpoint_type", "3": "dangling", "4": "unknown_type"}


def test_alias_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (102, 100), (200, 200), (201, None)]
    got = {x.id: (x.target, x.cyclic) for x in publication.alias_targets(spark.createDataFrame(links, "id long, alias_of long")).collect()}
    assert all(got[i] == (20, False) for i in range(20))
    assert all(got[i][1] for i in (100, 101, 102)) and 200 not in got and 201 not in got


def test_payloads(spark, tmp_path):
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(x.a for x in readers.jsonl(spark, str(lines), "a long").collect()) == [1, 2]
    candle = spark.createDataFrame([('{"t":0,"T":60000,"s":"N","o":"1.5","h":"2","l":"x","c":"1","v":"3","n":4}',)], "j string")
    got = readers.candles(candle, "j").first()
    assert (got.symbol, got.open, got.low, got.trade_count) == ("N", 1.5, None, 4)
    box = spark.createDataFrame([(i,) for i in range(9)], "event_id long")
    assert [x.event_id for x in readers.undelivered(box, box.where("event_id % 2 = 0"), 3).orderBy("event_id").collect()] == [1, 3, 5]
    raw = spark.createDataFrame([("1", '{"cik":"1","name":"A","formerNames":[{"name":"B","from":"2001-02-03T00:00:00Z","to":"2004-05-06"}]}'), ("2", None), ("3", "x")], "k string, j string")
    got = {x.k: (x.status, x.former_names[0].valid_from if x.former_names else None) for x in readers.submissions(raw, "k", "j").collect()}
    assert got == {"1": ("ok", dt.date(2001, 2, 3)), "2": ("miss", None), "3": ("miss", None)}
    config = readers.from_config(spark, [{"symbol": "A"}, {"symbol": "B"}], "symbol string", "universe_view")
    assert readers.read_sql(spark, "SELECT symbol FROM universe_view WHERE symbol = :s", {"s": "B"}).count() == 1 and config.count() == 2


def test_manifest_resumes(spark, tmp_path):
    path = str(tmp_path / "m")
    for name, status in (("a", "RUNNING"), ("a", "SUCCESS"), ("b", "RUNNING"), ("b", "FAILED")):
        sinks.record(spark, path, name, status)
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert sorted(x.name for x in sinks.pending(files, spark.read.parquet(path)).collect()) == ["b", "c"]


def test_modes_and_reranking(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "q long, d string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "q long, d string, rank int")
    order = lambda df: [x.d for x in df.orderBy("rank").collect()]
    assert order(retrieval.search("bm25", a, b, "q", "d", 2)) == ["x", "y"]
    assert order(retrieval.search("hybrid_rrf", a, b, "q", "d", 3)) == ["z", "y", "x"]
    assert order(retrieval.search("hybrid_rrf", a, None, "q", "d", 2)) == ["x", "y"]
    assert order(retrieval.search("hybrid_rerank", a, b, "q", "d", 2, retrieval.rerank_by((F.col("d") == "x").cast("int"), "q", "d"))) == ["x", "y"]
    with pytest.raises(ValueError):
        retrieval.search("hybrid_rerank", a, b, "q", "d", 1)


def test_weekend_of_matches_intervals(spark):
    spans = perpetuals.weekends(spark, "2024-03-01", "2024-03-31")
    hours = spark.range(0, 24 * 28 * 2).select(F.timestamp_seconds(F.lit(1709251200) + F.col("id") * 1800).alias("ts"))
    want = asof.interval_join(hours.withColumn("k", F.lit(1)), spans.withColumn("k", F.lit(1)), ["k"], "ts", "start", "end").select("ts", "weekend_id")
    got = hours.withColumn("weekend_id", perpetuals.weekend_of(F.col("ts")))
    assert rows(got, "ts") == rows(want, "ts")


def test_ewma_matches_weighted_moments(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=30), rng.normal(size=30)
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k string, d int, a double, b double")
    got = strategy.ewma(df, "k", "d", "a", "b", span=9, least=5).orderBy("d").collect()
    alpha = 0.2
    w = np.array([(1 - alpha) ** 29] + [alpha * (1 - alpha) ** (29 - i) for i in range(1, 30)])
    var = lambda v: (w @ (v - w @ v) ** 2) / (1 - (w * w).sum())
    cov = w @ ((x - w @ x) * (y - w @ y))
    assert got[3].vol_a is None or np.isnan(got[3].vol_a)
    assert np.isclose(got[-1].vol_a, np.sqrt(252 * var(x))) and np.isclose(got[-1].vol_b, np.sqrt(252 * var(y)))
    assert np.isclose(got[-1].corr, cov / np.sqrt((w @ (x - w @ x) ** 2) * (w @ (y - w @ y) ** 2)))


def test_link_facts_joins_no_pairs_of_a_company(spark):
    """One company, 30,000 facts and candidates: rungs, exact values, nulls, and no 900 million pairs."""
    cols = "company string, metric string, period string, unit string, dimensions string, value double"
    base = spark.range(30_000).select(F.lit("big").alias("company"), F.lit("m").alias("metric"), F.col("id").cast("string").alias("period"), F.lit("u").alias("unit"), F.lit(None).cast("string").alias("dimensions"), F.col("id").cast("double").alias("value"), "id")
    odd = [(-1, "none", "m", "1", "u", None, 1.0), (-2, "big", "x", "1", "u", None, 1.0), (-3, "big", "m", "no", "u", None, 1.0), (-4, "big", "m", "1", "v", None, 1.0), (-5, "big", "m", "1", "u", "d", 1.0), (-6, "big", "m", "1", "u", None, 1.0 + 1e-8), (-7, "big", "m", "1", "u", None, 1.0 + 5e-10), (-8, "big", "m", "1", "u", None, None), (-9, "big", "m", None, "u", None, 1.0)]
    facts = base.withColumnRenamed("id", "fact_id").unionByName(spark.createDataFrame(odd, f"fact_id long, {cols}"))
    out = publication.link_facts(facts, base.withColumnRenamed("id", "assertion"))
    got = {x.fact_id: (x.status, x.assertion) for x in out.collect()}
    want = ["cross_issuer", "metric_mismatch", "period_mismatch", "unit_incompatible", "dimensions_mismatch", "value_mismatch", "value_mismatch", "value_mismatch", "period_mismatch"]
    # without a scale, values must be equal to the last digit
    assert [got[-i - 1][0] for i in range(9)] == want
    assert all(got[i] == ("linked", i) for i in range(30_000))


def test_all_sections_of_every_page(spark):
    """Every page's article comes out whole, and pages without a section are not cut short."""
    from quillon.plans import knowledge

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").toPandas()
    got = knowledge.txt02_sections(spark, "/root/testdata/sf0.001").toPandas()
    article = got[got.section == "article"].set_index("page_id").section_text
    long = {p: h[h.index("<article>") : h.index("</article>")].strip() for p, h in zip(pages.page_id, pages.html) if "<article>" in h and "</article>" in h}
    assert long and all(article[p] == x for p, x in long.items() if 50 <= len(x) <= 50_000)
    assert set(got.page_id) == set(pages.page_id)
    odd = spark.createDataFrame([("p" * 120_000,)], "html string")
    out = text.sections(odd, "html", knowledge._SECTIONS, 50_000, fallback_cap=100_000).first()
    assert (out.section, len(out.section_text)) == ("full_document", 100_000)


def test_bm25_queries_are_all_items(spark):
    from quillon.plans import knowledge

    sf = "/root/testdata/sf0.001"
    items = {x.item_id for x in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id").collect()}
    assert {x.item_id for x in knowledge.ret01_bm25(spark, sf).collect()} == items
    assert {x.item_id for x in knowledge.ret03_04_rrf(spark, sf).collect()} == items


def test_entry_without_the_training_subpackage(tmp_path):
    """The other queries stay where the subpackage, or a library it needs, is missing."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), len(e.oracle_sql()))"
    shutil.copytree(root / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = lambda where, env: subprocess.run([sys.executable, "-c", code], cwd=where, env=env, capture_output=True, text=True, check=True).stdout.split()
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    n, training, _ = run(tmp_path, env)
    assert int(n) > 100 and training == "0"
    if (root / "quillon" / "llm").exists():
        (tmp_path / "zstandard.py").write_text("raise ImportError('not here')")
        shutil.copytree(root / "quillon" / "llm", tmp_path / "quillon" / "llm")
        assert run(tmp_path, env)[:2] == [n, "0"]


# -- sources, sinks and services ----------------------------------------------------------------


def test_publication_is_compare_and_set(spark, tmp_path):
    folder = f"{tmp_path}/published"
    assert sinks.generation(spark, folder) == 0
    assert sinks.publish(spark.range(3), folder, 0) == 1 and sinks.publish(spark.range(5), folder, 1) == 2
    with pytest.raises(sinks.PublicationConflict):
        sinks.publish(spark.range(9), folder, 1)
    assert sinks.published(spark, folder).count() == 5 and sinks.published(spark, folder, 1).count() == 3


def test_truncate_ingest_and_steps(spark, tmp_path):
    paths = {n: f"{tmp_path}/{n}" for n in ("a", "reviews")}
    for p in paths.values():
        spark.range(4).write.parquet(p)
    assert sinks.truncate(spark, paths, {"reviews"}) == ["a"]
    assert spark.read.parquet(paths["a"]).count() == 0 and spark.read.parquet(paths["a"]).columns == ["id"] and spark.read.parquet(paths["reviews"]).count() == 4
    log = f"{tmp_path}/manifest"

    def fails():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.ingest(spark, log, "f", fails)
    assert sinks.ingest(spark, log, "f", lambda: 7) == "SUCCESS" and sinks.ingest(spark, log, "f", fails) == "SKIPPED"
    assert sorted(x.status for x in spark.read.parquet(log).collect()) == ["FAILED", "RUNNING", "RUNNING", "SUCCESS"]
    seen = []
    steps = [("one", lambda s: seen.append(1), None), ("two", lambda s: seen.append(2), f"{tmp_path}/none"), ("three", lambda s: seen.append(3), paths["a"])]
    assert sinks.run_steps(spark, steps) == [("one", "ran"), ("two", "skipped"), ("three", "ran")] and seen == [1, 3]
    script = "-- head; no\nSELECT ';' AS a, 1 - 2 FROM ${t}; /* x; */ SELECT 2 / 1;\n;"
    assert sinks.statements(script, {"t": "x"}) == ["SELECT ';' AS a, 1 - 2 FROM x", "SELECT 2 / 1"]
    with pytest.raises(ValueError):
        sinks.statements("${gone}", {})
    with pytest.raises(Exception):
        sinks.require_not_null(spark.createDataFrame([(None,)], "a int"), ["a"]).collect()
    assert sinks.with_comments(spark.range(1), {"id": "key"}).schema["id"].metadata == {"comment": "key"}


def test_offline_parsers(spark):
    body = '{"results": [{"t": 1704207600000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10, "vw": 1.2, "n": 3}, {"o": 1}]}'
    got = readers.aggregate_pages(spark.createDataFrame([("A", body), ("B", "not json")], "s string, j string"), "s", "j").collect()
    assert [(x.symbol, x.event_ts, x.close, x.trade_count) for x in got] == [("A", dt.datetime(2024, 1, 2, 15), 1.5, 3)]
    funding = '[{"coin": "BTC", "fundingRate": "0.0001", "premium": "-0.1", "time": 1704207600000}, {"coin": "X"}]'
    assert [tuple(x) for x in readers.funding_rates(spark.createDataFrame([(funding,)], "j string"), "j").collect()] == [("BTC", dt.datetime(2024, 1, 2, 15), 0.0001, -0.1)]
    page = "<R><NextContinuationToken>tok</NextContinuationToken><Contents><Key>a/b</Key><LastModified>2024-01-02T00:00:00.000Z</LastModified><Size>7</Size></Contents><Contents><Size>1</Size></Contents></R>"
    got = readers.bucket_listing(spark.createDataFrame([(page,), ("<R></R>",)], "x string"), "x").collect()
    assert [tuple(x) for x in got] == [("a/b", 7, dt.datetime(2024, 1, 2), "tok")]
    pages = {"1": '{"next_url": "2"}', "2": "{}"}
    assert readers.fetch_pages(pages.__getitem__, "1") == list(pages.values())
    with pytest.raises(ValueError):
        readers.fetch_pages(lambda u: '{"next_url": "1"}', "1")
    out = []
    assert readers.in_batches(range(7), 3, out.append) == 7 and out == [[0, 1, 2], [3, 4, 5], [6]]
    assert readers.in_batches(range(7), 3, out.append, most=1) == 3
    assert readers.config_rows("# c\n- symbol: SPY\n  source: 'x'  # why\n\n- symbol: QQQ\n") == [{"symbol": "SPY", "source": "x"}, {"symbol": "QQQ"}]
    with pytest.raises(ValueError):
        readers.config_rows("symbol: A")
    win = rows(readers.fetch_windows(spark, "2024-01-01", "2024-01-20", 10, 3), "start")
    assert win[0] == (dt.date(2024, 1, 1), dt.date(2024, 1, 10)) and win[1][0] == dt.date(2024, 1, 8) and win[-1][1] == dt.date(2024, 1, 20)
    a, b = (readers.synthetic_matrix(spark, 3, 5, 1).repartition(n).orderBy("symbol", "day").collect() for n in (1, 4))
    assert a == b and len(a) == 15 and readers.synthetic_matrix(spark, 3, 5, 2).orderBy("symbol", "day").collect() != a
    outbox = spark.range(10).withColumnRenamed("id", "event_id")
    assert [x.event_id for x in readers.undelivered(outbox, outbox.where("event_id < 3"), 2, outbox.where("event_id = 3")).collect()] == [4, 5]


def test_calendar_check_and_weekends(spark):
    rules = calendar.derived(spark, 2024, 2024)
    static = rules.where("day <> '2024-06-19'").selectExpr("day", "kind", "false special").unionByName(spark.createDataFrame([(dt.date(2024, 3, 5), "closure", False), (dt.date(2024, 12, 5), "closure", True)], "day date, kind string, special boolean"))
    assert sorted((str(x.day), x.problem) for x in calendar.calendar_problems(static, rules).collect()) == [("2024-03-05", "no_rule"), ("2024-06-19", "missing")]
    sessions = calendar.sessions(spark, 2024, 2025)
    fridays = spark.createDataFrame([(dt.date(2024, 3, 29),), (dt.date(2024, 5, 24),), (dt.date(2024, 5, 23),)], "day date")
    got = {str(x.day): (x.start, x.end) for x in calendar.weekend_windows(fridays, sessions, "day").collect()}
    assert got["2024-03-29"] == (dt.datetime(2024, 3, 28, 20), dt.datetime(2024, 4, 1, 13, 30))  # a holiday on the Friday
    assert got["2024-05-24"] == (dt.datetime(2024, 5, 24, 20), dt.datetime(2024, 5, 28, 13, 30))  # and on the Monday
    assert got["2024-05-23"] == (None, None)
    assert calendar.trading_dates(sessions, "2024-07-01", "2024-07-07").count() == 4


def test_ordered_rejects_bad_days(spark):
    good = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "k string, d int")
    assert [tuple(x) for x in quality.ordered(good, ["k"], "d").orderBy("k", "d").collect()] == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1)]
    for bad in ([("a", 1), ("a", 1)], [("a", None)]):
        with pytest.raises(Exception):
            quality.ordered(spark.createDataFrame(bad, "k string, d int"), ["k"], "d").collect()


def test_retrieval_service(spark):
    loads, gone = [], []
    cache = retrieval.CorpusCache(lambda t: loads.append(t) or t.lower(), 2, gone.append)
    assert [cache.get(t) for t in ("A", " a ", "B", "A", "C", "B")] == ["a", "a", "b", "a", "c", "b"]
    assert loads == ["A", "B", "C", "B"] and gone == ["b", "a"]
    broken = retrieval.CorpusCache(lambda t: 1 / 0)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            broken.get("x")
    utc = dt.timezone.utc
    assert retrieval.parse_as_of("2024-05-01").hour == 23 and retrieval.parse_as_of("2024-05-01T12:00:00+02:00") == dt.datetime(2024, 5, 1, 10, tzinfo=utc)
    with pytest.raises(ValueError):
        retrieval.parse_as_of("yesterday")
    v = spark.createDataFrame([(1, [1.0, 2.0], "m"), (2, [1.0], "m")], "i int, v array<double>, model string")
    assert retrieval.check_vectors(v.where("i = 1"), "v", "model", 2, "m").count() == 1
    with pytest.raises(Exception):
        retrieval.check_vectors(v, "v", "model", 2, "m").collect()
    gold = spark.createDataFrame([(1, 10), (2, 20)], "q int, d int")
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, rank int")
    strata = spark.createDataFrame([(1, "x"), (2, "y")], "q int, kind string")
    got = {(x["mode"], x.stratum): (x.n, x.recall, x.mrr) for x in retrieval.evaluate({"bm25": ranked}, gold, strata, "q", "d", 5).collect()}
    assert got == {("bm25", "all"): (2, 0.5, 0.5), ("bm25", "kind=x"): (1, 1.0, 1.0), ("bm25", "kind=y"): (1, 0.0, 0.0)}
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "i int, t string")
    assert retrieval.enriched(docs, "i", "t", None, 3).count() == 0
    assert [x.note for x in retrieval.enriched(docs, "i", "t", lambda ts: [t.upper() for t in ts], 3).orderBy("i").collect()] == ["T0", "T1", "T2"]


def test_identity_versions(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("x", "y")], "p string, q string")
    moves = identity.migration(df, "k", ["p", "q"])
    assert sorted(x.collided for x in moves.collect()) == [False, True, True]
    held = df.select(identity.versioned_id("k", 1, F.col("p"), F.col("q")).alias("id"))
    out = [x.id for x in identity.migrated(held, "id", moves).collect()]
    assert sum(x.startswith("k:v2:") for x in out) == 1
    assert identity.collisions(df.withColumn("id", identity.versioned_id("k", 1, F.col("p"), F.col("q"))), "id", ["p", "q"]).first().n == 2


def test_drift_summary_and_frames(spark):
    from quillon.operators import experiments

    a, b = spark.range(1000).selectExpr("id x", "id y"), spark.range(1000).selectExpr("id x", "id + 900 y")
    report = research.drift_report(a, b, ["x", "y"])
    doc = experiments.drift_summary(report, report, 1000, 1000, "test")
    assert doc["feature_drift"] == {"per_feature_drift": {"x": False, "y": True}, "n_features": 2, "n_drifted_features": 1, "share_of_drifted_features": 0.5, "dataset_drift": True}
    with pytest.raises(ValueError):
        experiments.require_columns(a, ["x", "z"])


def test_pair_estimates_and_signals(spark):
    from quillon.operators import experiments

    rng = np.random.default_rng(2)
    prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, (90, 4)), axis=0))
    df = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(prices)], "s string, d int, open_a double, close_a double, open_b double, close_b double")
    got = experiments.estimate_pair(df, "s", "d", percentile=30).orderBy("d").toPandas()
    r = pd.Series(prices[:, 1]).pct_change()
    assert np.allclose(got.rvol_20_a, r.rolling(20, min_periods=5).std() * np.sqrt(252), equal_nan=True)
    assert np.allclose(got.vol_a, np.sqrt(r.ewm(span=20, adjust=False, min_periods=10).var() * 252), equal_nan=True)
    want = [np.mean([x <= v for x in w]) if len(w) == 30 else np.nan for v, w in ((got.vol_a[i], got.vol_a[: i + 1].dropna()[-30:]) for i in range(90))]
    full = got.vol_a.rolling(30).count() == 30
    assert np.allclose(got.vol_pct_a[full], np.array(want)[full])
    z = experiments.momentum_z(df, "close_a", "s", "d", 5).orderBy("d").toPandas().signal
    ratio = pd.Series(prices[:, 1]).pct_change(5)
    assert np.allclose(z[15:], np.tanh(ratio / ratio.rolling(5).std())[15:]) and experiments.varies_in_magnitude("momentum_z")
    m = df.select("d", experiments.reference_signal("close_a", "s", "d", "reversal", 5).alias("v")).orderBy("d").toPandas().v
    assert np.allclose(m, -np.sign(ratio.fillna(0)))


def test_gate_and_choice_of_holding(spark):
    from quillon.operators import experiments

    pos = spark.createDataFrame([("s", d, 1, 1) for d in range(4)], "symbol string, day int, hold int, position int")
    regimes = spark.createDataFrame([(1, "NARROW"), (2, "BROAD"), (1, "NARROW")], "day int, regime string")
    assert [x.position for x in experiments.gated(pos, regimes).orderBy("day").collect()] == [0, 1, 0, 0]
    rng = np.random.default_rng(4)
    net = {(h, d): float(rng.normal(0.1 * (h == 5 and d < 50), 1)) for h in (3, 5) for d in range(100)}
    df = spark.createDataFrame([(h, d, v) for (h, d), v in net.items()], "hold int, day int, net double")
    got = experiments.walk_forward_hold(df, 3, 5).collect()
    assert {x.day for x in got} == set(range(25, 100))
    for x in got:
        train = range(0, x.fold * 25 - 5)
        ratio = {h: np.mean([net[h, d] for d in train]) / np.std([net[h, d] for d in train]) for h in (3, 5)}
        assert x.hold == max(ratio, key=ratio.get) and x.net == net[x.hold, x.day]


def test_label_clashes_and_graph_ids(spark):
    part = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, l string")
    n = graph.nodes([("t", part, "k", "l")])
    assert sorted((x.key, x.label) for x in n.collect()) == [("1", "a"), ("2", "c")]
    assert [tuple(x) for x in graph.label_clashes([("t", part, "k", "l")]).collect()] == [("t", "1", 2)]


def test_market_classes(spark):
    names = ["E-mini S&P 500 - CME", "MICRO BITCOIN", "ETHER DOLLAR", "UST 10Y", "Canadian Dollar", "BLOOMBERG COMMODITY", "WHEAT", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [x.c for x in df.select(r.market_class(F.col("n")).alias("c")).collect()] == ["equity_index", "crypto", "crypto", "rate", "fx", "commodity", "other", "other"]


def test_fact_links_by_scale_and_time(spark):
    """Values agree at the scale the candidate is stated in: half a unit of it, exactly at 0; candidates that are not
    known yet are not there."""
    base = ("c", "m", "2024", "USD", "d")
    facts = [(i, *base, v) for i, v in enumerate([1_234_400.0, 1_234_501.0, 1_234_000.0, 0.125, -500.0, 7.0])]
    cand = [(10, *base, 1_234_000.0, -3, 1), (11, *base, 0.13, 2, 1), (12, *base, 0.0, -3, 9), (13, *base, 7.0000001, 0, 1)]
    f = spark.createDataFrame(facts, "fact_id int, company string, metric string, period string, unit string, dimensions string, value double")
    c = spark.createDataFrame(cand, "assertion int, company string, metric string, period string, unit string, dimensions string, value double, decimals int, known_from int")
    got = lambda k: {x.fact_id: (x.status, x.assertion) for x in publication.link_facts(f, c, F.lit(k)).collect()}
    miss = ("value_mismatch", None)
    assert got(5) == {0: ("linked", 10), 1: miss, 2: ("linked", 10), 3: ("linked", 11), 4: miss, 5: miss}
    assert got(9)[4] == ("linked", 12) and got(9)[3] == ("ambiguous", None) and got(9)[5] == ("linked", 12)
    assert set(got(0).values()) == {("no_candidate", None)}


def test_names_at_a_time(spark):
    d = lambda m, day=1: dt.date(2024, m, day)
    names = spark.createDataFrame([(1, "old", d(1), d(3, 31)), (1, "new", d(4), None), (2, "seen b", None, None), (2, "seen a", None, None), (1, "seen", None, None)], "k int, name string, valid_from date, valid_to date")
    at = lambda m, day=1: dt.datetime(2024, m, day, 12)
    points = spark.createDataFrame([(1, at(3, 31)), (1, at(4, 1)), (2, at(2)), (1, dt.datetime(2023, 1, 1)), (3, at(2))], "k int, t timestamp")
    got = {(x.k, x.t): x.name for x in graph.names_at(points, names, "k", "t").collect()}
    assert got == {(1, at(3, 31)): "old", (1, at(4, 1)): "new", (2, at(2)): "seen b", (1, dt.datetime(2023, 1, 1)): "seen", (3, at(2)): None}


def test_reconcile_at_a_knowledge_time(spark):
    f = spark.createDataFrame([(1, "a", 5, "x"), (1, "b", 1, "y"), (2, "b", None, "z")], "k int, s string, t int, v string")
    got = lambda at: [(x.k, x.v) for x in graph.reconcile(f, ["k"], "s", ["a", "b"], "t", F.lit(at)).collect()]
    assert got(9) == [(1, "x")] and got(4) == [(1, "y")] and got(0) == []


def test_deflated_sharpe(spark):
    from math import e, sqrt
    from statistics import NormalDist

    q, g = NormalDist().inv_cdf, 0.5772156649015329
    df = spark.createDataFrame([(0.1, 500, -0.5, 4.0)], "s double, n int, g double, k double")
    got = df.select(outcomes.deflated_sharpe(F.col("s"), F.col("n"), 8, F.col("g"), F.col("k")).alias("z")).first().z
    spread = sqrt((1 + 0.5 * 0.1 + 3 / 4 * 0.01) / 499)
    best = spread * ((1 - g) * q(1 - 1 / 8) + g * q(1 - 1 / (8 * e)))
    assert abs(got - (0.1 - best) / spread) < 1e-9


def test_dense_search_over_blocks(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(120, 8)), 1)
    v[60:80] = v[:20]  # exact copies, so ties
    lists = [[float(x) for x in row] for row in v] + [[0.0] * 8, None, [1.0, None] + [0.0] * 6, [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(lists)), "d long, v array<float>")
    asked = df.where("d % 5 = 0 or d > 119").withColumnRenamed("d", "q")
    got = rows(text.dense_top_k(df, asked, "d", "v", "q", 7, query_block=8, vector_block=2).select("q", "rank", "d", "score"), "q", "rank")
    u = np.float32(v).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = []
    for q in [x for x in range(124) if x % 5 == 0 or x > 119]:
        known = {d: float(u[q] @ u[d]) for d in range(120)} if q < 120 else {123: 1.0} if q == 123 else {}
        best = sorted(range(124), key=lambda d: (-round(known.get(d, -2), 9), d))[:7]
        want += [(q, i + 1, d, known.get(d)) for i, d in enumerate(best)]
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all((a is None and b is None) or abs(a - b) < 1e-12 for (*_, a), (*_, b) in zip(got, want))


def test_exact_quantiles_at_whole_ranks(spark):
    df = spark.range(2_000_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 40).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(0, None), (2, None), (3, 7.0)], "k long, v double"))
    got = rows(research.exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}), "k")
    assert got == [(0, 18.0, 36.0), (1, 19.0, 37.0), (2, None, None), (3, 7.0, 7.0)]
    from quillon.operators import experiments

    p = spark.range(2_000_000).selectExpr("1 a", "id % 5 d", "cast(id % 3 = 0 as int) y", "id % 7 / 7D p", "id % 11 - 5D r", "cast(id % 40 as double) ms")
    one = experiments.evaluation_bundle(p, ["a"], "d", "y", "p", "r", 5.0, "ms").first()
    assert (one.latency_p50, one.latency_p95) == (19.0, 37.0)


def _minutes(spark, folder):
    """An event a minute, of which the one two minutes before the end of the first file comes late."""
    cols = ["timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int), 0) as ts", "id % 3 as user_id", "'click' as event_type", "id % 7 + 1D as value", "'' as props"]
    spark.range(300).selectExpr("id + 2 as event_id", *cols).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["str03_05_08_sliding_windows", "str07_agg13_latency"])
def test_every_row_behind_the_watermark_is_late(spark, tmp_path, name):
    import duckdb

    from quillon import registry
    from tests.test_queries import normal

    folder = _minutes(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    assert len(want) > 200 and normal(registry.QUERIES[name](spark, folder).toPandas()) == normal(want)
    assert spark.conf.get("spark.sql.streaming.statefulOperator.allowMultiple") == "true"


def test_landed_files_are_in_order(spark, tmp_path):
    from pathlib import Path

    from quillon.plans import stream

    landed = Path(stream._landed(spark, _minutes(spark, tmp_path)))
    times = [p.stat().st_mtime_ns // 1_000_000 for i in range(stream.FILES) for p in landed.glob(f"due={i}/*.parquet")]
    assert [b - a for a, b in zip(times, times[1:])] == [10_000, 10_000]


def _against_sql(spark, name, folder):
    import duckdb

    from quillon import registry
    from tests.test_queries import normal

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder)).toPandas()
    assert normal(got) == normal(con.execute(registry.ORACLE_SQL[name]).df())
    return got


def test_estimates_where_a_close_is_zero(spark, tmp_path):
    spark.range(40).selectExpr("id as event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id as int)) as ts", "1L as user_id", "'click' as event_type", "id * 7 % 10 + 0D as value", "'' as props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = _against_sql(spark, "rsk12_estimates", tmp_path)
    assert sum(got.r_a == -1) == 3 and got.r_a.isna().sum() == 5
    from quillon.operators import experiments

    p = spark.createDataFrame([("s", i, v, v, 1.0, 1.0) for i, v in enumerate([2.0, 0.0, 4.0])], "s string, d int, open_a double, close_a double, open_b double, close_b double")
    assert [x.r_a for x in experiments.estimate_pair(p, "s", "d").orderBy("d").collect()] == [None, None, None]


def test_velocity_of_bars_at_zero(spark, tmp_path):
    spark.range(60).selectExpr("id as event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as ts", "id % 3 as user_id", "'click' as event_type", "id % 4 + 0D as value", "'' as props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert (_against_sql(spark, "str02_06_velocity", tmp_path).intrabar_return == 0).all()
    from quillon.streaming import bars

    b = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (2.0, 3.0)], "open double, close double").selectExpr("*", "close as high", "open as low", "close as vwap")
    assert [[x.intrabar_return for x in bars.latest_features(b, u).orderBy("open", "close").collect()] for u in (None, 0.0)] == [[None, None, 0.5], [0.0, None, 0.5]]


def test_sliding_windows_keep_bars_not_windows(spark, tmp_path, monkeypatch):
    from quillon.plans import stream
    from quillon.streaming import bars

    queries, run = [], bars.run
    monkeypatch.setattr(bars, "run", lambda *a, **k: queries.append(run(*a, **k)) or queries[-1])
    rows = stream.str03_05_08_sliding_windows(spark, _minutes(spark, tmp_path)).count()
    steps = [p["stateOperators"] for p in queries[0].recentProgress]
    assert rows > 600 and all(sum(s["numRowsTotal"] for s in p) <= 300 for p in steps)


@pytest.mark.parametrize("window, slide", [("15 minutes", "1 minute"), ("10 minutes", "4 minutes"), ("1 minute", "1 minute")])
def test_ended_windows_are_the_sliding_windows(spark, window, slide):
    from quillon.streaming import bars

    # bars before and after 1970, on and beside whole minutes, two symbols of which one has most bars
    b = spark.range(400).selectExpr(
        "if(id % 10 = 0, 'B', 'A') as symbol", "timestamp_micros((id * id * 7919 % 20000 - 10000) * 1000000 + id % 2 * 17) as event_ts", "id * 1D as high", "id - 1D as low", "id % 7 * 1D as close",
        "timestamp_micros(id) as information_available_ts", "timestamp_micros(id) as bronze_ts",
    )
    length, step = (int(x.split()[0]) * 60_000_000 for x in (window, slide))
    key = lambda df: sorted([*r[:5], round(r.close_std or 0, 9), round(r.close_avg, 9), *r[7:]] for r in df.collect())
    parts = [(None, -600_000_000), (-600_000_000, 1_200_000_000), (1_200_000_000, 99_000_000_000)]
    got = [bars._ended(b, low, high, length, step, 3) for low, high in parts]
    assert key(got[0].unionByName(got[1]).unionByName(got[2])) == key(bars.windowed(b, window, slide))
    assert all(x.count() for x in got)


def test_a_micro_batch_of_windows_that_was_cut_off_comes_again(spark, tmp_path, monkeypatch):
    from pyspark.errors import StreamingQueryException

    from quillon.plans import stream
    from quillon.streaming import bars

    kept = bars.valid(bars.typed(stream._stream(spark, _minutes(spark, tmp_path / "in"))))
    read = lambda x: sorted((r.symbol, r.window_start, r.n_bars, r.close_avg) for r in spark.read.parquet(f"{tmp_path}/{x}").collect())
    bars.run_windowed(kept, f"{tmp_path}/whole", f"{tmp_path}/log1")
    delete, calls = bars._discard, []

    def cut(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("cut off")
        delete(*a)

    monkeypatch.setattr(bars, "_discard", cut)
    with pytest.raises(StreamingQueryException):
        bars.run_windowed(kept, f"{tmp_path}/out", f"{tmp_path}/log2")
    bars.run_windowed(kept, f"{tmp_path}/out", f"{tmp_path}/log2")
    assert read("out") == read("whole") and len(read("out")) > 600
    # the state is what the last micro-batches need
    assert sorted(p.name for p in (tmp_path / "log2/bars/open").iterdir()) == ["2", "3"]
