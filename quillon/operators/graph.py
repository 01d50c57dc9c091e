"""Provenance-carrying graphs, fact series, bitemporal logs and identity. Traversal is joins;
validation is aggregates and anti-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.market import canonical_id
from quillon.sources import scratch


def nodes(parts: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(node_id, node_type, key, label) of (type, frame, key column, label column), once per id; of clashing
    labels the first in order stays (label_clashes() tells them)."""
    out = None
    for kind, df, key, label in parts:
        part = df.select(F.lit(kind).alias("node_type"), F.col(key).cast("string").alias("key"), F.col(label).cast("string").alias("label"))
        out = part if out is None else out.unionByName(part)
    named = out.withColumn("node_id", canonical_id(F.col("node_type"), F.col("key")))
    return named.groupBy("node_id", "node_type", "key").agg(F.min("label").alias("label"))


def label_clashes(parts: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(node_type, key, n_labels) of keys that come with more than one label."""
    out = None
    for kind, df, key, label in parts:
        part = df.select(F.lit(kind).alias("node_type"), F.col(key).cast("string").alias("key"), F.col(label).cast("string").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("node_type", "key").agg(F.countDistinct("label").alias("n_labels")).where("n_labels > 1")


def edges(parts: Sequence[tuple[str, DataFrame, str, Column, str, Column]]) -> DataFrame:
    """(edge_id, edge_type, src, dst) of (type, frame, source type, source key, target type, target
    key), once per id; rows without an end give none."""
    out = None
    for kind, df, st, sk, dt, dk in parts:
        part = df.where(sk.isNotNull() & dk.isNotNull()).select(F.lit(kind).alias("edge_type"), canonical_id(F.lit(st), sk.cast("string")).alias("src"), canonical_id(F.lit(dt), dk.cast("string")).alias("dst"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("edge_id", canonical_id(F.col("edge_type"), F.col("src"), F.col("dst"))).dropDuplicates(["edge_id"])


def split_dangling(e: DataFrame, n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with both ends among the nodes, the others with the reason)."""
    ids = n.select("node_id")
    marked = (
        e.join(ids.select(F.col("node_id").alias("src"), F.lit(True).alias("_s")), "src", "left")
        .join(ids.select(F.col("node_id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    )
    reason = F.when(F.col("_s").isNull() & F.col("_d").isNull(), "both_missing").when(F.col("_s").isNull(), "src_missing").when(F.col("_d").isNull(), "dst_missing")
    marked = marked.withColumn("reason", reason).drop("_s", "_d")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def neighbours(e: DataFrame, n: DataFrame, start: DataFrame) -> DataFrame:
    """(start, edge_type, direction, node_id, ...) one hop from start (node_id): an equi-join for
    each direction."""
    s = start.select(F.col("node_id").alias("start")).distinct()
    out = e.join(s, e["src"] == s["start"]).select("start", "edge_type", F.lit("out").alias("direction"), F.col("dst").alias("node_id"))
    back = e.join(s, e["dst"] == s["start"]).select("start", "edge_type", F.lit("in").alias("direction"), F.col("src").alias("node_id"))
    return out.unionByName(back).join(n, "node_id")


def supersession(facts: DataFrame, series: Sequence[str], order: Sequence[str], fact_id: str, value: str) -> DataFrame:
    """(newer, older) where a fact's value differs from the version just before it in its series."""
    w = Window.partitionBy(*series).orderBy(*order)
    step = facts.withColumns({"_p": F.lag(fact_id).over(w), "_v": F.lag(value).over(w)})
    changed = F.col("_p").isNotNull() & ~F.col(value).eqNullSafe(F.col("_v"))
    return step.where(changed).select(F.col(fact_id).alias("newer"), F.col("_p").alias("older"))


def latest_facts(facts: DataFrame, series: Sequence[str], order: Sequence[str], as_of: Column | None = None, stamp: str | None = None) -> DataFrame:
    """The last version of each series known at as_of, its number of versions and whether the value
    was ever restated."""
    known = facts if as_of is None else facts.where(F.col(stamp).isNotNull() & (F.col(stamp) <= as_of))
    rest = [c for c in facts.columns if c not in series]
    packed = known.groupBy(*series).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l"), F.count("*").alias("versions"), F.countDistinct("value").alias("_values"))
    return packed.select(*series, "_l.*", "versions", (F.col("_values") > 1).alias("restated"))


def derive_intervals(log: DataFrame) -> DataFrame:
    """Adds system_from and system_to to (event_id, recorded_at, supersedes, ...): an event is
    believed from its record to the first record of one that supersedes it; null means still."""
    ends = log.where("supersedes is not null").groupBy(F.col("supersedes").alias("event_id")).agg(F.min("recorded_at").alias("system_to"))
    return log.join(ends, "event_id", "left").withColumn("system_from", F.col("recorded_at"))


def log_issues(log: DataFrame) -> DataFrame:
    """(issue, n): duplicate ids, links to unknown events, corrections recorded before what they correct,
    and events whose corrections run into a cycle."""
    ids = log.groupBy("event_id").agg(F.count("*").alias("n"), F.min("recorded_at").alias("at"))
    dup = ids.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_id").alias("issue"), "n")
    linked = log.where("supersedes is not null").join(ids.select(F.col("event_id").alias("supersedes"), "at"), "supersedes", "left")
    counts = linked.agg(F.count_if(F.col("at").isNull()).alias("d"), F.count_if(F.col("recorded_at") < F.col("at")).alias("b"))
    return dup.unionByName(counts.select(F.lit("dangling").alias("issue"), F.col("d").alias("n"))).unionByName(counts.select(F.lit("before_original").alias("issue"), F.col("b").alias("n"))).unionByName(correction_cycles(log).agg(F.count("*").alias("n")).select(F.lit("cycle").alias("issue"), "n"))


def resolve(log: DataFrame, business: Column, knowledge: Column, view: str) -> DataFrame:
    """The value of each (entity, attribute) for a business time as known at a knowledge time.

    system_replay: what the system believed then. public_as_of: only events public by then; an event
    goes if a chain of corrections leads back to it from a public one, also through events that are
    not public."""
    known = derive_intervals(log)
    covers = (F.col("valid_from") <= business) & (F.col("valid_to").isNull() | (business < F.col("valid_to")))
    if view == "system_replay":
        seen = known.where((F.col("system_from") <= knowledge) & (F.col("system_to").isNull() | (knowledge < F.col("system_to"))))
        rank = F.struct("valid_from", "recorded_at", "event_id")
    elif view == "public_as_of":
        public = (F.col("public_at") <= knowledge) & (F.col("recorded_at") <= knowledge)
        eligible = known.where(F.coalesce(public, F.lit(False)))
        gone = _corrected_by(log, eligible.select("event_id", "supersedes"))
        seen = eligible.join(gone, "event_id", "left_anti")
        rank = F.struct("public_at", "valid_from", "recorded_at", "event_id")
    else:
        raise ValueError(f"unknown view {view}")
    best = seen.where(covers).groupBy("entity", "attribute").agg(F.max_by(F.struct("value", "event_id"), rank).alias("_b"))
    return best.select("entity", "attribute", "_b.value", "_b.event_id")


def _corrected_by(log: DataFrame, start: DataFrame) -> DataFrame:
    """Ids reached from start by following supersedes any number of steps.

    Pointer doubling, twice a round: a round's pointers lead 1, 4, 16, ... steps on, one row a link at most, so
    a chain of n links takes half of log2(n) rounds of equi-joins. Each round is written to the shared folder
    and the one before removed. A cycle ends with the number of its links."""
    jump = scratch.cut(log.where("supersedes is not null").select(F.col("event_id").alias("f"), F.col("supersedes").alias("t")).distinct())
    reach = start.where("supersedes is not null").select(F.col("supersedes").alias("event_id")).distinct()
    steps, links, held = 1, None, []
    while True:
        twice = _composed(jump)
        further = _followed(_followed(reach, jump), twice).distinct()
        ahead = scratch.cut(_composed(twice).distinct())
        steps *= 4
        if steps > 1024 and links is None:
            links = log.count()
        if ahead.isEmpty() or (links is not None and steps > links):
            return further
        held.append(jump)
        if steps > 4:  # the first round's result is read from its two tables
            further, old = scratch.cut(further), held
            scratch.discard(*old)
            held = [further]
        jump, reach = ahead, further


def _composed(jump: DataFrame) -> DataFrame:
    """Pointers (f, t) that lead twice as far, not yet made distinct."""
    both = jump.alias("x").join(jump.alias("y"), F.col("x.t") == F.col("y.f"))
    return both.select(F.col("x.f").alias("f"), F.col("y.t").alias("t"))


def _followed(reach: DataFrame, jump: DataFrame) -> DataFrame:
    return reach.unionByName(reach.join(jump, reach["event_id"] == jump["f"]).select(F.col("t").alias("event_id")))


def correction_cycles(log: DataFrame) -> DataFrame:
    """(event_id) of every event whose chain of corrections leads into a cycle: those that still have a
    successor after as many steps as there are links."""
    jump = scratch.cut(log.where("supersedes is not null").select(F.col("event_id").alias("f"), F.col("supersedes").alias("t")).distinct())
    links, steps = jump.count(), 1
    while steps <= links and not jump.isEmpty():
        jump, old = scratch.cut(_composed(_composed(jump)).distinct()), jump
        scratch.discard(old)
        steps *= 4
    return jump.select(F.col("f").alias("event_id")).distinct()


def reconcile(facts: DataFrame, keys: Sequence[str], source: str, precedence: Sequence[str], stamp: str, knowledge: Column | None = None) -> DataFrame:
    """One fact of each key: by the source's precedence, then the latest stamp, then source name; with
    `knowledge`, of those whose stamp is known and not later."""
    if knowledge is not None:
        facts = facts.where(F.col(stamp).isNotNull() & (F.col(stamp) <= knowledge))
    order = F.array_position(F.array(*[F.lit(s) for s in precedence]), F.col(source))
    rank = F.when(order == 0, len(precedence) + 1).otherwise(order)
    w = Window.partitionBy(*keys).orderBy(rank, F.desc(stamp), source)
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def conflicts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, n, issue columns): keys whose rows disagree on a column, or that lack it in all rows."""
    per = df.groupBy(key).agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(c) for c in columns])
    bad = [F.when(F.col(c) > 1, f"conflict_{c}").when(F.col(c) == 0, f"missing_{c}") for c in columns]
    out = per.select(key, "n", F.array_join(F.array_compact(F.array(*bad)), ",").alias("issues"))
    return out.where("issues <> ''")


def overlaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows whose half-open interval begins before the end of an earlier one of its key."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    open_end = F.coalesce(F.col(end), F.lit("9999-12-31").cast(df.schema[end].dataType))
    return df.withColumn("_e", F.max(open_end).over(w)).where(F.col(start) < F.col("_e")).drop("_e")


def half_open(df: DataFrame, end: str) -> DataFrame:
    """Inclusive end dates as exclusive ones."""
    return df.withColumn(end, F.date_add(end, 1))


def names_at(points: DataFrame, names: DataFrame, key: str, at: str) -> DataFrame:
    """points with the name that was valid at a time, of names (key, name, valid_from, valid_to, inclusive ends) and
    of observations without an interval (both ends null), which only count where no interval does: the last
    of them by name. Repeated points come once."""
    from quillon.operators.asof import interval_join

    dated = half_open(names.where("valid_from is not null"), "valid_to")
    seen = names.where("valid_from is null and valid_to is null").groupBy(key).agg(F.max("name").alias("_seen"))
    out = interval_join(points, dated.select(key, "name", F.col("valid_from").cast("timestamp").alias("_from"), F.col("valid_to").cast("timestamp").alias("_to")), [key], at, "_from", "_to")
    first = out.groupBy(*points.columns).agg(F.max_by("name", F.struct("_from", "name")).alias("name"))  # of overlapping ones the latest
    return first.join(seen, key, "left").withColumn("name", F.coalesce("name", "_seen")).drop("_seen")


def canonical_ticker(mapping: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """(ticker, cik, n_chunks, canonical): of tickers sharing a CIK, that with most chunks, then the
    first by name, stands for all."""
    joined = mapping.join(chunk_counts, "ticker", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    w = Window.partitionBy("cik").orderBy(F.desc("n_chunks"), "ticker").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return joined.withColumn("canonical", F.first("ticker").over(w))
