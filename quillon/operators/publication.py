"""Fact linking, alias chains, edge contracts and the publication of generations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions.market import canonical_id
from quillon.sources import scratch


def link_facts(facts: DataFrame, candidates: DataFrame, knowledge: Column | None = None) -> DataFrame:
    """(fact_id, status, assertion): each fact linked to the one candidate that agrees in company,
    metric, period, unit, dimensions and value, or the first rung of that ladder that none reaches;
    no_candidate where there is none at all.

    Values agree within half a unit of the candidate's `decimals` (which may be negative: -3 is thousands);
    without that column, or where it is 0 or null, they must be equal. With `knowledge`, only candidates whose
    known_from is not later are there; one of unknown time is not.

    Candidates are counted by all these columns first. Each rung is looked up by an equi-join with the
    different keys that reach it, and values meet in buckets of their scale, so no fact meets the candidates
    of its company one by one."""
    keys = ["company", "metric", "period", "unit"]
    if knowledge is not None:
        candidates = candidates.where(F.col("known_from").isNotNull() & (F.col("known_from") <= knowledge))
    places = F.coalesce(F.col("decimals").cast("int"), F.lit(0)) if "decimals" in candidates.columns else F.lit(0)
    value = F.col("value").cast("double")
    bucket = lambda d: F.floor(value / F.pow(F.lit(10.0), -d))
    counted = candidates.withColumn("decimals", places).groupBy(*keys, "dimensions", "decimals", "value").agg(F.count("*").alias("_n"), F.min("assertion").alias("_found"))
    j = facts.select("fact_id", *keys, "dimensions", "value")
    for i in range(3):
        j = j.join(counted.select(*keys[: i + 1]).distinct().withColumn(f"_k{i}", F.lit(1)), keys[: i + 1], "left")
    dims = F.coalesce("dimensions", F.lit(""))
    j = j.join(counted.groupBy(*keys).agg(F.min(dims).alias("_low"), F.max(dims).alias("_high"), F.lit(1).alias("_k3")), keys, "left")

    def meet(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        right = right.withColumnsRenamed({c: f"_c_{c}" for c in (*keys, "dimensions", *more)})
        on = F.col("dimensions").eqNullSafe(F.col("_c_dimensions"))
        for c in (*keys, *more):
            on = on & (F.col(c) == F.col(f"_c_{c}"))
        return left.join(right, on, "left").drop(*[f"_c_{c}" for c in (*keys, "dimensions", *more)])

    # a fact has a row for each scale that its candidates are stated in, and three buckets of each
    scales = counted.groupBy(*keys, "dimensions").agg(F.collect_set("decimals").alias("_scales"), F.lit(1).alias("_k4"))
    j = meet(j, scales).withColumn("_d", F.explode_outer("_scales")).drop("_scales")
    at = bucket(F.col("_d"))
    j = j.withColumn("_b", F.explode_outer(F.when(F.col("_d").isNotNull(), F.array(at - 1, at, at + 1))))
    j = meet(j, counted.select(*keys, "dimensions", F.col("decimals").alias("_d"), bucket(F.col("decimals")).alias("_b"), F.col("value").alias("_value"), "_n", "_found"), "_d", "_b")
    exact = "decimal(38,12)"
    apart = F.abs(F.col("value").cast(exact) - F.col("_value").cast(exact))
    same = F.when(F.col("_d") == 0, F.col("value") == F.col("_value")).otherwise(apart <= (F.pow(F.lit(10.0), -F.col("_d")) / 2).cast(exact))
    per = j.groupBy("fact_id").agg(
        *[F.count(f"_k{i}").alias(n) for i, n in enumerate(("n0", "n1", "n2", "n3", "n_same"))],
        F.when(F.min("_low") < F.max("_high"), 2).otherwise(1).alias("n_dims"),
        F.coalesce(F.sum(F.when(same, F.col("_n"))), F.lit(0)).alias("n_value"), F.min(F.when(same, F.col("_found"))).alias("found"),
    )
    status = F.when(F.lit(counted.isEmpty()), "no_candidate").when(F.col("n0") == 0, "cross_issuer")
    for i, name in enumerate(("metric_mismatch", "period_mismatch", "unit_incompatible")):
        status = status.when(F.col(f"n{i + 1}") == 0, name)
    status = status.when(F.col("n_dims") > 1, "unknown_dimensions").when(F.col("n_same") == 0, "dimensions_mismatch").when(F.col("n_value") == 0, "value_mismatch").when(F.col("n_value") > 1, "ambiguous").otherwise("linked")
    return per.select("fact_id", status.alias("status"), F.when(status == "linked", F.col("found")).alias("assertion"))


def numeric_citations(text: Column, pattern: str = r"-?\d[\d,]*(?:\.\d+)?") -> Column:
    """The numbers in a text, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def cited(value: Column, numbers: Column, tolerance: float = 0.005) -> Column:
    """Whether a number within the relative tolerance of value, also in thousands or millions, is
    among those of a text."""
    near = lambda x: (F.abs(x - value) <= tolerance * F.abs(value)) | (F.abs(x * 1e3 - value) <= tolerance * F.abs(value)) | (F.abs(x * 1e6 - value) <= tolerance * F.abs(value))
    return F.coalesce(F.exists(numbers, near), F.lit(False))


def alias_targets(aliases: DataFrame, most_steps: int = 40) -> DataFrame:
    """(id, target, cyclic): where a chain of (id, alias_of) ends; pointers double each round, so a
    chain of n links takes log2(n) joins. Ids still moving after that lie on a cycle."""
    links = aliases.where("alias_of is not null and alias_of <> id").select("id", F.col("alias_of").alias("target")).distinct()
    now, steps = scratch.cut(links), 1
    most = min(2**most_steps, 2 * max(1, now.count()))
    while steps <= most:
        ahead = now.select(F.col("id").alias("i"), F.col("target").alias("t")).alias("b")
        both = now.alias("a").join(ahead, F.col("a.target") == F.col("b.i"), "left")
        old, now = now, scratch.cut(both.select("a.id", F.coalesce("b.t", "a.target").alias("target"), F.col("b.t").isNotNull().alias("_moved")))
        scratch.discard(old)
        moved, steps = not now.where("_moved").isEmpty(), steps * 2
        now = _kept(now)
        if not moved:
            break
    ends = now.join(links.select(F.col("id").alias("target"), F.lit(True).alias("cyclic")).distinct(), "target", "left")
    return ends.select("id", "target", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def _kept(table: DataFrame) -> DataFrame:
    """A table of alias_targets() without its mark, still removable."""
    out = table.drop("_moved")
    out._quillon_path = table._quillon_path
    return out


def edge_issues(edges: DataFrame, nodes: DataFrame, allowed: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(edge_id, issue) of edges that break their contract: a type that is not known, an end of
    another type, or no evidence."""
    kind = nodes.select(F.col("node_id").alias("_n"), F.col("node_type").alias("_t"))
    j = edges.join(kind.withColumnsRenamed({"_n": "src", "_t": "src_type"}), "src", "left").join(kind.withColumnsRenamed({"_n": "dst", "_t": "dst_type"}), "dst", "left")
    known = F.col("edge_type").isin(*{a for a, _, _ in allowed})
    fits = F.lit(False)
    for e, s, d in allowed:
        fits = fits | ((F.col("edge_type") == e) & (F.col("src_type") == s) & (F.col("dst_type") == d))
    issue = F.when(~known, "unknown_type").when(F.col("src_type").isNull() | F.col("dst_type").isNull(), "dangling").when(~fits, "endpoint_type")
    if "evidence_id" in edges.columns:
        issue = issue.when(F.col("evidence_id").isNull(), "no_evidence")
    return j.withColumn("issue", issue).where("issue is not null").select("edge_id", "issue")


def merge_subset(previous: DataFrame, rebuilt: DataFrame, members: DataFrame, owner: str) -> DataFrame:
    """The next generation: previous rows of owners that are not members, and the rebuilt ones of
    members; rebuilt rows of others do not count."""
    ids = members.select(owner).distinct()
    return previous.join(ids, owner, "left_anti").unionByName(rebuilt.join(ids, owner, "left_semi"))


def fact_keys(entry: Sequence[Column], series: Sequence[Column]) -> dict[str, Column]:
    """series_key, and assertion_key over the series and the entry."""
    return {"series_key": canonical_id(*series), "assertion_key": canonical_id(*series, *entry)}


def distinct_observations(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One observation of each key, the first in order, with how many there were."""
    rest = [c for c in df.columns if c != key]
    packed = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_o"), F.count("*").alias("n_observations"))
    return packed.select(key, "_o.*", "n_observations")
