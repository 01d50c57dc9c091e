"""The graph of filings: nodes and edges of all types from chunks, facts and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.market import canonical_id
from quillon.operators.graph import split_dangling, supersession

#: The types of nodes and of edges.
NODE_TYPES = ["Company", "Filing", "Section", "Chunk", "XbrlFact", "Metric", "Period", "RiskFactor", "Event", "Segment", "Product", "Customer"]
EDGE_TYPES = ["FILED", "HAS_SECTION", "HAS_CHUNK", "REPORTED_FACT", "INSTANCE_OF", "FOR_PERIOD", "SOURCED_FROM", "DISCLOSED_RISK", "REPORTED_EVENT", "HAS_SEGMENT", "HAS_PRODUCT", "HAS_CUSTOMER", "SUPERSEDES"]
#: Kind of entity -> its node type, the edge to it, and the type of that edge's source.
ENTITIES = {
    "risk": ("RiskFactor", "DISCLOSED_RISK", "Filing"),
    "event": ("Event", "REPORTED_EVENT", "Filing"),
    "segment": ("Segment", "HAS_SEGMENT", "Company"),
    "product": ("Product", "HAS_PRODUCT", "Company"),
    "customer": ("Customer", "HAS_CUSTOMER", "Company"),
}


def _id(kind: str, *key: Column | str) -> Column:
    return canonical_id(F.lit(kind), *[F.col(k) if isinstance(k, str) else k for k in key])


def _node(df: DataFrame, kind: str, key: list, label: Column | str, company: str = "cik", stamp: str | None = None) -> DataFrame:
    whole = None
    for k in key:
        c = (F.col(k) if isinstance(k, str) else k).isNotNull()
        whole = c if whole is None else whole & c
    when = F.col(stamp).cast("string") if stamp else F.lit(None).cast("string")
    owner = F.col(company).cast("string") if company else F.lit(None).cast("string")
    return df.where(whole).select(F.lit(kind).alias("node_type"), _id(kind, *key).alias("node_id"), (F.col(label) if isinstance(label, str) else label).cast("string").alias("label"), owner.alias("company"), when.alias("known_from"))


def _edge(df: DataFrame, kind: str, src: Column, dst: Column, needs: list[str], stamp: str | None = None) -> DataFrame:
    for c in needs:
        df = df.where(F.col(c).isNotNull())
    when = F.col(stamp).cast("string") if stamp else F.lit(None).cast("string")
    return df.select(F.lit(kind).alias("edge_type"), src.alias("src"), dst.alias("dst"), when.alias("known_from"))


def build(chunks: DataFrame, facts: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejects) of chunks (cik, company, accession, accepted_ts, section, chunk_index), facts (cik,
    accession, accepted_ts, concept, period, value, chunk_index) and entities (cik, accession, accepted_ts, kind,
    name, chunk_index).

    One node an id and one edge an id: of clashing labels the first in order stays and the clash is a reject
    (`label_conflict`); an edge without one of its ends is a reject as well, and so is an entity of an unknown
    kind or a row that lacks a part of its key (`missing_key`). A node is known from its first source on.
    Facts and chunks name their companies and filings, which the chunks alone describe."""
    fact_key = ["cik", "concept", "period", "accession", "value"]
    e = {k: entities.where(F.col("kind") == k) for k in ENTITIES}
    nodes = [
        _node(chunks, "Company", ["cik"], "company"),
        _node(chunks, "Filing", ["accession"], "accession", stamp="accepted_ts"),
        _node(chunks, "Section", ["accession", "section"], "section", stamp="accepted_ts"),
        _node(chunks, "Chunk", ["accession", "chunk_index"], F.lit(""), stamp="accepted_ts"),
        _node(facts, "XbrlFact", fact_key, F.col("value"), stamp="accepted_ts"),
        _node(facts, "Metric", ["concept"], "concept", company=None),
        _node(facts, "Period", ["period"], "period", company=None),
        *[_node(e[k], kind, ["cik", "name"], "name", stamp="accepted_ts") for k, (kind, _, _) in ENTITIES.items()],
    ]
    fact, company, filing, chunk = _id("XbrlFact", *fact_key), _id("Company", "cik"), _id("Filing", "accession"), _id("Chunk", "accession", "chunk_index")
    section = _id("Section", "accession", "section")
    own = ["cik", "concept", "period", "accession", "value"]
    replaced = supersession(facts.where(" and ".join(f"{c} is not null" for c in own)).withColumn("_id", fact), ["cik", "concept", "period"], ["accepted_ts", "accession"], "_id", "value")
    edges = [
        _edge(chunks, "FILED", company, filing, ["cik", "accession"], "accepted_ts"),
        _edge(chunks, "HAS_SECTION", filing, section, ["accession", "section"], "accepted_ts"),
        _edge(chunks, "HAS_CHUNK", section, chunk, ["accession", "section", "chunk_index"], "accepted_ts"),
        _edge(facts, "REPORTED_FACT", company, fact, own, "accepted_ts"),
        _edge(facts, "INSTANCE_OF", fact, _id("Metric", "concept"), own, "accepted_ts"),
        _edge(facts, "FOR_PERIOD", fact, _id("Period", "period"), own, "accepted_ts"),
        _edge(facts, "SOURCED_FROM", fact, chunk, [*own, "chunk_index"], "accepted_ts"),
        replaced.select(F.lit("SUPERSEDES").alias("edge_type"), F.col("newer").alias("src"), F.col("older").alias("dst"), F.lit(None).cast("string").alias("known_from")),
    ]
    for k, (kind, edge, source) in ENTITIES.items():
        node, need = _id(kind, "cik", "name"), ["cik", "name", *(["accession"] if source == "Filing" else [])]
        edges.append(_edge(e[k], edge, filing if source == "Filing" else company, node, need, "accepted_ts"))
        edges.append(_edge(e[k], "SOURCED_FROM", node, chunk, ["cik", "name", "accession", "chunk_index"], "accepted_ts"))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    n = union(nodes).groupBy("node_id").agg(F.min("node_type").alias("node_type"), F.min("label").alias("label"), F.max("label").alias("_other"), F.min("company").alias("company"), F.min("known_from").alias("known_from"))
    one = union(edges).groupBy("edge_type", "src", "dst").agg(F.min("known_from").alias("known_from"))
    one = one.withColumn("edge_id", canonical_id(F.col("edge_type"), F.col("src"), F.col("dst")))
    good, bad = split_dangling(one, n)
    part = lambda df, kind, reason, key: df.select(F.lit(kind).alias("kind"), reason.alias("reason"), key.alias("id"))
    lacking = lambda df, cols: df.where(" or ".join(f"{c} is null" for c in cols))
    rejects = union(
        [
            part(n.where("label <> _other"), "node", F.lit("label_conflict"), F.col("node_id")),
            part(bad, "edge", F.col("reason"), F.col("edge_id")),
            part(entities.where(~F.coalesce(F.col("kind").isin(*ENTITIES), F.lit(False))), "entity", F.lit("unknown_kind"), F.col("name")),
            part(lacking(entities.where(F.col("kind").isin(*ENTITIES)), ["cik", "name"]), "entity", F.lit("missing_key"), F.col("name")),
            part(lacking(facts, own), "fact", F.lit("missing_key"), F.col("concept")),
            part(lacking(chunks, ["cik", "accession", "section", "chunk_index"]), "chunk", F.lit("missing_key"), F.col("accession")),
        ]
    )
    return n.drop("_other"), good.select("edge_id", "edge_type", "src", "dst", "known_from"), rejects


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("kind", "reason").agg(F.count("*").alias("n"))


def find_nodes(nodes: DataFrame, edges: DataFrame, node_type: str | None = None, company: str | None = None, as_of: str | None = None) -> DataFrame:
    """Nodes of a type and a company that are known at as_of: their own stamp, or, for nodes without one, that
    of some edge at them, is not later."""
    out = nodes if node_type is None else nodes.where(F.col("node_type") == node_type)
    out = out if company is None else out.where(F.col("company") == company)
    if as_of is None:
        return out
    seen = edges.where(F.col("known_from") <= as_of)
    touched = seen.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    own = out.where(F.col("known_from") <= as_of)
    return own.unionByName(out.where("known_from is null").join(touched, "node_id", "left_semi"))


def neighbours_at(nodes: DataFrame, edges: DataFrame, start: DataFrame, as_of: str) -> DataFrame:
    """(start, edge_type, direction, node_id, node_type, label) one hop from start (node_id): edge and node are
    both known at as_of; one without a stamp is."""
    known = F.col("known_from").isNull() | (F.col("known_from") <= as_of)
    e, n = edges.where(known), nodes.where(known).select("node_id", "node_type", "label")
    s = start.select(F.col("node_id").alias("start")).distinct()
    out = e.join(s, e["src"] == s["start"]).select("start", "edge_type", F.lit("out").alias("direction"), F.col("dst").alias("node_id"))
    back = e.join(s, e["dst"] == s["start"]).select("start", "edge_type", F.lit("in").alias("direction"), F.col("src").alias("node_id"))
    return out.unionByName(back).join(n, "node_id").select("start", "edge_type", "direction", "node_id", "node_type", "label")


def latest_risks(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The n risk factors of each company that were disclosed last."""
    risks = nodes.where("node_type = 'RiskFactor'").join(edges.where("edge_type = 'DISCLOSED_RISK'").groupBy(F.col("dst").alias("node_id")).agg(F.max("known_from").alias("disclosed")), "node_id")
    w = Window.partitionBy("company").orderBy(F.desc("disclosed"), "label")
    return risks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
