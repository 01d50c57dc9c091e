"""Retrieval as a service: alias and coverage checks, modes, reranking, embedding upkeep, and the
evaluation of answers."""

from __future__ import annotations

import datetime as dt
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future
from threading import Lock

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.operators import text as tx

MODES = ("bm25", "dense", "hybrid_rrf", "hybrid_rerank")


def known_at(df: DataFrame, stamp: str, as_of: Column) -> DataFrame:
    """Rows known at as_of; an unknown stamp is not known."""
    return df.where(F.col(stamp).isNotNull() & (F.col(stamp) <= as_of))


def canonical(df: DataFrame, aliases: DataFrame, ticker: str) -> DataFrame:
    """df with its ticker replaced by the canonical one of aliases (ticker, canonical), and whether
    that has any coverage (n_chunks)."""
    a = aliases.select(F.upper("ticker").alias("_t"), F.col("canonical").alias("_c"), F.col("n_chunks").alias("_n"))
    out = df.join(a, F.upper(F.trim(ticker)) == F.col("_t"), "left")
    return out.withColumns({ticker: F.coalesce("_c", ticker), "covered": F.coalesce(F.col("_n") > 0, F.lit(False))}).drop("_t", "_c", "_n")


def search(mode: str, keyword: DataFrame | None, dense: DataFrame | None, query_id: str, doc_id: str, top: int, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Results of a mode over legs that hold twice as many as wanted; a reranker may reorder them."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    out = tx.hybrid(keyword, dense, "hybrid_rrf" if mode == "hybrid_rerank" else mode, query_id, doc_id, 2 * top if mode == "hybrid_rerank" else top)
    if mode == "hybrid_rerank":
        if rerank is None:
            raise ValueError("hybrid_rerank needs a reranker")
        out = rerank(out)
    return out.where(F.col("rank") <= top)


def rerank_by(score: Column, query_id: str, doc_id: str) -> Callable[[DataFrame], DataFrame]:
    """A reranker that orders candidates by a score column; a model's scores come in through it."""

    def apply(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(query_id).orderBy(F.desc("_score"), doc_id)
        return df.withColumn("_score", score).withColumn("rank", F.row_number().over(w)).drop("_score")

    return apply


def embed_new(chunks: DataFrame, stored: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], model: str) -> DataFrame:
    """(key, model, vector) of chunks that have no vector of this model yet; texts go to the model in
    Arrow batches, and the result is to be inserted, never updated."""
    todo = chunks.dropDuplicates([key]).join(stored.where(F.col("model") == model).select(key), key, "left_anti").select(key, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "model": model, "vector": embed(pdf[text].fillna("").tolist())})

    return todo.mapInPandas(run, f"`{key}` {chunks.schema[key].dataType.simpleString()}, model string, vector array<float>")


def section_rollup(df: DataFrame, keys: Sequence[str], section: str, index: str, text: str) -> DataFrame:
    """The text of each section, its chunks in order."""
    packed = df.groupBy(*keys, section).agg(F.array_sort(F.collect_list(F.struct(index, text))).alias("_c"))
    return packed.select(*keys, section, F.array_join(F.transform("_c", lambda x: x[text]), "\n\n").alias("section_text"), F.size("_c").alias("n_chunks"))


def delta_to_previous(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Each column's change from the key's row before."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in columns})


def score_items(items: DataFrame, answered: str, answerable: str, recall: str) -> DataFrame:
    """outcome of each question: answered or abstained, rightly or not."""
    a, can = F.col(answered), F.col(answerable)
    return items.withColumn("outcome", F.when(can & a & (F.col(recall) > 0), "hit").when(can & a, "miss").when(can, "wrong_abstention").when(a, "wrong_answer").otherwise("right_abstention"))


def stratified(items: DataFrame, strata: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means by stratum, and over all under stratum `all`: one pass with grouping sets by hand."""
    both = items.select(F.explode(F.array(F.lit("all"), *[F.concat_ws("=", F.lit(s), F.col(s)) for s in strata])).alias("stratum"), *values)
    return both.groupBy("stratum").agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def propose_questions(facts: DataFrame, key: Sequence[str], label: str, value: str, most: int) -> DataFrame:
    """Question and answer candidates of facts with one undisputed value, `most` for each label."""
    sure = facts.groupBy(*key, label).agg(F.countDistinct(value).alias("_n"), F.max(value).alias(value)).where("_n = 1").drop("_n")
    w = Window.partitionBy(label).orderBy(*key)
    return sure.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


class CorpusCache:
    """Loaded corpora by ticker, the least lately used going first; two callers that ask for one ticker at a time get
    one load. A corpus is whatever load() gives, for instance a persisted DataFrame, and `drop` is told of those that
    go."""

    def __init__(self, load: Callable[[str], object], most: int = 32, drop: Callable[[object], None] | None = None):
        self.load, self.most, self.drop = load, most, drop
        self.held: OrderedDict[str, Future] = OrderedDict()
        self.lock = Lock()

    def get(self, ticker: str) -> object:
        key = ticker.strip().upper()
        with self.lock:
            found = self.held.get(key)
            mine = found is None
            if mine:
                found = self.held[key] = Future()
            self.held.move_to_end(key)
            gone = [self.held.popitem(last=False)[1] for _ in range(max(0, len(self.held) - self.most))]
        if mine:
            try:
                found.set_result(self.load(key))
            except BaseException as e:
                with self.lock:
                    if self.held.get(key) is found:
                        del self.held[key]
                found.set_exception(e)
        for old in gone:
            if self.drop and old.done() and old.exception() is None:
                self.drop(old.result())
        return found.result()


def parse_as_of(text: str) -> dt.datetime:
    """An instant in UTC of an ISO date (its end) or time; a time without a zone is UTC. Anything else is an error."""
    cleaned = text.strip()
    if len(cleaned) == 10:
        return dt.datetime.combine(dt.date.fromisoformat(cleaned), dt.time(23, 59, 59, 999_999), dt.timezone.utc)
    at = dt.datetime.fromisoformat(cleaned.replace("Z", "+00:00"))
    return at.astimezone(dt.timezone.utc) if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)


def check_vectors(df: DataFrame, vector: str, model: str, dimension: int, name: str) -> DataFrame:
    """df, whose rows fail when they are computed if a vector is of another length or another model."""
    bad = (F.size(vector) != dimension) | ~F.col(model).eqNullSafe(F.lit(name))
    return df.withColumn(vector, F.when(bad, F.raise_error(F.lit(f"not a vector of {name} with {dimension} components"))).otherwise(F.col(vector)))


def citations(results: DataFrame, chunks: DataFrame, doc_id: str) -> DataFrame:
    """Results with their citation: accession, section and chunk of the source, and its stamp."""
    source = chunks.select(doc_id, F.struct("accession", "section", "chunk_index", "accepted_ts").alias("citation"))
    return results.join(source, doc_id, "left")


def evaluate(modes: Mapping[str, DataFrame], gold: DataFrame, strata: DataFrame, query_id: str, doc_id: str, k: int) -> DataFrame:
    """(mode, stratum, n, recall, mrr, ndcg) of each mode's ranked results against gold (query_id, doc_id), over all
    queries and by the strata columns of (query_id, ...). Queries without results count as 0."""
    out = None
    for mode, ranked in modes.items():
        per = tx.ranking_metrics(ranked, gold, query_id, doc_id, k).join(strata, query_id, "left")
        part = stratified(per, [c for c in strata.columns if c != query_id], ["recall", "mrr", "ndcg"]).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def enriched(df: DataFrame, key: str, text: str, enrich: Callable[[list[str]], list[str]] | None, budget: int) -> DataFrame:
    """(key, note) of at most `budget` rows, by key, from an outside model that takes lists of texts; without a model, no
    rows: enrichment is off by default."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, note string"
    some = df.orderBy(key).limit(budget if enrich else 0).select(key, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "note": enrich(pdf[text].fillna("").tolist()) if len(pdf) else []})

    return some.mapInPandas(run, schema)
