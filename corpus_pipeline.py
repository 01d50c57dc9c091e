"""The training-corpus pipeline: five operators of quillon.llm over documents, each stage written as
Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import common, langid, line_dedup, packing, simhash, toxicity

#: A document whose language is less likely than this, or that has no letter, is rejected.
LEAST_LANGUAGE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; `und` and doubtful ones go."""
    common.bound_batches(spark)
    found = langid.identify(docs.withColumnsRenamed({c: f"_quillon_{c}" for c in docs.columns if c in ("lang_pred", "score")}), langid.fit(docs))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({f"_quillon_{c}": c for c in ("lang_pred", "score")})


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic."""
    common.bound_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = docs.withColumnsRenamed({c: f"_quillon_{c}" for c in docs.columns if c in ("score", "predicted")})
    kept = toxicity.score(plain, model).where("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({f"_quillon_{c}": c for c in ("score", "predicted")})


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated passages; one that loses all its text goes."""
    plain = docs.withColumnsRenamed({c: f"_quillon_{c}" for c in docs.columns if c in ("n_lines", "n_removed")})
    kept = line_dedup.dedup_lines(plain).where("n_removed = 0 or trim(text) <> ''").drop("n_lines", "n_removed")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return kept.withColumnsRenamed({f"_quillon_{c}": c for c in ("n_lines", "n_removed")})


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    common.bound_batches(spark)
    return simhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their place in training windows."""
    common.bound_batches(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("packing", pack),
]

#: Models and packing have no SQL; the tests hold run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.cut(docs, "snappy")
            common.discard(*held)  # the stage before is read by this one alone
            held = [docs]
    return docs
