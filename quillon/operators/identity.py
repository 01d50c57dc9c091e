"""Normal forms and deterministic keys of companies, filings and facts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def unicode_normal(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, single spaces, no space at the ends. No built-in normalises Unicode."""
    import unicodedata

    for s in values:
        yield s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()))


def normal_ticker(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(F.trim(x)), r"[./#]", "-"), F.lit(""))


def padded_cik(x: Column) -> Column:
    """Ten digits; null where there are no digits or too many."""
    digits = F.regexp_replace(x.cast("string"), r"\D", "")
    return F.when(F.length(digits).between(1, 10), F.lpad(digits, 10, "0"))


def accession(x: Column) -> Column:
    """0000000000-00-000000 of 18 digits in any spelling; else null."""
    d = F.regexp_replace(x, r"\D", "")
    return F.when(F.length(d) == 18, F.concat_ws("-", F.substring(d, 1, 10), F.substring(d, 11, 2), F.substring(d, 13, 6)))


def exact_decimal(x: Column) -> Column:
    return x.cast("string").try_cast("decimal(38,12)")


def record_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by two bars; null is an empty part."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def ticker_variants(mapping: DataFrame, ticker: str) -> DataFrame:
    """A row per spelling of a ticker: as it is, with a dot, with a dash, without either."""
    t = F.col(ticker)
    forms = F.array_distinct(F.array(t, F.translate(t, ".", "-"), F.translate(t, "-", "."), F.regexp_replace(t, "[.-]", "")))
    return mapping.select("*", F.explode(forms).alias("variant"))


def filer_conflicts(rows: DataFrame, accession_: str, cik: str) -> DataFrame:
    """Accessions under more than one CIK, with the one their own prefix names."""
    per = rows.groupBy(accession_).agg(F.countDistinct(cik).alias("n_ciks"), F.array_sort(F.collect_set(cik)).alias("ciks"))
    return per.where("n_ciks > 1").withColumn("owner", F.substring(F.regexp_replace(accession_, r"\D", ""), 1, 10))


def observation_key(*parts: Column) -> Column:
    """Hash of a canonical JSON object of the parts, in the given order."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def versioned_id(kind: str, version: int, *parts: Column) -> Column:
    """The id of a natural key under an encoding: 1 joins the parts with bars, so that parts with bars can run together;
    2 gives each its length. The version is part of the id."""
    from quillon.functions.market import canonical_id

    if version == 1:
        return F.concat(F.lit(f"{kind}:v1:"), F.sha2(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))
    if version == 2:
        return F.concat(F.lit(f"{kind}:v2:"), canonical_id(F.lit(kind), *parts))
    raise ValueError(f"unknown identity version {version}")


def migration(df: DataFrame, kind: str, parts: list[str]) -> DataFrame:
    """(old_id, new_id, collided) from version 1 to 2, once each; collided: different keys shared the old id, so the
    old one alone cannot tell which new one is meant."""
    cols = [F.col(p) for p in parts]
    ids = df.select(versioned_id(kind, 1, *cols).alias("old_id"), versioned_id(kind, 2, *cols).alias("new_id")).distinct()
    n = ids.groupBy("old_id").agg(F.count("*").alias("_n"))
    return ids.join(n, "old_id").select("old_id", "new_id", (F.col("_n") > 1).alias("collided"))


def migrated(df: DataFrame, key: str, moves: DataFrame) -> DataFrame:
    """df with old ids in `key` replaced by new ones; collided and unknown ids stay."""
    sure = moves.where("not collided").select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    return df.join(sure, df[key] == F.col("_old"), "left").withColumn(key, F.coalesce("_new", key)).drop("_old", "_new")


def collisions(df: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, n) of ids that stand for more than one natural key."""
    told = F.struct(*[F.col(p) for p in parts])
    return df.groupBy(key).agg(F.countDistinct(told).alias("n")).where("n > 1")
