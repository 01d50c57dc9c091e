"""Writers: append, partitioned overwrite, and a manifest that makes ingestion resumable."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "name string, status string, rows bigint, at timestamp"


def append(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Appends with an ingest time."""
    df.withColumn("ingest_ts", F.current_timestamp()).write.mode("append").partitionBy(*partition).parquet(path)


def overwrite(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Replaces the partitions that df has, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def truncate(spark: SparkSession, paths: Mapping[str, str], preserved: Collection[str]) -> list[str]:
    """Empties the tables (name -> path) that are not preserved, keeping their columns; returns the names."""
    done = []
    for name, path in paths.items():
        if name in preserved:
            continue
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        done.append(name)
    return done


def ingest(spark: SparkSession, manifest: str, name: str, work: Callable[[], int]) -> str:
    """Runs work() for a file unless the manifest says it succeeded; records RUNNING, then SUCCESS with its rows,
    or FAILED before the error is passed on."""
    try:
        last = spark.read.parquet(manifest).where(F.col("name") == name).groupBy("name").agg(F.max_by("status", "at").alias("s")).first()
    except AnalysisException:
        last = None  # no manifest yet
    if last is not None and last.s == "SUCCESS":
        return "SKIPPED"
    record(spark, manifest, name, "RUNNING")
    try:
        rows = work()
    except BaseException:
        record(spark, manifest, name, "FAILED")
        raise
    record(spark, manifest, name, "SUCCESS", rows)
    return "SUCCESS"


def require_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, whose rows fail when they are computed if one of the columns is null."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null"))).otherwise(F.col(c)))
    return df


def with_comments(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(c) for c in df.columns])


def run_steps(spark: SparkSession, steps: Sequence[tuple[str, Callable[[SparkSession], object], str | None]]) -> list[tuple[str, str]]:
    """Runs named steps in order; one whose source table (a path, or None) is not there is skipped, and an error
    ends the run. Returns (name, ran or skipped)."""
    out = []
    for name, step, source in steps:
        if source is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
            if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
                out.append((name, "skipped"))
                continue
        step(spark)
        out.append((name, "ran"))
    return out


def statements(script: str, values: Mapping[str, str]) -> list[str]:
    """The statements of an SQL script: ${name} filled in (an unknown name is an error), comments gone, cut at
    semicolons outside quotes."""
    import re

    def fill(m: re.Match) -> str:
        if m.group(1) not in values:
            raise ValueError(f"no value for ${{{m.group(1)}}}")
        return values[m.group(1)]

    text, out, now = re.sub(r"\$\{(\w+)\}", fill, script), [], ""
    for token in re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|;|[^'\"\-/;]+|.", text, flags=re.S):
        if token == ";":
            out.append(now.strip())
            now = ""
        elif not token.startswith(("--", "/*")):
            now += token
    return [s for s in [*out, now.strip()] if s]


def pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (name) whose last state is not a success."""
    last = manifest.groupBy("name").agg(F.max_by("status", "at").alias("status"))
    return files.join(last.where("status = 'SUCCESS'").select("name"), "name", "left_anti")


def record(spark: SparkSession, path: str, name: str, status: str, rows: int | None = None) -> None:
    """One more state of a file in the manifest at path."""
    df = spark.createDataFrame([(name, status, rows)], "name string, status string, rows bigint")
    df.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def written_rows(df: DataFrame, path: str, mode: str = "append") -> int:
    """Writes df and returns by how many rows the table grew, from file footers before and after: df
    is read once. (An Observation would stay with the session, and Spark's ML transformers cannot be
    shipped from a session that has had one.)"""
    spark = df.sparkSession
    empty = spark.createDataFrame([], df.schema)
    if mode == "append":
        empty.write.mode("append").parquet(path)  # so that there is a table to count
    before = 0 if mode == "overwrite" else spark.read.parquet(path).count()
    df.write.mode(mode).parquet(path)
    return spark.read.parquet(path).count() - before


def missing_keys(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Keys of df that the written table lacks: empty after a good append."""
    return df.select(*keys).distinct().join(df.sparkSession.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")


class PublicationConflict(ValueError):
    """Another generation was published since the expected one."""


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def generation(spark: SparkSession, folder: str) -> int:
    """The number of the latest generation published in folder; 0 for none."""
    path, store = _store(spark, folder)
    if not store.exists(path):
        return 0
    names = [s.getPath().getName() for s in store.listStatus(path)]
    return max((int(n.removeprefix("generation-")) for n in names if n.startswith("generation-")), default=0)


def publish(df: DataFrame, folder: str, expected: int) -> int:
    """Publishes df as the generation after `expected`, or raises PublicationConflict: the data are written under a
    fresh name first, and the generation's pointer is created only if it is not there, so of two writers one
    wins and readers see whole generations alone."""
    import uuid

    spark, name = df.sparkSession, f"data-{uuid.uuid4().hex}"
    if generation(spark, folder) != expected:
        raise PublicationConflict(f"{folder} is not at generation {expected}")
    df.write.parquet(f"{folder}/{name}")
    path, store = _store(spark, f"{folder}/generation-{expected + 1:012d}")
    try:
        out = store.create(path, False)
    except Exception as e:
        raise PublicationConflict(f"{folder} has left generation {expected}") from e
    out.write(bytearray(name.encode()))
    out.close()
    return expected + 1


def published(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The latest generation, or the one of that number."""
    number = generation(spark, folder) if number is None else number
    path, store = _store(spark, f"{folder}/generation-{number:012d}")
    stream = store.open(path)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return spark.read.parquet(f"{folder}/{name}")
