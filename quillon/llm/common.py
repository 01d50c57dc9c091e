"""What the training-data operators share: the cluster's shared folder, tables written to cut
lineage, file access from executors, and bounded slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Used where the session does not name a shared folder and all its tasks run in the driver's process.
LOCAL_SHARED = "/tmp/checkpoints"


def base_dir(spark: SparkSession) -> str:
    """This application's folder below the one all executors share; clear() removes it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/quillon/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one all executors share."""
    return f"{base_dir(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and what is read
    survives the loss of any executor. discard() removes the table again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._quillon_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables made by cut() that no DataFrame still to be computed reads."""
    for t in tables:
        _delete(t.sparkSession, t._quillon_path)


def clear(spark: SparkSession) -> None:
    """Removes everything this application's operators wrote to the shared folder: call it once their
    results are stored elsewhere."""
    _delete(spark, base_dir(spark))


def slices(
    batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, most_rows: int = 2000
) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches that hold at most most_bytes of a string or binary column
    (one longer value makes a slice of its own), so Python objects for a slice stay bounded."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def bound_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Has Spark hand texts to Python in Arrow batches of about most_bytes, unless the session asks for less. Its own
    bound (64 MB) is held several times over by each task: in the JVM, on its way and in the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("bB"))
    if now <= 0 or now > most_bytes:
        spark.conf.set(key, str(most_bytes))


def open_store(uri: str):
    """(pyarrow file system, path in it) of a folder that executors share."""
    from pyarrow import fs

    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path if scheme else uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def new_file(uri: str, name: str):
    """(name, output stream) of a new file in the shared folder. The name holds a fresh id, so a retried
    or speculative task never touches the file of another attempt; only names in a committed manifest
    count."""
    store, root = open_store(uri)
    store.create_dir(root, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    return name, store.open_output_stream(f"{root}/{name}")


def open_file(uri: str, name: str):
    """A seekable file of the shared folder."""
    store, root = open_store(uri)
    return store.open_input_file(f"{root}/{name}")


def spread(df: DataFrame, least: int = 1) -> DataFrame:
    """Deals a small table of tasks (one row is much work) evenly over all cores."""
    spark = df.sparkSession
    n = max(least, spark.sparkContext.defaultParallelism)
    return df.repartition(n)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 = 2, the rows no model learns from; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
