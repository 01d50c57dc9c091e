"""Token-id shards: every document's ids compressed by themselves with one shared zstandard
dictionary, so a short document can be read alone.

Shard file: MAGIC; the documents' zstandard frames; an Arrow IPC stream with doc_id, offset, size and
n_tokens of each; then a footer of fixed length: index offset, index size, bytes per id, the
dictionary's SHA-256, MAGIC. The dictionary is a file of its own in the same folder, named by its
hash. Shards and their rows are in ascending doc_id order (null first; equal ids in input order)."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.llm import common
from quillon.llm.wordids import encoder

MAGIC = b"QTOKSHD1"
FOOTER = struct.Struct("<QQI32s8s")
#: Fitting the dictionary only: documents looked at on average, bytes of each, bytes of the dictionary.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1200, 8192, 64 << 10
#: Compressed bytes after which a task begins another shard.
SHARD_BYTES = 64 << 20
INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64())])


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or raw content where there are too few samples to train one."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class ShardWriter:
    """One shard, written front to back."""

    def __init__(self, out, dictionary: bytes, width: int):
        self.out, self.width, self.hash = out, width, hashlib.sha256(dictionary).digest()
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_content_size=True)
        self.rows: list[tuple] = []
        self.at = self.tokens = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {int(ids.max())} does not fit {self.width} bytes")
        frame = self.compressor.compress(ids.astype(f"<u{self.width}").tobytes())
        self.rows.append((doc_id, self.at, len(frame), len(ids)))
        self.tokens += len(ids)
        self._put(frame)

    def close(self) -> None:
        cols = list(zip(*self.rows)) or [[], [], [], []]
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, INDEX) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=INDEX))
        index, at = sink.getvalue(), self.at
        self._put(index)
        self._put(FOOTER.pack(at, len(index), self.width, self.hash, MAGIC))


class ShardReader:
    """Random and sequential access to one shard (a seekable file)."""

    def __init__(self, file, dictionary: bytes):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - FOOTER.size)
        at, size, self.width, digest, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        file.seek(at)
        self.index = pa.ipc.open_stream(file.read(size)).read_all()

    def document(self, row: int) -> np.ndarray:
        """The ids of the row-th document, reading its frame alone."""
        self.file.seek(self.index["offset"][row].as_py())
        return self._ids(self.file.read(self.index["size"][row].as_py()))

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that id, by the sorted index."""
        ids = self.index["doc_id"]
        if doc_id is None:
            return [self.document(row) for row in range(ids.null_count)]
        known = ids.combine_chunks().drop_null().to_numpy()
        low, high = np.searchsorted(known, [doc_id, doc_id + 1])
        return [self.document(ids.null_count + row) for row in range(low, high)]

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.decompressor.decompress(frame), dtype=f"<u{self.width}")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in order; frames lie behind one another."""
        self.file.seek(len(MAGIC))
        for doc_id, size in zip(self.index["doc_id"].to_pylist(), self.index["size"].to_pylist()):
            yield doc_id, self._ids(self.file.read(size))


def _sample(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            out = []
            for ids in encoder(path).encode(batch.column(0).to_pylist()):
                # a slice from anywhere in the whole document
                ids, most = np.frombuffer(ids, "<u4").astype("<u2"), SAMPLE_BYTES // 2
                at = zlib.crc32(ids.tobytes()) % max(1, len(ids) - most + 1)
                out.append(ids[at : at + most].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return run


def fit_dictionary(docs: DataFrame, tokenizer: str | None = None) -> bytes:
    """A dictionary from about SAMPLE_DOCS documents picked by a hash of their whole text, of equal texts
    one. It affects the shards' size only, never what they hold."""
    texts = docs.select("text", F.xxhash64("text").alias("h")).where("text is not null")
    step = max(1, -(-texts.count() // SAMPLE_DOCS))
    picked = texts.where(F.pmod("h", F.lit(step)) == 0).groupBy("h").agg(F.min("text").alias("text"))
    rows = picked.select("text").mapInArrow(_sample(tokenizer), "ids binary").collect()
    return train_dictionary(sorted(bytes(r.ids) for r in rows))


MANIFEST = "shard long, part long, name string, n_docs long, n_tokens long, bytes long"


def _write(folder: str, dictionary: bytes, path: str | None, end_id: int, width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4")
        name = sink = writer = None

        def finish() -> pa.RecordBatch:
            writer.close()
            sink.close()
            row = [[shard], [part], [name], [len(writer.rows)], [writer.tokens], [writer.at]]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["shard", "part", "name", "n_docs", "n_tokens", "bytes"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=names)

        for batch in common.slices(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(texts)):
                if writer is None:
                    name, sink = common.new_file(folder, f"shard-{shard:06d}-{part:04d}")
                    writer = ShardWriter(sink, dictionary, width)
                writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
            if writer is not None and writer.at >= most:
                yield finish()
                part, writer = part + 1, None
        if writer is not None:
            yield finish()

    return run


def write_shards(docs: DataFrame, folder: str, dictionary: bytes, tokenizer: str | None = None, end_id: int = 1, width: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes docs, writes them as shards below folder and returns the committed manifest with
    `base`, the number of ids in all shards before.

    Rows are dealt by ranges of (doc_id, input position): the position breaks ties, so a doc_id that
    a third of all rows share is still split over tasks. Files of lost attempts are in no manifest."""
    store = common.open_store(folder)
    store[0].create_dir(store[1], recursive=True)
    name = f"dictionary-{hashlib.sha256(dictionary).hexdigest()}"
    with store[0].open_output_stream(f"{store[1]}/{name}") as out:
        out.write(dictionary)
    rows = docs.select("doc_id", "text").withColumn("at", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at")
    written = rows.select("doc_id", "text").mapInArrow(_write(folder, dictionary, tokenizer, end_id, width, shard_bytes), MANIFEST)
    manifest = common.cut(_few_files(written))
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _few_files(written: DataFrame) -> DataFrame:
    """The rows of a manifest in as many tasks as there are cores, not a file for each task that wrote a shard. They
    are dealt by shard, so a retried task's rows, which name other files, take the place of the lost ones."""
    spark = written.sparkSession
    cores = spark.sparkContext.defaultParallelism
    dealt = max(cores + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return written.repartition(dealt, "shard").coalesce(cores)


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, row long"


def _read(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with common.open_file(folder, name) as file:
                    yield from _documents(ShardReader(file, dictionary), name, base)

    return run


def _documents(reader: ShardReader, name: str, base: int, most: int = 10_000) -> Iterable[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "row"]
    types = [pa.int64()] * 4 + [pa.string(), pa.int64()]
    out: list[tuple] = []
    for row, (doc_id, ids) in enumerate(reader):
        out.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name, row))
        base += len(ids)
        if len(out) == most or row == reader.index.num_rows - 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out = []


def read_shards(manifest: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """A row per document of the shards in manifest, from the files alone."""
    return common.spread(manifest.select("name", "base")).mapInArrow(_read(folder, dictionary), DOCUMENTS)


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """documents (doc_id, text, ...) written as token shards and read back: doc_id, start (ids of all
    documents before), n_tokens, ids_crc32, shard and row. Null text is an empty document (the end id
    alone); null ids come first; an empty table gives no row; other columns play no part."""
    common.bound_batches(spark)
    folder, dictionary = common.shared_dir(spark), fit_dictionary(docs, tokenizer)
    return read_shards(write_shards(docs, folder, dictionary, tokenizer, end_id), folder, dictionary)
