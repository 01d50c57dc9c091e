"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. Behind them lie a skippable frame with the
record index (record id -> frame, offset in the decompressed frame, length) and, as the last frame,
the footer seek table of the public seekable format (compressed and decompressed size per frame), so
plain Zstandard tools decompress a bundle to a plain WARC file and one record costs one frame."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from functools import cached_property
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import common

#: Fixed values of the Zstandard frame and seekable formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
#: Decompressed bytes after which a frame ends; compressed bytes after which a bundle ends.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def record_id(page_id: int | None, digest: str) -> str:
    """The URN of a page's record; a revisit can name its response's without reading it."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}").urn


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """(record id, bytes) of a response, or of a revisit where refers_to is given."""
    digest = payload_digest(payload)
    name = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that begins at `at`."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) for line in lines)
    n = int(head["Content-Length"])
    return head, data[stop + 4 : stop + 4 + n], stop + 4 + n + 4


class BundleWriter:
    def __init__(self, out, level: int = 3):
        self.out, self.at = out, 0
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple] = []
        self.buffer = bytearray()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, page_id: int | None, data: bytes) -> None:
        self.index.append((name, page_id, len(self.frames), len(self.buffer), len(data)))
        self.buffer += data
        if len(self.buffer) >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.buffer:
            frame = self.compressor.compress(bytes(self.buffer))
            self.frames.append((len(frame), len(self.buffer)))
            self._put(frame)
            self.buffer.clear()

    def close(self) -> None:
        self._flush()
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, INDEX) as w:
            cols = list(zip(*self.index)) or [[]] * 5
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, INDEX)], schema=INDEX))
        index = self.compressor.compress(sink.getvalue())
        self._put(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<II", *f) for f in [*self.frames, (8 + len(index), 0)])
        table += FOOTER.pack(len(self.frames) + 1, 0, SEEKABLE)
        self._put(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class BundleReader:
    """Sequential and random access to a bundle (a seekable file)."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - FOOTER.size)
        n, _, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError("not a seekable bundle")
        file.seek(end - FOOTER.size - 8 * n)
        sizes = list(struct.iter_unpack("<II", file.read(8 * n)))
        self.starts, at = [], 0
        for size, _ in sizes:
            self.starts.append(at)
            at += size
        self.sizes, self.decompressor = sizes, zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        self.file.seek(self.starts[i])
        return self.decompressor.decompress(self.file.read(self.sizes[i][0]))

    def index(self) -> pa.Table:
        self.file.seek(self.starts[-1] + 8)
        return pa.ipc.open_stream(self.decompressor.decompress(self.file.read(self.sizes[-1][0] - 8))).read_all()

    def records(self) -> Iterator[tuple[str, int | None, int, int, int]]:
        """(record id, page id, frame, offset, length) of every record, in order."""
        return zip(*(self.index()[f.name].to_pylist() for f in INDEX))

    @cached_property
    def rows(self) -> dict[str, tuple[int, int, int]]:
        """Record id -> (frame, offset, length)."""
        return {r[0]: r[2:] for r in self.records()}

    def read(self, name: str) -> tuple[dict[str, str], bytes]:
        """One record by its id: a look-up in the index, then one frame."""
        frame, offset, length = self.rows[name]
        return at_offset(self.frame(frame), offset, length, name)


def at_offset(data: bytes, offset: int, length: int, name: str) -> tuple[dict[str, str], bytes]:
    """The record that the index says lies there; an error if another one does."""
    head, block, end = parse(data[offset : offset + length])
    if end != length or head["WARC-Record-ID"] != f"<{name}>":
        raise ValueError(f"the index is wrong about {name}")
    return head, block


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): null html is empty; refers_to is the smallest page_id among
    equal payloads of at least least_bytes, null for that page itself. Rows without a page_id refer
    to the smallest id there is, and are responses where there is none; rows that repeat the
    smallest id are all responses.

    Only digests that occur twice come back to the pages. Counts are combined before they are
    shuffled; a payload that a third of all pages share is a skewed key of a plain equi-join."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    shared = (
        rows.where(F.octet_length("html") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


MANIFEST = "name string, n_records long, bytes long"


def write_bundles(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes (page_id, url, html, refers_to) as bundles below folder; returns the manifest of the
    bundles of tasks that ended well, written to the shared folder. No other file counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, name, sink, writer = TaskContext.get().partitionId(), None, None, None

        def finish() -> pa.RecordBatch:
            writer.close()
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(writer.index)]), pa.array([writer.at])], names=["name", "n_records", "bytes"])

        for batch in common.slices(batches, "html"):
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if writer is None:
                    name, sink = common.new_file(folder, f"pages-{task:06d}")
                    writer = BundleWriter(sink)
                writer.add(*(lambda n, d, p=page_id: (n, p, d))(*record(page_id, url, html.encode(), refers_to, date)))
                if writer.at >= BUNDLE_BYTES:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return common.cut(records.mapInArrow(run, MANIFEST))


LOCATIONS = "record_id string, page_id long, bundle string, frame long, offset long, length long"


def locate(manifest: DataFrame, folder: str) -> DataFrame:
    """(record_id, page_id, bundle, frame, offset, length) of every record of the bundles in manifest, from
    their footers and record indices alone: the table that leads from an id to its bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with common.open_file(folder, name) as file:
                    found = BundleReader(file).index()
                for part in found.to_batches(max_chunksize=20_000):
                    cols = [part.column(0), part.column(1), pa.array([name] * part.num_rows), *part.columns[2:]]
                    yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in LOCATIONS.split(", ")])

    return common.cut(common.spread(manifest.select("name")).mapInArrow(run, LOCATIONS))


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, bundle string"
#: Compressed bytes that one task reads back, about.
READ_BYTES = 32 << 20


def read_records(locations: DataFrame, folder: str, tasks: int, keep_payload: bool = False) -> DataFrame:
    """A row per row of locations, read at its offset in its frame; a frame is decompressed once for all
    rows of it in a task, and no other frame is read. Rows are dealt by ranges of (bundle, frame), so
    one large bundle is read by many tasks. A response's payload must have the digest its header names.
    With keep_payload, the payload as well (null for revisits)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bundle = file = reader = frame = data = None
        number = lambda head, k: int(head[k]) if k in head else None
        try:
            for batch in batches:
                for name, at, offset, length, record_id_ in zip(*(c.to_pylist() for c in batch.columns)):
                    if name != bundle:
                        if file:
                            file.close()
                        file, frame = common.open_file(folder, name), None
                        bundle, reader = name, BundleReader(file)
                    if at != frame:
                        frame, data = at, reader.frame(at)
                    head, block = at_offset(data, offset, length, record_id_)
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"damaged record {record_id_} in {name}")
                    row = (number(head, "X-Page-ID"), size, digest, kind, number(head, "X-Refers-To-Page-ID"), record_id_, head["WARC-Target-URI"], name)
                    yield (*row, payload if kind == "response" else None) if keep_payload else row
        finally:
            if file:
                file.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.split() for f in schema.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        got = rows(batches)
        while held := list(islice(got, 200 if keep_payload else 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*held), fields)], names=[n for n, _ in fields])

    schema = RECORDS + ", payload binary" * keep_payload
    dealt = locations.select("bundle", "frame", "offset", "length", "record_id").repartitionByRange(tasks, "bundle", "frame")
    return dealt.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, schema)


def read_bundles(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the bundles in manifest, from the files alone: record ids and offsets by the
    bundles' indices, then the records at their offsets. The two must agree in number."""
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("n")).first()
    found = locate(manifest, folder)
    if found.count() != total.n:
        raise ValueError("the bundles' indices do not hold the records written")
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-total.bytes // READ_BYTES))
    return read_records(found, folder, tasks)


def lookup(locations: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """The records (with their payloads) of ids (record_id), by an equi-join with the locations; ids
    that no bundle has give no row, an id asked for twice comes once."""
    wanted = locations.join(ids.select("record_id").distinct(), "record_id", "left_semi")
    return read_records(wanted, folder, locations.sparkSession.sparkContext.defaultParallelism, keep_payload=True)


def archive(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html, ...) written as bundles and read back; see mark_revisits() for
    nulls, ties and repeated rows. An empty table gives no bundle and no row."""
    folder = common.shared_dir(spark)
    return read_bundles(write_bundles(mark_revisits(pages, least_bytes), folder), folder)
