"""Operators that write files or bytes and read them back, and line dedup."""

import base64
import hashlib
import io
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

import public_tokenizers
from quillon.llm import bpe, common, line_dedup, media, queries, tokenbin, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- BPE --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys(library, monkeypatch):
    mine = bpe.encoder()
    rng = random.Random(1)
    odd = [chr(rng.randint(1, 0x2FFF)) for _ in range(300)] + list(" \n\t\x1c\x85\xa0  'stvd.,!?09abcABC漢字😀") * 8
    for _ in range(3000):
        t = "".join(rng.choices(odd, k=rng.randint(0, 60)))
        ids = mine.encode(t)
        assert ids == library.encode_ordinary(t) and mine.decode(ids) == t.encode()
    long = "".join(rng.choices("abcdefgh", k=20_000))
    assert mine.encode(long) == library.encode_ordinary(long)
    monkeypatch.setattr(bpe, "LONG", 100)
    assert mine.encode(long + " x" * 500) == library.encode_ordinary(long + " x" * 500)


def test_minimal_perfect_hash_is_minimal_and_perfect():
    keys = [f"key {i}".encode() for i in range(5003)]
    table = bpe.MinimalPerfectHash(keys)
    assert sorted(table.slot_of.tolist()) == list(range(5003))
    assert np.array_equal(table.slots(table.hashes(keys)), table.slot_of)


def test_bpe_query(spark, docs, library):
    df = docs.select("doc_id", "text", F.lit("x").alias("n_tokens")).unionByName(spark.createDataFrame([(9001, None, "x"), (9002, "", "x"), (9002, "", "x"), (None, "a", "x")], "doc_id long, text string, n_tokens string"))
    rows = df.collect()
    got = sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.encode_decode(df).collect())
    want = []
    for x in rows:
        ids = library.encode_ordinary(x.text or "")
        want.append((str(x.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_decode(df.limit(0)).count() == 0


# -- token shards -----------------------------------------------------------------------------


def test_token_shards(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(x.doc_id, x.text) for x in docs.collect()] + [(-5, "first"), (10**12, "last"), (7777, None), (7777, ""), (8888, "Wörter, und mehr. " * 30_000)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit(0)).repartition(5)
    got = tokenbin.token_shards(spark, df).orderBy("start").collect()
    assert [x.doc_id for x in got] == sorted(i for i, _ in rows)
    texts, start = dict(rows), 0
    for x in got:
        ids = np.array(tk.encode(texts[x.doc_id] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenbin.token_shards(spark, df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (3, "b c"), (None, "a")], "doc_id long, text string")
    got = tokenbin.token_shards(spark, nulls).orderBy("start").collect()
    assert [(x.doc_id, x.start) for x in got] == [(None, 0), (None, got[0].n_tokens), (3, 2 * got[0].n_tokens)]


def test_manifest_is_written_by_few_tasks(spark, tmp_path):
    """Many small shards: the manifest has a row for each, in no more files than there are cores."""
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        manifest = tokenbin.write_shards(df, str(tmp_path), b"")
        rows = manifest.orderBy("shard").collect()
        assert len(manifest.inputFiles()) <= spark.sparkContext.defaultParallelism < len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert sum(x.n_docs for x in rows) == 400 and len({x.name for x in rows}) == len(rows)
    at = 0
    for x in rows:
        assert x.base == at
        at += x.n_tokens
    got = tokenbin.read_shards(manifest, str(tmp_path), b"").orderBy("start").collect()
    assert [x.doc_id for x in got] == list(range(400))


def test_shard_random_access_and_dictionary_check(tmp_path):
    data = [np.arange(n) % 300 for n in (0, 1, 5000)]
    dictionary = tokenbin.train_dictionary([np.arange(i, i + 300).astype("<u2").tobytes() for i in range(300)], 4096)
    sink = io.BytesIO()
    writer = tokenbin.ShardWriter(sink, dictionary, 2)
    for i, ids in enumerate(data):
        writer.add(None if i == 0 else i, ids)
    writer.close()
    reader = tokenbin.ShardReader(io.BytesIO(sink.getvalue()), dictionary)
    assert all(np.array_equal(reader.document(i), d) for i, d in enumerate(data))
    assert [i for i, _ in reader] == [None, 1, 2]
    with pytest.raises(ValueError):
        tokenbin.ShardReader(io.BytesIO(sink.getvalue()), b"another")
    assert tokenbin.train_dictionary([]) == b""
    assert [np.array_equal(x, data[2]) for x in reader.find(2)] == [True] and len(reader.find(None)) == 1 and reader.find(99) == []
    with pytest.raises(ValueError):
        tokenbin.ShardWriter(io.BytesIO(), dictionary, 2).add(1, np.array([70_000]))
    wide = tokenbin.ShardWriter(sink := io.BytesIO(), b"", 4)
    wide.add(1, np.array([70_000]))
    wide.close()
    assert tokenbin.ShardReader(io.BytesIO(sink.getvalue()), b"").document(0).tolist() == [70_000]


# -- WARC -------------------------------------------------------------------------------------


def test_archive(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    extra = [(-1, "http://a/\r\nX: y", "same"), (50_000, None, "same"), (50_001, "u", "same"), (50_002, "u", None), (50_003, "u", ""), (None, "u", "same"), (50_004, "u", "é\r\n\r\nWARC/1.1"), (50_005, "u", "alone"), (50_005, "u", "alone")]
    df = pages.unionByName(spark.createDataFrame(extra, pages.schema)).withColumn("digest", F.lit("x"))
    rows = df.collect()
    got = warc.archive(spark, df).collect()
    first = {}
    for x in rows:
        if x.page_id is not None:
            first[x.html or ""] = min(first.get(x.html or "", x.page_id), x.page_id)
    want = []
    for x in rows:
        data = (x.html or "").encode()
        refers = first[x.html or ""] if first[x.html or ""] != x.page_id else None
        want.append((x.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    assert sorted(map(str, want)) == sorted(str((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to)) for x in got)
    assert warc.archive(spark, df.limit(0)).count() == 0
    assert {x.record_type for x in warc.archive(spark, df.where("html = 'same'"), least_bytes=5).collect()} == {"response"}


def test_records_are_read_through_index_and_offsets(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 20_000)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    big = spark.createDataFrame([(70_000, "u", "".join(random.Random(7).choices("abcdefgh <>", k=700_000))), (70_001, None, "")], pages.schema)
    pages = pages.unionByName(big)
    folder = common.shared_dir(spark)
    manifest = warc.write_bundles(warc.mark_revisits(pages.select("page_id", "url", "html")), folder)
    assert manifest.count() >= 2
    places = warc.locate(manifest, folder)
    assert places.count() == pages.count() and places.where("offset > 0").count() > 0
    some = pages.where("page_id % 7 = 0 or page_id >= 70000").select("page_id", "html").collect()
    asked = spark.createDataFrame([(warc.record_id(x.page_id, warc.payload_digest((x.html or "").encode())),) for x in some] * 2 + [("urn:uuid:none",)], "record_id string")
    got = {x.page_id: x for x in warc.lookup(places, asked, folder).collect()}
    assert set(got) == {x.page_id for x in some}
    assert all(got[x.page_id].payload in ((x.html or "").encode(), None) and (got[x.page_id].payload is None) == (got[x.page_id].record_type == "revisit") for x in some)
    # an index that is wrong by a byte or an id is an error
    for wrong in (places.withColumn("offset", F.col("offset") + 1), places.withColumn("length", F.col("length") - 1), places.withColumn("record_id", F.lit("urn:uuid:other"))):
        with pytest.raises(Exception):
            warc.read_records(wrong, folder, 2).count()


def test_corrupted_bundle_is_an_error():
    sink = io.BytesIO()
    writer = warc.BundleWriter(sink)
    name, data = warc.record(1, "http://x/1", b"payload", None, "2024-01-01T00:00:00Z")
    writer.add(name, 1, data)
    writer.close()
    raw = bytearray(sink.getvalue())
    assert warc.BundleReader(io.BytesIO(bytes(raw))).read(name)[1].endswith(b"payload")
    with pytest.raises(KeyError):
        warc.BundleReader(io.BytesIO(bytes(raw))).read("urn:uuid:none")
    at = raw.index(struct.pack("<I", warc.SKIPPABLE_INDEX)) + 30
    raw[at] ^= 0xFF
    with pytest.raises(Exception):
        warc.BundleReader(io.BytesIO(bytes(raw))).read(name)


def test_bundle_is_seekable_and_plain_zstandard(monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 3000)
    sink = io.BytesIO()
    writer = warc.BundleWriter(sink)
    records = [warc.record(i, f"http://x/{i}", bytes([65 + i % 26]) * i * 10, 3 if i == 7 else None, "2024-01-01T00:00:00Z") for i in range(60)]
    for i, (name, data) in enumerate(records):
        writer.add(name, i, data)
    writer.close()
    raw = sink.getvalue()
    reader = warc.BundleReader(io.BytesIO(raw))
    assert len(reader.starts) > 5
    head, block = reader.read(records[31][0])
    assert head["X-Page-ID"] == "31" and block.endswith(b"F" * 310)
    assert reader.read(records[7][0])[0]["WARC-Refers-To"] == f"<{warc.record_id(3, warc.payload_digest(bytes([72]) * 70))}>"
    plain, at = b"", zstandard.ZstdDecompressor()
    with at.stream_reader(io.BytesIO(raw), read_across_frames=True) as f:
        plain = f.read()
    assert plain == b"".join(d for _, d in records)


# -- media ------------------------------------------------------------------------------------


def plain_adpcm(block):
    level, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [level]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = media.STEPS[index]
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            level = max(-32768, min(32767, level - change if code & 8 else level + change))
            index = max(0, min(88, index + media.INDEX_MOVES[code & 7]))
            out.append(level)
    return out


def test_codecs():
    assert len(media.STEPS) == 89
    assert media.EXPAND[media.MULAW][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert media.EXPAND[media.ALAW][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    blocks = np.frombuffer(random.Random(3).randbytes(64 * 40), np.uint8).reshape(-1, 64)
    assert media.decode_adpcm(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]


def plain_mulaw(b):
    b = ~b & 0xFF
    size = ((2 * (b & 15) + 33) << (b >> 4 & 7)) - 33
    return -4 * size if b & 0x80 else 4 * size


def plain_alaw(b):
    b ^= 0x55
    part, low = b >> 4 & 7, 2 * (b & 15) + 1
    size = 8 * low if part == 0 else 8 * (low + 32) << part - 1
    return size if b & 0x80 else -size


def plain_resample(x):
    out = []
    at = lambda i: x[min(max(i, 0), len(x) - 1)]
    for i in range(len(x)):
        out += [x[i], max(-32768, min(32767, int(np.rint(sum(c * at(i + 8 - k) for k, c in enumerate(media.TAPS))))))]
    return out


def test_features_by_hand(spark):
    """media_bytes, media_sha256, feature and PCM against plain loops over the payload."""
    texts = ["", "a", "Ein Text, der länger ist. " * 9, "zz" * 64, "漢字😀" * 30, "0123456789" * 7, "~\x7f\n" * 33, *(f"text {i}" for i in range(6))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = set()
    for x in media.round_trip(df).collect():
        data = texts[x.doc_id].encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        kind = (media.MULAW, media.ALAW, media.ADPCM)[zlib.crc32(payload) % 3]
        kinds.add(kind)
        if kind == media.ADPCM:
            samples = [v for i in range(0, len(payload), 64) for v in plain_adpcm(payload[i : i + 64])]
        else:
            samples = [(plain_mulaw if kind == media.MULAW else plain_alaw)(b) for b in payload]
        wide = plain_resample(samples)
        pcm = b"".join(v.to_bytes(2, "little", signed=True) for v in wide)
        rms = int((sum(v * v for v in samples) / len(samples)) ** 0.5)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
        assert x.feature == f"{media.NAMES[kind]}:{len(wide)}:{rms}:{max(map(abs, samples))}:{crossings}:{zlib.crc32(pcm):08x}"
        assert x.pcm[44:] == pcm and x.pcm == media.pcm_wav(np.array(wide, np.int16))
        stored = media.wav(payload, kind, len(data))
        assert (x.media_bytes, x.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.parse_wav(stored)[:2] == (kind, len(data)) and stored.endswith(payload)
    assert len(kinds) == 3


def test_resampling_keeps_tones_and_long_texts(monkeypatch):
    """A tone below the old band's edge keeps its shape; parts of a long sound join without a seam."""
    t = np.arange(4000)
    for hz in (200, 1000, 3000):
        tone = np.rint(20_000 * np.sin(2 * np.pi * hz * t / media.RATE)).astype(np.int16)
        want = 20_000 * np.sin(2 * np.pi * hz * np.arange(8000) / (2 * media.RATE))
        assert np.abs(media.resample(tone) - want)[40:-40].max() < 20_000 * 0.02
    loud = np.random.default_rng(0).integers(-32768, 32767, 5000).astype(np.int16)
    whole = media.resample(loud)
    monkeypatch.setattr(media, "SPAN", 333)
    assert np.array_equal(media.resample(loud), whole) and len(media.resample(loud[:0])) == 0


def test_corrupted_pcm_is_told(spark, docs, tmp_path):
    path = f"{tmp_path}/stored"
    media.round_trip(docs.limit(50)).write.parquet(path)
    stored = spark.read.parquet(path)
    assert {x.intact for x in media.check_pcm(stored).collect()} == {True}
    bad = stored.withColumn("pcm", F.expr("unhex(concat(substring(hex(pcm), 1, 100), case substring(hex(pcm), 101, 2) when '00' then '01' else '00' end, substring(hex(pcm), 103)))"))
    assert {x.intact for x in media.check_pcm(bad).collect()} == {False}
    assert media.check_pcm(stored.limit(0)).count() == 0


def test_media_round_trip(spark, docs):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "x" * 64), (9004, "x" * 65), (9005, "é" * 200_000), (9003, "x" * 64)], "doc_id long, text string")).withColumn("media", F.lit(b"x"))
    rows = df.collect()
    got = media.round_trip(df).collect()
    want = []
    for x in rows:
        data = (x.text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        want.append((x.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(want) == sorted((x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in got)
    assert len({(x.media_sha256, x.feature) for x in got if x.doc_id in (9001, 9002)}) == 1
    assert all(x.pcm[:4] == b"RIFF" and x.media_bytes > x.payload_bytes for x in got)
    assert media.round_trip(df.limit(0)).count() == 0


# -- line dedup -------------------------------------------------------------------------------


def test_line_dedup_equals_sql(spark):
    got = queries.op4_line_dedup(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(line_dedup.SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want) and got.n_removed.sum() > 0


def test_line_dedup_by_hand(spark):
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\n a \nb\n\nc\nd\ny"), (3, "a\nb"), (4, "a\nb"), (5, None), (6, ""), (7, "r\nr\nr\nr"),
        (8, "one"), (9, "one\n\n"), (10, "a\nb\nz"), (None, "q\nw\ne"), (11, "q\nw\ne\n"), (12, "m\nn\no"), (12, "m\nn\no"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("s", F.lit(2))
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "spans", "s", "n_lines", "n_removed"]
    got = sorted((str(x.doc_id), x.text, x.n_removed) for x in out.collect())
    want = [
        ("1", "a\nb\nc\nd", 0), ("2", "x\ny", 5), ("3", "a\nb", 0), ("4", "", 2), ("5", None, 0), ("6", "", 0), ("7", "r", 3), ("8", "one", 0),
        ("9", "\n", 1), ("10", "a\nb\nz", 0), ("None", "q\nw\ne", 0), ("11", "", 3), ("12", "m\nn\no", 0), ("12", "m\nn\no", 0),
    ]
    assert got == sorted(want)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_merges_long_passages(spark):
    passage = "\n".join(f"line {i}" for i in range(3000))
    df = spark.createDataFrame([(1, passage), (2, f"head\n{passage}\ntail")], "doc_id long, text string")
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()}[2] == "head\ntail"


# -- shared helpers and the pipeline ----------------------------------------------------------


def test_slices_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 5, 50, 1, 1)] + [None])], names=["text"])
    assert [s.num_rows for s in common.slices([batch], "text", most_bytes=10)] == [2, 1, 3]
    assert list(common.slices([batch.slice(0, 0)], "text")) == []


def test_shared_tables_are_removed(spark):
    import os

    a, b = common.cut(spark.range(3)), common.cut(spark.range(4))
    common.discard(a)
    assert not os.path.exists(a._quillon_path) and os.path.exists(b._quillon_path) and b.count() == 4


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["language_id", "toxicity", "line_dedup", "simhash_near_dedup", "packing"]
    extra = spark.createDataFrame([(90_001, "12 34 !!", "en", "s", 8), (90_002, None, "en", "s", None)], docs.schema)
    wide = docs.unionByName(extra).withColumn("score", F.lit(0.5)).withColumn("n_lines", F.lit(1))
    before = wide
    for name, stage in c.STAGES:
        after = common.cut(stage(spark, before, SF))
        if name != "packing":
            assert after.columns == wide.columns and after.count() <= before.count()
        if name == "language_id":
            assert before.count() - after.count() == 2
        if name == "simhash_near_dedup":
            assert after.where("text is not null").select("text").distinct().count() == after.count()
        before, last = after, before
    assert before.select("doc_id").distinct().count() == last.count()
    assert c.run(spark, SF).count() > 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Stage by stage: an empty table, rows that are there twice, and a table whose every row is rejected."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.limit(0)
    letterless = docs.withColumn("text", F.lit("12 34 !!"))
    for name, stage in c.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
    assert c.STAGES[0][1](spark, letterless, SF).count() == 0
    once, twice = docs.limit(60), docs.limit(60)
    twice = twice.unionByName(once)
    before = twice
    for name, stage in c.STAGES[:4]:
        before = common.cut(stage(spark, before, SF))
    assert before.count() == before.distinct().count() == before.select("doc_id").distinct().count() > 0
    assert before.select("doc_id").join(once, "doc_id", "left_anti").count() == 0
    packed = c.STAGES[4][1](spark, before, SF)
    assert packed.select("doc_id").distinct().count() == before.count()
    for table in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
