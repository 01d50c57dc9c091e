"""Media columns: telephony audio.

A payload of bytes is stored as it is, as 8-bit mu-law or A-law samples or as IMA ADPCM blocks, in a
WAV file held by a binary column. Reading expands the two laws by lookup tables, decodes ADPCM with
numpy across all blocks of a slice at once, and resamples to 16-bit PCM at twice the rate through a
half-band filter. The PCM is a WAV file in a binary column of its own; `check_pcm` compares the stored
column with the features."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import common

RATE = 8000
#: Payloads are filled with zero bytes to a multiple of this, the ADPCM block size.
UNIT = 64
#: WAVE format tags, and the step and index tables of IMA ADPCM.
ALAW, MULAW, ADPCM = 6, 7, 0x11
NAMES = {ALAW: "alaw", MULAW: "mulaw", ADPCM: "ima_adpcm"}
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
    107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
    876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
    5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
    27086, 29794, 32767,
]
INDEX_MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def _mulaw_table() -> np.ndarray:
    b = ~np.arange(256) & 0xFF
    size = (((b & 0x0F) << 3) + 0x84 << (b >> 4 & 7)) - 0x84
    return np.where(b & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    b = np.arange(256) ^ 0x55
    part, low = b >> 4 & 7, (b & 0x0F) << 4
    size = np.where(part == 0, low + 8, low + 0x108 << np.maximum(part - 1, 0))
    return np.where(b & 0x80, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index and nibble: the change of the predictor, and the next step index times 16."""
    step, code = np.array(STEPS)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
    move = np.array(INDEX_MOVES * 2)[None, :]
    follow = np.clip(np.arange(len(STEPS))[:, None] + move, 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (follow * 16).astype(np.int32).ravel()


EXPAND = {MULAW: _mulaw_table(), ALAW: _alaw_table()}
CHANGE, FOLLOW = _adpcm_tables()
SAMPLES = 1 + 2 * (UNIT - 4)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, UNIT) bytes to (blocks, SAMPLES) 16-bit samples, one step for all blocks at a time.
    A block's header holds its first sample and its step index, taken within the table's range."""
    out = np.empty((SAMPLES, len(blocks)), np.int16)
    level = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out[0] = level
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(1, SAMPLES):
        byte = data[(i - 1) // 2]
        at = index + (byte & 15 if i % 2 else byte >> 4)
        level = np.clip(level + CHANGE[at], -32768, 32767)
        index = FOLLOW[at]
        out[i] = level
    return np.ascontiguousarray(out.T)


def wav(payload: bytes, kind: int, n_bytes: int) -> bytes:
    """A mono WAV file whose data chunk is the payload; a chunk of its own holds the unfilled size."""
    per_block, bits, extra = (UNIT, 4, struct.pack("<HH", 2, SAMPLES)) if kind == ADPCM else (1, 8, struct.pack("<H", 0))
    n = len(payload) // UNIT * SAMPLES if kind == ADPCM else len(payload)
    rate = RATE * UNIT // SAMPLES if kind == ADPCM else RATE
    fmt = struct.pack("<HHIIHH", kind, 1, RATE, rate, per_block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n)
    body += b"size" + struct.pack("<IQ", 8, n_bytes) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(body) + len(payload)) + body + payload


def parse_wav(data: bytes) -> tuple[int, int, memoryview]:
    """(format tag, unfilled size, data chunk) of a file by wav()."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, size = 12, 0, 0
    while at < len(data):
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind = int.from_bytes(data[at + 8 : at + 10], "little")
        elif name == b"size":
            size = int.from_bytes(data[at + 8 : at + 16], "little")
        elif name == b"data":
            return kind, size, memoryview(data)[at + 8 : at + 8 + n]
        at += 8 + n
    raise ValueError("no data chunk")


def pcm_wav(samples: np.ndarray, rate: int = 2 * RATE) -> bytes:
    """Samples as a 16-bit PCM WAV file."""
    data = samples.astype("<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data


def decode(files: list[tuple[int, memoryview]]) -> list[np.ndarray]:
    """The 16-bit samples of each (format tag, data): each law by one lookup over all its files,
    ADPCM over the blocks of all its files together."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(files)
    for kind in (MULAW, ALAW, ADPCM):
        which = [i for i, f in enumerate(files) if f[0] == kind]
        if not which:
            continue
        data = np.frombuffer(b"".join(files[i][1] for i in which), np.uint8)
        if kind == ADPCM:
            blocks = data.reshape(-1, UNIT)
            flat = np.concatenate([decode_adpcm(blocks[s : s + 20_000]).ravel() for s in range(0, len(blocks), 20_000)])
            sizes = [len(files[i][1]) // UNIT * SAMPLES for i in which]
        else:
            flat, sizes = EXPAND[kind][data], [len(files[i][1]) for i in which]
        for i, part in zip(which, np.split(flat, np.cumsum(sizes)[:-1])):
            out[i] = part
    return out


def _half_band(n: int = 8) -> np.ndarray:
    """2n coefficients of the sample half-way between two others: a sinc under a Hamming window, with a
    sum of one. At the samples themselves such a filter is the identity."""
    at = np.arange(2 * n) - n + 0.5
    taps = np.sinc(at) * (0.54 + 0.46 * np.cos(np.pi * at / n))
    return taps / taps.sum()


TAPS = _half_band()
#: Samples filtered at once.
SPAN = 1 << 20


def resample(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples, and between them those of the half-band filter, rounded and held
    within 16 bits. The first and the last sample are held beyond the ends."""
    wide = np.empty(2 * len(samples), np.int16)
    wide[::2] = samples
    if len(samples):
        n = len(TAPS) // 2
        held = np.pad(samples, (n - 1, n), mode="edge")
        for s in range(0, len(samples), SPAN):
            part = held[s : s + SPAN + 2 * n - 1].astype(np.float64)
            wide[1::2][s : s + SPAN] = np.clip(np.rint(np.convolve(part, TAPS, "valid")), -32768, 32767)
    return wide


def feature(kind: int, samples: np.ndarray, wide: np.ndarray) -> str:
    """Format, resampled samples, root mean square, peak and zero crossings of the samples, and the
    CRC-32 of the resampled PCM."""
    x = samples.astype(np.int64)
    rms = int(np.sqrt(np.dot(x, x) / max(1, len(x))))
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return f"{NAMES[kind]}:{len(wide)}:{rms}:{int(np.abs(x).max(initial=0))}:{crossings}:{zlib.crc32(wide.astype('<i2').tobytes()):08x}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media) of docs (doc_id, text, ...): each text's UTF-8 (null: empty), filled to a
    positive multiple of UNIT, as a WAV file; its CRC-32 picks one of the three formats, so equal
    texts give equal files. Other columns play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            media = []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                payload = data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")
                media.append(wav(payload, (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3], len(data)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def read(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the
    payload's last UNIT bytes), media_bytes, media_sha256, feature, and pcm, the resampled 16-bit PCM as a
    WAV file (up to 7.6 bytes for a byte of the payload; a value holds 2 GB at most, so payloads of over
    280 MB fail). An empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "media", most_bytes=2 << 20):
            files = batch.column(1).to_pylist()
            parsed = [parse_wav(f) for f in files]
            sounds = decode([(k, d) for k, _, d in parsed])
            wide = [resample(s) for s in sounds]
            cols = [
                batch.column(0),
                pa.array([n for _, n, _ in parsed], pa.int64()),
                pa.array([len(d) for _, _, d in parsed], pa.int64()),
                pa.array([hashlib.sha256(d).hexdigest() for _, _, d in parsed]),
                pa.array([zlib.crc32(d[-UNIT:]) for _, _, d in parsed], pa.int64()),
                pa.array([len(f) for f in files], pa.int64()),
                pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                pa.array([feature(k, s, w) for (k, _, _), s, w in zip(parsed, sounds, wide)]),
                pa.array(map(pcm_wav, wide), pa.binary()),
            ]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    return media.select("doc_id", "media").mapInArrow(run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores docs as media in the shared folder and reads them back; a row per row, repeated ones too.
    The resampled PCM is a column of the result: whoever writes the result stores it."""
    return read(common.cut(store(docs)))


def check_pcm(stored: DataFrame) -> DataFrame:
    """(doc_id, intact) of a stored result of read(): whether the PCM that is read back is a PCM file at
    twice the rate with as many samples and the CRC-32 that `feature` tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "pcm", most_bytes=16 << 20):
            intact = []
            for pcm, told in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                said = told.split(":")
                head = len(pcm) >= 44 and pcm[:4] == b"RIFF" and struct.unpack_from("<HHI", pcm, 20) == (1, 1, 2 * RATE)
                intact.append(head and len(pcm) - 44 == 2 * int(said[1]) and zlib.crc32(pcm[44:]) == int(said[5], 16))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(intact, pa.bool_())], names=["doc_id", "intact"])

    return stored.select("doc_id", "pcm", "feature").mapInArrow(run, "doc_id long, intact boolean")
