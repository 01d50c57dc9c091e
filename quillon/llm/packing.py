"""Packing tokenised documents into training windows by Karmarkar-Karp multiway differencing.

A document longer than a window is cut into full windows and a rest; the rests are dealt into groups
of bounded size by a hash, and each group is split into near-equal windows: the two partial
partitions with the largest imbalance are merged, largest load onto smallest, until one is left. If
its heaviest window exceeds the capacity, the rests are cut where that helps or the window count
rises by one and differencing starts over."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillon.llm import common
from quillon.llm.wordids import encoder

WINDOW = 4096
#: Rests a group holds on average: bounds a task's memory and the share of half-empty windows.
GROUP = 4096


def differencing(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp for k parts: the part of each size, and the parts' loads, heaviest first.

    A partial partition is kept as its non-zero loads in falling order, so merging costs what is
    filled, not k; the j-th largest load of one meets the j-th smallest of the other, which is an
    empty part until both together fill more than k."""
    n = len(sizes)
    load = np.asarray(sizes, dtype=np.int64)
    # nodes 0..n-1 are the items; a later node joins two earlier ones
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    nodes = n
    # (minus the imbalance, age, loads, nodes)
    heap = [(-int(s), i, load[i : i + 1], np.array([i])) for i, s in enumerate(load)]
    heapq.heapify(heap)
    age = n
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        if len(a) < len(b):
            a, ia, b, ib = b, ib, a, ia
        free = k - len(a)
        if len(b) > free:
            met = len(a) - 1 - np.arange(len(b) - free)
            joined = np.arange(nodes, nodes + len(met))
            left[joined], right[joined] = ia[met], ib[free:]
            nodes += len(met)
            a, ia = a.copy(), ia.copy()
            a[met] += b[free:]
            ia[met] = joined
            b, ib = b[:free], ib[:free]
        loads, ids = np.concatenate([a, b]), np.concatenate([ia, ib])
        rank = np.argsort(-loads, kind="stable")
        loads, ids = loads[rank], ids[rank]
        low = int(loads[-1]) if len(loads) == k else 0
        heapq.heappush(heap, (low - int(loads[0]), age, loads, ids))
        age += 1
    part = np.zeros(nodes, dtype=np.int64)
    out = np.zeros(k, dtype=np.int64)
    if heap:
        _, _, loads, ids = heap[0]
        out[: len(loads)] = loads
        part[ids] = np.arange(len(ids))
        for x in range(nodes - 1, n - 1, -1):
            part[left[x]] = part[right[x]] = part[x]
    return part[:n], out


def windows(sizes: list[int], capacity: int = WINDOW) -> tuple[np.ndarray, int]:
    """The window of each size, and how many there are. From the fewest windows that could hold the
    total, the count rises, by the imbalance just seen, while a window exceeds the capacity."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        part, loads = differencing(sizes, k)
        over = int(loads.max(initial=0)) - capacity
        if over <= 0:
            return part, k
        room = capacity - (int(loads.max()) - total / k)  # what a window may hold on average
        k = min(max(k + 1, int(np.ceil(total / max(1.0, room)))), max(len(sizes), k + 1))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece_key long"


def _pieces(path: str | None, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        key = TaskContext.get().partitionId() << 33
        for batch in common.slices(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = memoryview(ids)[4 * start : 4 * (start + window)]
                    row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), n, key)
                    for col, x in zip(out, row):
                        col.append(x)
                    key += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece_key"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Every document's tokens (its ids, then end_id) cut at multiples of the window. Null text is
    an empty document: the end id alone. Repeated rows are documents of their own."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end_id, window), PIECES)


def pack(cuts: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Gives each piece a sequence_id and its offset there.

    cuts has length and a unique piece_key; other columns are kept. Full pieces are windows by
    themselves. The rest are dealt by a hash of their unique key into groups of about `group`, so
    no key, source or document can make one group large, and only sizes are shuffled, never ids."""
    cuts = common.cut(cuts)
    full = cuts.where(F.col("length") >= window).select(
        *cuts.columns, (F.col("piece_key") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = cuts.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece_key", kind="stable").reset_index(drop=True)
        part, _ = windows(pdf["length"].tolist(), window)
        pdf["sequence_id"] = (pdf.pop("grp").astype("int64") * (1 << 32) + part) * 2
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.schema)
    placed = (
        rest.withColumn("grp", F.pmod(F.xxhash64("piece_key"), F.lit(groups)))
        .groupBy("grp")
        .applyInPandas(place, f"{schema}, sequence_id long, offset long")
    )
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """documents (doc_id, text, ...) to pieces with their place in a window; see pieces() and pack().
    An empty table gives no piece; other columns of docs play no part."""
    return pack(pieces(docs, tokenizer, end_id, window), window).drop("piece_key")
