"""Byte-level BPE from a rank file, by a two-tier lookup.

A pre-token that is in the vocabulary as a whole is found by a minimal perfect hash over the
vocabulary. Any other is merged: a heap of adjacent pairs by (rank, position) over doubly linked
bytes, n log n for a pre-token of n bytes. What was resolved lately is remembered per worker."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from quillon.llm import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: White space as Unicode's White_Space has it; the regex library's \s has four controls more.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters of text above which a document is encoded part by part.
LONG = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str) -> regex.Pattern:
    """A pre-token pattern with \\s and \\S meaning Unicode's White_Space."""
    inside = regex.sub(r"\[([^\]]*)\]", lambda m: "[" + m[1].replace(r"\s", SPACE) + "]", pattern)
    return regex.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"), regex.V0)


class MinimalPerfectHash:
    """Hash and displace: keys fall into buckets; each bucket, largest first, gets the first
    displacement that sends its keys to free slots; a bucket of one takes a free slot directly.
    n keys fill n slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = len(keys)
        self.buckets = max(1, self.n // per_bucket)
        h = self.hashes(keys)
        if len(np.unique(h)) != self.n:
            raise ValueError("two keys have one hash")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        start = np.concatenate([[0], np.cumsum(size)])
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        taken = np.zeros(self.n, dtype=bool)
        for b in np.argsort(-size, kind="stable"):
            if size[b] < 2:
                break
            own = h[order[start[b] : start[b + 1]]]
            d = 0
            while True:
                # many displacements at a time
                slots = self._slots(own[None, :], np.arange(d, d + 64, dtype=np.uint64)[:, None])
                good = ~taken[slots].any(axis=1)
                for row in np.flatnonzero(good):
                    if len(set(slots[row].tolist())) == len(own):
                        break
                else:
                    d += 64
                    continue
                taken[slots[row]] = True
                self.shift[b] = d + row
                break
        free = np.flatnonzero(~taken)
        self.shift[np.flatnonzero(size == 1)] = -1 - free[: int((size == 1).sum())]
        self.slot_of = self.slots(h)

    @staticmethod
    def hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=np.uint64)

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return ((x * np.uint64(0x94D049BB133111EB) >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; that of a key not in the set is some key's."""
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._slots(h, np.maximum(d, 0).astype(np.uint64)))


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 1_000_000):
        self.split = splitter(pattern)
        self.bytes_of = dict(zip(ranks.values(), ranks))
        self.text_of = {r: str(r) for r in self.bytes_of}
        keys = list(ranks)
        self.table = MinimalPerfectHash(keys)
        self.slot_key: list[bytes] = [b""] * len(keys)
        self.slot_rank = [0] * len(keys)
        for slot, key in zip(self.table.slot_of.tolist(), keys):
            self.slot_key[slot], self.slot_rank[slot] = key, ranks[key]
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        #: (left rank, right rank) as one number -> rank of both together
        self.width = max(ranks.values()) + 1
        self.pair = {}
        for key, rank in ranks.items():
            for i in range(1, len(key)):
                left, right = ranks.get(key[:i]), ranks.get(key[i:])
                if left is not None and right is not None:
                    self.pair[left * self.width + right] = rank
        self.most, self.young, self.old = most // 2, {}, {}

    def merge(self, key: bytes) -> tuple[int, ...]:
        """Ranks of a pre-token that is not in the vocabulary."""
        n, width, rank_of = len(key), self.width, self.pair.get
        ids = [self.single[b] for b in key]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # a pair as rank * n + position: the lowest rank, leftmost first
        heap = []
        for i in range(n - 1):
            r = rank_of(ids[i] * width + ids[i + 1])
            if r is not None:
                heap.append(r * n + i)
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of(ids[i] * width + ids[j]) != r:
                continue  # one of the two was merged away meanwhile
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                s = rank_of(r * width + ids[k])
                if s is not None:
                    heappush(heap, s * n + i)
            h = before[i]
            if h >= 0:
                s = rank_of(ids[h] * width + r)
                if s is not None:
                    heappush(heap, s * n + h)
        return tuple([x for x in ids if x >= 0])

    def resolve(self, tokens: set[str]) -> dict[str, tuple[int, ...]]:
        """The ranks of each pre-token. Short ones are remembered."""
        young, old, long, new = self.young, self.old, [], []
        for t in tokens.difference(young):
            known = old.get(t)
            if known is None:
                new.append(t)
            else:
                young[t] = known
        keys = [t.encode("utf-8", "surrogatepass") for t in new]
        slots = self.table.slots(MinimalPerfectHash.hashes(keys)).tolist() if keys else []
        for t, key, slot in zip(new, keys, slots):
            young[t] = (self.slot_rank[slot],) if self.slot_key[slot] == key else self.merge(key)
            if len(key) > 64:
                long.append(t)
        self._long = long
        if len(young) > self.most:
            self.young, self.old = {}, young
        return young

    def forget_long(self) -> None:
        for t in self._long:
            self.young.pop(t, None)
            self.old.pop(t, None)

    def parts(self, text: str) -> Iterator[list[int]]:
        """The ranks of a text, in parts."""
        if len(text) <= LONG:
            yield from self.encode_many([text])
            return
        found = (m.group() for m in self.split.finditer(text))
        while tokens := list(islice(found, 1 << 16)):
            table = self.resolve(set(tokens))
            yield list(chain.from_iterable(map(table.__getitem__, tokens)))
            self.forget_long()

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        split = [self.split.findall(t) for t in texts]
        get = self.resolve(set(chain.from_iterable(split))).__getitem__
        out = [list(chain.from_iterable(map(get, tokens))) for tokens in split]
        self.forget_long()
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str | None = None, pattern: str | None = None) -> BytePairEncoder:
    """The worker's encoder; kept between tasks."""
    key = (path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(load_ranks(key[0]), key[1])
    return _ENCODERS[key]


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the
    decoded bytes) and, if wanted, ids of each document (doc_id, text, ...). Null and empty texts
    have no token; a row per row, repeated ones too; other columns play no part; an empty table gives
    an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        strings = bpe.text_of.__getitem__
        for batch in common.slices(batches, "text", most_bytes=2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            short = iter(bpe.encode_many([t for t in texts if len(t) <= LONG]))
            counts, hashes, decoded, kept = [], [], [], []
            for text in texts:
                n, all_ids, said, held = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in [next(short)] if len(text) <= LONG else bpe.parts(text):
                    if ids:
                        all_ids.update(("," * (n > 0) + ",".join(map(strings, ids))).encode())
                        said.update(bpe.decode(ids))
                        n += len(ids)
                        held += ids if keep_ids else ()
                counts.append(n)
                hashes.append(all_ids.hexdigest())
                decoded.append(said.hexdigest())
                kept.append(held)
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
