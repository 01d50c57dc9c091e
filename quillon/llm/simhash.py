"""SimHash near-duplicates under the generalised pigeonhole principle.

64-bit fingerprints of word shingles link at a bounded Hamming distance. Correlated bits are grouped
into partitions; a dynamic programme gives each partition its own threshold, so that the estimated
cost of candidates and probes is least and no pair within the distance can miss every partition.
Fingerprints that meet in a partition's bucket are verified; only a spanning forest of the verified
links leaves a task.

`deduplicate` decides by the exact Jaccard similarity of shingle sets. SimHash links and MinHash bands
only propose: proposals make components, and the sets of a component are compared whole."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillon.llm import common
from quillon.llm.components import components

SEED = 42
#: A bucket with more rows is split into blocks of about this size; blocks are compared in pairs.
BLOCK = 32_768
#: Split buckets are told by a broadcast up to this many of them, by a join beyond.
BROADCAST_BUCKETS = 50_000
#: Rows of the bucket stream compared at once.
RUN_ROWS = 100_000
#: Estimated seconds for a probe row (made, dealt, sorted) and for a pair compared.
ROW_COST, PAIR_COST = 3e-6, 4e-9
#: Thresholds that need more probe rows a fingerprint than this are not considered.
MOST_PROBES = 50_000
#: Runs of at least so many rows are compared as matrices of so many rows at a time.
DENSE, CHUNK = 48, 128
#: Pairs whose sketches are compared at once.
PAIRS = 1 << 18
#: Sketch of the shingles for verifying a similarity: smallest hash in each of 16 ranges, 8 bits each.
BINS = 16
#: MinHash of the shingle sets: BANDS bands of ROWS values. Sets with 0.8 in common share no band in 2 of
#: 10,000 cases. Of the BANDS * ROWS values, kept as a byte each, AGREE must agree; at 0.8 they do so but
#: in about 1 of 10,000 cases.
BANDS, ROWS, AGREE = 16, 4, 0.6
#: Shingle sets of a component with more bytes, or of more sets, are split into blocks of about so many.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1024
#: Components of more sets are compared with one of their sets first, in parts of about so many.
FEW, PART = 64, 4096

_MULTIPLY, _COMBINE = (np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(k))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(words) - k + 1)


def _shingle_hashes(text: str | None, k: int, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The hashes of a whole text's shingles; texts over `most` bytes are read through in parts."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= most:
        yield _hashes(data.split(), k)
        return
    found, words, any_yet = (m.group() for m in _WORD.finditer(data)), [], False
    while more := list(islice(found, 1 << 16)):
        words = words[len(words) - k + 1 :] + more if words else more
        if len(words) >= k:
            any_yet = True
            yield _hashes(words, k)
    if not any_yet:
        yield _hashes(words, k)


def _sketch(h: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The smallest hash in each range of the first four bits, given those of earlier parts."""
    h = np.sort(h)
    at = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(60))
    found = np.where(at < len(h), h[np.minimum(at, len(h) - 1)], np.uint64(0)) if len(h) else np.zeros(BINS, np.uint64)
    inside = (at < len(h)) & (found >> np.uint64(60) == np.arange(BINS, dtype=np.uint64))
    return np.minimum(low, np.where(inside, found, np.uint64(2**64 - 1)))


def fingerprint(text: str | None, k: int = 4, sketch: bool = False, most: int = 1 << 20) -> tuple[int, bytes]:
    """The SimHash of a whole text, and a sketch of its shingles if wanted: A-Z lower-cased, words
    between ASCII white space, k-word shingles with repeats (fewer words: all of them as one; none:
    zero). A bit is set if more than half the shingles' hashes have it."""
    n, total, low = 0, np.zeros(64, dtype=np.int64), np.full(BINS, 2**64 - 1, dtype=np.uint64)
    for h in _shingle_hashes(text, k, most):
        n, total = n + len(h), total + _bits(h)
        if sketch:
            low = _sketch(h, low)
    full = low < np.uint64(2**64 - 1)
    small = np.where(full, 1 + low % np.uint64(255), np.uint64(0)).astype(np.uint8).tobytes() if sketch else b""
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0]), small


def fingerprints(docs: DataFrame, k: int = 4, sketch: bool = False) -> DataFrame:
    """(doc_id, text_hash, fp, sketch) of each row; text_hash tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            fps, small = zip(*(fingerprint(t, k, sketch) for t in batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(small, pa.binary())], names=["doc_id", "text_hash", "fp", "sketch"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, sketch binary")


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The different hashes of a whole text's shingles, sorted."""
    return np.unique(np.concatenate([np.unique(h) for h in _shingle_hashes(text, k)]))


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of a shingle set under each of BANDS * ROWS multipliers."""
    low = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[i : i + 2048, None] * _MULTIPLY[None, :]).min(axis=0))
    return low


def shapes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, fp, sketch, node, bands, values) of each row: node stands for the whole
    shingle set, bands are its MinHash bucket keys (none without shingles), values a byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            texts = batch.column(2).to_pylist()
            fps, small = zip(*(fingerprint(t, k, True) for t in texts))
            sets = [shingle_set(t, k) for t in texts]
            low = np.array([minhash(h) for h in sets]).reshape(-1, BANDS * ROWS)
            keys = (low * _COMBINE[None, :]).reshape(-1, BANDS, ROWS).sum(axis=2, dtype=np.uint64).view(np.int64)
            values = (1 + low % np.uint64(255)).astype(np.uint8)
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], dtype=np.uint64).view(np.int64)
            cols = [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(small, pa.binary()), pa.array(node)]
            cols += [pa.array([x if len(h) else [] for x, h in zip(keys, sets)], pa.list_(pa.int64())), pa.array([x.tobytes() for x in values], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "fp", "sketch", "node", "bands", "values"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, sketch binary, node long, bands array<long>, values binary")


# -- the plan ---------------------------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each two bits are both set: over all of
    them, 64 x 64 numbers per task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65), dtype=np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(0, len(fp), 1 << 15):
                x = np.unpackbits(fp[i : i + (1 << 15)].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                x = np.hstack([x, np.ones((len(x), 1), np.uint8)]).astype(np.float32)
                total += (x.T @ x).astype(np.int64)
        i, j = np.triu_indices(65)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((65, 65))
    for r in rows:
        both[r.i, r.j] = both[r.j, r.i] = r.n
    return int(both[64, 64]), both


def _group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size: each starts at the bit most correlated with what is left and
    takes, one by one, the bit most correlated with the group."""
    left, groups = set(range(64)), []
    for g in range(m):
        size = 64 // m + (g < 64 % m)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].sum() - corr[b, b], -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _within(both: np.ndarray, group: list[int]) -> np.ndarray:
    """P(two fingerprints differ in at most t of the group's bits), t = 0, 1, ...: a beta-binomial
    with the mean and variance that the bits' frequencies and pairwise counts give exactly."""
    n, w = max(1.0, both[64, 64]), len(group)
    p1 = both[group, 64] / n
    p11 = both[np.ix_(group, group)] / n
    p10, p01 = p1[:, None] - p11, p1[None, :] - p11
    p00 = 1 - p1[:, None] - p1[None, :] + p11
    joint = 2 * (p11 * p00 + p10 * p01)
    q = 2 * p1 * (1 - p1)
    mean, var = q.sum(), (joint - q[:, None] * q[None, :]).sum()
    mu = min(max(mean / w, 1e-6), 1 - 1e-6)
    rho = min(max((var / (w * mu * (1 - mu)) - 1) / max(1, w - 1), 1e-6), 1 - 1e-6)
    a, b = mu * (1 - rho) / rho, (1 - mu) * (1 - rho) / rho
    from math import comb, exp, lgamma

    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    pmf = [comb(w, d) * exp(beta(d + a, w - d + b) - beta(a, b)) for d in range(w + 1)]
    return np.minimum(1.0, np.cumsum(pmf))


def plan(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, thresholds summing with one per partition
    to distance + 1. For each number of partitions, dynamic programming over the partitions finds
    the thresholds (-1: left out) with the least estimated cost of probe rows and candidate pairs."""
    from math import comb

    n = max(n, 2)  # a plan for no fingerprints costs nothing whatever it is
    freq = both[:64, 64] / max(1, n)
    cov = both[:64, :64] / max(1, n) - np.outer(freq, freq)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    best = (np.inf, [])
    for m in range(1, min(distance + 1, 16) + 1):
        groups = _group_bits(corr, m)
        state = {0: (0.0, [])}  # threshold units spent -> cost, thresholds so far
        for group in groups:
            near, after = _within(both, group), {}
            for spent, (cost, chosen) in state.items():
                for t in range(-1, min(distance - spent, len(group) - 1) + 1):
                    probes = 0 if t < 0 else 1 if t == 0 else 1 + sum(comb(len(group), d) for d in range(t + 1))
                    if probes > MOST_PROBES:
                        continue
                    pairs = 0 if t < 0 else n * n / 2 * near[t]
                    # rows of a bucket over BLOCK go to as many groups as it has blocks
                    copies = max(1.0, n * near[0] * probes / BLOCK)
                    c = cost + n * probes * copies * ROW_COST + pairs * PAIR_COST
                    if c < after.get(spent + t + 1, (np.inf,))[0]:
                        after[spent + t + 1] = (c, [*chosen, t])
            state = after
        if distance + 1 in state and state[distance + 1][0] < best[0]:
            best = (state[distance + 1][0], [(g, t) for g, t in zip(groups, state[distance + 1][1]) if t >= 0])
    return best[1]


# -- probe and verify -------------------------------------------------------------------------


def _masks(bits: list[int], t: int) -> np.ndarray:
    """All ways to flip up to t of the bits."""
    return np.array([sum(1 << b for b in c) for d in range(t + 1) for c in combinations(bits, d)], dtype=np.uint64)


def probes(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(grp, key, fp, sketch, probe): each fingerprint once in its bucket of each partition; with a
    threshold above 0 also as a probe in every bucket that its partition's bits reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = [(g, np.uint64(sum(1 << b for b in bits)), _masks(bits, t) if t else None) for g, (bits, t) in enumerate(parts)]
        for batch in batches:
            fp, small = batch.column(0).to_numpy().astype(np.int64).view(np.uint64), batch.column(1)
            for g, mask, flips in plans:
                own = fp & mask
                yield rows(g, own, fp, small, False)
                if flips is None:
                    continue
                step = max(1, 50_000 // len(flips))
                for i in range(0, len(fp), step):
                    at = np.repeat(np.arange(i, min(i + step, len(fp))), len(flips))
                    yield rows(g, (own[i : i + step, None] ^ flips[None, :]).ravel(), fp[at], small.take(pa.array(at)), True)

    def rows(g: int, key: np.ndarray, fp: np.ndarray, small: pa.Array, probe: bool) -> pa.RecordBatch:
        cols = [pa.array(np.full(len(fp), g, np.int32)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), small, pa.array(np.full(len(fp), probe))]
        return pa.RecordBatch.from_arrays(cols, names=["grp", "key", "fp", "sketch", "probe"])

    return fps.select("fp", "sketch").mapInArrow(run, "grp int, key long, fp long, sketch binary, probe boolean")


def split_buckets(rows: DataFrame) -> DataFrame:
    """Adds (i, j, blk): the pair of blocks a row is compared in, and its own block. A bucket of up
    to BLOCK rows is one block; a larger one is dealt into blocks by a hash of the fingerprint, and
    every pair of its blocks is a group of its own, so no task holds more than two blocks."""
    plain = lambda df: df.withColumns({c: F.lit(0) for c in ("i", "j", "blk")})
    hot = common.cut(rows.groupBy("grp", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    n = hot.count()
    if n == 0:
        return plain(rows)
    hot = hot.withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")).drop("n")
    joined = rows.join(F.broadcast(hot) if n <= BROADCAST_BUCKETS else hot, ["grp", "key"], "left")
    cold = plain(joined.where("blocks is null").drop("blocks"))
    hots = joined.where("blocks is not null").withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = hots.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = other.select("grp", "key", "fp", "sketch", "probe", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk")
    return cold.unionByName(other)


class _Forest:
    """Union-find over 0..n-1 with vectorised look-up; the smaller root wins."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        for x, y in zip(a.tolist(), b.tolist()):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)


def _similar(sketch: np.ndarray | None, a: np.ndarray, b: np.ndarray, least: float | None) -> np.ndarray:
    """Whether the rows' shingle sets are estimated to be alike: equal ranges among those in use."""
    if least is None:
        return np.ones(len(a), bool)
    x, y = sketch[a], sketch[b]
    used = ((x | y) != 0).sum(axis=1)
    return ((x == y) & (x != 0)).sum(axis=1) >= least * used


def _links(run: np.ndarray, fp: np.ndarray, sketch: np.ndarray | None, probe: np.ndarray, first: np.ndarray, exact: np.ndarray, own: np.ndarray, distance: int, least: float | None):
    """Edges (fp, smallest fp linked) among rows of equal run (runs are contiguous). Rows of one
    fingerprint are one node; pairs already connected are dropped before they are joined. Short runs
    are compared at offset 1, 2, ..., all at once; long ones as matrices."""
    value, node = np.unique(fp, return_inverse=True)
    forest = _Forest(len(value))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), PAIRS):
            x, y = a[i : i + PAIRS], b[i : i + PAIRS]
            root = forest.roots()
            apart = root[node[x]] != root[node[y]]
            x, y = x[apart], y[apart]
            alike = _similar(sketch, x, y, least)
            forest.join(node[x[alike]], node[y[alike]])

    begin, end = np.searchsorted(run, run, side="left"), np.searchsorted(run, run, side="right")
    for s in np.unique(begin[end - begin >= DENSE]):
        e = end[s]
        rows = np.arange(s, e)
        if not exact[s]:
            left, right = rows[~probe[s:e]], rows[probe[s:e]]
        elif own[s]:
            left = right = rows
        else:
            left, right = rows[first[s:e]], rows[~first[s:e]]
        for i in range(0, len(left), CHUNK):
            some = left[i : i + CHUNK]
            other = right[i:] if left is right else right
            x, y = np.nonzero(np.bitwise_count(fp[some][:, None] ^ fp[other][None, :]) <= distance)
            join(some[x], other[y])
    at = np.flatnonzero(end - begin < DENSE)
    d = 1
    while True:
        at = at[end[at] - at > d]
        if not len(at):
            break
        a, b = at, at + d
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        ok &= exact[a] | (probe[a] != probe[b])
        join(a[ok], b[ok])
        d += 1
    root = forest.roots()
    moved = np.flatnonzero(root != np.arange(len(root)))
    return value[moved], value[root[moved]]


def links(rows: DataFrame, parts: list[tuple[list[int], int]], distance: int, least: float | None = None) -> DataFrame:
    """Verified links (a, b) of the bucket rows: for each task a spanning forest, never all pairs."""
    keys = ["grp", "key", "i", "j"]
    zero = np.array([t == 0 for _, t in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def emit(t: pa.Table) -> pa.RecordBatch:
            c = {n: t[n].to_numpy() for n in t.column_names if n != "sketch"}
            new = np.zeros(t.num_rows, dtype=np.int64)
            if t.num_rows:
                new[1:] = np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in keys])
            run_id = np.cumsum(new)
            size = np.bincount(run_id, minlength=1)[run_id] if t.num_rows else new
            keep = size > 1
            small = None
            if least is not None:
                data = b"".join(t["sketch"].filter(pa.array(keep)).to_pylist())
                small = np.frombuffer(data, np.uint8).reshape(int(keep.sum()), -1) if keep.any() else np.zeros((0, BINS), np.uint8)
            a, b = _links(
                run_id[keep], c["fp"].astype(np.int64).view(np.uint64)[keep], small, c["probe"][keep],
                (c["blk"] == c["i"])[keep], zero[c["grp"][keep]], (c["i"] == c["j"])[keep], distance, least,
            )
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < RUN_ROWS:
                continue
            # whole runs only: the last one may go on in the next batch
            last = [held[k][held.num_rows - 1].as_py() for k in keys]
            same = np.logical_and.reduce([held[k].to_numpy() == v for k, v in zip(keys, last)])
            first = int(np.argmax(same))
            if first:
                yield emit(held.slice(0, first))
                held = held.slice(first)
        if held is not None:
            yield emit(held)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def linked_fingerprints(fps: DataFrame, distance: int, least: float | None = None) -> DataFrame:
    """(node, root) of the distinct fingerprints (fp, sketch) that link to another one."""
    n, both = bit_statistics(fps)
    parts = plan(n, both, distance)
    return components(links(split_buckets(probes(fps, parts)), parts, distance, least))


def _rooted(docs: DataFrame, k: int, distance: int, least: float | None) -> tuple[DataFrame, DataFrame]:
    """(a row per row of docs with its fingerprint, (fp, least, root) of the distinct ones)."""
    rows = common.cut(fingerprints(docs, k, least is not None))
    classes = common.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("sketch").alias("sketch")))
    found = linked_fingerprints(classes, distance, least)
    return rows, classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, k: int = 4, distance: int = 4, least: float | None = None) -> DataFrame:
    """A row per row of docs (doc_id, text, ...): doc_id, text_hash, fingerprint (16 hex digits),
    root (the component's smallest fingerprint as a number) and component_id (the smallest doc_id
    reachable over fingerprints that differ in at most `distance` bits, null only if all are null).
    With `least`, two fingerprints link only if their shingle sketches agree in that share, too.

    Null and empty texts have fingerprint zero. Equal fingerprints are one node, so exact copies
    cost one row however many there are. Repeated rows get equal results; an empty table gives none."""
    rows, named = _rooted(docs, k, distance, least)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.select("fp", "root").join(smallest, "root")
    return rows.join(labels, "fp").select(
        "doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root"
    )


# -- exact similarity -------------------------------------------------------------------------


def proposals(classes: DataFrame, distance: int, least: float) -> DataFrame:
    """(node, root) of the shingle sets (node, fp, sketch, bands, values) that may be alike: components
    of SimHash links, of equal fingerprints, and of MinHash bands whose values agree."""
    fps = common.cut(classes.groupBy("fp").agg(F.min("sketch").alias("sketch"), F.min("node").alias("first")))
    n, both = bit_statistics(fps)
    parts = plan(n, both, distance)
    near = links(split_buckets(probes(fps, parts)), parts, distance, least)
    name = lambda c: fps.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    near = near.join(name("a"), "a").join(name("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    equal = classes.select("fp", "node").join(fps.select("fp", "first"), "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    rows = classes.select(F.posexplode("bands").alias("grp", "key"), F.col("node").alias("fp"), F.col("values").alias("sketch"), F.lit(False).alias("probe"))
    banded = links(split_buckets(rows), [([], 0)] * BANDS, 64, AGREE)
    return components(near.unionByName(equal).unionByName(banded))


def _alike(sets: list[np.ndarray], node: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Links (a, b) between rows of left and right (equal, or apart) whose sets have a Jaccard similarity of
    `least`: a spanning forest. Each row is compared, all at once, with those it is not yet joined to."""
    forest, size = _Forest(len(sets)), np.array([len(x) for x in sets])
    whole = len(left) == len(right) and np.array_equal(left, right)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start, mark = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(ids) + 1, bool)
    for at, x in enumerate(left.tolist()):
        other = right[at + 1 :] if whole else right
        root = forest.roots()
        ok = (root[other] != root[x]) & (np.minimum(size[other], size[x]) >= least * np.maximum(size[other], size[x]) - 1e-6)
        other = other[ok]
        if not len(other):
            continue
        mine = ids[start[x] : start[x + 1]]
        mark[mine] = True
        n = size[other]
        ends = np.cumsum(n)
        flat = np.arange(ends[-1]) + np.repeat(start[other] - (ends - n), n)
        shared = np.add.reduceat(mark[ids[flat]], ends - n, dtype=np.int64)
        mark[mine] = False
        found = other[shared / (size[x] + n - shared) >= least]
        found = found[np.unique(root[found], return_index=True)[1]]  # one link to each tree
        forest.join(np.full(len(found), x), found)
        for y in found.tolist():
            yield int(node[x]), int(node[y])


def _judged(sets: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """(root, node, hashes, pivot, alike) of the sets of the roots in sizes (root, n): whether a set is alike to its
    root's first one, the pivot. A root's sets meet its pivot in parts of about PART, so no task gets a large
    root."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = sets.join(sizes.select("root", parts.alias("parts")), "root")
    first = own.groupBy("root", "parts").agg(F.min("node").alias("pivot"))
    pivots = own.select("root", "node", F.col("hashes").alias("pivot_hashes")).join(first, "root").where("node = pivot").dropDuplicates(["root"]).drop("node")
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = own.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts").join(pivots, ["root", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "hashes"):
            alike = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(bool(shared) and shared / (len(x) + len(y) - shared) >= least)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(alike, pa.bool_())], names=["root", "node", "hashes", "pivot", "alike"])

    return met.select("root", "node", "hashes", "pivot", "pivot_hashes").mapInArrow(run, "root long, node long, hashes binary, pivot long, alike boolean")


def _paired(sets: DataFrame) -> DataFrame:
    """(root, i, j, blk, node, hashes): the sets (root, node, hashes, alike) of each root in blocks, and every two
    blocks as a group, but for two of alike sets, which are joined through their pivot. Blocks hold about
    BLOCK_BYTES and BLOCK_ROWS."""
    blocks = lambda side: F.ceil(F.greatest(F.sum(F.when(side, F.length("hashes"))) / F.lit(BLOCK_BYTES), F.count_if(side) / F.lit(BLOCK_ROWS))).cast("int")
    alike = F.col("alike")
    total = sets.groupBy("root").agg(F.coalesce(blocks(~alike), F.lit(0)).alias("rest"), F.coalesce(blocks(alike), F.lit(0)).alias("near"))
    dealt = sets.join(total.where("rest > 0"), "root")
    h = F.xxhash64("node")
    blk = F.when(alike, F.col("rest") + F.pmod(h, F.greatest("near", F.lit(1)))).otherwise(F.pmod(h, F.col("rest"))).cast("int")
    # a set alike to the pivot meets the blocks of the others, one of the others meets all blocks
    other = F.when(alike, F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("near") - 1))
    dealt = dealt.withColumn("blk", blk).withColumn("o", F.explode(other))
    return dealt.select("root", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "node", "hashes")


def verified(sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the sets (root, node, hashes) of one root, by their exact similarity; they join the
    same sets as all links do.

    In a root of more than FEW sets or BLOCK_BYTES, each set is first compared with one of them, the pivot:
    those alike to it are joined through it and need no comparison with each other, so a large group of near
    copies costs its size, not its square. What is left is compared with everything of its root, in blocks."""
    sizes = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("hashes")).alias("bytes"))
    large = sizes.where((F.col("n") > FEW) | (F.col("bytes") > BLOCK_BYTES)).select("root", "n")
    judged = common.cut(_judged(sets, large, least))
    near = judged.where("alike and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    small = sets.join(large, "root", "left_anti").select("root", "node", "hashes", F.lit(False).alias("alike"))
    dealt = _paired(small.unionByName(judged.select("root", "node", "hashes", "alike")))
    keys = ["root", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def emit() -> pa.RecordBatch:
            a, b = [], []
            if len(held) > 1:
                blk, node = np.array([x[0] for x in held]), np.array([x[1] for x in held], dtype=np.int64)
                arrays = [np.frombuffer(x[2], "<u8") for x in held]
                left = np.flatnonzero(blk == key[1])
                right = left if key[1] == key[2] else np.flatnonzero(blk != key[1])
                for x, y in _alike(arrays, node, left, right, least):
                    a.append(x)
                    b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in common.slices(batches, "hashes"):
            for r, i, j, blk, node, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if (r, i, j) != key:
                    if held:
                        yield emit()
                    held, key = [], (r, i, j)
                held.append((blk, node, hashes))
        if held:
            yield emit()

    compared = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")
    return near.unionByName(compared)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(root, node, hashes) of docs (root, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            hashes = [shingle_set(t, k).astype("<u8").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.binary())], names=["root", "node", "hashes"])

    return docs.select("root", "node", "text").mapInArrow(run, "root long, node long, hashes binary")


def deduplicate(docs: DataFrame, k: int = 5, distance: int = 12, least: float = 0.6, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays (null
    ids last; of rows with one doc_id, the one with the smallest text hash, once).

    Two texts link if their whole sets of k-word shingles have a Jaccard similarity of `similarity`.
    Proposed are those within `distance` bits whose sketches agree in `least` of the ranges (these alone miss
    about one in six at 0.8) and those that share a MinHash band; each link is then verified exactly."""
    rows = common.cut(shapes(docs, k))
    some = {c: F.min(c).alias(c) for c in ("fp", "sketch", "bands", "values")}
    # the first row of each set, then of each component: no large group meets in a task
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k")
    classes = common.cut(rows.groupBy("node").agg(first, *some.values()))
    keys = ["_quillon_a", "_quillon_b", "_quillon_c"]
    key = lambda doc_id, text_hash: dict(zip(keys, [F.coalesce(doc_id.cast("long"), F.lit(0)), doc_id.isNull(), text_hash]))
    named = lambda df: df.select("*", *[c.alias(n) for n, c in key(F.col("k.doc_id"), F.col("k.text_hash")).items()])
    marked = docs.withColumns(key(F.col("doc_id"), F.xxhash64("text")))
    proposed = named(proposals(classes, distance, least).join(classes.select("node", "k"), "node"))
    texts = marked.select(*keys, "text").join(proposed.select(*keys, "node", "root"), keys)
    # repeated rows are one set
    sets = common.cut(shingle_sets(texts, k))
    found = components(verified(sets, similarity))
    kept = classes.select("node", "k").join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k"))
    wanted = named(kept).select(*keys)
    # one dealing of the texts serves the join and the removal of repeated rows
    return marked.join(wanted, keys, "left_semi").dropDuplicates(keys).drop(*keys)
