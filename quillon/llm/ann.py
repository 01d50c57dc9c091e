"""Approximate nearest neighbours by a hash-prefix forest.

Hash strings are signs of random projections of centred vectors. The sorted strings of one tree over the
whole table cut it into blocks of neighbouring prefixes, a file each. In every block each tree is a
sorted array of long hash strings: a query descends all trees to the longest prefix it shares with any
string, then ascends them together, one bit at a time; the rows under its prefix in any tree are
candidates, and their exact distances are computed. It ends where a neighbour as near as the worst one
held would, but for a probability of `miss`, share a prefix in some tree; the top of all trees is the
whole block, and `miss` 0 is exact. No number of candidates bounds the search.

A query first searches its own block. The worst distance it then holds prunes the other blocks and
their cells: a cell (neighbours in the block's order) lies within a ball, and one further off than
that distance cannot hold a nearer row."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F

from quillon.llm import common

#: Trees, bits of a hash string.
TREES, BITS = 32, 32
#: Blocks have at most so many rows on average; a small table has FEW blocks, but none of under LEAST rows.
BLOCK, FEW, LEAST = 65_536, 8, 2048
#: Rows of a cell; queries searched at once.
CELL, BATCH = 128, 256
#: The probability of missing a neighbour as near as the worst one held.
MISS = 0.05
SEED = 11


def planes(dim: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * bits))


def strings(centred: np.ndarray, normals: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(rows, trees) hash strings, as numbers whose first bit is the highest."""
    place = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    out = np.empty((len(centred), normals.shape[1] // bits), np.uint64)
    for t in range(out.shape[1]):
        out[:, t] = (centred @ normals[:, t * bits : (t + 1) * bits] > 0) @ place
    return out


class Forest:
    """The forest of one block: vectors (rows of a double array) in the block's order, and their ids."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.vectors, self.ids, self.trees, self.bits = vectors, ids, trees, bits
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted_ids = ids[self.by_id]
        self.centre = vectors.mean(axis=0)
        self.normals = planes(vectors.shape[1], trees, bits, seed)
        centred = vectors - self.centre
        keys = strings(centred, self.normals, bits)
        self.order = np.argsort(keys, axis=0, kind="stable").T.astype(np.int32)
        self.keys = np.ascontiguousarray(np.sort(keys, axis=0, kind="stable").T)
        # single precision picks what is worth an exact distance
        self.scale = float(np.abs(centred).max(initial=0)) or 1.0
        self.small = (centred / self.scale).astype(np.float32)
        self.norms = (self.small.astype(np.float64) ** 2).sum(axis=1)
        starts = np.arange(0, len(vectors), CELL)
        sizes = np.diff(np.append(starts, len(vectors)))
        self.cells = np.add.reduceat(vectors, starts, axis=0) / sizes[:, None]
        self.cell_of = np.repeat(np.arange(len(starts)), sizes)
        self.radius = np.maximum.reduceat(self._exact(vectors, self.cells[self.cell_of]), starts)

    @staticmethod
    def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(((a - b) ** 2).sum(axis=1))

    def lower(self, queries: np.ndarray) -> np.ndarray:
        """(queries, cells): no row of the cell is nearer than this, less rounding."""
        out = np.empty((len(queries), len(self.cells)))
        for i, q in enumerate(queries):
            out[i] = self._exact(self.cells, q)
        slack = 1e-9 * (out + self.radius + np.abs(self.centre).max(initial=0))
        return out - self.radius - slack

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, bound: np.ndarray, miss: float = MISS) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each query the rows and distances of the k nearest found within its bound, nearest first,
        ties to the smaller id, and how many rows were looked at. Rows of the query's own id are left out."""
        out_rows, out_dist, looked = [], [], np.zeros(len(queries), np.int64)
        for s in range(0, len(queries), BATCH):
            part = slice(s, s + BATCH)
            rows, dist, looked[part] = self._batch(queries[part], query_ids[part], k, bound[part], miss)
            out_rows, out_dist = out_rows + rows, out_dist + dist
        return out_rows, out_dist, looked

    def _batch(self, queries, query_ids, k, bound, miss):
        m, n = len(queries), len(self.vectors)
        rows, dist = [np.zeros(0, np.int64)] * m, [np.zeros(0)] * m
        worst, looked = bound.astype(float).copy(), np.zeros(m, np.int64)
        seen = (self.lower(queries) > bound[:, None])[:, self.cell_of]
        low, high = (np.searchsorted(self.sorted_ids, query_ids, side) for side in ("left", "right"))
        for i in np.flatnonzero(high > low):
            seen[i, self.by_id[low[i] : high[i]]] = True
        alive = ~seen.all(axis=1)
        centred = queries - self.centre
        keys = strings(centred, self.normals, self.bits)
        reach = np.sqrt((centred**2).sum(axis=1))
        begin = np.stack([np.searchsorted(self.keys[t], keys[:, t]) for t in range(self.trees)], axis=1)
        end = begin.copy()
        # the longest prefix shared with a neighbour in a sorted array
        longest = np.zeros(m, np.int64)
        for side in (begin, begin - 1):
            for t in range(self.trees):
                ok = (side[:, t] >= 0) & (side[:, t] < n)
                apart = (self.keys[t][np.clip(side[:, t], 0, n - 1)] ^ keys[:, t]).astype(np.float64)
                shared = self.bits - np.ceil(np.log2(apart + 1)).astype(np.int64)
                longest = np.maximum(longest, np.where(ok, shared, 0))
        for depth in range(self.bits, -1, -1):
            now = np.flatnonzero(alive & (longest >= depth))
            if not len(now):
                continue
            shift = np.uint64(self.bits - depth)
            first = keys[now] >> shift << shift
            b, e = np.empty((len(now), self.trees), np.int64), np.empty((len(now), self.trees), np.int64)
            for t in range(self.trees):
                b[:, t] = np.searchsorted(self.keys[t], first[:, t])
                e[:, t] = np.searchsorted(self.keys[t], first[:, t] + (np.uint64(1) << shift))
            grown = (b < begin[now]) | (e > end[now])
            for j in np.flatnonzero(grown.any(axis=1)):
                i, flag = now[j], np.zeros(n, bool)
                for t in np.flatnonzero(grown[j]):
                    flag[self.order[t, b[j, t] : begin[i, t]]] = True
                    flag[self.order[t, end[i, t] : e[j, t]]] = True
                new = np.flatnonzero(flag & ~seen[i])
                seen[i] |= flag
                looked[i] += len(new)
                rows[i], dist[i] = self._nearer(queries[i], centred[i], new, rows[i], dist[i], k, bound[i])
                if len(dist[i]) == k:
                    worst[i] = min(bound[i], dist[i][-1])
            begin[now], end[now] = b, e
            if depth:
                # a neighbour at that distance from the query, as far from the centre as the query
                with np.errstate(invalid="ignore", over="ignore"):
                    cos = np.clip(1 - worst[now] ** 2 / (2 * np.maximum(reach[now], 1e-150) ** 2), -1, 1)
                    agree = 1 - np.arccos(cos) / np.pi
                    sure = (1 - agree**depth) ** self.trees <= miss
                alive[now[sure & np.isfinite(worst[now])]] = False
        return rows, dist, looked

    def _nearer(self, query, centred, new, rows, dist, k, bound):
        """rows and dist with those of the new rows that are within the bound and among the k nearest."""
        if not len(new):
            return rows, dist
        with np.errstate(over="ignore", invalid="ignore"):
            q = (centred / self.scale).astype(np.float32)
            size = float((q.astype(np.float64) ** 2).sum())
        if size < 1e30:
            n2 = self.norms[new]
            # the square of the distance less the most that single precision can be wrong by
            least = n2 + size - 2.0 * (self.small[new] @ q) - 2.4e-7 * (len(q) + 8) * (n2 + size)
            least *= self.scale**2
            if len(dist) < k < len(new):
                some = new[np.argpartition(least, k - 1)[:k]]
                limit = min(bound, np.partition(np.concatenate([dist, self._exact(self.vectors[some], query)]), k - 1)[k - 1])
            else:
                limit = min(bound, dist[-1]) if len(dist) == k else bound
            new = new[least <= limit * limit * (1 + 1e-12)]
        exact = self._exact(self.vectors[new], query)
        near = exact <= bound
        rows, dist = np.concatenate([rows, new[near]]), np.concatenate([dist, exact[near]])
        best = np.lexsort((self.ids[rows], dist))[:k]
        return rows[best], dist[best]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim): vectors as doubles, without null ids, null, empty or zero vectors, and
    vectors with a null or non-finite component. Rows that repeat id and vector count once."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null").where(~F.exists("v", odd))
    return rows.where(F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, vectors) of each dimension in a batch with a column v."""
    col = batch.column(batch.schema.get_field_index("v"))
    size = np.diff(col.offsets.to_numpy())
    flat, start = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield dim, rows, flat[start[rows][:, None] + np.arange(dim)].astype(np.float64)


def _centre(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of the most frequent dimensions (of ragged vectors, at most 64 are told)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for dim, at, x in _matrices(batch):
                held = total.setdefault(dim, [0, np.zeros(dim)])
                held[0] += len(at)
                held[1] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([t[1].tolist() for t in total.values()], pa.list_(pa.float64()))],
            names=["dim", "n", "total"],
        )

    parts = rows.select("v").mapInArrow(run, "dim int, n long, total array<double>")
    common_dims = [r.dim for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()]
    sums: dict[int, list] = {}
    for r in parts.where(F.col("dim").isin(common_dims)).collect() if common_dims else []:
        held = sums.setdefault(r.dim, [0, np.zeros(r.dim)])
        held[0] += r.n
        held[1] += np.array(r.total)
    return {dim: (t / n).astype(np.float32).astype(np.float64) for dim, (n, t) in sums.items()}


def _placed(rows: DataFrame) -> DataFrame:
    """rows with place, their hash string in the table's own tree."""
    centre = _centre(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[int, np.ndarray] = {}
        for batch in batches:
            place = np.zeros(batch.num_rows, np.int64)
            for dim, at, x in _matrices(batch):
                if dim not in normals:
                    normals[dim] = planes(dim, 1, BITS, SEED + 1)
                place[at] = strings(x - centre.get(dim, 0.0), normals[dim])[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    return rows.mapInArrow(run, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", place long")


def _read_block(path: str, name: str) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(dimension, vectors, the rows' other columns) of each dimension in a block's file, in its order."""
    store, root = common.open_store(path)
    with store.open_input_file(f"{root}/{name}") as file:
        table = pq.read_table(file, columns=["vec_id", "v", "h", "kept", "asked"]).combine_chunks()
    for batch in table.to_batches():
        for dim, at, x in _matrices(batch):
            yield dim, x, batch.drop_columns(["v"]).take(pa.array(at))


QUERIES = "query_id long, query_key long, home string, v array<double>, bound double, ids array<long>, scores array<double>"
NEIGHBOURS = "query_id long, query_key long, vec_id long, score double"


def _home(path: str, k: int, miss: float):
    """Each query of a block searched in its own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in QUERIES.split(", ")]
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            for _, x, rest in _read_block(path, name):
                ids, h, kept, asked = (rest.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "h", "kept", "asked"))
                at = np.flatnonzero(asked)
                found, dist = [np.zeros(0, np.int64)] * len(at), [np.zeros(0)] * len(at)
                forest = None
                if len(at) and kept.any():
                    forest = Forest(x[kept], ids[kept])
                    found, dist, _ = forest.search(x[at], ids[at], k, np.full(len(at), np.inf), miss)
                for s in range(0, len(at), 2000):
                    part = range(s, min(s + 2000, len(at)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[at][s : s + 2000]),
                            pa.array(h[at][s : s + 2000]),
                            pa.array([name] * len(part)),
                            pa.array(list(x[at][s : s + 2000]), pa.list_(pa.float64())),
                            pa.array([float(dist[i][-1]) if len(dist[i]) == k else np.inf for i in part]),
                            pa.array([forest.ids[found[i]] if forest else [] for i in part], pa.list_(pa.int64())),
                            pa.array([dist[i] for i in part], pa.list_(pa.float64())),
                        ],
                        names=names,
                    )

    return run


def _elsewhere(path: str, asked: str, k: int, miss: float):
    """All queries streamed past each block but their own; a block's forest is built once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = common.open_store(asked)
        from pyarrow import fs

        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            forests = {}
            for dim, x, rest in _read_block(path, name):
                kept, ids = (rest.column(c).to_numpy(zero_copy_only=False) for c in ("kept", "vec_id"))
                if kept.any():
                    forests[dim] = Forest(x[kept], ids[kept])
            for file in files:
                with store.open_input_file(file) as opened:
                    for batch in pq.ParquetFile(opened).iter_batches(4096, columns=["query_id", "query_key", "home", "v", "bound"]):
                        yield from past(forests, name, batch)

    def past(forests: dict, name: str, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        away = np.array(batch.column(batch.schema.get_field_index("home")).to_pylist()) != name
        for dim, at, x in _matrices(batch):
            at, x = at[away[at]], x[away[at]]
            if dim not in forests or not len(at):
                continue
            qid, key, bound = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[at] for c in ("query_id", "query_key", "bound"))
            found, dist, _ = forests[dim].search(x, qid, k, bound, miss)
            n = [len(f) for f in found]
            if sum(n):
                cols = [np.repeat(qid, n), np.repeat(key, n), forests[dim].ids[np.concatenate(found)], np.concatenate(dist)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "query_key", "vec_id", "score"])

    return run


def _first_copies(rows: DataFrame, k: int) -> DataFrame:
    """rows with kept: whether a row can be a neighbour. Of a vector's copies those with the k + 1 smallest
    ids; later ones stay, not kept, where they are asked about."""
    rows = rows.withColumn("vh", F.xxhash64("v"))
    many = common.cut(rows.groupBy("vh").count().where(F.col("count") > k + 1).select("vh"))
    if many.isEmpty():
        return rows.drop("vh").withColumn("kept", F.lit(True))
    copies = rows.join(many, "vh", "left_semi").drop("vh")
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = copies.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank").withColumn("kept", F.lit(True))
    later = copies.where("asked").join(first.select("vec_id", "h"), ["vec_id", "h"], "left_anti").withColumn("kept", F.lit(False))
    single = rows.join(many, "vh", "left_anti").drop("vh").withColumn("kept", F.lit(True))
    return common.cut(single.unionByName(first).unionByName(later.select(first.columns)))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, miss: float = MISS) -> DataFrame:
    """(query_id, rank, vec_id, score): of vectors (vec_id, embedding, ...), for each row whose
    vec_id is divisible by `every`, the k nearest rows found of the same dimension by Euclidean
    distance, nearest first, ties to the smaller vec_id; rows of the query's own vec_id are left
    out. Fewer rows than k: all of them. With miss 0 the result is exact. See usable() for what takes
    no part; an empty table gives none.

    Rows are dealt by ranges of (hash string, row hash), so copies of one vector are split as well, and of
    its copies only the k + 1 of the smallest ids can be anyone's neighbours. Vectors are shuffled a fixed
    number of times; queries and blocks meet through files in the shared folder."""
    rows = usable(vectors).withColumn("h", F.xxhash64("vec_id", "v")).withColumn("asked", F.col("vec_id") % every == 0)
    whole = _first_copies(common.cut(rows), k)
    n = whole.count()
    blocks = max(1, min(max(FEW, ceil(n / BLOCK)), ceil(n / LEAST)))
    dealt = _placed(whole).repartitionByRange(blocks, "dim", "place", "h").sortWithinPartitions("dim", "place", "h")
    table = common.cut(dealt)
    path = table._quillon_path
    files = table.select(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("name")).distinct()
    asked = common.cut(common.spread(files, blocks).mapInArrow(_home(path, k, miss), QUERIES))
    found = asked.select("query_id", "query_key", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", "query_key", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    others = common.spread(files, blocks).mapInArrow(_elsewhere(path, asked._quillon_path, k, miss), NEIGHBOURS)
    order = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    return found.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
