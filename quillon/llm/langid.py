"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A text is one sequence of UTF-8 bytes, white space included. It is read in windows of WINDOW bytes cut
between characters; each direction first reads up to CONTEXT bytes of the window's neighbour on its
side, so a position near a cut is seen from both sides as well. The network labels every byte position
and a document's probabilities pool the log-probabilities of all its positions. Training is
backpropagation through time with Adam over windows of the labelled documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm import common
from quillon.llm.common import held_out

#: The bounded sample the network is fitted on: labelled documents in all, shared evenly by the
#: languages (each has LEAST_DOCS at least, or all its documents), and windows of one document, spread
#: over its whole text by a hash.
TRAIN_DOCS, LEAST_DOCS, DOC_WINDOWS, TRAIN_WINDOW = 2000, 100, 8, 96
HIDDEN, EPOCHS, BATCH, RATE, SEED = 16, 3, 128, 0.02, 7
#: Bytes of a window, and of its neighbours read before it.
WINDOW, CONTEXT = 512, 48
#: Windows labelled at once, and label values held for them.
ROWS, VALUES = 1024, 1 << 22
#: Byte value that pads a window.
PAD = 256
UNKNOWN = "und"


class Network(NamedTuple):
    """Per direction: input weights by byte, recurrent weights, biases (update, reset and candidate
    gates side by side); then the output layer. Languages in sorted order."""

    langs: list[str]
    wx: np.ndarray  # 2, 257, 3h (row PAD pads)
    wh: np.ndarray  # 2, h, 3h
    b: np.ndarray  # 2, 3h
    wo: np.ndarray  # 2h, n
    bo: np.ndarray  # n


def initial(langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * (0.5 / np.sqrt(hidden))).astype(np.float32)
    return Network(langs, draw(2, 257, 3 * hidden), draw(2, hidden, 3 * hidden), np.zeros((2, 3 * hidden), np.float32), draw(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))


def _run(net: Network, way: int, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, rows, h) of one direction over bytes x (time, rows); padded positions have
    state zero. keep takes what the way back needs of each step."""
    h = net.wh.shape[1]
    # a logistic gate is half of one plus the hyperbolic tangent of half its input
    table = [np.ascontiguousarray((net.wx[way] + net.b[way])[:, i * h : (i + 1) * h]) * k for i, k in enumerate((0.5, 0.5, 1))]
    back = [np.ascontiguousarray(net.wh[way][:, i * h : (i + 1) * h]) * k for i, k in enumerate((0.5, 0.5, 1))]
    padded = mask.min(axis=1) == 0
    state = np.zeros((x.shape[1], h), net.wx.dtype)
    out = np.empty((len(x), *state.shape), net.wx.dtype)
    gates = np.empty((3, *state.shape), net.wx.dtype)
    rec = np.empty_like(state)
    for t in range(len(x)) if way == 0 else reversed(range(len(x))):
        for gate, rows, weights in zip(gates[:2], table, back):
            np.take(rows, x[t], axis=0, out=gate, mode="clip")
            np.matmul(state, weights, out=rec)
            gate += rec
        z, r, new = gates
        both = gates[:2]
        np.tanh(both, out=both)
        both += 1
        both *= 0.5
        np.take(table[2], x[t], axis=0, out=new, mode="clip")
        np.matmul(state, back[2], out=rec)
        if keep is not None:
            keep.append((t, state.copy(), z.copy(), r.copy(), rec.copy()))
        rec *= r
        new += rec
        np.tanh(new, out=new)
        if keep is not None:
            keep[-1] += (new.copy(),)
        new -= state
        new *= z
        state += new
        if padded[t]:
            state *= mask[t][:, None]
        out[t] = state
    return out


def position_log_probs(net: Network, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(time, languages, rows): the label distribution of every position."""
    h = net.wh.shape[1]
    # a product for each time step: small ones stay on one core
    logits = sum(np.matmul(net.wo[way * h : (way + 1) * h].T, _run(net, way, x, mask).transpose(0, 2, 1)) for way in (0, 1))
    logits += net.bo[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def gradients(net: Network, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted mean cross-entropy over positions and its gradients, through time both ways."""
    h = net.wh.shape[1]
    kept: tuple[list, list] = ([], [])
    hidden = np.concatenate([_run(net, way, x, mask, kept[way]) for way in (0, 1)], axis=2)
    logits = hidden @ net.wo + net.bo
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    w = mask * weight
    w = w / w.sum()
    at = np.arange(len(y))
    loss = float(-(np.log(np.maximum(p[:, at, y], 1e-12)) * w).sum())
    p[:, at, y] -= 1
    d = (p * w[:, :, None]).astype(net.wx.dtype)
    g = [np.zeros_like(a) for a in net[1:]]
    # a product for each time step: small ones stay on one core
    g[3][:], g[4][:] = (hidden.transpose(0, 2, 1) @ d).sum(axis=0), d.sum(axis=(0, 1))
    dh_all = d @ net.wo.T
    order = {way: [k[0] for k in kept[way]][::-1] for way in (0, 1)}
    for way in (0, 1):
        dh = np.zeros((x.shape[1], h), net.wx.dtype)
        inputs, recurrent, before_all = [], [], []
        for t, before, z, r, rec, new in reversed(kept[way]):
            dh = (dh + dh_all[t][:, way * h : (way + 1) * h]) * mask[t][:, None].astype(net.wx.dtype)
            dz = dh * (new - before) * z * (1 - z)
            dnew = dh * z * (1 - new * new)
            dr = dnew * rec * r * (1 - r)
            inputs.append(np.concatenate([dz, dr, dnew], axis=1))
            recurrent.append(np.concatenate([dz, dr, dnew * r], axis=1))
            before_all.append(before)
            dh = dh * (1 - z) + recurrent[-1] @ net.wh[way].T
        flat = np.concatenate(inputs)
        g[1][way] = np.matmul(np.stack(before_all).transpose(0, 2, 1), np.stack(recurrent)).sum(axis=0)
        g[2][way] = flat.sum(axis=0)
        seen = x[order[way]].ravel()
        place = np.argsort(seen, kind="stable")
        value, first = np.unique(seen[place], return_index=True)
        g[0][way][value] = np.add.reduceat(flat[place], first, axis=0)
    return loss, g


def batch_of(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, rows) bytes, padded at the end, and the mask of what is not padding."""
    long = max(map(len, windows))
    x = np.full((len(windows), long), PAD, np.int64)
    for i, w in enumerate(windows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    x = np.ascontiguousarray(x.T)
    return x, (x != PAD).astype(np.float32)


def train(windows: list[tuple[bytes, str, float]], hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """A network from (bytes, language, weight), by Adam over batches of windows of like length."""
    langs = sorted({lang for _, lang, _ in windows})
    net, rng = initial(langs, hidden), np.random.default_rng(SEED)
    moment = [(np.zeros_like(a), np.zeros_like(a)) for a in net[1:]]
    number = {lang: i for i, lang in enumerate(langs)}
    step = 0
    # a small sample is read more often
    epochs = max(epochs, -(-200 * BATCH // max(1, len(windows))))
    total = epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        draw = rng.random(len(windows))
        order = sorted(range(len(windows)), key=lambda i, r=draw: (len(windows[i][0]) // 16, r[i]))
        for s in rng.permutation(range(0, len(windows), BATCH)):
            some = [windows[i] for i in order[s : s + BATCH]]
            x, mask = batch_of([w for w, _, _ in some])
            y = np.array([number[lang] for _, lang, _ in some])
            _, grads = gradients(net, x, mask, y, np.array([k for _, _, k in some], np.float32))
            step += 1
            rate = RATE * (1 - step / (total + 1))
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for a, g, (m, v) in zip(net[1:], grads, moment):
                g *= min(1.0, 1.0 / max(size, 1e-12))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def cuts(data: np.ndarray, size: int) -> np.ndarray:
    """Where windows of a text's bytes begin: multiples of size, moved back to a character's start."""
    at = np.arange(0, len(data), size)
    for _ in range(3):
        at = at - ((at > 0) & (data[at] & 0xC0 == 0x80))
    return at


class Labeller:
    """Pooled language probabilities of whole texts."""

    def __init__(self, net: Network, window: int = WINDOW, context: int = CONTEXT):
        self.net, self.window, self.context = net, window, context

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages + 1): summed log-probabilities and the number of positions."""
        n = len(self.net.langs)
        out = np.zeros((len(texts), n + 1))
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        spans = []
        for i, end in enumerate(ends):
            begin = end - len(texts[i])
            first = begin + cuts(data[begin:end], self.window)
            last = np.append(first[1:], end)[: len(first)]
            spans.append(np.stack([np.full(len(first), i), first, last, np.maximum(first - self.context, begin), np.minimum(last + self.context, end)], axis=1))
        spans = np.concatenate(spans) if spans else np.zeros((0, 5), np.int64)
        spans = spans[np.argsort(spans[:, 4] - spans[:, 3], kind="stable")]
        rows = max(16, min(ROWS, VALUES // (n * (self.window + 2 * self.context))))
        for s in range(0, len(spans), rows):
            owner, first, last, begin, end = spans[s : s + rows].T
            at = begin + np.arange(int((end - begin).max()))[:, None]
            mask = at < end
            x = np.where(mask, data[np.minimum(at, len(data) - 1)], PAD).astype(np.int64)
            own = ((at >= first) & (at < last)).astype(np.float32)
            logp = position_log_probs(self.net, x, mask.astype(np.float32))
            np.add.at(out, owner, np.concatenate([(logp * own[:, None]).sum(axis=0).T, own.sum(axis=0)[:, None]], axis=1))
        return out

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text; UNKNOWN and 0 if it has no letter."""
        told = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        out = [(UNKNOWN, 0.0)] * len(texts)
        for i, total in zip(told, self.sums([texts[i].encode("utf-8", "surrogatepass") for i in told])):
            # the mean over positions, sharpened by the square root of the number of eight bytes
            z = total[:-1] / total[-1] * np.sqrt(max(1.0, total[-1] / 8))
            p = np.exp(z - z.max())
            best = int(p.argmax())
            out[i] = (self.net.langs[best], round(float(p[best] / p.sum()), 6))
        return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows (lang, part) of (lang, text): of each text those whose hashes are smallest."""
    for batch in common.slices(batches, "text"):
        langs, parts = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            at = [*cuts(np.frombuffer(data, np.uint8), TRAIN_WINDOW).tolist(), len(data)]
            found = {data[a:b] for a, b in zip(at, at[1:])}
            found = sorted(found, key=lambda w: (zlib.crc32(w), w))[:DOC_WINDOWS]
            langs += [lang] * len(found)
            parts += found
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["lang", "part"])


def fit(docs: DataFrame) -> Network | None:
    """A network from docs (doc_id, text, lang); None where no row has text, id and lang. Held-out rows
    are not read. Every language there is gets its even part of TRAIN_DOCS documents, picked by a hash
    of the id, and weighs as much as any other; the driver gets their windows, which are bounded. lang is
    taken to be a small set of values."""
    rows = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and text <> '' and lang is not null")
    rows = rows.where(~held_out(F.col("doc_id")))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    each = max(LEAST_DOCS, TRAIN_DOCS // len(sizes))
    share: Column = F.lit(0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(int(1_000_000 * min(1.0, each / n)))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    got = picked.select("lang", "text").mapInArrow(_windows, "lang string, part binary").collect()
    got = sorted((r.lang, bytes(r.part)) for r in got)
    count = {lang: sum(r[0] == lang for r in got) for lang in sizes}
    return train([(part, lang, len(got) / count[lang]) for lang, part in got]) if got else None


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with lang_pred and score. A text that is null or has no letter is `und` with score 0, and
    so is every text without a network; other columns pass through (of the same two names: are
    replaced), repeated rows get equal results, an empty table gives none."""
    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = None if net is None else Labeller(net)
        for batch in common.slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            got = labeller.label(texts) if labeller else [(UNKNOWN, 0.0)] * len(texts)
            cols = [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)
