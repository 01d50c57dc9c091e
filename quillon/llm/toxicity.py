"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model of their
accuracies and correlations, and a linear classifier trained on its posterior labels.

The lexicon is mined from the labelled training rows: words and word beginnings that many more toxic
than clean documents hold, whatever the language. Rows whose crc32(doc_id as text) mod 4 is 2 are
held out of all learning. A score depends on the text alone."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillon.llm import common
from quillon.llm.common import held_out

#: The classifier is fitted on at most so many toxic and clean labelled documents, picked by a hash;
#: of copies among them one stays.
TOXIC_DOCS, CLEAN_DOCS = 4000, 6000
#: Word beginnings of these lengths are candidates besides whole words.
SHORTEST, LONGEST = 3, 8
#: A form is a candidate if, at so many standard errors below the estimate, a document that holds it is
#: still more likely to be toxic than clean. How many voters each toxic document should have.
ERRORS, COVER = 1.0, 3
#: What a share of clean documents weighs against the same share of toxic ones in choosing forms.
COST = 4
#: Forms that share this part of their documents are a family; families are dealt to so many voters.
FAMILY, VOTERS = 0.5, 8
THRESHOLD = 0.3
#: Rounds of the label model, of its correlation estimate, and of the classifier; ridge penalty.
ROUNDS, CORRELATION_ROUNDS, STEPS, RIDGE = 15, 4, 25, 1.0
#: Voters correlated at least so much are copies of one; correlation given the label that counts as none
#: in estimating accuracies, and in weighting; voters one voter is compared with.
COPIES, NOISE, DEPENDENT, PARTNERS = 0.8, 0.1, 0.3, 64

_WORD = re.compile(r"[^\W\d_]+")


def forms(token: str) -> set[str]:
    """What a white-space-separated token can match: its words, whole (with a mark behind), and
    their beginnings."""
    out = set()
    for w in _WORD.findall(token.lower()):
        out.add((w if len(w) <= 40 else xxhash.xxh64_hexdigest(w)) + "$")
        out.update(w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


class _Forms(dict):
    """Token -> ids of the lexicon entries it matches."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = tuple(sorted(self.lexicon[f] for f in forms(token) if f in self.lexicon))
        if len(token) <= 48:
            if len(self) > 500_000:
                self.clear()
            self[token] = found
        return found


#: Pattern voters: share of capitals, of exclamation marks, of repeated tokens.
PATTERNS = 3


def patterns(text: str, tokens: list[str]) -> tuple[float, ...]:
    n = max(1, len(text))
    return (
        float(text.isupper()),
        min(1.0, 20 * text.count("!") / n),
        1.0 - len(set(tokens)) / max(1, len(tokens)),
    )


def features(table: _Forms, text: str | None) -> tuple[list[int], tuple[float, ...]]:
    """The lexicon entry of each different token that matches one, over the whole text, and the
    pattern values."""
    tokens = (text or "").split()
    return sorted(chain.from_iterable(map(table.__getitem__, set(tokens)))), patterns(text or "", tokens)


def row(n: int, entries: list[int], shown: tuple[float, ...]) -> np.ndarray:
    """The classifier's input: for each of n entries the logarithm to base 2 of one plus its number
    of different tokens, the patterns, and the same logarithm of all matches."""
    x = np.zeros(n + PATTERNS + 1)
    np.add.at(x, entries, 1)
    x[n : n + PATTERNS] = shown
    x[:n] = np.log2(1 + x[:n])
    x[-1] = np.log2(1 + len(entries))
    return x


class Model(NamedTuple):
    lexicon: dict[str, int]
    weights: np.ndarray  # lexicon entries, patterns, any entry at all
    bias: float
    accuracy: np.ndarray  # of each voter, by the label model
    correlation: np.ndarray

    def score(self, entries: list[int], shown: tuple[float, ...]) -> float:
        z = self.bias + self.weights @ row(len(self.lexicon), entries, shown)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def linked(near: np.ndarray) -> np.ndarray:
    """The component of each row of a symmetric boolean matrix, as its smallest member."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
        if np.array_equal(new, label):
            return label
        label = new


def loadings(c: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """From the voters' correlations c: each voter's own correlation with the hidden label, and the
    correlations that are left given the label.

    If voters i, j and k depend on each other through the label alone, c_ij c_ik / c_jk is the square of
    i's correlation with it; the median over many j and k is little moved by the few that depend on i
    otherwise. Those pairs are at first the ones that stand out in c, then the ones whose correlation is
    not explained by the label. No label is looked at."""
    m = len(c)
    others = ~np.eye(m, dtype=bool)
    usual = np.array([np.median(c[i, others[i]]) if m > 1 else 0.0 for i in range(m)])
    limit = 1.5 * np.maximum(usual, noise)
    free = ((c <= limit[:, None]) | (c <= limit[None, :])) & others
    load, rest = np.zeros(m), np.eye(m)
    for _ in range(CORRELATION_ROUNDS):
        for i in range(m):
            j = np.flatnonzero(free[i] & (c[i] > 0))
            j = j[np.argsort(-c[i, j], kind="stable")][:PARTNERS]
            under = c[np.ix_(j, j)]
            good = free[np.ix_(j, j)] & (under > noise / 4)
            load[i] = np.sqrt(np.clip(np.median(np.outer(c[i, j], c[i, j])[good] / under[good]), 0, 0.98)) if good.any() else np.nan
        # no two others to judge a voter by: taken to be as good as the one it agrees with most, if any
        judged = np.nan_to_num(load) > noise
        most = np.where(others, c, 0)[:, judged if judged.any() else slice(None)].max(axis=1, initial=0)
        load = np.where(np.isnan(load), np.sqrt(np.where(most > noise, np.minimum(most, 0.98), 0)), load)
        own = np.sqrt(1 - load**2)
        rest = np.clip((c - np.outer(load, load)) / np.outer(own, own), -1, 1)
        np.fill_diagonal(rest, 1)
        free = (rest <= noise) & others
    return load, rest


def label_model(votes: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row, each voter's accuracy, and the voters' correlation given
    the label. votes: rows x voters in -1, 0 (abstains), 1; prior: the share of label 1.

    Accuracies and correlations come from how the voters agree, whatever the label (see loadings()).
    Copies of a voter have its weight between them, and a voter correlated with others given the label
    weighs one over the sum of those correlations, itself included. From the weighted votes,
    expectation-maximisation fits the rate of each vote under either label; weights and prior stay, and
    abstaining says nothing."""
    n, m = votes.shape
    centred = votes - votes.mean(axis=0)
    sd = np.sqrt(np.maximum((centred**2).mean(axis=0), 1e-12))
    c = centred.T @ centred / n / np.outer(sd, sd)
    np.fill_diagonal(c, 1)
    first, family, size = np.unique(linked(c >= COPIES), return_inverse=True, return_counts=True)
    noise = max(NOISE, 4 / np.sqrt(n))
    load, rest = loadings(c[np.ix_(first, first)], noise)
    weight = (1 / np.where(rest > max(noise, DEPENDENT), rest, 0).sum(axis=1) / size)[family]
    load, corr = load[family], rest[np.ix_(family, family)]
    z = (centred / sd) @ (weight * load / (1 - load**2))
    z = (z - np.quantile(z, 1 - prior)) / max(z.std(), 1e-9)
    post = 1 / (1 + np.exp(-4 * z))
    values = [(votes == v).astype(float) for v in (-1, 0, 1)]
    table = np.empty((3, 2, m))
    for _ in range(ROUNDS):
        for v in range(3):
            table[v, 1] = (post @ values[v] + 0.1) / (post.sum() + 0.3)
            table[v, 0] = ((1 - post) @ values[v] + 0.1) / ((1 - post).sum() + 0.3)
        ratio = np.log(table[:, 1] / table[:, 0]) * weight
        ratio[1] = 0
        z = np.log(prior / (1 - prior)) + sum(values[v] @ ratio[v] for v in range(3))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    right = prior * table[2, 1] + (1 - prior) * table[0, 0]
    voted = prior * (table[2, 1] + table[0, 1]) + (1 - prior) * (table[2, 0] + table[0, 0])
    return post, right / np.maximum(voted, 1e-9), corr


def logistic(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on soft labels, by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9), a.T @ (p - target) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _counts(rows: DataFrame) -> DataFrame:
    """(form, n): in how many of the documents each form occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(set(chain.from_iterable(map(forms, set(text.split())))))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], schema=pa.schema([("form", pa.string()), ("n", pa.int64())]))

    return rows.select("text").mapInArrow(run, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))


def candidates(rows: DataFrame, n1: int, n0: int) -> list:
    """(form, toxic, clean), by form: all forms of two or more toxic documents that pass the test of ERRORS,
    and in how many of the n1 toxic and n0 clean documents each occurs."""
    a, b = F.col("toxic"), F.coalesce("clean", F.lit(0))
    held = _counts(rows.where("toxic = 1")).where("n >= 2").withColumnRenamed("n", "toxic")
    held = held.join(_counts(rows.where("toxic = 0")).withColumnRenamed("n", "clean"), "form", "left")
    # smoothed log odds, less so many standard errors
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    sure = odds - ERRORS * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    found = held.where(sure >= max(1.0, float(np.log(n0 / n1)))).select("form", "toxic", b.alias("clean")).collect()
    return sorted(found, key=lambda r: r.form)


def _sign(rows: DataFrame) -> DataFrame:
    """(text, toxic, sig, doc_id): sig is the smallest hash of a text's three-token shingles, which near
    copies mostly share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            sigs = []
            for text in batch.column(0).to_pylist():
                t = text.split()
                sigs.append(min((xxhash.xxh64_intdigest(" ".join(s)) >> 1 for s in zip(t, t[1:], t[2:])), default=len(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigs, pa.int64())], names=["text", "toxic", "doc_id", "sig"])

    columns = ["text", F.col("toxic").cast("int").alias("toxic"), F.col("doc_id").cast("string").alias("doc_id")]
    return rows.select(*columns).mapInArrow(run, "text string, toxic int, doc_id string, sig long")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from. Rows held out, without an id, a text or a
    label stay out; texts are whole. Of near copies with one label, the text with the least (doc_id,
    text) stays, however the rows are dealt."""
    known = labels.select("doc_id", "toxic").where("toxic is not null").distinct().where(~held_out(F.col("doc_id")))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw, kept = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)), F.lit(False)
    for value, most in ((1, TOXIC_DOCS), (0, CLEAN_DOCS)):
        share = min(1.0, most / max(1, sizes.get(value, 0)))  # of a hash's range: no row is chosen by its place
        kept = kept | ((F.col("toxic") == value) & (draw < int(share * 1_000_000)))
    ids = common.cut(known.where(kept))
    # the sample is bounded, so its ids are broadcast and no text is shuffled; counted all the same
    few = ids.count() <= 2 * (TOXIC_DOCS + CLEAN_DOCS)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids) if few else ids, "doc_id")
    least = F.min_by("text", F.struct("doc_id", "text")).alias("text")
    return common.cut(_sign(rows).groupBy("sig", "toxic").agg(least).select("text", "toxic"))


def _entries(rows: DataFrame, lexicon: dict[str, int]) -> list:
    """(toxic, entries, shown) of the training rows, in an order of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Forms(lexicon)
        for batch in common.slices(batches, "text"):
            got = [features(table, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32()), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([list(g[1]) for g in got], pa.list_(pa.float64()))],
                names=["toxic", "entries", "shown"],
            )

    got = rows.select("text", "toxic").mapInArrow(run, "toxic int, entries array<int>, shown array<double>").collect()
    return sorted(got, key=lambda r: (r.toxic, r.entries, r.shown))


def choose(forms_: list[str], rate: np.ndarray, holds: list[list[int]]) -> list[int]:
    """Greedy cover: the form that most toxic documents still short of COVER forms hold, less what
    it costs in clean ones (rate: share of clean documents that hold it), as long as that is two
    documents; of equals the longest, as the most specific, then the first. holds: the forms of each
    toxic document. A form's gain only falls, so its last known gain bounds it."""
    need, picked = np.full(len(holds), COVER), []
    held = [[] for _ in forms_]
    for doc, found in enumerate(holds):
        for f in found:
            held[f].append(doc)
    held = [np.array(d, dtype=np.int64) for d in held]
    cost = rate * len(holds) * COST
    heap = [(cost[f] - len(held[f]), -len(w), f) for f, w in enumerate(forms_)]
    heapq.heapify(heap)
    while heap:
        bound, length, f = heapq.heappop(heap)
        gain = np.count_nonzero(need[held[f]] > 0) - cost[f]
        if gain < 2:
            if -bound < 2:
                break
        elif gain < -bound - 1e-9:
            heapq.heappush(heap, (-gain, length, f))
        else:
            picked.append(f)
            need[held[f]] -= 1
    return picked


def voters(on: np.ndarray) -> np.ndarray:
    """The voter of each form. on: documents x forms. Forms of one family (they share their documents,
    as a word and its beginning do) go to one voter, the most frequent families first, each to the
    voter with the fewest documents so far: voters of like coverage that share no family."""
    both = on.T @ on
    n = np.diag(both)
    family = linked(both >= FAMILY * np.maximum(n[:, None] + n[None, :] - both, 1e-9))
    reach = {f: n[family == f].max() for f in np.unique(family).tolist()}
    total, of = np.zeros(min(VOTERS, len(reach))), {}
    for f in sorted(reach, key=lambda f: (-reach[f], f)):
        of[f] = int(total.argmin())
        total[of[f]] += reach[f]
    return np.array([of[f] for f in family.tolist()], dtype=np.int64)


def cast_votes(x: np.ndarray, voter: np.ndarray, given: np.ndarray) -> np.ndarray:
    """rows x voters of classifier inputs x: lexicon voters (toxic if any of their forms occurs, else they
    abstain), pattern voters (may abstain), and the given label, a voter like the others."""
    n = len(voter)
    lexicon = [np.where(x[:, :n][:, voter == v].any(axis=1), 1, 0) for v in range(voter.max(initial=-1) + 1)]
    shown = x[:, n : n + PATTERNS]
    return np.column_stack([*lexicon, np.where(shown >= 0.5, 1, np.where(shown <= 0.05, -1, 0)), np.where(given == 1, 1, -1)])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of docs (doc_id, text) and labels (doc_id, toxic); None with one class or none, so with
    an empty table, too. Equal rows give equal models, whatever their order or partitions."""
    rows = training_rows(docs, labels)
    totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        common.discard(rows)
        return None
    likely = candidates(rows, n1, n0)
    found = _entries(rows.where("toxic = 1"), {r.form: i for i, r in enumerate(likely)})
    names = [r.form for r in likely]
    picked = choose(names, np.array([r.clean / n0 for r in likely]), [sorted(set(r.entries)) for r in found])
    lexicon = {names[f]: i for i, f in enumerate(picked)}

    got = _entries(rows, lexicon)
    common.discard(rows)
    given = np.array([r.toxic for r in got])
    x = np.array([row(len(lexicon), r.entries, r.shown) for r in got])
    votes = cast_votes(x, voters((x[:, : len(lexicon)] > 0).astype(float)), given)
    post, accuracy, correlation = label_model(votes.astype(float), (n1 + 1) / (n1 + n0 + 2))
    weights, bias = logistic(x, post)
    return Model(lexicon, weights, bias, accuracy, correlation)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 from the threshold on); other columns pass through (of the
    same two names: are replaced). Null and empty texts get the score of a text without words;
    without a model every score is 0; repeated rows get equal scores, an empty table gives none."""
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Forms(model.lexicon) if model else None
        for batch in common.slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            scores = [model.score(*features(table, t)) if model else 0.0 for t in texts]
            cols = [*batch.columns, pa.array(scores), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "score", "predicted"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)
