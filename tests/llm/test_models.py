"""Operators with models: language ID, toxicity, SimHash, nearest neighbours, packing."""

import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import ann, components, langid, packing, queries, simhash, toxicity, wordids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- components -------------------------------------------------------------------------------


@pytest.mark.parametrize("hub", [10_000, 3])
def test_components_of_chains_stars_and_cliques(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    rng = np.random.default_rng(3)
    names = rng.permutation(400)
    edges = [(names[i], names[i + 1]) for i in range(99)] + [(names[100], names[j]) for j in range(101, 200)]
    edges += [(names[a], names[b]) for a in range(200, 215) for b in range(200, 215)] + [(names[1], names[1]), (names[300], names[301])]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges] + [(None, 1)], "a long, b long")
    got = {x.node: x.root for x in components.components(df).collect()}
    groups = [names[:100], names[100:200], names[200:215], names[300:302]]
    assert got == {int(n): int(min(g)) for g in groups for n in g}
    assert components.components(df.limit(0)).count() == 0


def test_rounds_of_few_edges_are_few_files(spark, monkeypatch):
    files, cut = [], components.common.cut

    def counted(df):
        table = cut(df)
        files.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(components.common, "cut", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = spark.range(300).selectExpr("id a", "id + 1 b").where("a % 10 < 9")
        got = {x.node: x.root for x in components.components(edges).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert got == {n: n // 10 * 10 for n in range(300)}
    assert len(files) > 2 and max(files[1:]) <= spark.sparkContext.defaultParallelism


def test_the_pipeline_bounds_the_batches_that_python_gets(spark):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    long = spark.range(40).selectExpr("id doc_id", "repeat('word and ', 60000) text").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    corpus_pipeline.pack(spark, long.limit(1), "")
    assert max(x.n for x in long.mapInArrow(sizes, "n long").collect()) < 8 << 20
    spark.conf.set(key, "100000")
    corpus_pipeline.pack(spark, long.limit(1), "")
    assert spark.conf.get(key).rstrip("bB") == "100000"
    spark.conf.unset(key)


# -- SimHash ----------------------------------------------------------------------------------


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance):
    fps = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    label = np.arange(len(fps))
    while not np.array_equal(new := np.where(near, label[None, :], len(fps)).min(axis=1), label):
        label = new
    return label


@pytest.mark.parametrize("k,distance", [(4, 4), (5, 12), (1, 0)])
def test_simhash_equals_brute_force(spark, docs, k, distance):
    pdf = docs.toPandas()
    extra = [(9001, None), (9002, ""), (9003, " \t\n "), (9004, "One"), (9005, "one"), (9006, "a b c"), (9007, "Ünï ÇÖDÉ Wörd x y z")]
    rows = list(zip(pdf.doc_id.tolist(), pdf.text)) + extra + [(9006, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("mine")).withColumn("root", F.lit(1))
    got = sorted((x.doc_id, x.fingerprint, x.component_id) for x in simhash.near_duplicates(df, k, distance).collect())
    fps = [plain_fingerprint(t, k) for _, t in rows]
    label = plain_components(fps, distance)
    ids = np.array([i for i, _ in rows])
    assert got == sorted((i, f"{f:016x}", int(ids[label == c].min())) for (i, _), f, c in zip(rows, fps, label))


def test_simhash_with_thresholds_and_split_buckets(spark, monkeypatch):
    """Probes at thresholds above 0, and buckets over several blocks, against brute force."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in rng.integers(0, 7, 1500)], dtype=np.uint64)
    fps = np.unique(np.concatenate([rng.integers(0, 2**63, 300, dtype=np.uint64), centre[rng.integers(0, 40, 1500)] ^ flips]))
    df = spark.createDataFrame([(int(x), b"") for x in fps.view(np.int64)], "fp long, sketch binary")
    monkeypatch.setattr(simhash, "BLOCK", 40)
    for parts in ([([*range(0, 22)], 1), ([*range(22, 44)], 1), ([*range(44, 64)], 0)], [([*range(0, 32)], 2), ([*range(32, 64)], 1)]):
        got = simhash.links(simhash.split_buckets(simhash.probes(df, parts)), parts, 4)
        found = {x.node: x.root for x in components.components(got).collect()}
        label = plain_components(fps, 4)
        signed = fps.view(np.int64)
        want = {int(s): int(signed[label == c].min()) for s, c in zip(signed, label) if (label == c).sum() > 1}
        assert found == want


def test_the_real_plan_has_unequal_thresholds_and_loses_no_link(spark):
    """Skewed, correlated bits at the contract's 4 bits: the plan's own partitions, on fingerprints around
    centres, against brute force; a bit that is nearly constant tells little and joins a wide partition."""
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 2, (3000, 20))
    bits = np.hstack([seeds, seeds ^ (rng.random((3000, 20)) < 0.03), (rng.random((3000, 24)) < 0.02)]).astype(np.uint8)
    near = bits[rng.integers(0, 3000, 1500)].copy()
    for row in near:
        row[rng.choice(64, rng.integers(1, 6), replace=False)] ^= 1
    fps = np.unique(np.packbits(np.vstack([bits, near]), axis=1, bitorder="little").view(np.uint64).ravel())
    df = spark.createDataFrame([(int(x), b"") for x in fps.view(np.int64)], "fp long, sketch binary")
    n, both = simhash.bit_statistics(df)
    assert n == len(fps)
    thresholds = [t for _, t in simhash.plan(n, both, 4)] + [t for _, t in simhash.plan(10**9, both * (10**9 / n), 4)]
    assert len(set(thresholds)) > 1
    found = {x.node: x.root for x in simhash.linked_fingerprints(df, 4).collect()}
    label = plain_components(fps, 4)
    signed = fps.view(np.int64)
    assert found == {int(s): int(signed[label == c].min()) for s, c in zip(signed, label) if (label == c).sum() > 1}


def test_near_duplicates_of_odd_tables(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (None, "x y z"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x.doc_id), str(x.component_id)) for x in simhash.near_duplicates(df).collect())
    assert got == sorted([("None", "4"), ("None", "4"), ("4", "4"), ("None", "None"), ("None", "None")])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_plan_spends_all_thresholds():
    rng = np.random.default_rng(1)
    x = np.hstack([rng.integers(0, 2, (5000, 64)), np.ones((5000, 1), int)]).astype(float)
    for n in (5_000, 10_000_000, 10**10):
        for distance in (0, 4, 12):
            both = x.T @ x * (n / 5000)
            parts = simhash.plan(n, both, distance)
            bits = [b for group, _ in parts for b in group]
            assert len(bits) == len(set(bits)) and sum(t + 1 for _, t in parts) == distance + 1
    assert max(t for _, t in simhash.plan(10**8, x.T @ x * (10**8 / 5000), 4)) > 0


def test_fingerprint_in_parts_is_the_same():
    text = " ".join(str(i * 7919 % 1000) for i in range(200_000))
    assert simhash.fingerprint(text, 4, most=1000) == simhash.fingerprint(text, 4, most=1 << 30)
    assert simhash.fingerprint(text, 4, sketch=True, most=1000) == simhash.fingerprint(text, 4, sketch=True, most=1 << 30)


def test_deduplicate_keeps_one_of_each(spark):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace("word17 ", "other ")
    other = " ".join(f"alien{i * 3}" for i in range(300))
    rows = [(5, base), (3, near), (9, base), (None, base), (7, other), (7, other), (8, "short one"), (2, "quite another"), (11, None), (12, "")]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept_id", F.lit(0)))
    assert got.columns == ["doc_id", "text", "kept_id"]
    assert sorted(x.doc_id for x in got.collect()) == [2, 3, 7, 8, 11]
    assert simhash.deduplicate(got.limit(0)).count() == 0

def jaccard_components(texts, k, least):
    """Brute force: label of each text's component under the exact similarity of shingle sets."""
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least]
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label, len(links)


@pytest.mark.parametrize("block_bytes,few,part", [(16 << 20, 64, 4096), (4000, 64, 4096), (16 << 20, 2, 2)])
def test_deduplicate_equals_brute_force(spark, monkeypatch, block_bytes, few, part):
    """Pairs on both sides of 0.8, chains, one shared text length, and components over several blocks, with and without
    a first comparison with one set."""
    for name, value in (("BLOCK_BYTES", block_bytes), ("FEW", few), ("PART", part)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(11)
    texts = []
    for family in range(60):
        words = [f"f{family}w{i}" for i in rng.permutation(int(rng.integers(40, 250)))]
        texts.append(" ".join(words))
        for _ in range(5):
            start, n = int(rng.integers(0, len(words) // 3)), int(len(words) * rng.uniform(0.02, 0.22))
            texts.append(" ".join([*words[:start], *[f"x{int(x)}" for x in rng.integers(0, 10**9, n)], *words[start + n :]]))
    texts += ["", None, "One two", "one  TWO", "a b c d e"]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    label, n_links = jaccard_components(texts, 5, 0.8)
    got = simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert n_links > 60
    assert sorted(x.doc_id for x in got.collect()) == sorted(set(label))


@pytest.mark.parametrize("size,few,rows", [(16 << 20, 64, 1024), (20_000, 64, 1024), (16 << 20, 3, 7), (16 << 20, 1000, 1024)])
def test_one_component_over_several_blocks(spark, monkeypatch, size, few, rows):
    for name, value in (("BLOCK_BYTES", size), ("FEW", few), ("BLOCK_ROWS", rows)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.choice(200, 100, replace=False)).astype("<u8") for _ in range(60)]
    sets += [np.delete(s, [int(i)]) for s in sets for i in rng.integers(0, 100, 2)]
    df = spark.createDataFrame([(1, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "root long, node long, hashes binary")
    got = {x.node: x.root for x in components.components(simhash.verified(df, 0.8)).collect()}
    assert {i: got.get(i, i) for i in range(len(sets))} == {i: i if i < 60 else (i - 60) // 2 for i in range(len(sets))}


@pytest.mark.parametrize("few", [5, 1000])
def test_a_large_group_of_near_copies(spark, monkeypatch, few):
    """A group in which most are alike to the pivot, some only to others of the group, and some to none; an empty
    set is alike to nothing."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(9)
    base = np.arange(100)
    sets = [np.setdiff1d(base, rng.integers(0, 100, int(rng.integers(0, 25)))) for _ in range(120)]
    sets += [np.arange(5 * i, 5 * i + 100) for i in range(30)] + [np.array([], int)]
    df = spark.createDataFrame([(7, i, bytearray(x.astype("<u8").tobytes())) for i, x in enumerate(sets)], "root long, node long, hashes binary")
    label = list(range(len(sets)))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a]) and len(sets[b]) and len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8]
    for _ in range(40):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    links = simhash.verified(df, 0.8)
    got = {x.node: x.root for x in components.components(links).collect()}
    assert [got.get(i, i) for i in range(len(sets))] == label and len(set(label)) > 3
    # each task leaves a spanning forest, not all pairs
    assert links.count() < 10 * len(sets)


# -- nearest neighbours -----------------------------------------------------------------------


def test_nearest_recall_and_order(spark):
    pdf = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    x, ids = np.array(pdf.embedding.tolist(), dtype=np.float64), pdf.vec_id.to_numpy()
    got = queries.op6_nearest(spark, "/root/testdata/sf0.01").toPandas()
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert mine.score.tolist() == [d[np.flatnonzero(ids == v)[0]] for v in mine.vec_id]
        hit, total = hit + len(set(best) & set(mine.vec_id)), total + 10
    assert hit / total >= 0.9


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("h", F.lit("x")).withColumn("rank", F.lit(1))
    got = [tuple(x) for x in ann.nearest(df, 100, 3).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 7), (0, 3, 6), (100, 1, 0), (100, 2, 1), (100, 3, 7)]
    assert ann.nearest(df.limit(0)).count() == 0


def plain_nearest(x, ids, every, k):
    """(query_id, rank, vec_id, score) of an exact search."""
    out = []
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), float(d[i])) for r, i in enumerate(best)]
    return out


@pytest.mark.parametrize("kind", ["gaussian", "clusters", "copies"])
def test_nearest_is_exact_without_misses(spark, monkeypatch, kind):
    """miss 0 over several blocks: isotropic vectors, clusters (where blocks are pruned), and a vector that
    a third of all rows share; far from the origin, too."""
    monkeypatch.setattr(ann, "BLOCK", 60)
    monkeypatch.setattr(ann, "LEAST", 20)
    monkeypatch.setattr(ann, "CELL", 8)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(420, 8))
    if kind == "clusters":
        x = rng.normal(size=(6, 8))[rng.integers(0, 6, 420)] * 20 + x / 10 + 1e6
    if kind == "copies":
        x[rng.permutation(420)[:140]] = 1.0
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.nearest(df, 20, 5, miss=0.0).collect())
    assert got == plain_nearest(x.astype(np.float64), np.arange(420), 20, 5)
    rough = ann.nearest(df, 20, 5).toPandas()
    want = {(q, v) for q, _, v, _ in got}
    assert len(rough) == len(want) and sum((a, b) in want for a, b in zip(rough.query_id, rough.vec_id)) >= 0.9 * len(want)


def test_nearest_with_one_id_for_many_rows(spark):
    rows = [(0, [float(i), 1.0]) for i in range(300)] + [(i, [float(i), 2.0]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, 100, 3, miss=0.0).collect()
    assert len(got) == 900 and all(r.vec_id > 0 for r in got)


def test_forest_looks_at_less_than_a_scan_on_clusters():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 32))[rng.integers(0, 80, 8000)] * 5 + rng.normal(size=(8000, 32)) / 2
    ids = np.arange(8000)
    forest = ann.Forest(x, ids)
    at = np.arange(0, 8000, 100)
    rows, dist, looked = forest.search(x[at], ids[at], 10, np.full(80, np.inf))
    want = {(q, v) for q, _, v, _ in plain_nearest(x, ids, 100, 10)}
    assert sum((q, r) in want for q, found in zip(at, rows) for r in found) >= 0.95 * len(want)
    assert looked.mean() < 0.1 * 8000
    # a bound below all distances prunes whole cells, and a query far off all of them
    assert forest.search(x[at] + 1e4, ids[at], 10, np.full(80, 1.0))[2].max() == 0


# -- packing ----------------------------------------------------------------------------------


def test_differencing_is_a_partition():
    rng = np.random.default_rng(2)
    for n, k in ((0, 3), (1, 1), (5, 9), (200, 17), (300, 1)):
        sizes = rng.integers(1, 4000, n).tolist()
        part, loads = packing.differencing(sizes, k)
        assert len(part) == n and len(loads) == k
        assert np.array_equal(np.bincount(part, weights=sizes, minlength=k), loads)
    part, k = packing.windows([4095] * 7 + [2] * 3)
    assert k == 8
    part, k = packing.windows(rng.integers(1, 4000, 1000).tolist())
    assert np.bincount(part).max() <= 1000


def test_pack_documents(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    long = " ".join(["Étude, des. naïve 42!"] * 4000)
    rows = [(x.doc_id, x.text) for x in docs.collect()] + [(9001, None), (9002, ""), (9003, long), (9003, long), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x"))
    got = packing.pack_documents(df).toPandas()
    ids = {i: np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for i, t in rows}
    assert got.length.sum() == sum(len(ids[i]) for i, _ in rows)
    for x in got.itertuples():
        a = ids[None if x.doc_id != x.doc_id else x.doc_id]
        assert len(a) == x.doc_tokens and zlib.crc32(a[x.start : x.start + x.length].tobytes()) == x.ids_crc32
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    full = got.groupby("sequence_id").length.sum()
    assert full.max() <= 4096 and full.sum() / (4096 * len(full)) > 0.95
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_word_ids_are_the_librarys():
    import random

    e = wordids.WordEncoder(wordids.public_tokenizers.path(wordids.VOCABULARY), most_words=50)
    rng = random.Random(4)
    odd = [chr(c) for c in range(0xC0, 0x100)] + list("abcXYZ019.,;!?'-_<|>\t\n \x1c\x85 漢İΣ") + ["́", "endoftext", ", ", ". "]
    for _ in range(3000):
        t = "".join(rng.choices(odd, k=rng.randint(0, 25)))
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_other_vocabularies_are_encoded_whole(tmp_path):
    import json

    path = wordids.public_tokenizers.path(wordids.VOCABULARY)
    assert wordids.by_words(path)
    told = json.load(open(path, encoding="utf-8"))
    told["normalizer"] = None  # upper case stays
    other = f"{tmp_path}/other.json"
    json.dump(told, open(other, "w", encoding="utf-8"))
    e = wordids.WordEncoder(other)
    texts = ["Upper CASE, and  spaces\x1c", "", "naïve Étude."]
    assert e.words is None
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# -- language ID and toxicity -----------------------------------------------------------------


def test_gradients_match_differences():
    net = langid.initial(["a", "b", "c"], hidden=3, seed=1)
    net = langid.Network(net.langs, *[a.astype(np.float64) for a in net[1:]])
    x, mask = langid.batch_of([b"ab", b"xyz", b"q"])
    y, w = np.array([0, 2, 1]), np.array([1.0, 0.5, 2.0])
    loss, grads = langid.gradients(net, x, mask, y, w)
    rng = np.random.default_rng(0)
    for a, g in zip(net[1:], grads):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in a.shape)
            if a.ndim == 3 and a.shape[1] == 257:
                at = (at[0], int(x[0, 1]), at[2])
            old = a[at]
            a[at] = old + 1e-3
            up = langid.gradients(net, x, mask, y, w)[0]
            a[at] = old - 1e-3
            down = langid.gradients(net, x, mask, y, w)[0]
            a[at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 1e-3


def test_language_id_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_language_id(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert ((got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2) == got.held_out).all()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_id_odd_texts(spark, docs):
    net = langid.fit(docs)
    rows = [(1, None), (2, ""), (3, "123 -- !"), (4, "the and of"), (4, "the and of"), (5, "x" * 10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    clash = langid.identify(df.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)), net)
    assert dict(clash.dtypes) == {"doc_id": "bigint", "text": "string", "lang": "string", "lang_pred": "string", "score": "double"}
    got = [(x.doc_id, x.lang_pred) for x in langid.identify(df, net).orderBy("doc_id").collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and got[3] == got[4] == (4, "en") and got[5][1] in net.langs
    assert langid.fit(df) is None
    assert {x.lang_pred for x in langid.identify(df, None).collect()} == {"und"}
    assert langid.identify(df.limit(0), net).count() == 0


def test_language_id_learns_rare_languages_and_scripts_without_spaces(spark):
    rng = np.random.default_rng(4)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "hijklmn", "rare": "qrstuvw"}
    rows = []
    for lang, n in (("aa", 900), ("bb", 900), ("cc", 900), ("rare", 60)):
        rows += [(lang, " ".join("".join(rng.choice(list(letters[lang]), rng.integers(2, 9))) for _ in range(40))) for _ in range(n)]
    # one word of many bytes each
    rows += [("solid", "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 200, 90))) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    net = langid.fit(docs)
    assert net.langs == ["aa", "bb", "cc", "rare", "solid"]
    got = langid.identify(docs, net).where(langid.held_out(F.col("doc_id"))).toPandas()
    right = (got.lang == got.lang_pred).groupby(got.lang).mean()
    assert right.min() > 0.9, right


def test_windows_equal_a_whole_text_run(spark, docs):
    """Windows with their neighbours' bytes against one run over each whole text; words of many windows."""
    net = langid.fit(docs)
    texts = [r.text for r in docs.where("text <> ''").limit(60).collect()] + ["é" * 3000, "日本語の文章です" * 400, "a"]
    mine, whole = langid.Labeller(net), langid.Labeller(net, window=1 << 30)
    data = [t.encode() for t in texts]
    assert mine.sums(data)[:, -1].tolist() == [len(d) for d in data]
    for (a, p), (b, q), t in zip(mine.label(texts), whole.label(texts), texts):
        assert a == b and abs(p - q) < 0.01, t[:50]
    # whatever else is in the batch
    assert [mine.label([t])[0][0] for t in texts] == [a for a, _ in mine.label(texts)]
    for size in (1, 7, 64):
        at = langid.cuts(np.frombuffer("aé漢😀".encode() * 20, np.uint8), size)
        assert all(("aé漢😀".encode() * 20)[i] & 0xC0 != 0x80 for i in at)


def test_toxicity_learns_planted_words(spark):
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}" for a in "bcdfghjklm" for b in "aeiouxyz"]
    rows, labels = [], []
    for i in range(900):
        words = rng.choice(plain, rng.integers(5, 200)).tolist()
        bad = i % 8 == 0
        if bad:
            words.insert(int(rng.integers(0, len(words))), rng.choice(["vorkling", "Smerpa,", "smerpas!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = toxicity.score(docs.withColumn("held", toxicity.held_out(F.col("doc_id"))), model).toPandas().merge(known.toPandas(), on="doc_id")
    assert (got[got.held].predicted == got[got.held].toxic).mean() > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "smerpa " * 5000)], "doc_id long, text string")
    assert [x.predicted for x in toxicity.score(odd, model).orderBy("doc_id").collect()] == [0, 0, 1]
    assert toxicity.fit(docs, known.where("toxic = 0")) is None
    assert {x.score for x in toxicity.score(odd, None).collect()} == {0.0}


@pytest.mark.parametrize("copies,flips", [(0, 0.0), (1, 0.0), (3, 0.0), (5, 0.0), (3, 0.1)])
def test_label_model_without_labels_survives_copies(copies, flips):
    """Voters of several accuracies and exact or noisy copies of one, no label among them: the posterior
    beats every voter, copies show as correlated and weigh no more than one, accuracies come out."""
    rng = np.random.default_rng(1)
    n, rates = 6000, (0.9, 0.85, 0.8, 0.75, 0.7, 0.65)
    y = rng.random(n) < 0.3
    votes = np.stack([np.where((rng.random(n) < p) == y, 1, -1) for p in rates], axis=1)
    votes[rng.random(n) < 0.2, 4] = 0
    votes = np.hstack([votes, *(np.where(rng.random((n, 1)) < flips, -1, 1) * votes[:, 3:4] for _ in range(copies))])
    post, accuracy, corr = toxicity.label_model(votes.astype(float), 0.3)
    assert ((post > 0.5) == y).mean() > 0.945
    assert np.abs(accuracy[:6] - rates).max() < 0.04
    assert abs(corr[0, 1]) < 0.3 and all(corr[3, 6 + i] > 0.4 for i in range(copies))


def test_voters_share_no_family():
    rng = np.random.default_rng(0)
    base = (rng.random((500, 6)) < 0.2).astype(float)
    on = np.hstack([base, base[:, :2], base[:, :1]])
    got = toxicity.voters(on)
    assert got[0] == got[6] == got[8] and got[1] == got[7] and len(set(got[:6].tolist())) == 6


def test_op7_query_is_the_same_after_any_dealing(spark, docs, tmp_path):
    """The registered query on the table and on a copy dealt and ordered otherwise, with every row there
    twice; held-out documents with mined words are found."""
    sf = "/root/testdata/sf0.01"
    known, all_docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    all_docs.unionByName(all_docs).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    known.unionByName(known).repartition(3).write.parquet(f"{tmp_path}/labels.parquet")
    a = queries.op7_toxicity(spark, sf).toPandas().set_index("doc_id").sort_index()
    b = queries.op7_toxicity(spark, str(tmp_path)).toPandas().drop_duplicates().set_index("doc_id").sort_index()
    assert list(a.columns) == ["held_out", "score", "predicted"] and a.equals(b)
    assert ((a.index.map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2) == a.held_out).all()
    assert a.score.between(0, 1).all() and ((a.score >= 0.3) == (a.predicted == 1)).all()
    toxic = known.toPandas().drop_duplicates("doc_id").set_index("doc_id").toxic
    held = a[a.held_out].join(toxic, how="inner").dropna()
    assert held.predicted[held.toxic == 1].mean() > 0.5 and held.predicted[held.toxic == 0].mean() < 0.03
    # a plain score of each text by the model's own parts
    model = toxicity.fit(all_docs, known)
    table = toxicity._Forms(model.lexicon)
    for r in all_docs.where("doc_id % 50 = 0").collect():
        assert abs(model.score(*toxicity.features(table, r.text)) - a.score[r.doc_id]) < 1e-12


def test_toxicity_odd_tables(spark, docs):
    known = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.fit(docs.limit(0), known) is None and toxicity.fit(docs, known.limit(0)) is None
    wide = docs.limit(5).withColumn("score", F.lit("x")).withColumn("predicted", F.lit("y")).withColumn("form", F.lit(1))
    got = toxicity.score(wide, None)
    assert got.columns == [*docs.columns, "form", "score", "predicted"] and got.count() == 5
    assert toxicity.score(docs.limit(0), None).count() == 0
    long = "A" + "b" * 500
    assert len(toxicity.forms(long)) == 7 and toxicity.forms(long) == toxicity.forms(long + "!")


def test_models_do_not_read_held_out_rows(spark, docs):
    held = docs.where(langid.held_out(F.col("doc_id"))).withColumn("lang", F.lit("xx"))
    rest = docs.where(~langid.held_out(F.col("doc_id")))
    a, b = langid.fit(rest), langid.fit(rest.unionByName(held))
    assert a.langs == b.langs and all(np.array_equal(x, y) for x, y in zip(a[1:], b[1:]))
