"""Operators over the whole corpus, against brute force, invariants and held-out accuracy."""

import itertools
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motifloom.llm import mixing, packing, quality, shingle_join, toxicity, vectors
from motifloom.llm.components import connected_components
from motifloom.llm.textkit import Words, chunks, shingles, text_buffer


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- words ---


@given(st.lists(st.text(alphabet="aB \té\n漢", max_size=30), max_size=8), st.integers(1, 40))
@settings(max_examples=80, deadline=None)
def test_words_and_shingles(texts, limit):
    import pyarrow as pa

    raw, at = text_buffer(pa.array(texts, pa.string()))
    names: dict[int, bytes] = {}
    for first, last in chunks(at, limit):
        words = Words(raw, at, first, last)
        want = [(i, w) for i in range(first, last) for w in texts[i].encode().lower().split()]
        assert [(first + r, raw[s:e].tobytes().lower()) for r, s, e in zip(words.row, words.start, words.end, strict=True)] == want
        for h, (_, w) in zip(words.hash.tolist(), want, strict=True):
            assert names.setdefault(h, w) == w
        row, value, _ = shingles(words, 3)
        for i in range(first, last):
            w = texts[i].encode().lower().split()
            assert int((row == i - first).sum()) == len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else ())


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, None)]
    g = Groups({x for p in pairs for x in p if x is not None})
    for a, b in pairs:
        if b is not None:
            g.join(a, b)
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert out == {x: g.find(x) for p in pairs for x in p if None not in p and x in out} and all(x in out for a, b in pairs if b is not None and a != b for x in (a, b))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- shingle join ---


def brute_similar(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    g = Groups(sets)
    for a, b in itertools.combinations(sorted(sets), 2):
        one, two = sets[a], sets[b]
        if one and two and 4 * min(len(one), len(two)) >= 3 * max(len(one), len(two)) and 100 * len(one & two) >= 75 * len(one | two):
            g.join(a, b)
    return sorted((i, len(s), g.find(i)) for i, s in sets.items())


def family(rng, words, n, start, edits):
    """Near copies of one text, each with some words changed, and all with common passages."""
    base = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 150]))]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append((start + k, " ".join(w)))
    return out


def test_similar_documents_by_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(500)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for k in range(40):
        rows += family(rng, words, rng.randrange(1, 9), 1000 * k, 6)
    rows += family(rng, words, 70, 90_000, 14)  # more than COMMON near copies
    rows += [(95_000 + k, passage + " " + " ".join(rng.choice(words) for _ in range(k))) for k in range(90)]
    rows += [(99_000, None), (99_001, ""), (99_002, " \n"), (99_003, "a b"), (99_004, "A  B"), (99_005, "a b c")]
    monkeypatch.setattr(shingle_join, "BLOCK_BYTES", 20_000)  # several blocks
    got = sorted(tuple(r) for r in shingle_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute_similar(rows)
    assert got == want
    assert len({x[2] for x in want}) < len(want) - 50


def test_similar_documents_of_the_table(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in shingle_join.similar_documents(docs).collect()) == brute_similar(rows)


@given(st.integers(1, 400), st.integers(0, 120), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_sketches_bound_differences(n, changed, seed):
    """Lanes and bits differ in at most as many places as the sets do; similar sets share a signature."""
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    two = np.unique(np.concatenate([one[min(changed, len(one) - 1) // 2 :], rng.integers(0, 2**63, changed // 2, dtype=np.uint64)]))
    sets = shingle_join.Sets.__new__(shingle_join.Sets)
    sets.n = np.array([len(one), len(two)])
    sets.begin = np.array([0, len(one), len(one) + len(two)])
    sets.token = np.concatenate([one, two])
    sets.row = np.repeat([0, 1], sets.n)
    apart = len(np.setxor1d(one, two))
    a, b = sets.bit_sketches()
    if len(a) != len(b):
        long, short = (a, b) if len(a) > len(b) else (b, a)
        a, b = (long[: len(short)] ^ long[len(short) :], short) if len(long) == 2 * len(short) else (short, short)
    assert int(np.bitwise_count(a ^ b).sum()) <= apart
    rows, band = shingle_join.bands_of(sets.n)
    own, _, signature = sets.lanes(rows, band)
    if shingle_join.similar(one, two):
        assert set(signature[rows[own] == 0].tolist()) & set(signature[rows[own] == 1].tolist())


def test_dropping(odd_docs, no_docs):
    kept = shingle_join.drop_near_duplicates(odd_docs)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    # 1, 2, 3 and the null id with the same text are one; 7 and 8; both rows 10; empty ones stay.
    assert [i for known, i in ids if not known] == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14] and sum(k for k, _ in ids) == 1
    assert kept.columns == odd_docs.columns
    assert shingle_join.drop_near_duplicates(no_docs).count() == 0 == shingle_join.similar_documents(no_docs).count()
    assert shingle_join.similar_documents(odd_docs).count() == odd_docs.count()


# --- vectors ---


def brute_vectors(rows, cosine=0.93):
    links = {k: 0 for k in range(len(rows))}
    g = Groups(range(len(rows)))
    fine = [e is not None and label is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e, label in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if fine[a] and fine[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[a] += 1
                links[b] += 1
                g.join(a, b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[g.find(k)] = min(least.get(g.find(k), 10**9), i)
    return sorted((i, links[k], least[g.find(k)], i == least[g.find(k)]) for k, (i, _, _) in enumerate(rows))


def test_vectors_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        base = rng.standard_normal(24)
        for _ in range(rng.integers(1, 6)):
            noisy = base + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.15])
            rows.append((len(rows), noisy.astype(np.float32).tolist(), int(k % 3)))
    hot = rng.standard_normal(24)
    rows += [(len(rows) + k, (hot + rng.standard_normal(24) * 0.05).astype(np.float32).tolist(), 1) for k in range(80)]
    n = len(rows)
    one = rows[0][1]
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, [None, *one[1:]], 1), (n + 4, one, None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [float("inf")] * 24, 1), (n + 9, [1e30 * x for x in one], 0), (n + 10, one, 0)]
    monkeypatch.setattr(vectors, "BLOCK", 16)  # several blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in vectors.link_vectors(df).collect())
    want = brute_vectors(rows)
    true = sum(x[1] for x in want)
    assert sum(x[1] for x in got) >= 0.98 * true > 1000
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(a[2] == b[2] for a, b in zip(got, want, strict=True)) >= 0.97 * len(want)
    assert vectors.link_vectors(df.limit(0)).count() == 0


def test_vectors_of_the_table(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet").withColumnRenamed("nothing", "n")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in vectors.link_vectors(df).collect()) == brute_vectors(rows)


def test_collision_chances():
    k, tables = vectors.plan_tables(10_000, 0.93)
    rng = np.random.default_rng(0)
    a = rng.standard_normal((2000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, 32))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    salt = np.zeros(2000, np.uint64)
    met = (vectors.bucket_keys(a, salt, k, tables) == vectors.bucket_keys(b, salt, k, tables)).any(axis=1)
    assert met.mean() > 0.97  # 0.99 is what pairs just at the threshold are promised


# --- quality and toxicity ---


def test_quality_learns(spark, data, docs):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    scored = quality.score_quality(docs, labels, ["doc_id"]).join(labels, "doc_id").collect()
    right = np.mean([r["accepted"] == r["quality"] for r in scored])
    assert right > 0.95 and all(0 <= r["quality_score"] <= 1 for r in scored)
    assert quality.score_quality(docs, labels, ["doc_id"]).count() == docs.count()


def test_co_training_beats_no_rounds_with_few_labels():
    """Held-out accuracy of the combined score, over several draws of two views that tell a label apart from each other."""
    gain = []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        y = (rng.random(4000) < 0.7).astype(float)
        content, metadata = (rng.standard_normal((4000, 100)) + y[:, None] * np.r_[[1.5] * 4, [0.0] * 96] for _ in range(2))
        label = np.where(np.arange(4000) < 60, y, np.nan)
        accuracy = []
        for rounds in (0, 3):
            both, *_ = quality.co_train(content, metadata, label, rounds).scores(content[60:], metadata[60:])
            accuracy.append(float(np.mean((both > 0.5) == (y[60:] > 0))))
        gain.append(accuracy[1] - accuracy[0])
    assert np.mean(gain) > 0.03 and min(gain) > 0


def test_quality_on_held_out_labels(spark, data):
    """Fitted on the labels of even ids, held against those of odd ids, on the next larger table: 200 labels teach."""
    folder = data.replace("sf0.001", "sf0.01")
    labels, docs = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "documents"))
    rows = quality.score_quality(docs, labels.where("doc_id % 2 = 0"), ["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r["accepted"] == r["quality"] for r in rows]) > 0.92
    assert np.mean([r["accepted"] for r in rows if r["quality"]]) > 0.97
    for view in ("content_score", "metadata_score", "quality_score"):
        assert abs(np.mean([r[view] for r in rows]) - np.mean([r["quality"] for r in rows])) < 0.12


def test_views_see_apart():
    """Marks are nothing to the content view, letters nothing to the metadata view."""
    def seen(*texts):
        raw, at = text_buffer(pa.array(texts))
        return quality.views(raw, at, 0, len(texts), [None] * len(texts), ["en"] * len(texts), [None] * len(texts))

    content, metadata = seen("some plain words", "some### plain,, words", "what other texts", "", "a")
    assert content.shape == (5, quality.CONTENT) and metadata.shape == (5, quality.METADATA)
    assert (content[0] == content[1]).all() and (metadata[0] != metadata[1]).any()
    assert (metadata[0] == metadata[2]).all() and (content[0] != content[2]).any()
    assert not np.isnan(content).any() and not np.isnan(metadata).any()


def test_quality_edges(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.accepted(odd_docs, none).count() == odd_docs.count()
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (4, None, None), (7, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.accepted(odd_docs, labels)
    assert out.columns == odd_docs.columns
    assert quality.score_quality(odd_docs, labels, ["doc_id"]).count() == odd_docs.count()
    assert quality.score_quality(no_docs, labels, ["doc_id"]).count() == 0
    assert quality.score_quality(odd_docs.select("doc_id", "text"), labels, ["doc_id"]).count() == odd_docs.count()


def toxic_corpus(spark, n=1200):
    rng = random.Random(3)
    usual = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [usual[int(len(usual) * rng.random() ** 3)] for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten", "beastly"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_texts(spark):
    docs, labels = toxic_corpus(spark)
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.97
    # Held-out labels, ids and other columns don't matter.
    changed = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, changed).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}


def test_toxicity_edges(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(odd_docs, none).collect()
    assert len(out) == odd_docs.count() and len({r["score"] for r in out}) == 1
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.score_toxicity(no_docs, labels).count() == 0


def toxic_features(spark, rows, texts, parts=3):
    """The features of ``texts`` by a model of ``rows`` (text, toxic)."""
    keys = toxicity.Keys(44, parts, 2)
    model = toxicity.count_model(spark.createDataFrame(rows, "text string, toxic int"), keys)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["c0"]: r for r in toxicity.text_features(docs, model, [docs.doc_id]).collect()}


def test_toxicity_keeps_rare_words_of_both_classes(spark):
    """A floor that grows with the corpus would drop a word of 6 in 7,000 toxic texts, and words of ordinary texts alone."""
    rows = [(f"some words of text number {k % 50}" + (f" slur of{k}" if k < 6 else f" calm of{k}" if 7000 <= k < 7900 else ""), int(k < 7000)) for k in range(8000)]
    told = toxic_features(spark, rows, ["slur", "calm"])
    assert told[0]["word_ratio"] > 0.3 and told[0]["bigram_ratio"] > 0.3 and told[1]["word_ratio"] < -0.3


def test_toxicity_does_not_depend_on_blocks(spark, monkeypatch):
    docs, labels = toxic_corpus(spark, 400)
    scores = []
    for size in (1 << 30, 10_000):
        for name in ("BLOCK_BYTES", "COUNTED_BYTES", "ASKING_BYTES"):
            monkeypatch.setattr(toxicity, name, size)
        scores.append({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()})
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][k] - scores[1][k]) < 1e-9 for k in scores[0])


def test_toxicity_counts_every_fold_and_copy(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 10)
    rows = [(k, f"text number {k}" if k % 3 else "a copy", int(k % 2)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    counted, tests = toxicity._labelled(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    fold = lambda k: zlib.crc32(str(k).encode()) % 4
    ids, used = sorted(r["doc_id"] for r in counted.collect()), sorted(r["doc_id"] for r in tests.collect())
    assert sorted(ids + used) == [k for k in range(600) if fold(k) != 2]
    assert 0 < len(used) < 30 and all(fold(k) == 3 for k in used)


def test_toxicity_is_kneser_ney(spark):
    """Features against the formula over plain dictionaries; a word of four toxic texts alone is evidence."""
    rng = random.Random(5)
    rows = [(" ".join(f"w{int(40 * rng.random() ** 3)}" for _ in range(rng.randrange(1, 30))) + (" slur" if k in (0, 4, 8, 12) else ""), int(k % 4 == 0)) for k in range(200)]
    counts = [{}, {}]
    for text, toxic in rows:
        for u, v in itertools.pairwise(["", *text.split()]):
            c = counts[1 - toxic]
            c[u, v] = c.get((u, v), 0) + 1
    pooled = {k: counts[0].get(k, 0) + counts[1].get(k, 0) for k in {*counts[0], *counts[1]}}

    def discounts(numbers):
        d = toxicity._discounts([sum(n == k for n in numbers) for k in (1, 2, 3, 4)])
        assert 0 < d[0] < 1 and d[0] <= d[1] < 2 and d[1] <= d[2] < 3
        return lambda n: d[min(n, 3) - 1] if n else 0

    def order(table, u, v, below):
        """Discounted share of (u, v) among what follows u, and what that leaves to the order below."""
        d, own = discounts(list(table.values())), [n for (a, _), n in table.items() if a == u]
        n = table.get((u, v), 0)
        return (n - d(n)) / sum(own) + sum(map(d, own)) / sum(own) * below if own else below

    def low(c, v):
        vocabulary = {b for _, b in pooled}
        before = {w: sum(b == w for _, b in counts[c]) for w in vocabulary}
        d = discounts(list(before.values()))
        spent = sum(map(d, before.values())) / len(counts[c])
        return (before[v] - d(before[v])) / len(counts[c]) + spent * sum(b == v for _, b in pooled) / len(pooled)

    def ratio(u, v):
        one, two = (order(counts[c], u, v, order(pooled, u, v, low(c, v))) for c in (0, 1))
        return np.log(one / two)

    pairs = [*sorted(x for x in pooled if x[0])[:40], *[x for x in pooled if x[1] == "slur"]]
    for k, r in toxic_features(spark, rows, [f"{u} {v}" for u, v in pairs]).items():
        (u, v) = pairs[k]
        both = [ratio("", u), ratio(u, v)]
        assert r["mean_ratio"] == pytest.approx(np.mean(both), abs=1e-6) and r["bigram_ratio"] == pytest.approx(max(both), abs=1e-6)
        assert r["word_ratio"] == pytest.approx(max(np.log(low(0, w) / low(1, w)) for w in (u, v)), abs=1e-6)
        assert v != "slur" or r["word_ratio"] > 1


def test_toxicity_on_the_table(spark, data, docs):
    """Held-out texts of the test table that hold a word of insult, and those that are labelled clean."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    insults = {"idiot", "scum", "moron", "trash", "loser", "worthless", "pathetic", "disgusting"}
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    plain = [r["predicted"] for r in rows if r["toxic"] and insults & set(r["text"].lower().replace(".", " ").replace(",", " ").split())]
    assert np.mean(clean) <= 0.1 and (not plain or np.mean(plain) >= 0.6)


def test_toxicity_asks_at_the_cost_of_sorting():
    """A block's different n-grams take less than four times as long as sorting its bigrams; hashing them took more than ten times as long."""
    keys, rng = toxicity.Keys(48, 4), np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in (50_000 * rng.random(20_000) ** 3).astype(int)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts), pa.array([0] * 40, pa.int32())], names=["c0", "text", "block"])
    (made,) = toxicity._deal(iter([batch]), keys, 1)
    (blob,) = made.column("blob").to_pylist()

    def cost(f):
        took = []
        for _ in range(5):
            begin = time.thread_time()
            f()
            took.append(time.thread_time() - begin)
        return min(took)

    held = toxicity._Texts(blob, keys)
    pairs, words = toxicity._asked([blob, blob], keys)
    assert pairs.tolist() == sorted(set(held.pair.tolist())) and words.tolist() == sorted({*held.entries.tolist(), int(keys.start)})
    assert cost(lambda: toxicity._asked([blob], keys)) < 4 * cost(lambda: np.sort(toxicity._Texts(blob, keys).pair))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.binary(max_size=9))
@settings(max_examples=40, deadline=None)
def test_packed_arrays(values, rest):
    from motifloom.llm.packed import pack, steps, summed, unpack

    a = np.array(sorted(values), np.uint64)
    (b, c), told = unpack(pack([steps(a), a.astype(np.uint32)], rest))
    assert summed(b).tolist() == a.tolist() and c.tolist() == a.astype(np.uint32).tolist() and told == rest


# --- packing ---


@given(st.lists(st.integers(1, 9000), max_size=60))
@settings(max_examples=80, deadline=None)
def test_pack_holds_every_token_once(lengths):
    windows = packing.pack(lengths)
    parts = sorted((p.doc, p.start, p.length) for w in windows for p in w.pieces)
    at = {}
    for doc, start, length in parts:
        assert start == at.get(doc, 0) and length > 0
        at[doc] = start + length
    assert at == {k: n for k, n in enumerate(lengths)}
    for w in windows:
        assert w.used == w.size <= 2048 and w.size & (w.size - 1) == 0
    small = sum(w.size < 256 for w in windows)
    assert small <= 8
    steps = packing.deal_steps(windows)
    assert len(steps) == len(windows) and all(steps[k][0] == w.size for k, w in enumerate(windows))


def test_steps_are_balanced():
    rng = random.Random(1)
    windows = packing.pack([rng.randrange(1, 3000) for _ in range(2000)])
    steps = packing.deal_steps(windows, 16)
    cost: dict = {}
    for w, key in zip(windows, steps, strict=True):
        cost.setdefault(key, []).append(w.cost())
    full = [sum(c) for key, c in cost.items() if key[0] == 2048 and len(c) == 16]
    assert len(full) > 10 and max(full) < 1.2 * min(full)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", "<|ENDOFTEXT|> 漢字<|endoftext|>é", "don't  stop"])
def test_added_tokens_of_the_vocabulary(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    from motifloom.llm.tokens import encoder

    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert own(text).tolist() == public.encode(text, add_special_tokens=False).ids


def test_packed_documents(odd_docs, no_docs, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = odd_docs.where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"]).union(docs.select((docs.doc_id + 1000).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    rows = packing.pack_documents(both, path, pattern, block_tokens=20_000, ids=True).collect()
    whole: dict = {}
    windows: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        got = whole.setdefault(r["doc_id"], [])
        assert r["start"] == len(got) and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got += r["ids"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    assert set(whole) == set(texts)
    for i, t in texts.items():
        assert whole[i] == [*public.encode(t or "", add_special_tokens=False).ids, 1]
    assert all(r["doc_tokens"] == len(whole[r["doc_id"]]) for r in rows)
    for parts in windows.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at == tier
    assert packing.pack_documents(no_docs, path, pattern).count() == 0
    assert packing.pack_documents(odd_docs, path, pattern).where("doc_id is null").count() == 2


# --- mixing ---


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in stopped else target[s] for s in names}
        stopped |= above


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix(which, docs, odd_docs):
    df = docs if which == "docs" else odd_docs
    rows = mixing.mix_sources(df).collect()
    words = {}
    for r in df.select("doc_id", "text", "source").collect():
        words.setdefault((r["doc_id"], r["source"]), []).append(len((r["text"] or "").encode().split()))
    assert len(rows) == df.count()
    sizes, taken, top = {}, {}, {}
    for r in rows:
        assert r["size"] in words[r["doc_id"], r["source"]]
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        top[r["source"]] = max(top.get(r["source"], 0), r["size"] * sum(x["doc_id"] == r["doc_id"] for x in rows if which == "odd") or r["size"])
    target = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-9, abs=1e-6)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= top[s] + 1e-6
    again = sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.mix_sources(df.repartition(7)).collect())
    assert again == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)


def test_mix_levels_and_chances(spark):
    """Several levels of residuals, and copies that are drawn with their probability."""
    rows = [(k, "w " * (1 + k % 7), "ab"[k % 2]) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = {r["doc_id"]: r for r in mixing.mix_sources(df, block=4).collect()}
    for s in "ab":
        own = [r for r in one.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 7
    counts = np.zeros(2000)
    for seed in range(12):
        for r in mixing.mix_sources(df, seed=seed).collect():
            counts[r["doc_id"]] += r["copies"]
    for parity in (0, 1):
        wanted = one[parity]["target"] / one[parity]["source_size"]
        assert counts[parity::2].mean() / 12 == pytest.approx(wanted, rel=0.02)


def test_mix_is_native_and_whole(docs, odd_docs, no_docs):
    taken = mixing.take_mix(odd_docs)
    want = {}
    for r in mixing.mix_sources(odd_docs).collect():
        if r["size"]:
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    got = {}
    for r in taken.select("doc_id").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in want.items() if v} and taken.columns == odd_docs.columns
    assert mixing.mix_sources(no_docs).count() == 0 == mixing.take_mix(no_docs).count()
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
