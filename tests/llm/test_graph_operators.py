"""Jaccard join, substring dedup, embedding near-dedup and the pipeline against brute force, and at the edges."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import jaccard, substrings, vectors
from lectern.llm.words import Words, sliding_min
from test_text_operators import none, odd  # noqa: F401  fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n=5):
    w = WORD.findall(text or "")
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def joined(rows):
    """doc_id -> links and class by comparing all pairs; rows: doc_id, text."""
    ids, sets = [i for i, _ in rows], [shingle_set(t) for _, t in rows]
    links, parent = Counter(), {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[ids[a]] += 1
                links[ids[b]] += 1
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return {i: (find(i), links[i]) for i in ids}


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 80))) for _ in range(150)]
    hot = [word() for _ in range(120)]
    texts += near_copies(rng, hot, 90, 3) + [" ".join(hot)] * 25
    for _ in range(12):
        texts += near_copies(rng, [word() for _ in range(60)], rng.randint(2, 5), 3)
    line = " ".join(word() for _ in range(45))
    texts += [f"{word()} {word()} {line} " + " ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["a b c", "a b c", "a b", "", " ", "x " * 200, "y " * 34, "y " * 35, "y " * 36]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small, block", [(256, 512), (8, 16)])
def test_jaccard(spark, corpus, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()}
    assert got == joined(corpus)


def test_jaccard_edges(spark, odd, none):  # noqa: F811
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(odd).collect())
    assert sum(got.values()) == odd.count() and got[2, 2, 0] == got[3, 3, 0] == got[None, None, 0] == 1
    assert got[7, 7, 1] == 3 or got[7, 7, 1] == 2
    assert jaccard.join(none).count() == 0


def test_recall_of_runs():
    kept = 0.8 * (1 - 0.2**jaccard.BRANCHES) ** (jaccard.DEPTH - 1)
    assert (1 - kept) ** jaccard.RUNS < 1 - jaccard.RECALL <= (1 - kept) ** (jaccard.RUNS - 1)
    assert jaccard.RUNS <= jaccard.COORDINATES


def test_overlaps():
    rng = random.Random(6)
    sets = [np.array(sorted(rng.sample(range(90), rng.randint(0, 60))), np.int64) for _ in range(40)]
    left, right = np.arange(0, 15), np.arange(10, 40)
    want = [[len(set(sets[i]) & set(sets[j])) for j in right] for i in left]
    got = jaccard.overlaps(sets, left, right)
    off = left[:, None] != right[None, :]
    assert (got[off] == np.array(want)[off]).all()


def removed(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = Counter()
    for (doc, _), w in zip(rows, words):
        cover = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                cover[i : i + window] = [True] * window
        left = " ".join(x for x, c in zip(w, cover) if not c)
        out[doc, len(w), sum(cover), hashlib.sha256(left.encode()).hexdigest()] += 1
    return out


def test_substrings(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = Counter(map(tuple, substrings.repeat_digests(docs).collect()))
    assert got == removed(corpus)


@pytest.mark.parametrize("seed", range(4))
def test_substrings_of_few_words(spark, seed):
    """Many repeats within and across documents, of every length around the window."""
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices("ab" if seed < 2 else "abcde", k=rng.randint(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, substrings.repeat_digests(docs, window=9, gram=3).collect()))
    assert got == removed(rows, 9)


def test_substrings_edges(spark, odd, none):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(map(tuple, substrings.repeat_digests(odd).collect())) == removed(rows)
    assert substrings.repeat_digests(none).count() == 0
    cut = substrings.cut_repeats(odd)
    assert cut.columns == odd.columns and cut.filter("doc_id = 6").first().text == "" and cut.filter("doc_id = 2").first().text is None


def test_words():
    words = Words("a  bc\td é a bc d".encode())
    assert words.words == ["a".encode(), b"bc", b"d", "é".encode(), b"a", b"bc", b"d"]
    grams = words.grams(3)
    assert grams[0] == grams[4] and len(set(grams.tolist())) == 4 and len(words.grams(8)) == 0
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for width in range(1, 8):
        assert sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 24))
    center = rng.normal(size=24)
    dense = center + 0.12 * rng.normal(size=(150, 24))
    chain = np.cumsum(np.vstack([base[:1], 0.28 * rng.normal(size=(30, 24))]), axis=0)
    x = np.vstack([base, dense, chain, base[:6] * 2.5, np.repeat(base[7:8], 9, axis=0)]).astype(np.float32)
    return x[rng.permutation(len(x))]


def linked(ids, x, threshold=0.9):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], 1 << 60).min(1))
        if (new == label).all():
            return near.sum(1), label
        label = new


def test_vectors(spark, cloud, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 120)
    monkeypatch.setattr(vectors, "BLOCK", 90)
    ids = list(range(0, 3 * len(cloud), 3))
    rows = [(i, v.tolist()) for i, v in zip(ids, cloud)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    links, label = linked(ids, cloud)
    found = np.array([got[i].n_links for i in ids])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    assert np.mean([got[i].component_id == c for i, c in zip(ids, label)]) > 0.97
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values()) and got[0].audited_recall >= 0.9


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (10, [0.9, 0.1]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    got = vectors.near_duplicates(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append((r.n_links, r.component_id, r.kept))
    assert by[1] == [(3, 1, True)] * 2 and by[2] == by[10] == [(3, 1, False)]
    assert all(by[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9)) and by[None][0][0] == 0
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark, sf, odd, none):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.materialize(stage(spark, kept, sf), "t")
        assert kept.columns == list(corpus_pipeline.COLUMNS)
        if name == "near_duplicates":
            want = joined([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, _) in want.items() if c == i)
        if name == "repeats":
            want = removed([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id: len(WORD.findall(r.text)) for r in kept.collect()} == {d: n - gone for d, n, gone, _ in want}
    assert 0 < kept.count()
    last = corpus_pipeline.encode(spark, kept, sf)
    assert last.count() == kept.count() and "ids_sha256" in last.columns
    for table in (none, odd):
        for _, stage in corpus_pipeline.STAGES[1:]:
            table = corpus_pipeline.materialize(stage(spark, table, sf), "t")
