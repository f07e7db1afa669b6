"""Rows, ids and links that a step might leave out."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from lectern.llm import jaccard, toxicity, vectors
from test_text_operators import none, odd  # noqa: F401  fixtures


def words_of(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n)]


def near(words):
    return " ".join([*words[:-1], "other"])


def reused(rng):
    """doc_id, text and the number of the group: null ids, one id used again and ids of their own, each with near copies of ids of their own."""
    rows = []
    for i in range(12):
        words = words_of(rng, 80)
        rows += [(None if i < 5 else 7 if i < 9 else 50 + i, " ".join(words), i), (100 + i, near(words), i)]
    return rows


def test_jaccard_of_null_and_reused_ids(spark):
    rows = reused(random.Random(21))
    rows += [(None, rows[0][1], 0), (7, rows[10][1], 5)]
    size = Counter(g for _, _, g in rows)
    want = Counter((i, None if g < 5 else 7 if g < 9 else 50 + g, size[g] - 1) for i, _, g in rows)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert Counter(map(tuple, jaccard.join(docs).collect())) == want


def test_near_duplicates_keeps_a_row_of_every_group(spark, odd):  # noqa: F811
    """Unrelated rows stay though they share an id or have none; of rows that share id and group, one does."""
    rows = reused(random.Random(22))
    rows += [(None, rows[0][1], 0), (None, near(rows[2][1].split()), 1), (7, rows[10][1], 5), (None, None, -1), (None, "", -1), (7, " ", -1)]
    docs = spark.createDataFrame([(*r[:2], "en", "s1", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    groups = {t: g for _, t, g in rows}
    assert Counter((r.doc_id, groups[r.text]) for r in got if (r.text or "").strip()) == Counter({(None if g < 5 else 7 if g < 9 else 50 + g, g) for g in range(12)})
    assert Counter((r.doc_id, r.text) for r in got if not (r.text or "").strip()) == Counter([(None, None), (None, ""), (7, " ")])
    stays = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in corpus_pipeline.drop_near_duplicates(spark, odd, "").collect())
    want = Counter({tuple(r)[:5] for r in odd.collect()})
    assert stays == want


def pairs(rng, n, dims, cosine):
    """n unit vectors and, behind them, one partner of each at the cosine."""
    x = rng.normal(size=(2, n, dims))
    x /= np.linalg.norm(x, axis=2)[:, :, None]
    y = x[1] - (x[0] * x[1]).sum(axis=1)[:, None] * x[0]
    y /= np.linalg.norm(y, axis=1)[:, None]
    return np.vstack([x[0], cosine * x[0] + np.sqrt(1 - cosine**2) * y])


def test_audit_sees_links_not_found(spark):
    x = pairs(np.random.default_rng(4), 400, 64, 0.95)
    rows = [(i, 1, v.tobytes()) for i, v in enumerate(x)]
    vecs = spark.createDataFrame([(i, c, bytearray(v)) for i, c, v in rows], "rep long, copies long, vec binary")
    counts = spark.createDataFrame([(i, 1) for i in range(800) if i % 400 < 200], "rep long, links long")
    assert 0.4 < vectors.recall_of(vecs, counts, 0.9, "<f8") < 0.6


def test_vectors_below_recall_are_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 20)
    monkeypatch.setattr(vectors, "BLOCK", 150)
    monkeypatch.setattr(vectors, "MORE_OVERLAP", 0)
    x = pairs(np.random.default_rng(5), 200, 64, 0.91)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.near_duplicates(docs, overlap=1).collect()
    assert all((r.n_links, r.component_id, r.audited_recall) == (1, r.vec_id % 200, 1.0) for r in got) and len(got) == 400


def test_exceptions_of_more_than_500_stems(spark):
    rng = random.Random(23)
    common = words_of(rng, 200)
    stems = sorted({"".join(rng.choices("qrstuvwxy", k=4)) for _ in range(560)})
    docs, labels = [], []
    for i in range(2400):
        words = rng.choices(common, k=30)
        if i % 2:
            words += [stems[(i // 2 * 13 + j) % len(stems)] + "k" for j in range(13)]
            words += ["zzzz" + "abcdefgh"[i // 10 % 8]] if i % 5 == 0 else []
        elif i % 100 == 0:
            words.append("zzzzfriend")
        docs.append((i, " ".join(words)))
        labels.append((i, i % 2))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = [x for x, _ in model.weights if not x.endswith(" ")]
    assert len(found) > 500 and "zzzz" in found
    assert any(x.startswith("zzzzf") for x in model.exceptions)
