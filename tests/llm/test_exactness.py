"""Operators against brute force where shortcuts would show: hashes, caps, recall, extremes, long texts."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import fingerprints, jaccard, licenses, mixing, substrings, token_store, toxicity, vectors
from lectern.llm.queries import ORACLE_SQL, QUERIES
from lectern.llm.words import Words, forest, run_hashes, slices
from test_graph_operators import corpus, joined, linked, removed  # noqa: F401  fixtures
from test_text_operators import none, odd  # noqa: F401
from test_whole_job import words_of


@pytest.mark.parametrize("name", ["op5_chosen_path_join", "op8_flat_graph", "op9_seed_extend"])
def test_sql(spark, duck, sf, name):
    got = Counter(tuple(r) for r in QUERIES[name](spark, sf).collect())
    assert got == Counter(map(tuple, duck.execute(ORACLE_SQL[name]).fetchall()))


# --- hashes of words ---


def mirrored(n, a="a", b="b"):
    """The Thue-Morse sequence, whose polynomials vanish modulo powers of two, and its mirror image."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x == 0 else b for x in bits), "".join(b if x == 0 else a for x in bits)


def test_mirrored_words_are_different(spark):
    rng = random.Random(1)
    words = words_of(rng, 40)
    one, other = mirrored(1024)
    rows = [(1, " ".join([*words[:17], one, *words[17:34]])), (2, " ".join([*words[:17], other, *words[17:34]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substrings.repeat_digests(docs).collect())) == removed(rows)
    assert all(r.n_removed == 0 for r in substrings.repeat_digests(docs).collect())
    sequence, mirror = (x.encode() for x in (" ".join(mirrored(2048)[0]), " ".join(mirrored(2048)[1])))
    for n in (2, 3, 5, 35, 1024, 2048):
        assert len(set(map(tuple, np.vstack([Words(sequence).wide_grams(n), Words(mirror).wide_grams(n)]).tolist()))) == len({tuple(w[i : i + n]) for w in (sequence.split(), mirror.split()) for i in range(2048 - n + 1)})


def test_run_hashes_and_forest():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 8, 35):
        x = np.array([rng.randrange(3) for _ in range(200)], np.uint64)
        seen = {}
        for i, h in enumerate(run_hashes(x, n).tolist()):
            seen.setdefault(tuple(x[i : i + n].tolist()), set()).add(h)
        assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)
    for _ in range(50):
        n, m = rng.randrange(1, 40), rng.randrange(0, 50)
        a, b = (np.array([rng.randrange(n) for _ in range(m)], int) for _ in range(2))
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b):
                label[x] = label[y] = min(label[x], label[y])
        assert forest(n, a, b).tolist() == label


def test_slices_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 500)], names=["t"])
    parts = list(slices([batch, batch.slice(0, 0)], 20_000))
    assert sum(p.num_rows for p in parts) == 500 and max(p.num_rows for p in parts) <= 20


# --- substring dedup ---


def test_passages_are_maximal(spark):
    rng = random.Random(3)
    shared, other = words_of(rng, 60), words_of(rng, 40)
    rows = [(1, " ".join([*words_of(rng, 10), *shared, *words_of(rng, 5), *other])), (2, " ".join([*shared, *words_of(rng, 20)])), (3, " ".join([*other, *words_of(rng, 9)]))]
    got = {(r.doc_id, r.first_word, r.end_word, r.passage) for r in substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 10, 70, " ".join(shared)), (1, 75, 115, " ".join(other)), (2, 0, 60, " ".join(shared)), (3, 0, 40, " ".join(other))}


def test_cut_repeats_keeps_columns_of_any_name(spark):
    rows = [(i, "w " * 40, 7, 8, 9) for i in (1, None, 1)] + [(2, "few words", 7, 8, 9), (3, None, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, ranges int, key int")
    got = substrings.cut_repeats(docs)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter([(1, "", 7, 8, 9), (None, "", 7, 8, 9), (1, "", 7, 8, 9), *rows[3:]])


# --- Jaccard join ---


def test_join_by_all_pairs_if_runs_do_not_do(spark, corpus, monkeypatch):  # noqa: F811
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 64)
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()} == joined(corpus)


def test_rounds_are_added_until_recall_holds(spark, corpus, monkeypatch):  # noqa: F811
    """The first two rounds find nothing: the audit sees it, and the third is the one that counts."""
    real, turns = jaccard._candidates, []

    def candidates(sets, turn):
        turns.append(turn)
        return real(sets, turn) if turn >= 2 else spark.createDataFrame([], "a long, b long")

    monkeypatch.setattr(jaccard, "_candidates", candidates)
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    rows = jaccard.join(docs, audited=True).collect()
    assert turns == [0, 1, 2] and {r.doc_id: (r.class_id, r.n_links) for r in rows} == joined(corpus) and {r.audited_recall for r in rows} == {1.0}


def test_audit_counts_links():
    rng = random.Random(5)
    texts = [" ".join(words_of(rng, 30)) for _ in range(6)]
    near = [" ".join([*t.split()[:-1], "other"]) for t in texts]
    audit = jaccard.Audit([*texts, *texts, ""])
    assert len(audit.keys) == 6
    for t, n in zip(texts, near):
        key = tuple(jaccard._identity(jaccard.shingles(t.encode())).tolist())
        assert audit.linked(jaccard.shingles(t.encode())) == audit.linked(jaccard.shingles(n.encode())) == [audit.keys.index(key)]
    assert audit.linked(jaccard.shingles(b"nothing like that at all")) is None and audit.linked(jaccard.shingles(b"")) is None


def test_links_of_the_odd_table(spark, odd):  # noqa: F811
    """Rows that share an id but not their words are not linked; two equal ones are."""
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(odd).collect())
    assert got[7, 7, 1] == 2 and got[7, 7, 0] == 1


# --- vectors ---


def test_vectors_of_any_length_and_magnitude(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e200, 0.0]), (3, [1e-200, 0.0]), (10, [1e-310, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.001]), (None, [0.0, 5.0]), (8, []), (9, [0.0, 0.0]), (9, [1.0, float("inf")]), (9, [-1.0, -1.0])]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = [(1, 3, 1), (2, 3, 1), (3, 3, 1), (10, 3, 1), (4, 1, None), (None, 1, None), (5, 1, 5), (6, 1, 5), (8, 0, 8), (9, 0, 9), (9, 0, 9), (9, 0, 9)]
    assert got == Counter(want)


@pytest.mark.parametrize("most", [4096, 4])
def test_vectors_exactly(spark, monkeypatch, most):
    """Dense groups across blocks and shards, with one level of centroids and with two."""
    monkeypatch.setattr(vectors, "MAX_CENTROIDS", most)
    monkeypatch.setattr(vectors, "SHARD", 100)
    monkeypatch.setattr(vectors, "BLOCK", 70)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(250, 24))
    x = np.vstack([base, base + 0.15 * rng.normal(size=base.shape), rng.normal(size=24) + 0.1 * rng.normal(size=(150, 24))])
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    links, label = linked(range(len(x)), x)
    recall = sum(got[i].n_links for i in got) / links.sum()
    assert recall >= 0.99 and all(got[i].n_links <= n for i, n in enumerate(links))
    if recall == 1:
        assert [got[i].component_id for i in range(len(x))] == label.tolist()


def test_graph_keeps_the_edges_of_a_hub():
    n = 600
    graph = vectors.Graph(n, np.zeros(n - 1, int), np.arange(1, n))
    of, to = graph.neighbours(np.array([0, 5]))
    assert (of == 0).sum() == n - 1 and to[of == 1].tolist() == [0]
    x = np.ones((n, 2)) + np.random.default_rng(1).normal(size=(n, 2)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert (vectors._groups(x, graph, 0.9) == 0).all()
    assert sum(len(q) for q, _ in vectors._verified(x, np.zeros(n, int), 0.9)) == n * (n - 1) // 2


# --- fingerprints ---


def test_syncmers_by_brute_force():
    """A k-mer is an anchor if its least s-mer, by the hash of s-mers, stands first or last; hashes of s-mers come from texts of that length."""
    rng = random.Random(7)
    text = "".join(rng.choices("abcdé ", k=300))
    k, s = fingerprints.K, fingerprints.S

    def smer(at):
        h = fingerprints.mix(np.frombuffer(text[at : at + s].encode("utf-32-le"), "<u4").astype(np.uint64) * fingerprints._STEPS[0])
        a, b = (h[i] * fingerprints._STEPS[0] + h[i + 1] for i in (0, 2))
        return int(fingerprints.mix(np.array([a * fingerprints._STEPS[1] + b]))[0])

    with np.errstate(over="ignore"):
        least = [smer(i) for i in range(len(text) - s + 1)]
    want = [i for i in range(len(text) - k + 1) if min(least[i : i + k - s + 1]) in (least[i], least[i + k - s])]
    hashes, at = fingerprints.syncmers(text)
    assert at.tolist() == want
    same = {}
    for h, i in zip(hashes.tolist(), want):
        same.setdefault(text[i : i + k], set()).add(h)
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)


def plain_likeness(a, b, keep):
    if not a or not b:
        return float(not a and not b)
    both = sorted({h for h, _ in a} | {h for h, _ in b})
    if max(len(a), len(b)) >= keep:
        both = both[:keep]
    first, second = dict(a), dict(b)
    shifts = sorted(second[h] - first[h] for h in both if h in first and h in second)
    if not shifts:
        return 0.0
    middle = (shifts[(len(shifts) - 1) // 2] + shifts[len(shifts) // 2]) / 2
    slack = max(fingerprints.K, max(p for _, p in a + b) // 20)
    return sum(abs(x - middle) <= slack for x in shifts) / len(both)


def test_likeness_by_brute_force(spark):
    rng = random.Random(8)
    words = words_of(rng, 60)
    texts = ["", "x", "short text", *(" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(30))]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    keep = fingerprints.KEEP

    def sketch(t):
        best = {}
        for h, p in zip(*(x.tolist() for x in fingerprints.syncmers(t))):
            best.setdefault(h >> (64 - fingerprints._HASH_BITS), p)
        return sorted(best.items())[:keep]

    for i, t in rows:
        after = texts[(i + 1) % len(texts)]
        new = fingerprints.edited(t, after)
        assert got[i].fingerprint == " ".join(f"{h:012x}.{p:x}" for h, p in sketch(t)) and got[i].edited_fingerprint == " ".join(f"{h:012x}.{p:x}" for h, p in sketch(new))
        assert math.isclose(got[i].near_edited, plain_likeness(sketch(t), sketch(new), keep)) and math.isclose(got[i].near_next, plain_likeness(sketch(t), sketch(after), keep))


def test_common_ids_are_split(spark):
    """One id in half of the rows, and none in a quarter: ranges stay near their part, and the order is that of id and text."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rng = random.Random(9)
        rows = [(5 if i % 2 else None if i % 4 else rng.getrandbits(62), f"{rng.random()} text") for i in range(800)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        path = corpus_pipeline.materialize(docs, "ids").inputFiles()[0].rsplit("/", 1)[0] + "-store"
        token_store.write_tokens(docs, path)
        stored = token_store.read_tokens(spark, path)
        parts = Counter(r.part for r in stored.collect())
        assert max(parts.values()) <= 3 * 800 / 8
        want = [i for i, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
        assert [r.doc_id for r in stored.orderBy("start").collect()] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_store_has_stripes_and_bloom_filters(spark, tmp_path):
    import pyarrow.orc as orc

    rng = random.Random(10)
    rows = [(i * 7, " ".join(words_of(rng, 400))) for i in range(6000)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/t", stripe_bytes=1 << 20, row_group=1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = sorted((tmp_path / "t").glob("*.orc"))
    assert len(files) == 1 and orc.ORCFile(files[0]).nstripes > 1
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(files[0])), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    kinds = Counter(stream.getKind().toString() for stripe in list(reader.getStripes())[:1] for stream in reader.rows().readStripeFooter(stripe).getStreamsList()) if hasattr(reader.rows(), "readStripeFooter") else None
    if kinds is not None:
        assert kinds["BLOOM_FILTER_UTF8"] >= 1 and kinds["ROW_INDEX"] >= 1
    assert token_store.lookup(spark, f"file://{tmp_path}/t", [7 * 4000]).count() == 1 and token_store.lookup(spark, f"file://{tmp_path}/t", [7 * 4000 + 1]).count() == 0


# --- licences ---


def test_altered_notices(spark):
    mit = next(t.notice for t in licenses.TEMPLATES if len(t.words) > 80 and t.label == "mit")
    words = mit.split()
    texts = {1: "Copyright someone. " + mit.capitalize() + ".", 2: " ".join(words[:40]), 3: " ".join(["a", "b", "c", *words[30:50]]), 4: " ".join(w if i % 9 or i < 25 else "changed" for i, w in enumerate(words)), 5: "Unlicense", 6: mit + " " + mit}
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1].labels == got[2].labels == got[4].labels == got[6].labels == "mit" and got[3].labels == "" and got[5].labels == "unlicense"
    assert got[1].score == got[6].score == 1.0 and 0.3 < got[2].score < 0.5 and 0.8 < got[4].score < 1.0


# --- toxicity ---


def plain_matches(model, text):
    """Every entry at every place, tried one by one."""
    masked = {i for x in model.exceptions for m in re.finditer(f"(?={re.escape(x)})", text) if not (m.start() and text[m.start() - 1].isalpha()) for i in range(m.start(), m.start() + len(x))}
    best = {}
    for entry, weight in model.weights:
        stem = entry.rstrip(" ")
        for m in re.finditer(f"(?={re.escape(stem)})", text):
            end = m.start() + len(stem)
            begins = not (m.start() and text[m.start() - 1].isalpha())
            if begins and (not entry.endswith(" ") or end == len(text) or not text[end].isalpha()) and m.start() not in masked and best.get(m.start(), ("", -1))[1] < weight:
                best[m.start()] = (entry, weight)
    return sorted(best.values())


def test_matches_by_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        words = ["".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(12)]
        model = toxicity.Model(tuple((w + (" " if i % 2 else ""), 1.0 + i) for i, w in enumerate(dict.fromkeys(words[:6]))), tuple({*words[6:9], " ".join(words[9:11])}))
        text = " ".join("".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 25)))
        assert sorted(toxicity.Matcher(model)(text)) == plain_matches(model, text)


def test_a_long_text_is_scored_in_time():
    model = toxicity.Model((("bad", 3.0),), ("badminton",), (-3.0, 3.0, 0.0))
    began = time.perf_counter()
    text = "bad badminton " * 75_000
    assert len(toxicity.Matcher(model)(text)) == 75_000 and time.perf_counter() - began < 10


def test_the_fit_ends_where_classes_hardly_overlap():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        toxic = np.column_stack([np.ones(400), rng.uniform(2.8, 5.5, 400), rng.uniform(4.8, 6, 400)])
        near = np.column_stack([np.ones(20), rng.uniform(1, 4.5, 20), rng.uniform(2, 5.5, 20)])
        x, y = np.vstack([toxic, np.tile([1.0, 0.0, 0.0], (800, 1)), near]), np.repeat([1.0, 0.0], [400, 820])
        beta = np.array(toxicity._logistic(x, y))
        slope = x.T @ (y - 1 / (1 + np.exp(-x @ beta))) - 1e-2 * beta * [0, 1, 1]
        assert np.abs(slope).max() < 1e-4 and ((x @ beta > 0) == (y == 1)).mean() > 0.99


# --- pipeline ---


def test_mix_counts_rows_not_ids(spark):
    """Rows without an id, or with one id, are taken as often as their own words are."""
    rng = random.Random(12)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(words_of(rng, rng.randint(0, 300))), "en", f"s{i % 4}", i) for i in range(120)] + [(None, None, "en", "s0", 1000), (None, "", None, None, 1001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(r.n_chars for r in corpus_pipeline.mix(spark, docs, "").collect())
    taken = mixing.taken_words(*mixing.mix(docs, row="n_chars")).collect()
    assert got == Counter({r._row: math.ceil(r.taken / r.size) for r in taken if r.taken})
    assert len(taken) == len(rows) and {r.size for r in taken if r._row > 999} == {0}


def test_stages_leave_extra_columns_out(spark, odd, none):  # noqa: F811
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, odd, "").columns == list(corpus_pipeline.COLUMNS) and stage(spark, none, "").count() == 0
    cut = {(r.doc_id, r.text or "") for r in corpus_pipeline.drop_repeats(spark, odd, "").collect()}
    assert (6, "") in cut and (1, "a short text") in cut


def test_toxicity_stage_keeps_clean_rows_whole(spark, sf, odd):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = toxicity.Matcher(model).score
    want = Counter(tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect() if score(r.text) < 0.5)
    assert Counter(map(tuple, corpus_pipeline.drop_toxic(spark, docs, sf).collect())) == want
    assert docs.select(F.max("doc_id")).first()[0] is not None
