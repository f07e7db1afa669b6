"""Token store, fingerprints, BPE, licences, sharding, toxicity and mixing against plain Python, and at the edges."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, fingerprints, licenses, mixing, sharding, token_store, toxicity
from lectern.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPECIAL = "Tab\tand\x0bmore space \x1c x́ ÉCOLE ß İstanbul Kelvin <|endoftext|> don't 12½ 中文 😀 …"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, extra columns with clashing names."""
    rows = [
        (1, "a short text", "en", "s1", 12),
        (2, None, None, None, None),
        (3, "", "en", "s1", 0),
        (None, "no id here", "en", "s2", 10),
        (5, SPECIAL, "xx", "s2", len(SPECIAL)),
        (6, "word " * 40_000, "en", "s1", 200_000),
        (7, "twice the same", "en", "s1", 14),
        (7, "twice the same", "en", "s1", 14),
        (7, "same id, other text", "en", "s3", 19),
        (9, " \n\t ", "en", "", 4),
        (10, "Released under the MIT License. " * 3, "en", "s1", 96),
    ]
    extra = ["key", "part", "_h", "rep", "score", "size", "words", "ids", "start"]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit("x").alias(c) for c in extra])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_encoders_equal_the_library():
    tok, rng = library(), random.Random(7)
    encoders = [bpe.PieceEncoder(bpe.default_tokenizer()), bpe.ForcedBoundaryEncoder(bpe.default_tokenizer())]
    alphabet = "abzqxDONT'tsrevmld 12²½ªº!?.,<|>\n\t\x0b\x1c\x85\xa0éÉßñÀ“…œσςİK中😀‍ǅ_#"
    texts = [SPECIAL, "", "<|startoftext|>", *("".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(1500))]
    for t in texts:
        ids = ids_of(tok, t)
        for e in encoders:
            assert np.frombuffer(e(t.encode()), "<u4").tolist() == ids, repr(t)
        assert encoders[1].decode(e(t.encode())).decode() == tok.decode(ids, skip_special_tokens=False)


def test_forced_boundaries_hold():
    e = bpe.ForcedBoundaryEncoder(bpe.default_tokenizer())
    assert "".join(e.cut("qzthereqx")) == "qzthereqx" and len(e.cut("qzthereqx")) > 1
    assert all(len(t) < 2 or t[:2] in e.joined for t in (x.removesuffix("</w>") for x in list(e.spec["model"]["vocab"])[:5000]))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 10)
    e, tok = bpe.PieceEncoder(bpe.default_tokenizer()), library()
    text = " ".join(f"w{i % 37}x" for i in range(500))
    assert np.frombuffer(e(text.encode()), "<u4").tolist() == ids_of(tok, text)
    assert len(e.pieces) <= 10 and len(e.pieces.old) <= 10


def test_bpe_rows(odd, none):
    tok = library()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(odd).collect())
    want = Counter()
    for r in odd.collect():
        ids = ids_of(tok, r.text)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_digests(none).count() == 0
    assert {tuple(r.ids) for r in bpe.encode_decode(odd).filter("doc_id = 1").collect()} == {tuple(ids_of(tok, "a short text"))}


def test_token_store(spark, odd, none, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_tokens(odd, path)
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    tok, at, want = library(), 0, []
    for r in rows:
        ids = [*ids_of(tok, r.text), 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_store.digests(token_store.read_tokens(spark, path)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_store.lookup(spark, path, [7]).count() == 3
    pruned = token_store.lookup(spark, path, [7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in pruned or "EqualTo(doc_id,7)" in pruned
    token_store.write_tokens(none, f"{path}-none")
    assert token_store.read_tokens(spark, f"{path}-none").count() == 0


def test_token_store_stripes(spark, tmp_path, sf):
    import pyarrow.orc as orc

    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    token_store.write_tokens(docs, f"file://{tmp_path}/t", stripe_bytes=4096, row_group=1000)
    files = [orc.ORCFile(p) for p in sorted((tmp_path / "t").glob("*.orc"))]
    ids = [f.read(["doc_id"])["doc_id"].to_pylist() for f in files]
    flat = [x for part in sorted(ids) for x in part]
    assert flat == sorted(flat) and len(flat) == docs.count()


def test_fingerprints(odd, none):
    got = fingerprints.fingerprint(odd).collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want = Counter()
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        t, n = r.text or "", len(r.text or "") // 4
        want[r.doc_id, len(t), hashlib.sha256((t[: len(t) - n] + (after.text or "")[:n]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fingerprints.fingerprint(none).count() == 0
    assert fingerprints.fingerprint(odd.filter("doc_id = 1")).first().near_next == 1.0


def test_syncmers_are_context_free():
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=400))
    hashes, at = fingerprints.syncmers(text)
    inside = {(h, p) for h, p in zip(hashes.tolist(), at.tolist()) if 100 <= p and p + fingerprints.K <= 300}
    part, places = fingerprints.syncmers(text[100:300])
    assert inside == {(h, p + 100) for h, p in zip(part.tolist(), places.tolist())}
    assert len(at) > 400 / fingerprints.K and (np.diff(at) <= fingerprints.K).all()  # no long gaps


def test_likeness():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(900)]
    a, b = " ".join(words[:300]), " ".join(words[300:600])
    near = lambda x, y: fingerprints.likeness(fingerprints.sketch(x), fingerprints.sketch(y))
    assert near(a, a) == 1 and near(a, b) < 0.1 and near(a, fingerprints.edited(a, b)) > 0.4
    assert near("", "") == 1 and near("", a) == 0
    kept = fingerprints.sketch(a)
    assert [x.tolist() for x in fingerprints.from_string(fingerprints.to_string(kept))] == [x.tolist() for x in kept]


def scanned(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = defaultdict(list)
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        places[label] += [i for i in range(len(words)) if words[i : i + len(p)] == p]
    every = sorted(i for v in places.values() for i in v)
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in places.items() if v))


LICENSES = ["under the mit license", "x Under the MIT License, under the MIT license", "the mit", "CC BY-NC 4.0 cc-by-nc", "İcense under the mİt license", "under the mit K license", "Apache License, Version 2.0", "licensed under the GNU General Public License", "cc by nc cc by nc", "nc by cc"]


def test_licenses(spark, odd, none):
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in enumerate(LICENSES)], "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect())
    assert got == Counter((r.doc_id, *scanned(r.text)) for r in docs.collect())
    assert licenses.scan(none).count() == 0
    assert licenses.scan(docs).filter("doc_id = 107").first().labels == "gpl"


def test_licenses_sql(spark, duck, sf):
    got = {tuple(r) for r in QUERIES["op4_rare_token_licenses"](spark, sf).collect()}
    want = {tuple(r) for r in duck.execute(ORACLE_SQL["op4_rare_token_licenses"]).fetchall()}
    assert got == want


def test_sharding(odd, none):
    rows = sharding.shard(odd).collect()
    docs = odd.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs)
    check_shards(rows, 24)
    assert sharding.shard(none).count() == 0


def check_shards(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(n)]
    assert set(by) <= set(range(n)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_match_the_mixture(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("source"))
    rows = sharding.shard(docs, shards=10).collect()
    check_shards(rows, 10)
    total = Counter(r.source for r in rows)
    for s in range(10):
        part = Counter(r.source for r in rows if r.shard == s)
        assert all(abs(part[x] - n / 10) <= 2 for x, n in total.items())
    again = sharding.shard(docs.repartition(7), shards=10).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def filled(sizes, weights=(1, 2, 3), cap=3):
    """Targets by repeated resharing, exactly."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), Fraction(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing(odd, none):
    rows = mixing.taken_words(*mixing.mix(odd, block_words=2)).collect()
    docs = odd.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, count(r.text)) for r in docs)
    sizes = Counter()
    for r in docs:
        sizes[r.source] += count(r.text)
    want = filled(dict(sizes))
    assert sorted(round(r.target, 6) for r in rows) == sorted(round(float(want[r.source]), 6) for r in docs)
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.taken_words(*mixing.mix(none)).count() == 0


def test_mix_is_near_targets_and_repeatable(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 300), rng.choice(["a", "a", "a", "b", "c", None, "tiny"][: 7 if i % 60 == 0 else 6])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    laid, mixed = mixing.mix(docs)
    got = mixing.taken_words(laid, mixed).collect()
    source = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 4 * mixing.BLOCK_WORDS for s in target)
    again = mixing.taken_words(*mixing.mix(docs.repartition(5))).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    slots = [r.slot for r in mixed.select("slot").distinct().collect()]
    assert sorted(slots) == list(range(len(slots)))


def test_golden_points_are_even():
    u = [(i * mixing.STEP) % mixing.POINTS / mixing.POINTS for i in range(1000)]
    for a, b in ((0, 0.1), (0.35, 0.6), (0.9, 1)):
        assert abs(sum(a <= x < b for x in u) - 1000 * (b - a)) <= 3


CLEAN = ["der wagen steht lowed here", "a calm and pleasant day", "the lower shelf holds lowering blinds", "trash can outside", "nothing to see"]


@pytest.fixture(scope="session")
def labelled(spark):
    rng = random.Random(11)
    common = ["".join(rng.choices("aeioustrnl", k=rng.randint(3, 7))) for _ in range(300)]
    bad = ["vrakoid", "splunter", "blorgish", "quemanoid"]
    docs, labels = [], []
    for i in range(1500):
        words = rng.choices(common, k=rng.randint(10, 60))
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                b = rng.choice(bad)
                words.insert(rng.randrange(len(words)), rng.choice([b, b.upper(), b + "en", b.replace("o", "0").replace("i", "1"), b.replace("a", "а")]))
        docs.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.98
    assert sum(r.predicted for r in held if not r.toxic) == 0
    assert toxicity.drop_toxic(docs, model).count() == sum(not r.predicted for r in rows)
    # Labels of held-out rows change nothing.
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, other) == model


def test_toxicity_edges(spark, labelled, odd, none):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(none, model).count() == 0 and toxicity.drop_toxic(none, model).count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    for known in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        empty = toxicity.fit(docs, known)
        assert empty == toxicity.Model() and {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}


def test_toxicity_matching():
    model = toxicity.Model((("blorg", 3.0), ("moron ", 2.0)), (toxicity.fold("blorg tree"), "blorgen"), (-3.0, 3.0, 0.0))
    match = toxicity.matcher(model)
    found = lambda t: sorted(x for x, _ in match(toxicity.fold(t)))
    assert found("A BL0RG, a blоrgs and a m0r0n!") == ["blorg", "blorg", "moron "]
    assert found("ablorg morons blorg tree blorgen") == []


def test_all_query_names():
    assert [re.match(r"op(\d+)_", k)[1] for k in QUERIES] == [str(i) for i in range(1, 11)]
    assert duckdb.__version__
