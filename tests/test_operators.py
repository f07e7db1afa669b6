"""Operators against plain Python, and their behaviour at the edges."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern import chat, models
from lectern.functions import text
from lectern.models import LecternError
from lectern.operators import embedding_splitter as es
from lectern.operators import layout, ordered, present, rank, runs, splitter, windows
from lectern.operators.components import components
from lectern.operators.ordered import prefix_sums, range_bounds, ranged, with_range
from lectern.plans import asked
from lectern.plans.rank import RankRecords, all_pairs, rank_items
from lectern.sources import files
from lectern.streaming import journal

TEXTS = st.text(alphabet="ab ,\n\r\té😀", max_size=60)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 660)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root if any(a != b and x in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_sums_and_ranges(spark):
    rows = [(i % 3, i, i * 7 % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, k long, v long").withColumn("b", F.expr("k div 16"))
    got = {(r.g, r.k): r.before for r in prefix_sums(df, "b", ["k"], F.col("v"), ["g"]).collect()}
    assert got == {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}
    bounds = range_bounds(df, [F.col("k")], 5)
    assert [r.x for r in with_range(df, [F.col("k")], bounds, "x").orderBy("k").select("x").collect()] == [sum(b[0] <= k for b in bounds) for _, k, _ in rows]


@pytest.mark.parametrize("most", [1024, 3])
def test_ranges_of_sparse_and_common_keys(spark, monkeypatch, most):
    """Ids of 63 bits, one id in a third of the rows and none in another: no range gets much more than its part."""
    monkeypatch.setattr(ordered, "MAX_RANGES", most)
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else rng.getrandbits(62), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, t long")
    keys = [F.col("k"), F.xxhash64("t")]
    bounds = range_bounds(df, keys, 12)
    found = with_range(df, keys, bounds, "r").withColumn("h", F.xxhash64("t")).collect()
    key = lambda k, h: (k is not None, k or 0, h)
    assert all(r.r == sum(key(*b) <= key(r.k, r.h) for b in bounds) for r in found)
    assert max(Counter(r.r for r in found).values()) <= 3 * 600 / 12


def test_prefix_sums_over_sparse_keys(spark):
    rng = random.Random(4)
    rows = [(rng.getrandbits(62), rng.randint(0, 9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k long, v long")
    with_buckets = ranged(df, ["k"]).cache()
    assert with_buckets.select("_range").distinct().count() <= 8
    got = {r.k: r.before for r in prefix_sums(with_buckets, "_range", ["k"], F.col("v")).collect()}
    assert got == {k: sum(w for j, w in rows if j < k) for k, _ in rows}


def reference_window(tokens, i, budget):
    p = np.concatenate(([0], np.cumsum(tokens)))
    n, low, high = len(tokens), 3 * budget // 10, 7 * budget // 10
    step = max(1, high - low)
    mid2 = p[i] + p[i + 1]
    num = int(mid2 - budget)
    snap = int(math.copysign((abs(num) + step) // (2 * step), num)) * step
    s0 = min(n - 1, max(0, int(np.searchsorted(p, snap, "right")) - 1))
    end = lambda s: max(s + 1, min(n, int(np.searchsorted(p, p[s] + budget, "right")) - 1))

    def score(s):
        e, off = end(s), mid2 - 2 * p[s]
        band = 2 * low - off if off < 2 * low else off - 2 * high if off > 2 * high else 0
        return (not s <= i < e, band, budget - (p[e] - p[s]), abs(p[s] - snap), s)

    s = min((s for s in (s0, s0 + 1) if s < n), key=score)
    s = s if s <= i < end(s) else i
    return s, end(s)


@pytest.mark.parametrize("budget", [1, 50, 400])
def test_stable_windows(spark, budget):
    rng = random.Random(budget)
    tokens = [rng.choice([0, 1, 3, 20, 90]) for _ in range(120)]
    chunks = spark.createDataFrame([(0, i, t) for i, t in enumerate(tokens)], "corpus int, i long, tokens long")
    got = {r.i: (r.start, r.stop) for r in windows.stable_windows(chunks, budget).collect()}
    assert got == {i: reference_window(tokens, i, budget) for i in range(len(tokens))}


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_spans_and_cuts(t):
    for a, b in splitter.spans(t):
        assert a < b and "\n" not in t[a:b]
    at = splitter.cuts(t, 4)
    assert at[0] == 0 and at[-1] == len(t) and at == sorted(set(at))
    assert all(splitter.count_tokens(t[a:b]) <= 4 for a, b in zip(at, at[1:]))
    assert splitter.count_tokens(splitter.center_window(t, 3)) <= 3
    cut = splitter.delimiter_split(t)
    assert cut == -1 or 0 < cut < len(t)


def test_find_anchor():
    segment = "a" * 100 + "bc" + "d" * 100
    assert splitter.find_anchor(segment, "bc") == 100
    assert splitter.find_anchor(segment, "a") == -1 and splitter.find_anchor(segment, "zz") == -1 and splitter.find_anchor(segment, "") == -1


@pytest.mark.parametrize("n", [2, 3, 7, 20, 61])
def test_round_robin(spark, n):
    games = rank.round_robin(spark, n).toPandas()
    pairs = {tuple(sorted(p)) for p in zip(games.left, games.right)}
    assert len(games) == len(pairs) == n * (n - 1) // 2
    sides = games.left.value_counts().reindex(range(n), fill_value=0) - games.right.value_counts().reindex(range(n), fill_value=0)
    assert sides.abs().max() <= 4  # two games off an even split


def test_bradley_terry_order_is_win_order():
    rng = random.Random(1)
    for n in (2, 5, 12):
        games = [(i, j) if rng.random() < 0.7 else (j, i) for i, j in combinations(range(n), 2)]
        theta, won = rank.bradley_terry(games, n, 1e-3), np.bincount([w for w, _ in games], minlength=n)
        for i, j in combinations(range(n), 2):
            if won[i] != won[j]:
                assert (theta[i] > theta[j]) == (won[i] > won[j])
            else:
                assert abs(theta[i] - theta[j]) < 1e-6


def test_remembered(spark):
    asked = []

    def judge(games):
        asked.append(sorted((r.left, r.right) for r in games.collect()))
        return games.withColumn("winner", F.lit("left"))

    journal_ = spark.createDataFrame([(1, 2, "left", 0), (2, 1, "left", 1), (3, 4, "right", 2)], "left int, right int, winner string, ordinal int")
    games = spark.createDataFrame([(1, 2), (4, 3), (5, 6)], "left int, right int")
    found = {(r.left, r.right): r.winner for r in rank.remembered(judge, journal_)(games).collect()}
    assert found == {(1, 2): "right", (4, 3): "left", (5, 6): "left"} and asked[0] == [(5, 6)]


def test_bracket_modes(spark):
    items = spark.createDataFrame([(100 + i, i + 0.5) for i in range(0, 30, 3)], "item long, score double")
    anchors = spark.createDataFrame([(i, 30.0 - 2 * i, i + 1) for i in range(15)], "item long, score double, rank int")
    score = {r.item: r.score for r in items.collect() + anchors.collect()}
    table = spark.createDataFrame(list(score.items()), "x long, s double")

    def judge(games):
        sides = games.join(table.toDF("left", "_a"), "left").join(table.toDF("right", "_b"), "right")
        return sides.withColumn("winner", F.when(F.col("_a") >= F.col("_b"), "left").otherwise("right"))

    fair = {r.item: r.tier for r in rank.bracket(items.select("item"), anchors, judge, "corrected").collect()}
    true = {i: sum(score[a] > score[i] for a in range(15)) for i in fair}
    assert all(fair[i] in (true[i], true[i] - 1) for i in fair)
    quirk = {r.item: r.tier for r in rank.bracket(items.select("item"), anchors, judge).collect()}
    assert sum(quirk[i] == true[i] - 1 for i in quirk) > sum(fair[i] == true[i] - 1 for i in fair)


def test_tags_and_booleans(spark):
    o, c = text.OPEN_TAG, text.CLOSE_TAG
    cases = {"x": True, f"{o}a{c}": True, f"{o}a": False, f"a{c}": False, f"{o}{o}a{c}{c}": False, "<mark-yellow x>a": False, f"{o}a{c}b{o}c{c}": True}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.ok for r in df.select("t", text.valid_tags("t").alias("ok")).collect()} == cases
    flags = {"true": (True, True, True), "false": (False, False, False), '"false"': (False, False, True), '" TRUE"': (False, True, True), "0": (False, False, False), "2": (False, False, True), "[]": (False, False, False), "[1]": (False, False, True), None: (False, False, False), "oops": (False, False, False), "null": (False, False, False)}
    df = spark.createDataFrame([(k,) for k in flags], "t string").select("t", text.strict_true("t"), text.lenient_true("t"), text.truthy("t"))
    assert {r[0]: tuple(r[1:]) for r in df.collect()} == flags


def test_journal_roundtrip(spark, tmp_path):
    path = str(tmp_path / "0001.jsonl")
    files.append_record(path, {"type": "meta", "query": "q"})
    files.append_record(path, {"type": "judgement", "is_relevant": True})
    with open(path, "a") as f:
        f.write('{"type": "judg')
    assert [r.ordinal for r in files.journal(spark, path).orderBy("ordinal").collect()] == [0, 1]
    with pytest.raises(LecternError):
        files.journal(spark, path, strict=True)
    assert files.next_name("0009.jsonl") == "0010.jsonl" and files.next_name(None) == "0001.jsonl"


def test_chunk_files(spark, tmp_path, sf):
    docs = spark.createDataFrame([(1, "a b\n" * 900), (2, "short")], "doc_id long, text string")
    chunks = splitter.numbered_chunks(splitter.split_documents(docs).withColumn("source", F.lit("s")))
    files.write_chunks(chunks, str(tmp_path / "chunks"))
    back = files.chunk_files(spark, str(tmp_path / "chunks")).orderBy("original_index").collect()
    assert "".join(r.content.split("\n", 1)[1] for r in back) == "a b\n" * 900 + "short"
    with pytest.raises(LecternError):
        files.write_chunks(chunks, str(tmp_path / "chunks"))


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\rz\xff!")
    assert files.text_files(spark, str(tmp_path)).first().text == "x\ny\nz!"


def test_visible_pdfs(tmp_path):
    for name in ("b.PDF", ".c.pdf", "_a.pdf", "x.txt", ".d/e.pdf", "f/G.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    assert files.visible_pdfs(str(tmp_path)) == ["_a.pdf", "b.PDF", "f/G.pdf"]
    with pytest.raises(LecternError):
        files.manifest(["a/x.pdf", "b/x.pdf"], "")


def test_runs(spark):
    meta = spark.createDataFrame([("r1", 2), ("r2", 3)], "run string, total int")
    judged = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 1)], "run string, position int")
    assert (runs.plan(meta, judged, None), runs.plan(meta, judged, "r1"), runs.plan(meta, judged, "r2")) == ("fresh", "refine", "resume")
    with pytest.raises(LecternError):
        runs.RunMeta("q", 5, 5).same_corpus(6)
    schedule = spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "pair_index int, left int, right int")
    assert runs.follows_schedule(schedule.filter("pair_index = 0"), schedule)
    assert not runs.follows_schedule(schedule.filter("pair_index = 1"), schedule)


@given(st.text(alphabet="ab c\n", max_size=50), st.integers(5, 40))
@settings(max_examples=60, deadline=None)
def test_wrap(t, most):
    lines = layout.wrap_body([(t, False)], most, layout.fixed_width(10, 0.1))
    assert "".join(x for line in lines for x, _ in line) == t.replace("\n", "")
    assert all(sum(len(x) for x, _ in line) <= most for line in lines)
    assert "".join(layout.wrap(t.replace("\n", ""), most, layout.fixed_width(10, 0.1))) == t.replace("\n", "")


def test_chat_steps_over_tables(spark):
    """Scripted chats, asked once for each row."""
    items = spark.createDataFrame([(i, f"{i:06d}.txt", "s", "e", "x" * i) for i in range(1, 8)], "item long, filename string, summary string, evidence string, text string")
    judge = asked.pair_judge(items, lambda a, b: ("left" if len(a["text"]) > len(b["text"]) else "right", "longer"))
    assert [r.item for r in rank_items(items, judge).orderBy("rank").collect()] == list(range(7, 0, -1))
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id int, text string")
    assert {r.id: r.cleaned for r in asked.cleaned(rows, lambda t: f"<{t}>").collect()} == {1: "<a>", 2: "<None>", 3: "<>"}
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    cut = splitter.split_documents(docs, 6, chat.Splitter([lambda m: '{"begin_second_section": "six seven"}'])).orderBy("lo").collect()
    assert [r.body for r in cut] == ["one two three four five ", "six seven eight nine ten"]


def test_ranking_goes_on_from_its_journal(spark, tmp_path):
    """A ranking with a journal of all its games judges none; one with another schedule is refused."""
    items = spark.createDataFrame([(i, f"{i:06d}.txt") for i in range(9)], "item long, filename string")
    played = []

    def judge(games):
        rows = games.withColumn("winner", F.when(F.col("left") < F.col("right"), "left").otherwise("right"))
        played.append(rows.count())
        return rows

    placed = windows.number_rows(items, "item", "place")
    games = all_pairs(placed, 9).withColumn("winner", F.when(F.col("left") < F.col("right"), "left").otherwise("right")).orderBy("pair_index").collect()
    path = str(tmp_path / "rank.jsonl")
    for r in games:
        files.append_record(path, {"type": "cmp", "stage": "skeleton", **r.asDict()})
    records = RankRecords.of(files.journal(spark, path))
    assert [r.item for r in rank_items(items, judge, journal=records).orderBy("rank").collect()] == list(range(9)) and sum(played) == 0
    odd = RankRecords(records.games, records.confirms, records.skeleton.withColumn("left", F.col("right")))
    with pytest.raises(LecternError):
        rank_items(items, judge, journal=odd)


def test_confirmations_are_taken_in_order(spark):
    journal = spark.createDataFrame([(1, 9, 1, "left", 0), (1, 9, 9, "left", 1), (1, 9, 1, "right", 2)], "item long, against long, left long, winner string, ordinal int")
    games = spark.createDataFrame([(1, 9, 0, 1, 9), (1, 9, 1, 9, 1), (2, 9, 0, 2, 9)], "item long, anchor long, k int, left long, right long")
    asks = []

    def judge(g):
        asks.extend(r.item for r in g.collect())
        return g.withColumn("winner", F.lit("right"))

    got = {(r.item, r.k): r.winner for r in rank.confirmed(judge, journal)(games).collect()}
    assert got == {(1, 0): "left", (1, 1): "left", (2, 0): "right"} and asks == [2]


def test_names_order_and_numbers(spark):
    names = ["000012.txt", "ab-7.txt", "x.txt", "007"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.filename_parts("n").alias("p")).collect()
    assert {r.n: r.p and tuple(r.p) for r in got} == {"000012.txt": ("", 12, 6, ".txt"), "ab-7.txt": ("ab-", 7, 1, ".txt"), "x.txt": None, "007": None}
    paths = ["B", "a", "stra\u00dfe", "strasse", "\u03c3", "\u03c2"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(text.folded_path("p"), "p").collect()
    assert [r.p for r in got] == sorted(paths, key=lambda p: (p.casefold(), p))
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1)], "g int, num int")
    present.strictly_increasing(rows.filter("g = 1"), ["g"], "num")
    with pytest.raises(LecternError):
        present.strictly_increasing(rows, ["g"], "num")


@pytest.mark.parametrize("block", [3, 4096])
def test_covers_in_blocks(spark, block):
    rng = random.Random(9)
    rows = [(b, i, rng.choice([0, 1, 2, 5, 19, 20, 21, 40])) for b in ("x", "y", None) for i in range(1, 60)]
    want = {}
    for b in ("x", "y", None):
        total, cover = 0, 0
        for _, i, n in [r for r in rows if r[0] == b]:
            if cover == 0 or (total > 0 and total + n > 20):
                total, cover = n, cover + 1
            else:
                total += n
            want[b, i] = cover
    got = present.plan_covers(spark.createDataFrame(rows, "book string, ordinal long, pages long"), block=block)
    assert {(r.book, r.ordinal): r.cover for r in got.collect()} == want


def test_scores_without_the_matrix():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(12, 5))
    v /= np.linalg.norm(v, axis=1)[:, None]
    gram, blocks = v @ v.T, es._Blocks(v)
    a, b = np.array([0, 3, 5]), np.array([4, 4, 12])
    assert np.allclose(blocks.sum(a, b, a, b), [gram[i:j, i:j].sum() for i, j in zip(a, b)])
    assert np.allclose(blocks.mean_pairs(a, b), [1 if j - i < 2 else (gram[i:j, i:j].sum() - (j - i)) / ((j - i) * (j - i - 1)) for i, j in zip(a, b)])
    tokens = [f"t{i % 17}" for i in range(1000)]
    for size, stride in ((384, 128), (176, 64), (1000, 7)):
        at = es.window_starts(len(tokens), size, stride)
        want = [es.hashed_vectors(tokens[x:y], np.array([[0, y - x, 0]]))[0] for x, y, _ in at]
        assert np.allclose(es.hashed_vectors(tokens, at), want)


def test_a_very_long_text_is_split_in_bounded_memory():
    import tracemalloc

    tracemalloc.start()
    n, _ = es._scored("word other " * 100_000, es.Settings())
    assert n == 200_000 and tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_even_parts(spark):
    rows = [(n, p) for n in range(1, 40) for p in range(n)]
    got = spark.createDataFrame(rows, "n long, p long").select("n", present.even_parts(F.col("n"), F.col("p")).alias("part")).toPandas()
    for n, part in got.groupby("n").part:
        sizes = part.value_counts().sort_index()
        assert len(sizes) == -(-n // 5) and sizes.max() - sizes.min() <= 1 and list(sizes) == sorted(sizes, reverse=True)


@pytest.mark.parametrize("length", [1, 100, 319, 320, 1024, 1025, 5000])
def test_embedding_cuts(length):
    rng = np.random.default_rng(length)
    vectors = [v / np.linalg.norm(v, axis=1)[:, None] for w in ((384, 128), (176, 64)) for v in [rng.normal(size=(len(es.window_starts(length, *w)), 8))]]
    strength = es.boundary_scores(length, *vectors)
    at = es.nudged(es.choose_cuts(length, strength), length, strength)
    assert at[0] == 0 and at[-1] == length and at == sorted(set(at))
    assert length < 320 or all(b - a <= 1024 for a, b in zip(at, at[1:]))


def test_char_spans():
    t = "  one two, three\n\nfour five "
    assert es.char_spans(t, [0, 2, 5, 6]) == [(0, 9), (9, 23), (23, len(t))]
    assert "".join(t[a:b] for a, b in es.char_spans(t, [0, 2, 5, 6])) == t
    assert es.char_spans(t, [0, 2, 6], overlap=1) == [(0, 9), (6, len(t))]


@pytest.mark.parametrize("length, nearest", [(700, False), (2500, True), (4000, False)])
def test_boundary_scores(length, nearest):
    """Against averages over all pairs, one boundary at a time."""
    rng = np.random.default_rng(length)
    s = es.Settings(nearest_pairs=nearest)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.normal(size=(n, 8)))
    wide, narrow = es.window_starts(length, *s.coarse), es.window_starts(length, *s.fine)
    coarse, fine = unit(len(wide)), unit(len(narrow))
    got = es.boundary_scores(length, coarse, fine, s)
    mean = lambda x: sum(x) / len(x) if x else 1.0
    for t in range(16, length + 1, 16):
        sides = []
        for windows_, vectors_, k in ((wide, coarse, 5), (narrow, fine, 4)):
            sides.append([v for w, v in zip(windows_, vectors_) if w[2] < t][-k:])
            sides.append([v for w, v in zip(windows_, vectors_) if w[2] >= t][:k])
        lc, rc, lf, rf = sides
        m = min(len(lf), len(rf))
        if not lc or not rc or not m:
            assert got[t] == 0
            continue
        inner = (mean([a @ b for a, b in combinations(lc, 2)]) + mean([a @ b for a, b in combinations(rc, 2)])) / 2
        novelty = max(0.0, inner - mean([a @ b for a in lc for b in rc]))
        steps = [mean([a @ b for a, b in zip(x, x[1:])]) for x in (lf, rf)]
        across = mean([a @ b for a, b in zip(lf[-m:][::-1] if nearest else lf[-m:], rf)])
        assert got[t] == pytest.approx(novelty * steps[0] * steps[1] / (across + s.delta), rel=1e-6, abs=1e-9)


def test_models(spark):
    with pytest.raises(LecternError):
        models.ChatClient("http://h", "nobody").options()
    sent = [{"role": "user", "content": "x"}]
    body = models.ChatClient("http://h", "qwen3:32b", think=False).payload(sent, 256, as_json=True)
    assert body["options"]["num_predict"] == 256 and body["format"] == "json" and body["think"] is False
    assert "format" not in models.ChatClient("http://h", "gpt-oss:20b").payload(sent, 256, as_json=True)
    calls = []

    def broken(rows):
        calls.append(1)
        raise ValueError("no")

    out = models.retried(broken, pd.DataFrame({"i": [1]}), 3, models.fail_open)
    assert len(calls) == 3 and out.is_relevant[0] and out.fallback[0]
    with pytest.raises(LecternError):
        models.retried(broken, pd.DataFrame({"i": [1]}), 2, None)
    chunks = spark.createDataFrame([(0, 1, "x"), (0, 2, "y")], "corpus int, i long, text string")

    def judge(rows):
        return pd.DataFrame({"is_relevant": rows.text == "x", "summary": "", "evidence": rows.text})

    assert {(r.i, r.is_relevant) for r in models.judged(chunks, judge).collect()} == {(1, True), (2, False)}


def test_streamed_journal(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the license here"), (2, "nothing")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    journal.start_journal(journal.judged_stream(stream, "license"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.doc_id, r.is_relevant) for r in journal.read_journal(spark, str(tmp_path / "out")).collect()} == {(1, True), (2, False)}


def test_commands(spark, tmp_path, monkeypatch):
    from lectern.plans import commands

    rng = random.Random(1)
    words = ["river", "stone", "key", "night", "moon"]
    for name in ("b.txt", "a.txt"):
        (tmp_path / name).write_text("\n".join(" ".join(rng.choices(words, k=12)) for _ in range(400)))
    out = str(tmp_path / "split")
    n = commands.split(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")], out)
    first = (tmp_path / "split/chunks/000001.txt").read_text()
    assert n == len(list((tmp_path / "split/chunks").iterdir())) and first.startswith("[Chunk 1/") and "b.txt" in first.split("\n")[0]
    runs_dir = str(tmp_path / "runs")
    path = commands.search(spark, f"{out}/chunks", runs_dir, "moon key", "about", 2000, 1)
    whole = (tmp_path / "runs/0001.jsonl").read_text()
    assert path.endswith("0001.jsonl") and whole.count("\x1e") == n + 1
    # Cut off in the middle of a record, the run is resumed to the same state.
    (tmp_path / "runs/0001.jsonl").write_text("\x1e".join(whole.split("\x1e")[: n - 2]) + "\x1e\n")
    commands.search(spark, f"{out}/chunks", runs_dir, "moon key", "about", 2000, 1)
    assert (tmp_path / "runs/0001.jsonl").read_text() == whole
    assert commands.search(spark, f"{out}/chunks", runs_dir, "moon key", "about", 2000, 1).endswith("0002.jsonl")
    order = commands.rank(spark, f"{out}/chunks", runs_dir, "stone", str(tmp_path / "order.csv"))
    ranked = [int(x) for x in open(order).read().split(",")]
    assert sorted(ranked) == list(range(1, n + 1))
    hits = {i: sum(w == "stone" for w in (tmp_path / f"split/chunks/{i:06d}.txt").read_text().lower().split()) for i in ranked}
    assert ranked == sorted(ranked, key=lambda i: (-hits[i], i))
    raw = str(tmp_path / "raw.txt")
    bodies = [(tmp_path / f"split/chunks/{i:06d}.txt").read_text() for i in range(1, n + 1)]
    run = "0002.jsonl" if (tmp_path / "runs/0002.jsonl").read_text().count("\x1e") > n else "0001.jsonl"
    judged = {r["original_index"]: r for r in commands.read_records(tmp_path / "runs" / run) if r["type"] == "judgement"}
    assert commands.raw(spark, f"{out}/chunks", runs_dir, raw) == n
    assert open(raw).read() == "".join(f"{commands.json.dumps(judged[i], ensure_ascii=False)}\n{b}\n\n" for i, b in enumerate(bodies, 1))
    books, marked = str(tmp_path / "pretty"), str(tmp_path / "yellow")
    assert commands.pretty(spark, f"{out}/chunks", runs_dir, order, books) == 1  # all chunks are neighbours
    file = (tmp_path / "pretty/000001.txt").read_text()
    assert file.startswith("[ {") and file.count('"relevance_score"') == n and file.endswith("\n```\n")
    assert commands.yellow(spark, books, "moon", marked) == 1
    assert (tmp_path / "yellow/000001.txt").read_text().replace("<mark-yellow>", "").replace("</mark-yellow>", "") == file
    assert commands.pretty(spark, f"{out}/chunks", runs_dir, order, books) == 1 and commands.yellow(spark, books, "moon", marked) == 1


def test_rank_plan_beyond_the_skeleton(spark, monkeypatch):
    from lectern.plans.rank import rank_items

    monkeypatch.setattr(rank, "SKELETON", 12)
    items = spark.createDataFrame([(i, f"{i:06d}.txt") for i in range(40)], "item long, filename string")

    def judge(games):
        return games.withColumn("winner", F.when(F.col("left") < F.col("right"), "left").otherwise("right"))

    real = rank.skeleton
    monkeypatch.setattr(rank, "skeleton", lambda df, **k: real(df, size=12))
    found = {r.item: r["rank"] for r in rank_items(items, judge, "corrected").collect()}
    assert sorted(found.values()) == list(range(1, 41))
    # All tiers fit into the top block, so its items come first, in their own order, and the anchors after them.
    anchors = {round(i * 39 / 11) for i in range(12)}
    assert sorted(found, key=found.get) == [i for i in range(40) if i not in anchors] + sorted(anchors)


def test_books(spark):
    from lectern.plans.present import pretty_books, yellow_books
    from lectern.sources import books

    chunks = spark.createDataFrame([(i, f"{i:06d}.txt", f"[Chunk {i}]\nbody <b>{i}</b> moon\n") for i in range(1, 21)], "num long, filename string, content string")
    judged = spark.createDataFrame([(i, 0, f"e{i}") for i in (3, 4, 9, *range(11, 18))] + [(3, 1, "more")], "num long, ordinal int, evidence string")
    order = spark.createDataFrame([(n, r) for r, n in enumerate([9, 4, 3, *range(11, 18)], 1)], "num long, rank int")
    found = pretty_books(judged, chunks, order).orderBy("group_id").collect()
    assert [[x.chunk_filename for x in r.rows] for r in found] == [["000009.txt"], ["000003.txt", "000004.txt"], [f"{i:06d}.txt" for i in range(11, 18)]]
    assert found[1].text == "body 2 moon body 3 moon body 4 moon body 5 moon" and found[1].rows[0].evidence_text == "e3 | more" and found[1].rows[0].relevance_score == "3/10"
    assert found[2].text == " ".join(f"body {i} moon" for i in range(10, 19))
    back = spark.createDataFrame([(found[1].file,)], "f string").select(files.pretty("f").alias("p")).first().p
    assert back.inner == found[1].text and back.rows[0].chunk_info == "[Chunk 3]" and back.blocks == 1
    yellow = yellow_books(pretty_books(judged, chunks, order), "moon").filter("group_id = 1").first().file
    assert yellow.startswith("[") and yellow.count("<mark-yellow>moon</mark-yellow>") == 3
    names = spark.createDataFrame([("000001.txt",), ("000004.txt",), ("x.txt",)], "filename string")
    assert [r.missing for r in books.gaps(names).orderBy("missing").collect()] == [2, 3]
    assert {(r.filename, r.only) for r in books.unmatched(names, names.filter("filename <> 'x.txt'")).collect()} == {("x.txt", "left")}
    pages = spark.createDataFrame([("d", 1, "two\n"), ("d", 0, "one \n")], "document string, page_index int, md string")
    assert books.joined_pages(pages).first().markdown == "one\n\ntwo"


def test_journals_of_cuts_and_ranks(spark):
    from lectern.sources import books

    rows = [("p", 0, '{"type": "meta", "n": 1}'), ("p", 1, '{"type": "cut", "pos": 5}'), ("p", 2, '{"type": "meta", "n": 2}'), ("p", 3, '{"type": "cut", "pos": "6"}'), ("p", 4, '{"type": "other"}'), ("p", 5, '{"type": "cut", "pos": 9}')]
    df = spark.createDataFrame(rows, "path string, ordinal int, record string")
    assert books.cut_meta(df).first().meta.endswith('"n": 1}')
    assert [r.pos for r in books.cut_positions(df).orderBy("ordinal").collect()] == [5, 9]
    base = [{"type": "meta", "algo": "x", "created_at": "a"}, {"type": "skeleton", "ids": [1, 2]}, {"type": "cmp", "stage": "skeleton", "left": 1, "right": 2}, {"type": "bt_summary", "stage": "skeleton", "order": [2, 1]}, {"type": "probe", "stage": "bracket", "item": 3, "pivot": 1}, {"type": "confirm", "stage": "bracket", "item": 3, "against": 1}, {"type": "bracket_decision", "stage": "bracket", "item": 3, "tier": 1}]
    state = books.replay(base)
    assert state.skeleton == [1, 2] and state.orders["skeleton"] == [2, 1] and state.tiers == {3: 1} and (3, 1) in state.probes and len(state.games["skeleton"]) == 1
    for bad in ({"type": "skeleton", "ids": []}, {"type": "cmp", "stage": "?"}, {"type": "?"}, {"type": "bt_summary", "stage": "skeleton", "order": []}):
        with pytest.raises(LecternError):
            books.replay([*base, bad])
    books.same_meta({"a": 1, "created_at": 1}, {"a": 1, "created_at": 2})
    with pytest.raises(LecternError):
        books.same_meta({"a": 1}, {"a": 2})
    assert books.log_name("a/x y.pdf") != books.log_name("b/x y.pdf")


def test_chat_steps():
    from lectern import chat

    def script(*answers):
        left = list(answers)

        def call(messages):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return call

    segment = "one two three four five six seven eight nine ten " * 4
    assert chat.Splitter([script("no", '{"begin_second_section": "zzz"}', 'so {"begin_second_section": "six seven"}')])(segment) == segment.find("six seven")
    assert chat.Splitter([script(*["no"] * 3), script(LecternError("length"))])(segment) == splitter.delimiter_split(segment)
    judge = chat.PairJudge(script(ValueError(), '{"winner": "C"}', '{"winner": "B", "rationale": "r"}'), "q")
    assert judge({}, {}) == ("right", "r")
    with pytest.raises(LecternError):
        chat.PairJudge(script(*["{}"] * 5), "q")({}, {})
    assert chat.Cleaner(script("no", "```txt\nclean\n```"))("raw") == "clean" and chat.Cleaner(script(*["no"] * 6))("raw") == "raw"
    text = "a moon over the river " * 10
    good = "```txt\n" + text.replace("moon", "<mark-yellow>moon</mark-yellow>", 1) + "\n```"
    light = chat.Highlighter((script("```txt\nshort\n```", "```txt\n" + text + "<mark-yellow>\n```", good), script()), "moon", exact=True)
    assert light(text, ["e"]) == text.replace("moon", "<mark-yellow>moon</mark-yellow>", 1)
    with pytest.raises(LecternError):
        chat.Highlighter((script(*["x"] * 4), script(*["x"] * 4)), "moon")(text, ["e", "f"])
    page = "<<<MD_START page=000007>>>\n# T\n<<<MD_END page=000007>>>"
    waits = []
    assert chat.Transcriber((script(ValueError(), "x", "y"), script(page)), wait=waits.append)("", 7) == ("# T", 4) and waits == [1]
    assert "".join(chat.even_parts(segment, 5)) == segment and len(chat.even_parts("ab\ncd\nef", 3)) == 3


def test_config():
    from lectern.config import Config

    c = Config.from_environment({"LECTERN_HOST": "box", "LECTERN_MODEL_HYBRID": "qwen3:32b"})
    assert c.host == "http://box:11434" and c.client("hybrid").model == "qwen3:32b"
    with pytest.raises(LecternError):
        c.client("vision")


def test_ingest(spark, tmp_path):
    from lectern.plans import ingest

    (tmp_path / "a.pdf").write_bytes(b"x")
    stored = ingest.planned(str(tmp_path), None)
    (tmp_path / "b.pdf").write_bytes(b"y")
    with pytest.raises(LecternError):
        ingest.planned(str(tmp_path), stored)
    assert ingest.read_pdfs(spark, str(tmp_path)).count() == 2
    log = spark.createDataFrame([("a", "failed", 1), ("a", "success", 2), ("b", "success", 3), ("b", "failed", 4)], "pdf string, status string, line_no int")
    assert [r.pdf for r in ingest.to_convert(log.select("pdf").distinct(), log).collect()] == ["b"]
    pages = spark.createDataFrame([("d", 0, bytearray(b"p")), ("d", 1, bytearray(b"q"))], "document string, page_index int, png binary")
    done = ingest.transcribed(pages, lambda image, page: (f"# {page}", 1), spark.createDataFrame([("d", 0)], "document string, page_index int"))
    assert [(r.page_index, r.md) for r in done.collect()] == [(1, "# 2")]
