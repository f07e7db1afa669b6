"""Kernels hold a bounded part of a batch at once, and give the same rows as they do for the whole."""

import pyarrow as pa

from lectern.operators import splitter


class Held:
    """Takes what a query hands to Spark and runs it over one batch of many long rows."""

    isStreaming = True

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return [x.to_pylist() for x in run(iter([self.batch]))]

    def mapInPandas(self, run, _):
        return [x.to_dict("records") for x in run(iter([self.batch.to_pandas()]))]


def held(n=3000, most=4000, **more):
    text = ["one two three. " * (most // 15 if i % 3 else i % 7) for i in range(n)]
    return Held(pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": text, **more})), text


def bounded(out, text, size):
    """At most about ``size`` bytes of input in each part, and each document once, in order."""
    ids = [list(dict.fromkeys(r["doc_id"] for r in part)) for part in out]
    assert [d for part in ids for d in part] == [i for part in ids for i in sorted(part)]
    assert max(sum(len(text[d]) for d in part) for part in ids) <= size


def test_chunks_by_embedding_in_parts(spark):
    from lectern.operators import embedding_splitter as es

    docs, text = held()
    out = es.chunks_by_embedding(docs)
    bounded(out, text, 2 << 20)
    found = [r for part in out for r in part]
    assert ["".join(r["body"] for r in found if r["doc_id"] == d) for d in (1, 3, 2999)] == [text[1], text[3], text[2999]]


def test_parts_with_long_rows_together():
    from lectern.operators.parts import parts

    batch = pa.RecordBatch.from_pydict({"i": list(range(1000)), "t": ["x" * (900 if i < 100 else 1) for i in range(1000)]})
    found = list(parts([batch], 5000))
    assert [r for p in found for r in p.column("i").to_pylist()] == list(range(1000))
    assert max(sum(map(len, p.column("t").to_pylist())) for p in found) <= 5000
    assert [p.num_rows for p in parts([batch], 10)] == [1] * 1000
    assert list(parts([batch.slice(0, 0)])) == []


def test_wrapped_lines_in_parts(spark):
    from lectern.operators import layout

    docs, text = held()
    out = layout.wrapped_lines(docs)
    bounded(out, text, 2 << 20)
    assert {r["doc_id"] for part in out for r in part} == set(range(3000))


def test_body_lines_as_token_by_token():
    import random

    from lectern.operators import layout

    r = random.Random(3)
    for _ in range(4000):
        pick = lambda: "".join(r.choice(r.choice(["ab  \n", "abcdefghij ", "a　b\r\t\x1c c\n"])) for _ in range(r.randrange(60)))
        runs = [(pick(), r.random() < 0.5) for _ in range(r.randrange(4))]
        size, most = r.choice([1, 1.3, 0.7]), r.choice([3.1, 7.5, 12.2, 0.4, 5])
        lines = layout.wrap_body(runs, most, layout.fixed_width(size, 1.0))
        assert layout.body_lines(runs, most, size, 1.0) == (["".join(x for x, _ in q) for q in lines], [sum(len(x) for x, m in q if m) for q in lines])


def test_body_lines_measure_no_tokens(monkeypatch):
    """The width of a token is asked for nowhere: a line is found at once."""
    from lectern.operators import layout

    monkeypatch.setattr(layout, "wrap_body", None)
    assert layout.pages_of("[]", "word " * 20000 + "\n" + "x" * 500) > 10


def test_split_documents_in_parts(spark):
    docs, text = held()
    out = splitter.split_documents(docs, 300)
    bounded(out, text, 2 << 20)
    found = [r for part in out for r in part]
    assert ["".join(r["body"] for r in found if r["doc_id"] == d) for d in (1, 3, 2999)] == [text[1], text[3], text[2999]]


def test_span_queries_in_parts(spark, monkeypatch):
    """fallback_split and the like share split_documents' step."""
    from lectern.plans import queries_text

    docs, text = held()
    monkeypatch.setattr(queries_text, "_docs", lambda *_: docs)
    for query in (queries_text.fallback_split, queries_text.center_window, queries_text.split_text_even):
        bounded(query(spark, ""), text, 2 << 20)


def test_cosine_topk_streams_past_blocks(spark, monkeypatch):
    """No row holds a block, and copies are ordered by vec_id wherever they stand."""
    import numpy as np

    from lectern.plans import search

    monkeypatch.setattr(search, "VECTORS", 100)
    monkeypatch.setattr(search, "QUERIES", 3)
    widest = []
    plain = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, *a: widest.append(self.schema) or plain(self, *a))
    v = np.random.default_rng(5).normal(size=(60, 7))
    rows = [(i, v[i % 60].tolist() if i % 11 else None) for i in range(700)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in search.cosine_topk(docs.filter("vec_id % 50 = 1"), docs, 12).collect()}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    cos = lambda x, y: dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5
    want = {}
    for q, x in rows:
        if q % 50 == 1 and x:
            near = sorted(((-cos(x, y), i) for i, y in rows if y and i != q))[:12]
            want |= {(q, k): i for k, (_, i) in enumerate(near, 1)}
    assert got == want
    assert [f.dataType.simpleString() for f in widest[0]] == ["bigint", "boolean", "bigint", "array<double>"]


def test_cuts_and_scores_in_parts(spark):
    from lectern.operators import embedding_splitter as es

    docs, text = held()
    for query in (es.split_by_embedding, es.grid_scores):
        bounded(query(docs), text, 2 << 20)
