"""The search pass: chunks, context windows, judgement."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import token_count
from lectern.models import Judge, judged, lexical_judgement
from lectern.operators import windows
from lectern.plans.shared import materialize, shuffle_partitions

#: Queries compared at once, vectors of a block they are compared with, and pairs of about the same cosine that are compared at once.
QUERIES, VECTORS, CLOSE = 256, 8192, 1 << 16


def chunks_of(docs: DataFrame) -> DataFrame:
    """corpus, i, doc_id, text, tokens: each document is a chunk of one corpus, in the order of doc_id."""
    chunks = docs.select(F.lit(0).alias("corpus"), "doc_id", "text", token_count("text").alias("tokens"))
    return windows.number_rows(chunks, "doc_id")


def search(docs: DataFrame, query: str, budget: int, least: int = 1, judge: Judge | None = None, positives: bool = False) -> DataFrame:
    """corpus, i, doc_id, start, stop, context, is_relevant, summary, evidence of every chunk, or of the ``positives`` alone.

    The lexical judge reads the chunk only, so that contexts are built after it has judged, and only for the rows returned.
    Windows are found over the whole corpus and each different context is built once. With a judge of one's own the chunks are
    dealt by their window, so that prompts with the same beginning follow each other, and the judgements are written before
    they are used: no chunk is judged twice.
    """
    chunks = materialize(chunks_of(docs), "chunks")
    found = materialize(windows.stable_windows(chunks, budget), "windows")
    if judge is None:
        asked = chunks.select("*", lexical_judgement(F.col("text"), query, least).alias("_j")).select(*chunks.columns, "_j.*")
        asked = asked.filter("is_relevant") if positives else asked
        wanted = materialize(asked.join(found, ["corpus", "i"]), "judged")
        out = wanted.join(windows.context_texts(wanted, chunks), ["corpus", "start", "stop"])
        return out.select("corpus", "start", "stop", "i", "doc_id", "text", "tokens", "context", "is_relevant", "summary", "evidence")
    contexts = windows.context_texts(found, chunks)
    rows = chunks.join(found, ["corpus", "i"]).join(contexts, ["corpus", "start", "stop"])
    near = rows.repartitionByRange("corpus", "start").sortWithinPartitions("corpus", "start", "i")
    answers = materialize(judged(near, judge), "judgements")
    rows = rows.join(answers, ["corpus", "i"])
    return rows.filter("is_relevant") if positives else rows


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows."""
    import pyarrow.compute as pc

    size = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(size) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(size)}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), *size)


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, summed in order: equal vectors give equal sums, wherever they stand."""
    return (x * y).cumsum(1)[:, -1] if x.shape[1] else np.zeros(len(x))


class _Block:
    """Vectors that queries are compared with."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.squares, self.unit = _dots(vectors, vectors), self._units(vectors)

    @staticmethod
    def _units(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.sqrt((m * m).sum(1)), 1e-300)[:, None]

    def best(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id, cosine of the k nearest of each query in this block.

        Whatever comes within rounding of the k-th best of a matrix product is compared by ordered sums, in slices.
        """
        cos = self._units(vectors) @ self.unit.T
        cos[np.isnan(cos) | (ids[:, None] == self.ids[None, :])] = -np.inf
        k = min(k, cos.shape[1])
        least = np.partition(cos, -k, axis=1)[:, -k] - 1e-9
        q, b = np.nonzero((cos >= least[:, None]) & (cos > -np.inf))
        exact, squares = np.empty(len(q)), _dots(vectors, vectors)
        for at in range(0, len(q), CLOSE):
            i, j = q[at : at + CLOSE], b[at : at + CLOSE]
            norm = np.sqrt(squares[i] * self.squares[j])
            exact[at : at + CLOSE] = np.where(norm > 0, _dots(vectors[i], self.vectors[j]) / np.where(norm > 0, norm, 1), 0.0)
        order = np.lexsort((self.ids[b], -exact, q))
        q, b, exact = q[order], b[order], exact[order]
        first = np.searchsorted(q, q)
        top = np.arange(len(q)) - first < k
        return ids[q[top]], self.ids[b[top]], exact[top]


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, rank, cosine of the k nearest vectors of each query, itself left out.

    Vectors are dealt to blocks and every block is sent all queries, which stream past it: memory is bounded by one block and one
    batch of queries, and only the k best of each block are kept. The products grow with queries times vectors.
    """
    n = vectors.count()
    parts = shuffle_partitions(vectors.sparkSession)
    blocks = max(1, -(-n // VECTORS), min(parts, n // QUERIES))
    rows = lambda df, block, asked: df.filter(F.col("embedding").isNotNull()).select(block.alias("block"), F.lit(asked).alias("asked"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    base = rows(vectors, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), False)
    asked = rows(queries, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), True)
    dealt = base.union(asked).repartition(parts, "block").sortWithinPartitions("block", "asked")

    def best(batches):
        import pyarrow as pa

        at, held, block = None, [], None
        for batch in batches:
            number, is_asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "asked"))
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (is_asked[1:] != is_asked[:-1])) + 1
            for lo, hi in pairwise([0, *cuts.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                if number[lo] != at:
                    at, held, block = number[lo], [], None
                step = QUERIES if is_asked[lo] else hi - lo
                for start in range(lo, hi, step):
                    part = batch.slice(start, min(step, hi - start))
                    one = part.column("vec_id").to_numpy(), _matrix(part.column("v"))
                    if not is_asked[lo]:
                        held.append(one)
                        continue
                    if block is None and held:
                        block, held = _Block(*map(np.concatenate, zip(*held, strict=True))), []
                    if block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in block.best(*one, k)], ["query_id", "vec_id", "cosine"])

    found = dealt.mapInArrow(best, "query_id long, vec_id long, cosine double")
    lists = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("_c"), "vec_id"))), 1, k).alias("_l"))
    each = lists.select("query_id", F.posexplode("_l").alias("_i", "_x"))
    return each.select("query_id", F.col("_x.vec_id").alias("vec_id"), (F.col("_i") + 1).cast("long").alias("rank"), F.round(-F.col("_x._c"), 6).alias("cosine"))
