"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to Latin letters and digit substitutions to the letters they stand for. The lexicon is
learned from labelled rows: beginnings of words and whole words, weighted by their smoothed log-odds of document frequency in
toxic against other documents, and kept only if they occur in toxic documents that no stronger entry of the same beginning
explains. Near copies, by the least hash of their shingles, are learned from once, since their common words prove nothing.
Longer beginnings that contain an entry but are common in clean documents become exceptions and mask the matches inside
them, as do the exception phrases given. The weights found, by themselves and normalised by length, give a score by logistic
regression. Fitting uses a bounded sample of labelled rows; scoring reads every whole text.

Null and empty texts match nothing and get the score of no match. Null labels are not learned from, a document with several
labels is toxic if any says so, and with no labels of either kind every score is 0. Rows with a null doc_id are scored
like others and count as held out. Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.jaccard import shingles
from lectern.llm.words import slices
from lectern.plans.shared import materialize, spread

#: Most toxic and most other labelled rows that the lexicon is fitted on, taken in the order of a hash of doc_id.
MAX_TOXIC, MAX_CLEAN = 6_000, 12_000
#: Toxic documents that an entry must occur in, beyond those that a stronger entry of the same beginning explains.
MIN_DOCS = 4
#: Least log-odds of an entry (eight times likelier in toxic documents), and least log-odds times toxic documents.
MIN_WEIGHT, MIN_EVIDENCE = math.log(8), 20.0
PREFIXES = range(4, 9)
#: Phrases within which a match does not count.
EXCEPTIONS = ("dumb waiter", "dumb bell", "trash can", "trash bin", "class clown", "clown fish", "scum line")

# Homoglyphs and substitutions, as letters look alike.
_LIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
_FOLD = str.maketrans(_LIKE | dict.fromkeys("\u200b\u200c\u200d\ufeff\u00ad", ""))


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


@dataclass(frozen=True)
class Model:
    """``weights``: entry -> weight; an entry ends with a space if it is a whole word. ``coef``: bias, sum, sum by length."""

    weights: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    coef: tuple[float, float, float] | None = None


@dataclass
class Matcher:
    model: Model
    automaton: object = field(init=False, default=None)

    def __post_init__(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.model.weights:
            found.add_word(entry.rstrip(" "), [])
        for phrase in self.model.exceptions:
            found.add_word(phrase, [])
        for entry, weight in self.model.weights:
            found.get(entry.rstrip(" ")).append((len(entry.rstrip(" ")), entry.endswith(" "), entry, weight))
        for phrase in self.model.exceptions:
            found.get(phrase).append((len(phrase), False, None, 0.0))
        if len(found):
            found.make_automaton()
            self.automaton = found

    def __call__(self, text: str) -> list[tuple[str, float]]:
        """The entries that stand in a folded text, each as often as it does; of those that start at one place only the strongest."""
        if self.automaton is None or not text:
            return []
        hits: dict[int, tuple[str, float]] = {}
        masked: list[tuple[int, int]] = []
        size = len(text)
        for end, entries in self.automaton.iter(text):
            for length, whole, entry, weight in entries:
                start = end - length + 1
                if start and text[start - 1].isalpha():
                    continue
                if entry is None:
                    masked.append((start, end))
                elif (not whole or end + 1 == size or not text[end + 1].isalpha()) and (start not in hits or hits[start][1] < weight):
                    hits[start] = (entry, weight)
        if masked:
            merged: list[list[int]] = []
            for a, b in sorted(masked):
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            starts = [a for a, _ in merged]
            hits = {s: x for s, x in hits.items() if not ((at := bisect_right(starts, s)) and s <= merged[at - 1][1])}
        return list(hits.values())

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text or "")
        total = sum(w for _, w in self(folded))
        return math.log1p(total), (math.log1p(1000 * total / (5 + len(folded.split()))) if total else 0.0)

    def score(self, text: str | None) -> float:
        if self.model.coef is None:
            return 0.0
        a, b = self.features(text)
        bias, x, y = self.model.coef
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + x * a + y * b))))


@lru_cache(maxsize=4)
def matcher(model: Model) -> Matcher:
    return Matcher(model)


def word_features(text: str) -> set[str]:
    """The beginnings of the distinct words of a folded text, and the words with a space behind them."""
    words = {w for w in "".join(c if c.isalpha() else " " for c in text).split() if len(w) >= 3}
    return {w[:n] for w in words for n in PREFIXES if len(w) > n} | {f"{w} " for w in words}


def _count(batches):
    """Feature, toxic and other documents that have it, summed as far as one worker sees."""
    import pyarrow as pa

    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        keys = sorted({*seen[0], *seen[1]})
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["feature", "pos", "neg"])
        seen[0].clear()
        seen[1].clear()
        return batch

    size = 0
    for batch in slices(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = word_features(fold(text or ""))
            seen[toxic].update(found)
            size += sum(map(len, found))
            if size > 4_000_000:
                yield out()
                size = 0
    yield out()


def _least_shingle(batches):
    import pyarrow as pa

    for batch in slices(batches):
        least = [int(x[0]) if len(x) else 0 for x in (shingles((t or "").encode()) for t in batch.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(least, np.uint64).view(np.int64))], names=["text", "_toxic", "_like"])


def _sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """text, toxic of the training sample: a bounded number of ids, so it may be broadcast, and no text is shuffled."""
    train = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 != 0
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & train)
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("_toxic"))
    )
    order = F.xxhash64("_id")
    some = known.filter("_toxic = 1").orderBy(order, "_id").limit(max_toxic).unionAll(known.filter("_toxic = 0").orderBy(order, "_id").limit(max_clean))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    found = found.select("text", "_toxic").mapInArrow(_least_shingle, "text string, _toxic int, _like long")
    return found.groupBy("_toxic", "_like").agg(F.min("text").alias("text")).select("text", "_toxic")


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn from labelled rows of ``docs`` whose crc32(doc_id as text) mod 5 is not 0; at most the two bounds are used."""
    sample = materialize(_sample(docs, labels, max_toxic, max_clean), "toxic-sample")
    sizes = {r["_toxic"]: r["n"] for r in sample.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Model()
    counts = sample.mapInArrow(_count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    counts = materialize(counts.filter((F.col("pos") >= MIN_DOCS) | (F.col("neg") >= MIN_DOCS)).withColumn("weight", odds), "toxic-counts")
    rank = F.col("weight") * F.col("pos")
    strong = (F.col("pos") >= MIN_DOCS) & (F.col("weight") >= MIN_WEIGHT) & (F.col("weight") * F.col("pos") >= MIN_EVIDENCE)
    found = counts.filter(strong).orderBy(rank.desc(), "feature").collect()  # of a bounded sample
    candidates = Model(tuple((r["feature"], r["weight"]) for r in found))
    rows = sample.mapInArrow(_entries(candidates), "toxic int, entries array<string>").collect()  # at most the two bounds
    kept = _explaining([set(r["entries"]) for r in rows if r["toxic"]], {r["feature"]: r["weight"] * r["pos"] for r in found})
    weights = tuple((r["feature"], float(r["weight"])) for r in found if r["feature"] in kept)
    stems = sorted(x for x, _ in weights if not x.endswith(" "))
    benign = []
    if stems:
        # Stems have the lengths of PREFIXES, so those that a feature begins with are found by a join.
        begins = F.explode(F.array(*[F.left("feature", F.lit(n)) for n in PREFIXES]))
        common = counts.filter((F.col("weight") < 0) & (F.col("neg") >= MIN_DOCS)).select("feature", "neg", begins.alias("stem"))
        within = common.join(docs.sparkSession.createDataFrame([(x,) for x in stems], "stem string"), "stem").select("feature", "neg").distinct()
        benign = [r["feature"].rstrip(" ") for r in within.orderBy(F.col("neg").desc(), "feature").collect()]
    model = Model(weights, tuple(sorted({*map(fold, exceptions), *benign} - {x.rstrip(" ") for x, _ in weights})))
    rows = sample.mapInArrow(_features(model), "toxic int, a double, b double").collect()  # at most the two bounds
    return Model(model.weights, model.exceptions, _logistic(np.array([[1.0, r["a"], r["b"]] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float)))


def _explaining(docs: list[set[str]], rank: dict[str, float]) -> set[str]:
    """Entries by falling rank, as far as they add documents to those of entries that begin alike."""
    where: dict[str, set[int]] = {}
    for i, entries in enumerate(docs):
        for x in entries:
            where.setdefault(x, set()).add(i)
    kept: set[str] = set()
    own: dict[str, list[set[int]]] = {}  # documents of the kept entries by stem,
    below: dict[str, list[set[int]]] = {}  # and by every beginning of their stems
    for x in sorted(where, key=lambda x: (-rank[x], x)):
        stem = x.rstrip(" ")
        begins = [stem[:n] for n in range(1, len(stem) + 1)]
        alike = [*below.get(stem, []), *(d for y in begins[:-1] for d in own.get(y, []))]
        if len(where[x].difference(*alike)) >= MIN_DOCS:
            kept.add(x)
            own.setdefault(stem, []).append(where[x])
            for y in begins:
                below.setdefault(y, []).append(where[x])
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton's method; the ridge spares the bias. Steps are halved until the loss falls, since whole ones need not end where classes hardly overlap."""
    penalty = ridge * np.diag([0.0, 1.0, 1.0]) + 1e-9 * np.eye(3)

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((np.logaddexp(0.0, z) - y * z).sum() + beta @ penalty @ beta / 2)

    beta = np.zeros(x.shape[1])
    now = loss(beta)
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (y - p) - penalty @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, slope)
        gain, size = float(slope @ step), 1.0
        while size > 1e-12 and not (then := loss(beta + size * step)) <= now - 1e-4 * size * gain:
            size /= 2
        if size <= 1e-12:  # as low as the loss can be told
            break
        beta, now = beta + size * step, then
        if gain < 1e-12:
            break
    return tuple(float(b) for b in beta)


def _entries(model: Model):
    def run(batches):
        import pyarrow as pa

        match = all_entries(model)
        for batch in slices(batches):
            found = [sorted(match(fold(t or ""))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(found, pa.list_(pa.string()))], names=["toxic", "entries"])

    return run


@lru_cache(maxsize=2)
def all_entries(model: Model):
    known = {x for x, _ in model.weights}
    return lambda text: word_features(text) & known


def _features(model: Model):
    def run(batches):
        import pyarrow as pa

        match = matcher(model)
        for batch in slices(batches):
            x = [match.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], names=["toxic", "a", "b"])

    return run


def _scores(model: Model):
    def run(batches):
        import pyarrow as pa

        score = matcher(model).score
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([score(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return (
        spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
        .mapInArrow(_scores(model), "doc_id long, score double")
        .select("doc_id", F.coalesce(rest, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )


def _clean(model: Model, text_at: int):
    def run(batches):
        import pyarrow as pa

        score = matcher(model).score
        for batch in slices(batches):
            yield batch.filter(pa.array([score(t) < 0.5 for t in batch.column(text_at).to_pylist()], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    return spread(docs).mapInArrow(_clean(model, docs.columns.index("text")), docs.schema)
