"""Substring dedup by seed and extend.

Every window of ``WINDOW`` words has an anchor by winnowing: the least hash of its runs of ``GRAM`` words. Equal windows have
equal anchors, so windows can only repeat where an anchor does. A document falls into stretches of neighbouring windows with
one anchor. Documents are joined on anchors that occur more than once, and each match is extended to both sides of its seed:
where all stretches at an anchor agree to their ends, over the whole stretch at once, and elsewhere window by window, as far as
the words on the left and on the right agree with any other occurrence. What touches or overlaps in a document is put together
to maximal repeats; none is shorter than a window.

Anchors only choose what is compared. Whether stretches and windows are equal is decided by hashes of 128 bits of their
words, and rows go by a digest of 128 bits, so that no repeat is made up.

Windows are judged on the input, in all documents and within one. Null and empty texts, and texts shorter than a window, keep
everything. Documents are known by doc_id and text, so repeated rows and ids are judged as they stand: every copy of
a text of at least a window loses all of it. Extra columns are ignored by ``repeat_digests`` and kept by ``cut_repeats``,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lectern.llm.words import Words, mix, slices, sliding_min
from lectern.plans.shared import materialize, spread

WINDOW, GRAM = 35, 8
_PLACE = np.uint64(0x165667B19E3779F9)


def _stretches(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """anchor, both halves of the content's hash, first and windows of each stretch of a text, and whether the text holds the anchor again."""
    if len(words) < window:
        return None
    grams = words.grams(gram)
    least = sliding_min(grams, window - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.concatenate((first, [len(least)])))
    # The content is known by the hashes of its windows at their places.
    place = (np.arange(len(least)) - np.repeat(first, count)).astype(np.uint64) * _PLACE
    content = mix(np.add.reduceat(mix(words.wide_grams(window) + place[:, None]), first, axis=0) + count.astype(np.uint64)[:, None])
    grams = np.sort(grams)
    more = grams[1:][grams[1:] == grams[:-1]]
    again = np.isin(least[first], more) if len(more) else np.zeros(len(first), bool)
    return least[first].view(np.int64), *content.astype(np.uint64).view(np.int64).T, first.astype(np.int32), count.astype(np.int32), again


_SEED = "key binary, anchor long, c0 long, c1 long, first int, windows int, again boolean"


def _seeds(window: int, gram: int):
    def run(batches):
        import pyarrow as pa

        none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32, bool))
        for batch in slices(batches):
            found = [_stretches(Words(x), window, gram) for x in batch.column(1).to_pylist()]
            index = pa.array(np.repeat(np.arange(batch.num_rows), [0 if x is None else len(x[0]) for x in found]))
            columns = [pa.array(np.concatenate(c)) for c in zip(*([x for x in found if x is not None] or [none]), strict=True)]
            rows = pa.RecordBatch.from_arrays([batch.column(0).take(index), *columns], names=[x.split()[0] for x in _SEED.split(", ")])
            for at in range(0, rows.num_rows, 20_000):
                yield rows.slice(at, 20_000)

    return run


def _windows(window: int):
    """The window hashes of some stretches of a text, one row per stretch."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            for text, stretches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = Words(text).wide_grams(window).view(np.int64)
                for at in range(0, len(stretches), 2_000):
                    part = stretches[at : at + 2_000]
                    own = [grams[x["first"] : x["first"] + x["windows"]] for x in part]
                    offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32))
                    halves = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(h))) for h in np.concatenate(own).T]
                    yield pa.RecordBatch.from_arrays([pa.array([x["c0"] for x in part], pa.int64()), pa.array([x["c1"] for x in part], pa.int64()), *halves], names=["c0", "c1", "h0", "h1"])

    return run


def _key(docs: DataFrame) -> tuple[Column, Column]:
    """Digest of doc_id and text, and the text in UTF-8 (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b"\0"), text))), text


def _rows(docs: DataFrame) -> DataFrame:
    key, text = _key(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text.alias("text"))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, ranges (array of first word and end) of the documents that have repeated windows."""
    rows = _rows(docs)
    seeds = spread(rows.select("key", "text")).mapInArrow(_seeds(window, gram), _SEED)
    anchors = seeds.groupBy("anchor").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("c0", "c1") for f in (F.min, F.max)], F.max("again").alias("_again"))
    # Written, so that the join shuffles both sides and frequent anchors can be split between tasks.
    alike = F.expr("c0_min = c0_max and c1_min = c1_max and not _again")
    anchors = materialize(anchors.filter("n > 1 or _again").select("anchor", alike.alias("alike")), "repeated-anchors")
    found = materialize(seeds.join(anchors.hint("merge"), "anchor").drop("anchor", "again"), "repeated-stretches")
    whole = found.filter("alike").select("key", "first", (F.col("first") + F.col("windows") + (window - 1)).alias("end"))

    # The different stretches at an anchor, each once, with the document that shows its words and how often it occurs.
    kinds = found.filter("not alike").groupBy("c0", "c1").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "windows")).alias("_in"))
    kinds = materialize(kinds, "different-stretches")
    shown = kinds.groupBy(F.col("_in.key").alias("key"))
    shown = shown.agg(F.collect_list(F.struct("c0", "c1", F.col("_in.first").alias("first"), F.col("_in.windows").alias("windows"))).alias("_stretches"))
    texts = rows.join(shown.hint("merge"), "key").select("text", "_stretches")
    hashes = texts.mapInArrow(_windows(window), "c0 long, c1 long, h0 array<long>, h1 array<long>")
    # Equal rows show the same stretch more than once.
    hashes = materialize(hashes.dropDuplicates(["c0", "c1"]).join(kinds.select("c0", "c1", "n").hint("merge"), ["c0", "c1"]), "windows")
    each = hashes.select("c0", "c1", "n", F.posexplode(F.arrays_zip("h0", "h1")).alias("at", "h")).select("c0", "c1", "n", "at", "h.h0", "h.h1")
    twice = materialize(each.groupBy("h0", "h1").agg(F.sum("n").alias("n")).filter("n > 1").select("h0", "h1"), "repeated-windows")
    marked = each.join(twice.hint("merge"), ["h0", "h1"], "left_semi").groupBy("c0", "c1").agg(F.collect_list("at").alias("_at"))
    parts = found.filter("not alike").join(marked.hint("merge"), ["c0", "c1"])
    parts = parts.select("key", F.expr(f"inline(transform(_at, x -> struct(first + x as first, first + x + {window} as end)))"))
    return whole.unionByName(parts).groupBy("key").agg(F.collect_list(F.struct("first", "end")).alias("ranges"))


def maximal(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """The ranges of one document, put together where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((x["first"], x["end"]) for x in ranges or ()):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def _kept(text: bytes, ranges: list[dict] | None) -> tuple[int, int, bytes]:
    """Words of a text, words in its maximal repeats, and the others joined by blanks."""
    words = text.split()
    kept, at = [], 0
    for first, end in maximal(ranges):
        kept += words[at:first]
        at = end
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def _cut(batches):
    import pyarrow as pa

    for batch in slices(batches):
        found = [_kept(*x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        total, removed, kept = zip(*found, strict=True) if found else ((), (), ())
        digests = [hashlib.sha256(x).hexdigest() for x in kept]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _cut_text(batches):
    """Rows: row (struct of the columns), text, ranges -> row, text."""
    import pyarrow as pa

    for batch in slices(batches):
        texts = []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            texts.append(_kept(text.encode(), ranges)[2].decode() if ranges else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def _passages(batches):
    import pyarrow as pa

    for batch in slices(batches):
        out = [
            (doc_id, first, end, b" ".join(words[first:end]).decode())
            for doc_id, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for words in [text.split()]
            for first, end in maximal(ranges)
        ]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["doc_id", "first_word", "end_word", "passage"])


def passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, first_word, end_word, passage: the maximal repeats of every row of ``docs`` (doc_id, text)."""
    found = _rows(docs).join(repeats(docs, window, gram).hint("merge"), "key").select("doc_id", "text", "ranges")
    return found.mapInArrow(_passages, "doc_id long, first_word int, end_word int, passage string")


def repeat_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs`` (doc_id, text): the digest is of the words left, joined by blanks."""
    cut = _rows(docs).join(repeats(docs, window, gram).hint("merge"), "key", "left").select("doc_id", "text", "ranges")
    return cut.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the words of repeated windows removed; texts that lose nothing stay as they are."""
    key, _ = _key(docs)
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("row"), F.col("text").cast("string").alias("text"), key.alias("key"))
    cut = rows.join(repeats(docs, window, gram).hint("merge"), "key", "left").select("row", "text", "ranges")
    schema = StructType([StructField("row", StructType([docs.schema[c] for c in rest])), *StructType.fromDDL("text string")])
    return cut.mapInArrow(_cut_text, schema).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def repeats_sql(window: int = WINDOW) -> str:
    """The same result in DuckDB's SQL: every window of every document as a string, and how often it occurs."""
    return rf"""
WITH words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, md5(array_to_string(w[i + 1 : i + {window}], ' ')) AS h FROM (SELECT r, w, unnest(range(len(w) - {window - 1})) AS i FROM words WHERE len(w) >= {window})),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (SELECT r, list_distinct(flatten(list(range(i, i + {window})))) AS gone FROM windows JOIN twice USING (h) GROUP BY r),
kept AS (SELECT doc_id, w, coalesce(len(gone), 0) AS n, [w[k + 1] FOR k IN range(len(w)) IF gone IS NULL OR NOT list_contains(gone, k)] AS left_over FROM words LEFT JOIN covered USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept"""
