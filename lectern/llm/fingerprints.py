"""Document fingerprints from closed syncmers.

A k-mer of code points is selected if the least of its s-mers, by hash, stands first or last in it. Whether a k-mer is
selected depends on nothing but the k-mer, so a stretch of text that two documents share selects the same anchors in both.
The fingerprint keeps the anchors of least hash with their first positions; the likeness of two fingerprints is the share of
their common anchors whose positions agree up to one shift, among the anchors of least hash of both.

Null and empty texts have an empty fingerprint, which is like itself (1) and unlike any other (0). Texts shorter than a k-mer
have one anchor, the whole text. Equal texts have equal fingerprints. The next document is the next row in the order of
doc_id (null first), ties by text; after the last comes the first, and a single document is its own next. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import mix, slices, sliding_min
from lectern.operators.ordered import bounds_by_size, byte_keys, with_range

K, S, KEEP = 16, 4, 40
#: Text of one range, which a task sorts.
RANGE_BYTES = 256 << 20
_HASH_BITS = 48
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))

Anchors = tuple[np.ndarray, np.ndarray]


def syncmers(text: str) -> Anchors:
    """Hashes and positions of the closed syncmers of a text, in order of position."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(text) < K:
        whole = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
        return np.array([whole], np.uint64), np.zeros(1, np.int64)
    h, width = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) * _STEPS[0]), 1
    smers = h
    for step in _STEPS:  # hashes of 2, 4, 8 and 16 code points, each from two of the half
        h, width = h[:-width] * step + h[width:], 2 * width
        smers = mix(h) if width == S else smers
    inner = K - S + 1
    least = sliding_min(smers, inner)
    at = np.flatnonzero((smers[: len(least)] == least) | (smers[inner - 1 :] == least))
    return mix(h[at]), at


def sketch(text: str, keep: int = KEEP) -> Anchors:
    """The anchors of least hash, each with its first position."""
    hashes, at = syncmers(text)
    hashes = hashes >> np.uint64(64 - _HASH_BITS)
    if len(hashes) > 4 * keep:  # distinct hashes are at least as many as the kept ones unless the text repeats itself
        few = np.partition(hashes, 4 * keep)[4 * keep]
        low = hashes <= few
        if len(np.unique(hashes[low])) >= keep:
            hashes, at = hashes[low], at[low]
    hashes, first = np.unique(hashes, return_index=True)
    return hashes[:keep], at[first[:keep]]


def to_string(anchors: Anchors) -> str:
    return " ".join([f"{h:012x}.{p:x}" for h, p in zip(anchors[0].tolist(), anchors[1].tolist(), strict=True)])


def from_string(fingerprint: str) -> Anchors:
    pairs = [x.split(".") for x in fingerprint.split()]
    return np.array([int(h, 16) for h, _ in pairs], np.uint64), np.array([int(p, 16) for _, p in pairs], np.int64)


def likeness(a: Anchors, b: Anchors, keep: int = KEEP) -> float:
    """Share, from 0 to 1, of the least anchors of both that are common and stand at one shift of positions."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    both = np.union1d(a[0], b[0])
    if max(len(a[0]), len(b[0])) >= keep:
        both = both[:keep]
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = a[0][i] <= both[-1]
    if not common.any():
        return 0.0
    shift = (b[1][j] - a[1][i])[common]
    slack = max(K, int(max(a[1].max(), b[1].max())) // 20)
    return float((np.abs(shift - np.median(shift)) <= slack).sum() / len(both))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprints(batches):
    """Rows come in order; the last of a part is a copy of the first row of the next part, which only serves as a next document."""
    import pyarrow as pa

    before, rows = None, []
    for batch in slices(batches):
        for doc_id, data, copied in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text = data.decode("utf-8", "replace")
            now = (doc_id, text, sketch(text), copied)
            if before is not None and not before[3]:
                new = edited(before[1], text)
                of_new = sketch(new)
                rows.append((before[0], len(before[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), to_string(before[2]), to_string(of_new), likeness(before[2], of_new), likeness(before[2], now[2])))
            if before is None or not before[3]:
                before = now
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])
            rows = []


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of ``docs`` (doc_id, text) and of its edited text, and their likenesses.

    The text is shuffled once, by ranges of doc_id; the first row of each range is copied to the range before it.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *[k.alias(f"_k{i}") for i, k in enumerate(byte_keys(text))])
    keys = [F.col("doc_id"), F.col("_k0"), F.col("_k1")]
    bounds = bounds_by_size(rows, keys, F.octet_length("text"), RANGE_BYTES)
    rows = with_range(rows, keys, bounds, "_range")
    # One row per range, of which there are 1 << 17 at most.
    firsts = rows.groupBy("_range").agg(F.min(F.struct(*keys)).alias("_f")).select("_range", "_f.*").collect()
    firsts = sorted((tuple(r) for r in firsts), key=lambda r: r[0])
    if not firsts:
        return rows.sparkSession.createDataFrame([], _OUT)
    before = [(firsts[i - 1][0], *f[1:]) for i, f in enumerate(firsts)]
    before = F.broadcast(rows.sparkSession.createDataFrame(before, "_to int, _id long, _t0 long, _t1 long"))
    on = (F.col("_k0") == F.col("_t0")) & (F.col("_k1") == F.col("_t1")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    copies = rows.join(before, on).select("doc_id", "text", F.col("_to").alias("_range"))
    both = rows.select("doc_id", "text", "_range").withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))
    return (
        both.repartitionById(len(bounds) + 1, F.col("_range"))
        .sortWithinPartitions("_copy", F.asc_nulls_first("doc_id"), "text")
        .select("doc_id", "text", "_copy")
        .mapInArrow(_fingerprints, _OUT)
    )
