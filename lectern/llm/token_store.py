"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Rows are dealt by ranges of ``doc_id`` and sorted within them, so that files, and the row groups in them, cover narrow and
ascending ranges of ids: ORC's stripe and row-group statistics prune ranges, and the Bloom filter prunes single ids.
Each row keeps its part and the ids of its part before it; the offset of a part is the sum over the parts before it, so any
stripe can be read by itself and still know its place in the whole stream.

Null and empty texts are stored as the end id alone. Rows without a doc_id come first. Repeated ids are stored as often as
they occur, ordered by text; ranges follow its beginning too, so that a very common id (or none) is split between them. An empty table gives an empty store. Extra columns are not stored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import default_tokenizer, piece_encoder
from lectern.llm.words import slices
from lectern.operators.ordered import bounds_by_size, byte_keys, with_range

STORED = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
#: Stripes are the unit of parallel reads; row groups the unit of pruning within a stripe.
STRIPE_BYTES = 64 << 20
#: Text of one range, that is of one file.
RANGE_BYTES = 256 << 20
ROW_GROUP = 1000


def _encode(path: str, end_id: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        encode, at = piece_encoder(path), {}
        for batch in slices(batches):
            parts = batch.column(1).to_pylist()
            ids = [encode(x) + end for x in batch.column(2).to_pylist()]
            sizes = np.asarray([len(x) // 4 for x in ids], dtype=np.int64)
            start = []
            for part, size in zip(parts, sizes.tolist(), strict=True):
                start.append(at.get(part, 0))
                at[part] = start[-1] + size
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            stored = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(start, pa.int64()), pa.array(sizes), stored], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, stripe_bytes: int = STRIPE_BYTES, row_group: int = ROW_GROUP) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write the store at ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = rows.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(byte_keys(F.col("text")))])
    keys = [F.col("doc_id"), F.col("_k0"), F.col("_k1")]
    bounds = bounds_by_size(rows, keys, F.octet_length("text"), RANGE_BYTES)
    (
        with_range(rows, keys, bounds, "part")
        .select("doc_id", "part", "text")
        .repartitionById(len(bounds) + 1, F.col("part"))
        .sortWithinPartitions("part", "doc_id", "text")
        .mapInArrow(_encode(tokenizer or default_tokenizer(), end_id), STORED)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", row_group)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with ``start``: ids of all documents before each. Filters on doc_id reach the stripes."""
    stored = spark.read.schema(STORED).orc(path)
    # One row per part, and a part is a task of the write, 1 << 17 at most: a bounded table.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return stored.join(F.broadcast(sums), "part").withColumn("start", F.col("part_start") + F.col("start_in_part"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; only stripes and row groups whose statistics and Bloom filters admit them are read."""
    return spark.read.schema(STORED).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def _crc32(batches):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(3)
        offsets, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc32, "doc_id long, start long, n_tokens long, ids_crc32 long")
