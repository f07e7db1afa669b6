"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked; the r-th of n rows of a source has the fractional rank
(r - 1/2) / n. Sorted by fractional rank, every stretch of the sequence holds each source in its share of the whole, so equal
cuts give shards that all match the mixture. The law is ``rows``: counts of shards are at most one apart.

A hot source is split by the leading digits of the hash, and the sorted sequence by ranges of fractional rank; both are
numbered in two levels. Null sources are a source of their own; null texts have no bytes; rows without a doc_id and repeated
rows are dealt like others (equal rows may swap places, which changes nothing). Shards of fewer rows than shards may be
empty. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordered import HASH_DIGITS, prefix_sums
from lectern.plans.shared import materialize

SHARDS, SEED = 24, 42


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, source, text)."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("_h"),
    )
    rows = materialize(rows.withColumn("_hb", F.conv(F.substring("_h", 1, HASH_DIGITS), 16, 10).cast("int")), "shard-rows")
    ranked = prefix_sums(rows, "_hb", ["_h", "doc_id", "text_crc32", "size"], F.lit(1), ["source"], "_rank")
    counts = rows.groupBy("source").agg(F.count("*").alias("_n")).withColumnRenamed("source", "_s")
    at = (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_n")).cast("double")
    ranked = ranked.join(counts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_at", at)
    ranked = materialize(ranked.withColumn("_range", F.floor(F.col("_at") * 16**HASH_DIGITS).cast("int")), "shard-ranks")
    placed = prefix_sums(ranked, "_range", ["_at", "source", "_h", "doc_id", "text_crc32", "size"], F.lit(1), None, "_place")
    total = rows.count()
    which = F.expr(f"(_place * {shards}) div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", which.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def shard_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """The same result in DuckDB's SQL. The CRC-32 is worked out byte by byte, from its table of 256 entries."""
    return rf"""
WITH steps AS (SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) FOR i IN range(256)] AS t),
bytes AS (
  SELECT doc_id, source, text, [('0x' || x)::BIGINT FOR x IN string_split(rtrim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1 ', 'g')), ' ') IF x <> ''] AS b FROM documents),
rows AS (
  SELECT doc_id, source, len(b) + 8 AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32,
    md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM bytes, steps),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS place_in_source, count(*) OVER () AS total FROM rows),
placed AS (SELECT *, row_number() OVER (ORDER BY place_in_source, source NULLS FIRST, h, doc_id, text_crc32, size) - 1 AS place FROM ranked),
dealt AS (SELECT *, place * {shards} // total AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * total + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INT AS grown_shard FROM dealt"""
