"""Mixing sources to target weights with a low-discrepancy schedule.

Targets come from weights by water filling under a cap of ``max_repeats`` times a source's size. The mix is a sequence of
equal blocks of words; block i belongs to the source whose share of the unit interval holds the i-th golden-ratio point, so
every stretch of the mix is near the targets. The r-th slot of a source takes the r-th block of the source's documents, laid
end to end in seeded random order and, if needed, again from the start.

Golden-ratio points are taken as integers modulo 2^30, so that they are exact anywhere in the sequence. Null sources are a
source of their own, last in order; null texts and texts without words have size 0 and take nothing. Repeated rows are
documents of their own. An empty table gives an empty mix. Extra columns are ignored. Reruns agree: nothing depends on the
order of rows, except that equal rows may swap places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import HASH_DIGITS, prefix_sums
from lectern.plans.shared import materialize

BLOCK_WORDS, MAX_REPEATS, SEED = 128, 3, 42
#: The golden ratio's share of 2^30, made odd: multiples of it modulo 2^30 visit every point once and evenly.
POINTS, STEP = 1 << 30, 663608941


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: int = SEED, row: str | None = None) -> DataFrame:
    """doc_id, source, size, the hash that shuffles and the column ``row``, if named, as ``_row``; one row per document."""
    rows = docs.select(
        *([F.col(row).alias("_row")] if row else []),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("_h"),
    )
    return materialize(rows.withColumn("_hb", F.conv(F.substring("_h", 1, HASH_DIGITS), 16, 10).cast("int")), "mix-sizes")


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target. Weights repeat over the sources in code-point order, null last.

    Under water filling a source gets min(cap, level * weight). With the sources in order of cap / weight the level is set
    by the longest prefix of capped sources whose filling does not exceed the total; it is found with running sums.
    One row per source is ordered as a whole here, never rows of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    of = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", of.cast("long")).withColumn("cap", max_repeats * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    per = materialize(per.select("*", F.sum("cap").over(fill).alias("_c"), F.sum("weight").over(fill).alias("_w")), "mix-sources")
    total, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    full = F.col("_c") + F.col("cap") / F.col("weight") * (weight - F.col("_w")) <= total
    capped = per.filter(full & (F.col("_w") < weight)).agg(F.max(F.struct("_w", "_c")).alias("_k")).first()["_k"] or (0, 0)
    level = F.lit((total - capped[1]) / (weight - capped[0]))
    return per.select("source", "source_size", F.lit(total).alias("_total"), F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def schedule(spark, shares: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source, rank: the source of every block of the mix, and how many blocks of that source come before."""
    edges = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ends = shares.select("source", "target", "_total", F.floor(F.sum("target").over(edges) / F.greatest(F.col("_total"), F.lit(1)) * POINTS).alias("_to"))
    ends = ends.withColumn("_from", F.coalesce(F.lag("_to").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0)))
    total = shares.agg(F.max("_total").alias("t")).first()["t"] or 0
    slots = spark.range(-(-total // block_words)).select(F.col("id").alias("slot"), F.expr(f"((id % {POINTS}) * {STEP}) % {POINTS}").alias("_u"))
    # Points fall into 4,096 bins; the sources that reach into a bin are one list, so that the lookup is an equi-join.
    bins = F.floor(F.col("_u") * 16**HASH_DIGITS / POINTS).cast("int")
    width = POINTS // 16**HASH_DIGITS
    held = ends.filter("_to > _from").withColumn("_bin", F.explode(F.sequence(F.expr(f"cast(_from div {width} as int)"), F.expr(f"cast((_to - 1) div {width} as int)"))))
    lists = held.groupBy("_bin").agg(F.collect_list(F.struct("_from", "_to", "source")).alias("_held"))
    one = F.filter("_held", lambda x: (x["_from"] <= F.col("_u")) & (F.col("_u") < x["_to"]))
    found = slots.withColumn("_bin", bins).join(lists, "_bin").withColumn("_one", F.get(one, F.lit(0))).filter("_one is not null")
    found = found.select("slot", F.col("_one.source").alias("source"), F.expr("slot div 8192").alias("_chunk"))
    return prefix_sums(found, "_chunk", ["slot"], F.lit(1), ["source"], "rank").drop("_chunk")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS, seed: int = SEED, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, source, size, source_size, target, _key) and the mix: slot, source, _key, doc_id, from_word, to_word.

    A row of the mix is a stretch of words of one document; slots in order, and in a slot by ``at``, give the mixed text.
    ``row`` names a column that tells rows apart; the documents then keep it as ``_row``.
    """
    spark = docs.sparkSession
    rows = sized(docs, seed, row)
    own = ["_row"] if row else []
    shares = materialize(targets(rows, weights, max_repeats), "mix-targets")
    laid = prefix_sums(rows, "_hb", ["_h", "doc_id", "size", *own], F.col("size"), ["source"], "_start")
    laid = laid.join(shares.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    laid = materialize(laid.select(*own, "doc_id", "source", "size", "source_size", "target", F.col("_start").alias("_key")), "mix-laid")
    slots = materialize(schedule(spark, shares, block_words), "mix-slots")
    taken = slots.groupBy(F.col("source").alias("_s")).agg((F.max("rank") + 1).alias("_slots"))
    last = F.least(F.col("_slots") * block_words, max_repeats * F.col("source_size"))
    copies = (
        laid.filter("size > 0")
        .join(taken, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_end", last)
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("_a", F.col("_key") + F.col("_epoch") * F.col("source_size"))
        .withColumn("_b", F.least(F.col("_a") + F.col("size"), F.col("_end")))
        .filter("_b > _a")
    )
    pieces = copies.withColumn("rank", F.explode(F.sequence(F.expr(f"_a div {block_words}"), F.expr(f"(_b - 1) div {block_words}"))))
    pieces = pieces.select(
        "source",
        "rank",
        "doc_id",
        "_key",
        F.greatest(F.col("_a"), F.col("rank") * block_words).alias("at"),
        (F.greatest(F.col("_a"), F.col("rank") * block_words) - F.col("_a")).alias("from_word"),
        (F.least(F.col("_b"), (F.col("rank") + 1) * block_words) - F.col("_a")).alias("to_word"),
    )
    block = slots.select("slot", F.col("source").alias("_s"), F.col("rank").alias("_r"))
    mixed = pieces.join(block, (F.col("rank") == F.col("_r")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_r")
    return laid, mixed


def taken_words(laid: DataFrame, mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and ``_row`` if the documents have it.

    A document is known by its source and its place in the source's order, where documents without words share their place
    with the next one and take nothing.
    """
    got = mixed.groupBy(F.col("source").alias("_s"), F.col("_key").alias("_k")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k")) & (F.col("size") > 0)
    return laid.join(got, on, "left").select(*[c for c in laid.columns if c == "_row"], "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_sql(weights: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> str:
    """The words taken, in DuckDB's SQL: the same schedule, and each document's overlap with its source's blocks in closed form."""
    return rf"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
laid AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM docs),
per AS (
  SELECT source, source_size, {list(weights)}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT] AS weight, {max_repeats} * source_size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source)),
filled AS (
  SELECT *, sum(cap) OVER w AS c, sum(weight) OVER w AS v, sum(source_size) OVER () AS total, sum(weight) OVER () AS whole
  FROM per WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
capped AS (SELECT coalesce(max(v), 0) AS v, coalesce(max(c), 0) AS c FROM filled WHERE v < whole AND c + cap / weight * (whole - v) <= total),
targets AS (SELECT source, source_size, total::BIGINT AS total, least(cap::DOUBLE, (total - capped.c)::DOUBLE / (whole - capped.v)::DOUBLE * weight) AS target FROM filled, capped),
edges AS (SELECT *, floor(sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / greatest(total, 1) * {POINTS})::BIGINT AS upto FROM targets),
shares AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY source NULLS LAST), 0) AS since FROM edges),
points AS (SELECT ((i % {POINTS}) * {STEP}) % {POINTS} AS u FROM range((SELECT (max(total) + {block_words - 1}) // {block_words} FROM targets)) t(i)),
slots AS (SELECT source, count(*) AS n FROM points JOIN shares ON since <= u AND u < upto GROUP BY source),
ends AS (SELECT t.*, least(coalesce(n, 0) * {block_words}, {max_repeats} * source_size) AS last FROM targets t LEFT JOIN slots s ON t.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, list_sum([greatest(0, least(a + k * source_size + size, last) - (a + k * source_size)) FOR k IN range({max_repeats})])::BIGINT AS taken
FROM laid l JOIN ends e ON l.source IS NOT DISTINCT FROM e.source"""
