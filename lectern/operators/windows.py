"""Token prefix sums, as-of lookups and context windows over a sequence of chunks.

A corpus is a table with ``corpus``, ``i`` (0-based place of the chunk) and ``tokens``. Prefix sums are taken in two levels
over ranges of ``i``, so that one huge corpus is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.numbers import round_div
from lectern.operators.ordered import prefix_sums, ranged
from lectern.plans.shared import materialize

#: Chunks in one range of a prefix sum or an as-of lookup.
RANGE = 4096


def number_rows(df: DataFrame, key: str, out: str = "i", group: list[str] | None = None) -> DataFrame:
    """0-based place of each row in the order of an integer key, in two levels."""
    return prefix_sums(ranged(df, [key]), "_range", [key], F.lit(1).cast("long"), group, out).drop("_range")


def with_prefix_sums(chunks: DataFrame) -> DataFrame:
    """``lo``, ``hi``: tokens before the chunk and up to its end. Places have no gaps, so stretches of them are buckets."""
    ranges = chunks.withColumn("_range", F.expr(f"i div {RANGE}"))
    return prefix_sums(ranges, "_range", ["i"], F.col("tokens"), ["corpus"], "lo").withColumn("hi", F.col("lo") + F.col("tokens")).drop("_range")


def as_of(points: DataFrame, x: str, bounds: DataFrame, at: str, value: str, out: str, group: str = "corpus", span: int = 1 << 20) -> DataFrame:
    """Add ``out``: the largest ``value`` of the bounds with ``at`` <= ``x`` in the same group; null if there is none.

    Points and bounds are put into cells of ``span`` along the axis and looked up within a cell by a running maximum; what
    stands before a cell comes from the table of the cells' last bounds.
    """
    cells = bounds.select(F.col(group).alias("_g"), F.col(at).cast("long").alias("_at"), F.col(value).cast("long").alias("_v"))
    cells = cells.withColumn("_cell", F.expr(f"floor(_at / {span})"))
    asked = points.withColumn("_cell", F.expr(f"floor({x} / {span})")).withColumn("_g", F.col(group)).withColumn("_at", F.col(x).cast("long"))
    row = F.struct(*[F.col(c) for c in points.columns])
    both = asked.select("_g", "_cell", "_at", F.lit(None).cast("long").alias("_v"), F.lit(1).alias("_ask"), row.alias("_row"))
    both = both.unionByName(cells.withColumn("_ask", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy("_g", "_cell").orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.max("_v").over(inside)).filter("_ask = 1")
    ends = cells.groupBy("_g", "_cell").agg(F.max("_v").alias("_end"))
    every = ends.unionByName(asked.select("_g", "_cell").distinct().withColumn("_end", F.lit(None).cast("long"))).groupBy("_g", "_cell").agg(F.max("_end").alias("_end"))
    # Cells may be as many as the rows where values are far apart, so they too are taken in ranges, and these in order.
    every = materialize(every, "cells")
    every = ranged(every, ["_cell"], "_part")
    parts = every.groupBy("_g", "_part").agg(F.max("_end").alias("_most"))
    parts = parts.select(F.col("_g").alias("_pg"), F.col("_part").alias("_pp"), F.max("_most").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    every = every.join(parts, every["_g"].eqNullSafe(F.col("_pg")) & (F.col("_part") == F.col("_pp")))
    near = F.max("_end").over(Window.partitionBy("_g", "_part").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    before = every.select("_g", "_cell", F.coalesce(near, "_earlier").alias("_before"))
    on = found["_g"].eqNullSafe(before["_g"]) & (found["_cell"] == before["_cell"])
    return found.join(before.select("_g", "_cell", "_before"), on).select("_row.*", F.coalesce("_in", "_before").alias(out))


def boundaries(sums: DataFrame) -> DataFrame:
    """corpus, b, p: the N + 1 boundaries between chunks and the tokens before each."""
    starts = sums.select("corpus", F.col("i").alias("b"), F.col("lo").alias("p"))
    ends = sums.groupBy("corpus").agg(F.max(F.struct("i", "hi")).alias("_l")).select("corpus", (F.col("_l.i") + 1).alias("b"), F.col("_l.hi").alias("p"))
    return starts.unionByName(ends)


def stable_windows(chunks: DataFrame, budget: int) -> DataFrame:
    """i, start, stop of the context window of each chunk: at most ``budget`` tokens, with starts that move in few steps.

    The ideal start, which centres the chunk, is snapped to a grid of two fifths of the budget, so that neighbours share
    their window. Of the two boundaries next to the grid point the better is taken: one whose window holds the chunk, keeps
    its centre between 3/10 and 7/10, wastes least of the budget and is nearest to the grid point. Half units are doubled.
    """
    low, high = 3 * budget // 10, 7 * budget // 10
    step = max(1, high - low)
    # Numbers only, written once: every lookup below reads them again, and none should count tokens again.
    sums = materialize(with_prefix_sums(chunks.select("corpus", "i", "tokens")), "prefix-sums")
    bounds = boundaries(sums)
    count = sums.groupBy("corpus").agg(F.count("*").alias("n"))
    rows = sums.join(count, "corpus").withColumn("_mid2", F.col("lo") + F.col("hi")).withColumn("_num", F.col("_mid2") - budget)
    rows = rows.withColumn("_snap", round_div("_num", str(2 * step)) * step)
    rows = materialize(as_of(rows, "_snap", bounds, "p", "b", "_s0"), "snapped")
    rows = rows.withColumn("_s0", F.least(F.col("n") - 1, F.greatest(F.lit(0), F.coalesce("_s0", F.lit(-1)))))
    # Three starts are tried: the two candidates and, for when neither window holds the chunk, the chunk itself.
    tries = rows.withColumn("_try", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    tries = tries.withColumn("s", F.when(F.col("_try") == 2, F.col("i")).otherwise(F.col("_s0") + F.col("_try"))).filter("s < n")
    start = bounds.select("corpus", F.col("b").alias("s"), F.col("p").alias("_ps"))
    tries = tries.join(start, ["corpus", "s"]).withColumn("_limit", F.col("_ps") + budget)
    tries = as_of(tries, "_limit", bounds, "p", "b", "_e").withColumn("e", F.greatest(F.col("s") + 1, F.least(F.col("n"), F.col("_e"))))
    tries = tries.join(bounds.select("corpus", F.col("b").alias("e"), F.col("p").alias("_pe")), ["corpus", "e"])
    off2 = F.col("_mid2") - 2 * F.col("_ps")
    band = F.when(off2 < 2 * low, 2 * low - off2).when(off2 > 2 * high, off2 - 2 * high).otherwise(0)
    outside = F.when((F.col("s") <= F.col("i")) & (F.col("i") < F.col("e")), 0).otherwise(1)
    # The chunk itself comes last, so it is taken only if both others miss the chunk.
    score = F.struct(
        F.when(F.col("_try") == 2, F.lit(0)).otherwise(outside).alias("out"),
        F.when(F.col("_try") == 2, 1).otherwise(0).alias("self"),
        band.cast("long").alias("band"),
        (F.lit(budget) - (F.col("_pe") - F.col("_ps"))).alias("waste"),
        F.abs(F.col("_ps") - F.col("_snap")).alias("dist"),
        F.col("s"),
    )
    best = tries.groupBy("corpus", "i").agg(F.min_by(F.struct("s", "e"), score).alias("_w"))
    return best.select("corpus", "i", F.col("_w.s").alias("start"), F.col("_w.e").alias("stop"))


def cache_misses(windows: DataFrame) -> DataFrame:
    """corpus, misses: how often the start changes from one chunk to the next. Neighbours meet by a join, not in one sorted task."""
    after = windows.select("corpus", (F.col("i") - 1).alias("i"), F.col("start").alias("_next"))
    both = windows.select("corpus", "i", "start").join(after, ["corpus", "i"], "left")
    return both.groupBy("corpus").agg(F.sum(F.when(F.col("_next") != F.col("start"), 1).otherwise(0)).cast("long").alias("misses"))


def context_members(windows: DataFrame) -> DataFrame:
    """corpus, start, stop, i: the chunks of each different window, so that a context is built once for all that share it."""
    return windows.select("corpus", "start", "stop").distinct().withColumn("i", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))


def context_texts(windows: DataFrame, chunks: DataFrame, separator: str = "\n---\n") -> DataFrame:
    """corpus, start, stop, context: the texts of the chunks of each different window, in order."""
    members = context_members(windows).join(chunks.select("corpus", "i", "text"), ["corpus", "i"])
    parts = members.groupBy("corpus", "start", "stop").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("_p"))
    return parts.select("corpus", "start", "stop", F.array_join(F.transform("_p", lambda x: x["text"]), separator).alias("context"))


def islands(df: DataFrame, family: list[str], num: str) -> DataFrame:
    """Add ``island``: the first number of the run of consecutive numbers that the row is in, within its family.

    A number without a predecessor starts an island; every number belongs to the latest start before it.
    """
    rows = df.withColumn("_family", F.xxhash64(*family)).withColumn("_num", F.col(num).cast("long"))
    starts = rows.select("_family", "_num").distinct()
    starts = starts.join(starts.select("_family", (F.col("_num") + 1).alias("_num")), ["_family", "_num"], "left_anti")
    return as_of(rows, "_num", starts, "_num", "_num", "island", group="_family").drop("_family", "_num")
