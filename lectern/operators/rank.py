"""Tournament ranking: schedules, Bradley-Terry scores, bracketing into tiers and the final order.

Pairs are played as one batch per stage, so the cost is a few waves of the pair judge. A judge is a function of a table with
``left`` and ``right`` that adds ``winner``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import prefix_sums
from lectern.plans.shared import materialize

#: Anchors of a skeleton, items of a top block, comparisons with each neighbour; limits of the fit.
SKELETON, TOP, CONFIRMATIONS = 120, 60, 2
ALPHA, TOLERANCE, MAX_ITERATIONS = 1e-7, 1e-10, 1000

PairJudge = Callable[[DataFrame], DataFrame]


def round_robin(spark: SparkSession, n: int) -> DataFrame:
    """round, slot, left, right (0-based places): every pair once, by the circle method in closed form.

    Place 0 stays, the others move on by one each round; an odd number plays against a dummy that is left out. Sides swap
    in every other round, so that nobody stands on one side more often than on the other.
    """
    m = n + n % 2
    if m < 2:
        return spark.range(0).select(*[F.lit(0).alias(c) for c in ("round", "slot", "left", "right")]).limit(0)
    games = spark.range((m - 1) * (m // 2)).select(F.expr(f"cast(id div {m // 2} as int)").alias("round"), F.expr(f"cast(id % {m // 2} as int)").alias("slot"))
    holder = lambda p: f"if({p} = 0, 0, 1 + pmod({p} - 1 - round, {m - 1}))"
    games = games.withColumn("_a", F.expr(holder("slot"))).withColumn("_b", F.expr(holder(f"({m - 1} - slot)")))
    games = games.filter((F.col("_a") < n) & (F.col("_b") < n))
    even = F.col("round") % 2 == 0
    return games.select("round", "slot", F.when(even, F.col("_a")).otherwise(F.col("_b")).alias("left"), F.when(even, F.col("_b")).otherwise(F.col("_a")).alias("right"))


def skeleton(items: DataFrame, place: str = "place", size: int = SKELETON) -> DataFrame:
    """The rows of ``size`` evenly spread places (half to even), or all if there are no more; ``anchor``: place among them."""
    n = items.count()
    if n <= size:
        return items.withColumn("anchor", F.col(place))
    chosen = items.sparkSession.range(size).select(F.col("id").alias("anchor"), F.bround(F.col("id") * F.lit(float(n - 1)) / F.lit(float(size - 1))).cast("long").alias("_p"))
    return items.join(chosen, F.col(place) == F.col("_p")).drop("_p")


def wins(games: DataFrame) -> DataFrame:
    """item, wins of every item that played; games: left, right, winner."""
    won = games.select(F.col("left").alias("item"), (F.col("winner") == "left").cast("long").alias("w"))
    won = won.unionByName(games.select(F.col("right").alias("item"), (F.col("winner") == "right").cast("long").alias("w")))
    return won.groupBy("item").agg(F.sum("w").alias("wins"))


def order_by_wins(games: DataFrame, items: DataFrame, place: str = "place") -> DataFrame:
    """item, wins, rank: on a complete round robin the Bradley-Terry order is the order of wins; ties by place."""
    table = items.select(F.col("item"), F.col(place)).join(wins(games), "item", "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("wins"), place)))


def bradley_terry(games: list[tuple[int, int]], n: int, alpha: float = ALPHA) -> np.ndarray:
    """Maximum a posteriori strengths of ``n`` items from (winner, loser) pairs, by damped Newton steps.

    Items are as many as a skeleton or a top block holds, so this is a small dense problem of the driver.
    """
    won = np.zeros((n, n))
    for w, l in games:
        won[w, l] += 1
    played, theta = won + won.T, np.zeros(n)

    def value(t: np.ndarray) -> float:
        d = t[:, None] - t[None, :]
        return float((won * np.logaddexp(0, -d)).sum() + alpha * (t @ t))

    for _ in range(MAX_ITERATIONS):
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - theta[:, None], -500, 500)))
        gradient = (played * p).sum(1) - won.sum(1) + 2 * alpha * theta
        if np.abs(gradient).max(initial=0) < TOLERANCE:
            break
        curve = played * p * p.T
        step = np.linalg.solve(np.diag(curve.sum(1) + 2 * alpha) - curve + 1e-12 * np.eye(n), gradient)
        scale = 1.0
        while scale > 1e-8 and value(theta - scale * step) > value(theta):
            scale /= 2
        theta = theta - scale * step
    return theta


def remembered(judge: PairJudge, journal: DataFrame) -> PairJudge:
    """A judge that asks only for pairs the journal lacks; journal: left, right, winner, ordinal, on either side, the last one wins."""
    flipped = journal.select(F.col("right").alias("left"), F.col("left").alias("right"), F.when(F.col("winner") == "left", "right").otherwise("left").alias("winner"), "ordinal")
    known = journal.select("left", "right", "winner", "ordinal").unionByName(flipped).groupBy("left", "right").agg(F.max_by("winner", "ordinal").alias("winner"))

    def play(games: DataFrame) -> DataFrame:
        old = games.join(known, ["left", "right"])
        new = judge(games.join(known, ["left", "right"], "left_anti"))
        return new.unionByName(old.select(*new.columns))

    return play


def confirmed(judge: PairJudge, journal: DataFrame, most: int = CONFIRMATIONS) -> PairJudge:
    """A judge that takes the first ``most`` recorded confirmations of an item against an anchor, in their order, and asks for the rest.

    journal: item, against, left, winner, ordinal. Games also have item, at and k, as ``bracket`` gives them.
    """
    nth = F.row_number().over(Window.partitionBy("item", "against").orderBy("ordinal")) - 1
    known = journal.select("item", F.col("against").alias("anchor"), nth.alias("k"), (F.col("winner") == F.when(F.col("left") == F.col("item"), "left").otherwise("right")).alias("_won")).filter(F.col("k") < most)

    def play(games: DataFrame) -> DataFrame:
        old = games.join(known, ["item", "anchor", "k"]).withColumn("winner", F.when(F.col("_won") == (F.col("left") == F.col("item")), "left").otherwise("right"))
        new = judge(games.join(known, ["item", "anchor", "k"], "left_anti"))
        return new.unionByName(old.select(*[c for c in new.columns if c in old.columns]), allowMissingColumns=True)

    return play


def bracket(items: DataFrame, anchors: DataFrame, judge: PairJudge, confirm_mode: str = "reference", confirm: PairJudge | None = None) -> DataFrame:
    """item, tier, votes: a binary search of each item among the ranked anchors, all items in one wave per level.

    anchors: item, rank (1-based). Tier t stands below the first t anchors. Afterwards the two neighbours of the place found
    are played twice each; in mode ``reference`` an item is expected above the anchor before it and below the one after it,
    so that consistent judges cost it a tier; mode ``corrected`` expects the opposite. ``confirm`` judges these games, if given.
    """
    size = anchors.count()
    ranked = anchors.select(F.col("item").alias("anchor"), (F.col("rank") - 1).cast("int").alias("at"))
    state = items.select("item", F.lit(0).alias("lo"), F.lit(size).alias("hi"), F.lit(0).alias("votes"), F.lit(0).alias("played"))
    for _ in range(max(1, int(np.ceil(np.log2(size + 1))))):
        open_ = state.filter("lo < hi").withColumn("at", F.expr("cast((lo + hi) div 2 as int)")).join(ranked, "at")
        even = F.col("played") % 2 == 0
        game = open_.withColumn("left", F.when(even, F.col("item")).otherwise(F.col("anchor"))).withColumn("right", F.when(even, F.col("anchor")).otherwise(F.col("item")))
        up = (F.col("winner") == "left") == even
        done = judge(game).select(
            "item", F.when(up, F.col("lo")).otherwise(F.col("at") + 1).alias("lo"), F.when(up, F.col("at")).otherwise(F.col("hi")).alias("hi"), (F.col("votes") + F.when(up, 1).otherwise(-1)).alias("votes"), (F.col("played") + 1).alias("played")
        )
        state = materialize(done.unionByName(state.filter("lo >= hi")), "bracket")
    above = confirm_mode == "reference"
    sides = F.array(*[F.struct((F.col("lo") + shift).alias("at"), F.lit(expect).alias("expect"), F.lit(k).alias("k")) for shift, expect in ((-1, above), (0, not above)) for k in range(CONFIRMATIONS)])
    checks = state.withColumn("_s", F.explode(sides)).select("item", "lo", "votes", "played", "_s.*").filter((F.col("at") >= 0) & (F.col("at") < size)).join(ranked, "at")
    first = (F.col("played") + F.col("k") + F.when(F.col("at") == F.col("lo"), F.when(F.col("lo") > 0, CONFIRMATIONS).otherwise(0)).otherwise(0)) % 2 == 0
    game = checks.withColumn("_f", first).withColumn("left", F.when(F.col("_f"), F.col("item")).otherwise(F.col("anchor"))).withColumn("right", F.when(F.col("_f"), F.col("anchor")).otherwise(F.col("item")))
    side = (confirm or judge)(game).withColumn("_up", F.when((F.col("winner") == "left") == F.col("_f"), 1).otherwise(-1)).groupBy("item", "at").agg(F.sum("_up").alias("s"), F.first("expect").alias("expect"))
    votes = side.groupBy("item").agg(F.sum(F.when((F.col("s") > 0) == F.col("expect"), 1).otherwise(-1)).alias("confirm"))
    out = state.join(votes, "item", "left").withColumn("votes", F.col("votes") + F.coalesce("confirm", F.lit(0)))
    return out.select("item", F.when((F.col("votes") < 0) & (F.col("lo") > 0), F.col("lo") - 1).otherwise(F.col("lo")).cast("int").alias("tier"), F.col("votes").cast("long").alias("votes"))


def top_block(tiers: DataFrame, cap: int = TOP) -> DataFrame:
    """tier, n, total, taken: the longest prefix of tiers whose items do not exceed the cap."""
    counts = tiers.groupBy("tier").agg(F.count("*").alias("n"))
    running = counts.withColumn("total", F.sum("n").over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, 0)))
    return running.withColumn("taken", F.max(F.when(F.col("total") > cap, 1).otherwise(0)).over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, 0)) == 0)


def final_order(tiers: DataFrame, anchors: DataFrame, block: DataFrame | None = None) -> DataFrame:
    """item, rank: the top block in its own order, then tier by tier (file name, id), the anchor below each tier after it.

    tiers: item, filename, tier; anchors: item, rank (1-based); block: item, rank.
    """
    rest = tiers.select("item", F.col("tier").alias("_t"), F.lit(0).alias("_a"), "filename")
    rest = rest.unionByName(anchors.select("item", (F.col("rank") - 1).cast("int").alias("_t"), F.lit(1).alias("_a"), F.lit("").alias("filename")))
    rest = rest.withColumn("_b", F.lit(1)).withColumn("_r", F.lit(0))
    if block is not None:
        first = block.select("item", F.lit(0).alias("_t"), F.lit(0).alias("_a"), F.lit("").alias("filename"), F.lit(0).alias("_b"), F.col("rank").cast("int").alias("_r"))
        rest = first.unionByName(rest.join(block, "item", "left_anti"))
    # Tiers are the buckets of the order: each is sorted by itself.
    rest = rest.withColumn("_tier", F.when(F.col("_b") == 0, -1).otherwise(F.col("_t")))
    order = prefix_sums(rest, "_tier", ["_r", "_a", "filename", "item"], F.lit(1).cast("long"), None, "_before")
    return order.select("item", (F.col("_before") + 1).alias("rank"))
