"""The ranking pass: skeleton, bracketing, top block, final order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.models import LecternError
from lectern.operators import rank, runs
from lectern.operators.windows import number_rows
from lectern.plans.shared import materialize


def all_pairs(items: DataFrame, size: int) -> DataFrame:
    """pair_index, left, right: the round robin of ``size`` items with ``place`` 0 to size - 1, in the order of play."""
    at = items.select("item", "place")
    # At most as many games as those of a skeleton or a top block are numbered here.
    number = F.row_number().over(Window.orderBy("round", "slot")) - 1
    games = rank.round_robin(items.sparkSession, size).select(number.alias("pair_index"), "left", "right")
    games = games.join(at.withColumnsRenamed({"place": "left", "item": "_l"}), "left").join(at.withColumnsRenamed({"place": "right", "item": "_r"}), "right")
    return games.select("pair_index", F.col("_l").alias("left"), F.col("_r").alias("right"))


@dataclass(frozen=True)
class RankRecords:
    """What a journal has of a ranking: games (left, right, winner, ordinal), confirms (item, against, left, winner, ordinal), skeleton (pair_index, left, right)."""

    games: DataFrame
    confirms: DataFrame
    skeleton: DataFrame

    @classmethod
    def of(cls, records: DataFrame) -> RankRecords:
        """From records (ordinal, record) as ``files.journal`` gives them."""
        v = F.try_parse_json("record")
        read = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
        rows = records.select("ordinal", read("type", "string").alias("type"), read("stage", "string").alias("stage"), *[read(c, "long").alias(c) for c in ("pair_index", "left", "right", "item", "against")], read("winner", "string").alias("winner"))
        rows = materialize(rows, "rank-records")
        games = rows.filter("type in ('cmp', 'probe')").select("left", "right", "winner", "ordinal")
        skeleton = rows.filter("type = 'cmp' and stage = 'skeleton'").select("pair_index", "left", "right")
        return cls(games, rows.filter("type = 'confirm'").select("item", "against", "left", "winner", "ordinal"), skeleton)


def rank_items(items: DataFrame, judge: rank.PairJudge, confirm_mode: str = "reference", journal: RankRecords | None = None) -> DataFrame:
    """item, rank of every item (item: long, filename), best first.

    Up to as many items as a skeleton holds play a full round robin. Beyond that the skeleton does, the others are bracketed
    into tiers between its members, and the items of the first tiers, up to the size of a top block, play each other. Each
    stage is written before it is used, so no pair is judged twice. A ``journal`` of an earlier try is taken over: its games of
    the skeleton must be the first of the schedule, and only pairs that it lacks are judged.
    """
    confirm = judge
    if journal is not None:
        confirm = rank.confirmed(judge, journal.confirms)
        judge = rank.remembered(judge, journal.games)
    placed = number_rows(items.select("item", "filename"), "item", "place")
    bones = materialize(rank.skeleton(placed), "skeleton").select("item", F.col("anchor").alias("place"))
    size = bones.count()
    schedule = all_pairs(bones, size)
    if journal is not None and not runs.follows_schedule(journal.skeleton, schedule.select("pair_index", "left", "right")):
        raise LecternError("the journal does not follow the schedule")
    games = materialize(judge(schedule.select("left", "right")), "skeleton-games")
    anchors = materialize(rank.order_by_wins(games, bones), "anchors").select("item", "rank")
    rest = materialize(placed.join(anchors, "item", "left_anti"), "rest")
    if rest.isEmpty():
        return anchors
    tiers = materialize(rank.bracket(rest.select("item"), anchors, judge, confirm_mode, confirm).join(rest.select("item", "filename"), "item"), "tiers")
    taken = rank.top_block(tiers).filter("taken").select("tier")
    top = materialize(number_rows(tiers.join(taken, "tier", "left_semi").select("item"), "item", "place"), "top")
    n = top.count()
    block = None
    if n:
        played = materialize(judge(all_pairs(top, n).select("left", "right")), "top-games")
        block = rank.order_by_wins(played, top).select("item", "rank")
    return rank.final_order(tiers, anchors, block)
