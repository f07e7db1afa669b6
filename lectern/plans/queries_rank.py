"""Queries of tournaments: documents are items, longer ones win, ties go to the lower id."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import rank
from lectern.operators.windows import number_rows
from lectern.plans.catalog import query, table
from lectern.plans.rank import all_pairs
from lectern.plans.shared import materialize

N = rank.SKELETON


def _items(spark, sf_dir):
    # Written once: every wave of games reads the scores again.
    return materialize(number_rows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("n_chars").alias("score")), "item", "place"), "items")


def _judge(items):
    scores = items.select("item", "score")

    def play(games):
        left = scores.select(F.col("item").alias("left"), F.col("score").alias("_ls"))
        right = scores.select(F.col("item").alias("right"), F.col("score").alias("_rs"))
        won = (F.col("_ls") > F.col("_rs")) | ((F.col("_ls") == F.col("_rs")) & (F.col("left") < F.col("right")))
        return games.join(left, "left").join(right, "right").withColumn("winner", F.when(won, "left").otherwise("right")).drop("_ls", "_rs")

    return play


def _anchors(spark, sf_dir):
    """The ranked skeleton: item, wins, rank."""
    items = _items(spark, sf_dir)
    bones = materialize(rank.skeleton(items), "skeleton")
    at = bones.select("anchor", "item")
    games = rank.round_robin(spark, bones.count()).join(at.withColumnsRenamed({"anchor": "left", "item": "l"}), "left").join(at.withColumnsRenamed({"anchor": "right", "item": "r"}), "right")
    played = _judge(items)(games.select(F.col("l").alias("left"), F.col("r").alias("right")))
    return items, materialize(rank.order_by_wins(played, bones.select("item", F.col("anchor").alias("place"))), "anchors")


_SCHEDULE = f"""
games AS (SELECT r AS round, s AS slot, CASE WHEN s = 0 THEN 0 ELSE 1 + ((s - 1 - r) % {N - 1} + {N - 1}) % {N - 1} END AS a, 1 + (({N - 1} - s - 1 - r) % {N - 1} + {N - 1}) % {N - 1} AS b
  FROM range({N - 1}) t(r), range({N // 2}) u(s))"""

_RANKED = f"""
items AS (SELECT doc_id AS item, n_chars AS score, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents),
bones AS (SELECT item, score, row_number() OVER (ORDER BY place) - 1 AS anchor FROM items WHERE n <= {N} OR place IN (SELECT round_even(i * (n - 1)::DOUBLE / {N - 1}, 0)::BIGINT FROM range({N}) t(i), (SELECT count(*) AS n FROM documents))),
anchors AS (SELECT a.item, a.score, count(b.item) FILTER (a.score > b.score OR (a.score = b.score AND a.item < b.item)) AS wins, row_number() OVER (ORDER BY count(b.item) FILTER (a.score > b.score OR (a.score = b.score AND a.item < b.item)) DESC, a.anchor) AS rank
  FROM bones a JOIN bones b ON a.item <> b.item GROUP BY a.item, a.score, a.anchor)"""


@query(f"WITH {_SCHEDULE} SELECT round, slot, CASE WHEN round % 2 = 0 THEN a ELSE b END AS left_item, CASE WHEN round % 2 = 0 THEN b ELSE a END AS right_item FROM games")
def round_robin(spark, sf_dir):
    return rank.round_robin(spark, N).withColumnsRenamed({"left": "left_item", "right": "right_item"})


@query(f"WITH {_RANKED} SELECT anchor, item FROM bones")
def skeleton(spark, sf_dir):
    return rank.skeleton(_items(spark, sf_dir)).select("anchor", "item")


@query(f"WITH {_RANKED} SELECT item, wins, rank FROM anchors")
def bt_order(spark, sf_dir):
    return _anchors(spark, sf_dir)[1].select("item", "wins", F.col("rank").cast("long").alias("rank"))


@query()
def bt_scores(spark, sf_dir):
    """Bradley-Terry strengths of the skeleton, fitted on its round robin."""
    items, anchors = _anchors(spark, sf_dir)
    ids = [r["item"] for r in anchors.orderBy("rank").collect()]  # at most as many as the skeleton holds
    theta = rank.bradley_terry([(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids))], len(ids))
    return spark.createDataFrame([(i, float(t)) for i, t in zip(ids, theta, strict=True)], "item long, strength double")


_BRACKET = f"""{_RANKED},
size AS (SELECT count(*) AS n FROM anchors),
state AS (
  SELECT i.item, (SELECT count(*) FROM anchors a WHERE a.score > i.score OR (a.score = i.score AND a.item < i.item)) AS goal, 0::BIGINT AS lo, (SELECT n FROM size) AS hi, 0::BIGINT AS votes
  FROM items i WHERE i.item NOT IN (SELECT item FROM bones)
  UNION ALL
  SELECT item, goal, CASE WHEN (lo + hi) // 2 >= goal THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN (lo + hi) // 2 >= goal THEN (lo + hi) // 2 ELSE hi END, votes + CASE WHEN (lo + hi) // 2 >= goal THEN 1 ELSE -1 END
  FROM state WHERE lo < hi),
placed AS (SELECT item, lo, votes - (lo > 0)::INT - (lo < n)::INT AS votes FROM state, size WHERE lo >= hi),
tiers AS (SELECT item, CASE WHEN votes < 0 AND lo > 0 THEN lo - 1 ELSE lo END AS tier, votes FROM placed)"""


def _tiers(spark, sf_dir):
    items, anchors = _anchors(spark, sf_dir)
    rest = items.join(anchors, "item", "left_anti").select("item")
    return items, anchors, materialize(rank.bracket(rest, anchors, _judge(items)), "tiers")


@query(f"WITH RECURSIVE {_BRACKET} SELECT item, tier, votes FROM tiers")
def bracket_votes(spark, sf_dir):
    return _tiers(spark, sf_dir)[2]


_TOP = f"""{_BRACKET},
counts AS (SELECT tier, count(*) AS n, sum(count(*)) OVER (ORDER BY tier)::BIGINT AS total FROM tiers GROUP BY tier)"""


@query(f"WITH RECURSIVE {_TOP} SELECT tier, n, total, total <= {rank.TOP} AS taken FROM counts")
def top_block(spark, sf_dir):
    return rank.top_block(_tiers(spark, sf_dir)[2])


@query(f"""WITH RECURSIVE {_TOP},
block AS (SELECT t.item, row_number() OVER (ORDER BY i.score DESC, t.item) AS r FROM tiers t JOIN items i USING (item) WHERE tier IN (SELECT tier FROM counts WHERE total <= {rank.TOP})),
rest AS (SELECT item, 0 AS b, r, 0 AS t, 0 AS a FROM block UNION ALL SELECT item, 1, 0, tier, 0 FROM tiers WHERE item NOT IN (SELECT item FROM block) UNION ALL SELECT item, 1, 0, rank - 1, 1 FROM anchors)
SELECT item, row_number() OVER (ORDER BY b, r, t, a, item) AS rank FROM rest""")
def final_order(spark, sf_dir):
    items, anchors, tiers = _tiers(spark, sf_dir)
    taken = rank.top_block(tiers).filter("taken").select("tier")
    top = materialize(number_rows(tiers.join(taken, "tier", "left_semi").select("item"), "item", "place"), "top")
    block = rank.order_by_wins(_judge(items)(all_pairs(top, top.count()).select("left", "right")), top).select("item", "rank")
    named = tiers.withColumn("filename", F.concat(F.lpad(F.col("item").cast("string"), 12, "0"), F.lit(".txt")))
    return rank.final_order(named, anchors, block).select("item", F.col("rank").cast("long").alias("rank"))
