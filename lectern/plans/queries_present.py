"""Queries of grouping, evidence and packing for reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import present
from lectern.operators.ordered import prefix_sums, ranged
from lectern.operators.windows import islands, number_rows
from lectern.plans.catalog import query, table


def _hits(spark, sf_dir):
    """Documents of high quality; the rank is by length, then id, among all documents of the source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return docs.join(labels, "doc_id").select(F.lit("f").alias("family"), F.col("doc_id").alias("num"), (F.lit(1_000_000) - F.col("n_chars")).alias("rank"))


_HITS = """
hits AS (SELECT 'f' AS family, d.doc_id AS num, 1000000 - d.n_chars AS rank FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
runs AS (SELECT *, min(num) OVER (PARTITION BY family, d) AS island FROM (SELECT *, num - row_number() OVER (PARTITION BY family ORDER BY num) AS d FROM hits))"""


@query(f"WITH {_HITS} SELECT num, island FROM runs")
def adjacent_groups(spark, sf_dir):
    return islands(_hits(spark, sf_dir), ["family"], "num").select("num", "island")


@query(f"WITH {_HITS}, g AS (SELECT island, count(*) AS size, min(rank) AS best FROM runs GROUP BY island) SELECT island, size, row_number() OVER (ORDER BY best, island) AS group_rank FROM g")
def groups_ordered(spark, sf_dir):
    return present.grouped(_hits(spark, sf_dir), ["family"]).select("island", "size", F.col("group_rank").cast("long").alias("group_rank")).distinct()


@query(f"""WITH {_HITS}, k AS (SELECT DISTINCT island, num + o AS num FROM runs, (SELECT unnest([-1, 0, 1]) AS o)),
b AS (SELECT doc_id AS num, CASE WHEN contains(text, chr(10)) THEN substring(text, strpos(text, chr(10)) + 1) ELSE '' END AS body FROM documents)
SELECT island, count(*) AS chunks, sha256(string_agg(body, '' ORDER BY num)) AS sha FROM k JOIN b USING (num) GROUP BY island""")
def group_context(spark, sf_dir):
    members = islands(_hits(spark, sf_dir), ["family"], "num").select(F.lit(0).alias("corpus"), "island", "num")
    chunks = table(spark, sf_dir, "documents").select(F.lit(0).alias("corpus"), F.col("doc_id").alias("num"), "text")
    context = present.with_neighbours(members, chunks)
    size = context.groupBy("island").agg(F.count("*").alias("chunks"))
    return present.group_text(context).join(size, "island").select("island", "chunks", F.sha2("text", 256).alias("sha"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT doc_id, lpad(doc_id::VARCHAR, 6, '0') || '.txt' AS filename, rank FROM r JOIN labels USING (doc_id)""")
def filename_rank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", (-F.col("n_chars")).alias("_least"), "doc_id")
    order = prefix_sums(ranged(docs, ["_least", "doc_id"]), "_range", ["_least", "doc_id"], F.lit(1).cast("long"), ["source"], "_before")
    order = order.select(F.col("doc_id").alias("num"), (F.col("_before") + 1).alias("rank"))
    names = table(spark, sf_dir, "labels").select(F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".txt")).alias("filename"))
    return names.withColumn("num", text.filename_parts("filename")["num"]).join(order, "num").select(F.col("num").alias("doc_id"), "filename", "rank")


_PARTS = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"


@query(f"""WITH p AS ({_PARTS}), q AS (SELECT *, (n + 4) // 5 AS parts FROM p)
SELECT conv_id, turn, (SELECT min(k) FROM range(1, 100000) t(k) WHERE k <= parts AND k * (n // parts) + least(k, n % parts) > place) AS part FROM q""")
def split_evenly(spark, sf_dir):
    turns = number_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "turn", "place", ["conv_id"])
    turns = turns.join(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")
    return turns.select("conv_id", "turn", present.even_parts(F.col("n"), F.col("place")).alias("part"))


@query("""WITH f AS (SELECT conv_id, text AS e, min(turn) AS t FROM conversations GROUP BY conv_id, text)
SELECT conv_id::VARCHAR AS filename, string_agg(e, ' | ' ORDER BY t) AS evidence FROM f GROUP BY conv_id""")
def evidence_map(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("filename"), F.col("turn").alias("ordinal"), F.col("text").alias("evidence"))
    return present.evidence(rows)


@query("""WITH r AS (SELECT conv_id, (turn * 7) % 11 + 1 AS num, CASE WHEN conv_id % 2 = 0 THEN 9 ELSE 9 + turn % 2 END AS den, text, turn FROM conversations)
SELECT conv_id, CASE WHEN count(DISTINCT den) <= 1 THEN string_agg('#' || num, ' · ' ORDER BY num, den) ELSE string_agg('#' || num || '/' || den, ' · ' ORDER BY num, den) END AS ranks, arg_min(sha256(text), num * 1000 + turn) AS best, count(*) AS n FROM r GROUP BY conv_id""")
def top_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.expr("(turn * 7) % 11 + 1").alias("num"), F.expr("if(conv_id % 2 = 0, 9L, 9L + turn % 2)").alias("den"), "text", "turn")
    found = rows.groupBy("conv_id").agg(F.collect_list(F.struct("num", "den")).alias("r"), F.min_by(F.sha2("text", 256), F.struct("num", "turn")).alias("best"), F.count("*").alias("n"))
    return found.select("conv_id", present.rank_display(F.col("r")).alias("ranks"), "best", "n")


_COVERS = """
g AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal, 1 + length(text) // 1500 AS pages FROM documents),
packed AS (
  SELECT book, ordinal, pages, 1::BIGINT AS cover, pages AS total FROM g WHERE ordinal = 1
  UNION ALL
  SELECT g.book, g.ordinal, g.pages, p.cover + CASE WHEN p.total + g.pages > 20 THEN 1 ELSE 0 END, CASE WHEN p.total + g.pages > 20 THEN g.pages ELSE p.total + g.pages END
  FROM packed p JOIN g ON g.book = p.book AND g.ordinal = p.ordinal + 1)"""


def _groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", F.expr("1 + length(text) div 1500").alias("pages"))
    return number_rows(docs, "doc_id", "ordinal", ["book"]).select("book", (F.col("ordinal") + 1).alias("ordinal"), "pages")


@query(f"WITH RECURSIVE {_COVERS} SELECT book, ordinal, cover FROM packed")
def plan_covers(spark, sf_dir):
    return present.plan_covers(_groups(spark, sf_dir))


@query(f"""WITH RECURSIVE {_COVERS}, c AS (SELECT book, cover, sum(pages)::BIGINT AS pages FROM packed GROUP BY book, cover)
SELECT book, cover, pages, (coalesce(sum(pages + 1) OVER (PARTITION BY book ORDER BY cover ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2)::BIGINT AS first_page,
  (coalesce(sum(pages + 1) OVER (PARTITION BY book ORDER BY cover ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 + pages)::BIGINT AS last_page FROM c""")
def cover_ranges(spark, sf_dir):
    groups = _groups(spark, sf_dir)
    covers = present.plan_covers(groups).join(groups, ["book", "ordinal"]).groupBy("book", "cover").agg(F.sum("pages").alias("pages"))
    return present.cover_ranges(covers)
