"""Queries of runs and journals: labels are the judgements of documents, a high quality is relevant; events are a status log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import token_count
from lectern.operators import runs
from lectern.operators.windows import number_rows
from lectern.plans.catalog import TOKENS, query, table
from lectern.sources import books


def _chunks(spark, sf_dir):
    docs = number_rows(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars"), "doc_id", "_i")
    return docs.withColumn("original_index", F.col("_i") + 1).drop("_i")


def _judgements(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("is_relevant"))
    return labels.join(_chunks(spark, sf_dir).select("doc_id", "original_index", "source"), "doc_id")


_RUN = """
chunks AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS original_index FROM documents),
judged AS (SELECT c.doc_id, c.original_index, c.source, l.quality = 1 AS is_relevant FROM labels l JOIN chunks c USING (doc_id))"""


@query(f"WITH {_RUN} SELECT original_index, doc_id FROM chunks WHERE original_index % 3 = 0")
def selected_chunks(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return runs.selected(chunks.select("original_index").filter("original_index % 3 = 0"), chunks).select("original_index", "doc_id")


@query(f"WITH {_RUN} SELECT source AS run, original_index AS position FROM chunks WHERE original_index NOT IN (SELECT original_index FROM judged)")
def resume_pending(spark, sf_dir):
    positions = _chunks(spark, sf_dir).select(F.col("source").alias("run"), F.col("original_index").alias("position"))
    done = _judgements(spark, sf_dir).select(F.col("source").alias("run"), F.col("original_index").alias("position"))
    return runs.pending(positions, done)


@query(f"WITH {_RUN} SELECT original_index, doc_id, row_number() OVER (ORDER BY original_index) AS position FROM chunks WHERE original_index IN (SELECT original_index FROM judged WHERE is_relevant)")
def refine_selection(spark, sf_dir):
    return runs.refined(_chunks(spark, sf_dir), _judgements(spark, sf_dir)).select("original_index", "doc_id", F.col("position").cast("long").alias("position"))


@query(f"WITH {_RUN} SELECT source AS run, count(*) AS total, count(j.original_index) AS judged, count(j.original_index) >= count(*) AS complete FROM chunks c LEFT JOIN judged j USING (original_index, source) GROUP BY source")
def run_status(spark, sf_dir):
    meta = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("run")).agg(F.count("*").alias("total"))
    return runs.status(meta, _judgements(spark, sf_dir).withColumnRenamed("source", "run"))


@query(f"WITH {_RUN} SELECT original_index, doc_id, {TOKENS}::BIGINT AS tokens FROM chunks WHERE original_index IN (SELECT original_index FROM judged WHERE is_relevant)")
def rank_items(spark, sf_dir):
    hits = _judgements(spark, sf_dir).filter("is_relevant").select("original_index")
    return hits.join(_chunks(spark, sf_dir), "original_index").select("original_index", "doc_id", token_count("text").alias("tokens")).orderBy("original_index")


@query(f"""WITH {_RUN} SELECT original_index, sha256('{{"original_index":' || original_index || '}}' || chr(10) || text || chr(10) || chr(10)) AS entry FROM chunks WHERE original_index IN (SELECT original_index FROM judged WHERE is_relevant)""")
def collect_raw(spark, sf_dir):
    hits = _judgements(spark, sf_dir).filter("is_relevant").select("original_index")
    entry = F.concat(F.to_json(F.struct("original_index")), F.lit("\n"), "text", F.lit("\n\n"))
    return hits.join(_chunks(spark, sf_dir), "original_index").select("original_index", F.sha2(entry, 256).alias("entry"))


@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS line_no FROM events GROUP BY user_id")
def latest_status(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("line_no"))
    return runs.latest(log, "user_id").select("user_id", "status", "line_no")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS s FROM events GROUP BY user_id) WHERE s = 'purchase')")
def pdf_pending(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("line_no"))
    return log.select("user_id").distinct().join(runs.latest(log, "user_id").filter("status = 'purchase'"), "user_id", "left_anti")


@query("""WITH p AS (SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS host, url FROM pages)
SELECT host, count(*) AS n, sha256(string_agg(url, chr(10) ORDER BY lower(url), url)) AS sha FROM p GROUP BY host""")
def manifest_sha(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "https?://([^/]+)", 1).alias("host"), F.struct(F.lower("url").alias("k"), "url").alias("_u"))
    lists = pages.groupBy("host").agg(F.array_sort(F.collect_list("_u")).alias("_l"))
    return lists.select("host", F.size("_l").cast("long").alias("n"), F.sha2(F.array_join(F.transform("_l", lambda x: x["url"]), "\n"), 256).alias("sha"))


@query("""WITH a AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 <> 0), b AS (SELECT DISTINCT url FROM pages WHERE page_id % 2 <> 0)
SELECT url, 'missing' AS side FROM (SELECT url FROM a EXCEPT SELECT url FROM b) UNION ALL SELECT url, 'added' FROM (SELECT url FROM b EXCEPT SELECT url FROM a)""")
def manifest_diff(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    a, b = pages.filter("page_id % 3 <> 0").select("url").distinct(), pages.filter("page_id % 2 <> 0").select("url").distinct()
    return a.join(b, "url", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "url", "left_anti").withColumn("side", F.lit("added")))


def _journals(spark, sf_dir):
    """One cut journal per source: a meta record, cuts, some with broken positions, unknown types."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    kind = F.col("doc_id") % 7
    record = (
        F.when(kind == 0, F.to_json(F.struct(F.lit("meta").alias("type"), "doc_id")))
        .when(kind == 1, F.to_json(F.struct(F.lit("cut").alias("type"), F.col("n_chars").cast("string").alias("pos"))))
        .when(kind == 2, F.lit('{"type": "cu'))
        .otherwise(F.to_json(F.struct(F.lit("cut").alias("type"), F.col("n_chars").alias("pos"))))
    )
    return docs.select(F.col("source").alias("path"), F.col("doc_id").alias("ordinal"), record.alias("record"))


@query("SELECT source AS path, n_chars AS pos, doc_id AS ordinal FROM documents WHERE doc_id % 7 > 2")
def cut_positions(spark, sf_dir):
    return books.cut_positions(_journals(spark, sf_dir)).select("path", "ordinal", "pos")


@query("""SELECT source AS path, '{"type":"meta","doc_id":' || min(doc_id) || '}' AS meta FROM documents WHERE doc_id % 7 = 0 GROUP BY source""")
def cut_meta(spark, sf_dir):
    return books.cut_meta(_journals(spark, sf_dir))


@query("SELECT doc_id AS missing FROM documents WHERE doc_id > 0 AND doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id < (SELECT max(doc_id) FROM labels)")
def output_gaps(spark, sf_dir):
    names = table(spark, sf_dir, "labels").select(F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".txt")).alias("filename"))
    return books.gaps(names)


@query("SELECT doc_id::VARCHAR AS filename, 'left' AS only FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched_files(spark, sf_dir):
    left, right = (table(spark, sf_dir, t).select(F.col("doc_id").cast("string").alias("filename")) for t in ("documents", "labels"))
    return books.unmatched(left, right)


@query("SELECT conv_id::VARCHAR AS document, string_agg(regexp_replace(text, '[ \\t\\n\\r]+$', ''), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def joined_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document"), F.col("turn").alias("page_index"), F.col("text").alias("md"))
    return books.joined_pages(pages)
