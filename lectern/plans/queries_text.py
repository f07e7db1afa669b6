"""Queries of the scans and of the functions on text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import numbers, text
from lectern.operators import layout, splitter
from lectern.operators.ordered import prefix_sums, ranged
from lectern.operators.parts import by_row
from lectern.plans.catalog import TOKENS, query, table
from lectern.plans.shared import materialize
from lectern.sources import files


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(r"""
SELECT doc_id, source AS path, length(regexp_replace(text, '\r\n?', chr(10), 'g'))::BIGINT AS size_chars,
  sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS sha FROM documents""")
def src_documents(spark, sf_dir):
    clean = _docs(spark, sf_dir).withColumn("t", text.universal_newlines("text"))
    return clean.select("doc_id", F.col("source").alias("path"), F.length("t").cast("long").alias("size_chars"), F.sha2("t", 256).alias("sha"))


@query(rf"""
WITH c AS (SELECT doc_id, source, length(text) AS n, {TOKENS} AS tokens, row_number() OVER (ORDER BY doc_id) AS chunk_id,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS local, count(*) OVER (PARTITION BY source) AS n_local,
  coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM documents)
SELECT chunk_id, lpad(chunk_id::VARCHAR, 6, '0') || '.txt' AS filename,
  '[Chunk ' || local || '/' || n_local || ' | Source: ' || source || ' | chars:' || lo || '-' || (lo + n) || ' | tokens:' || tokens || ']' AS header FROM c""")
def src_chunks(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "source", F.length("text").cast("long").alias("n"), text.token_count("text").alias("tokens"))
    docs = materialize(ranged(docs, ["doc_id"]), "ranges")
    one = F.lit(1).cast("long")
    for value, group, out in ((one, None, "chunk_id"), (one, ["source"], "local"), (F.col("n"), ["source"], "lo")):
        docs = prefix_sums(docs, "_range", ["doc_id"], value, group, out)
    docs = docs.join(docs.groupBy("source").agg(F.count("*").alias("n_local")), "source")
    header = F.format_string("[Chunk %d/%d | Source: %s | chars:%d-%d | tokens:%d]", F.col("local") + 1, "n_local", "source", "lo", F.col("lo") + F.col("n"), "tokens")
    return docs.select((F.col("chunk_id") + 1).alias("chunk_id"), F.concat(F.lpad((F.col("chunk_id") + 1).cast("string"), 6, "0"), F.lit(".txt")).alias("filename"), header.alias("header"))


@query(r"""
WITH j AS (SELECT user_id, string_agg(CASE WHEN event_id % 7 = 0 THEN left(props, 5) ELSE props END || chr(30) || chr(10), '' ORDER BY event_id) AS journal FROM events GROUP BY user_id),
r AS (SELECT user_id, trim(unnest(string_split(journal, chr(30))), chr(10) || ' ') AS rec FROM j),
k AS (SELECT user_id, rec, json_valid(rec) AS ok FROM r WHERE rec <> '')
SELECT user_id, count(*) AS n_records, count(*) FILTER (ok) AS n_good,
  coalesce(sum(CASE WHEN ok THEN json_extract_string(rec, '$.k')::BIGINT END), 0)::BIGINT AS sum_k FROM k GROUP BY user_id""")
def scan_rs_lenient(spark, sf_dir):
    record = F.when(F.col("event_id") % 7 == 0, F.left("props", F.lit(5))).otherwise(F.col("props"))
    lines = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", F.concat(record, F.lit(files.RS + "\n")).alias("r")).alias("_r"))
    journals = lines.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda x: x["r"]), "").alias("journal"))
    rows = journals.select("user_id", F.inline(files.records("journal"))).withColumn("v", F.try_parse_json("record"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_records"), F.count("v").alias("n_good"), F.coalesce(F.sum(F.try_variant_get("v", "$.k", "long")), F.lit(0)).alias("sum_k"))


@query(r"""
WITH n AS (SELECT printf('%04d.jsonl', event_id) AS name FROM events),
s AS (SELECT max(name) FILTER (regexp_full_match(name, '\d{4}\.jsonl')) AS strict, max(name) AS lexical FROM n)
SELECT strict, lexical, printf('%04d.jsonl', (regexp_extract(strict, '^\d+')::INT + 1)) AS following FROM s""")
def newest_run(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.format_string("%04d.jsonl", "event_id").alias("name"))
    both = files.newest_name(names).select(F.col("newest").alias("strict")).join(files.newest_name(names, strict=False).select(F.col("newest").alias("lexical")), F.lit(True))
    return both.withColumn("following", F.format_string("%04d.jsonl", F.regexp_extract("strict", r"^(\d+)", 1).cast("int") + 1))


@query("SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, doc_id AS original_index FROM documents")
def rank_from_order(spark, sf_dir):
    docs = _docs(spark, sf_dir).groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("n"), "doc_id"))).alias("_d"))
    lines = docs.select("source", F.array_join(F.transform("_d", lambda x: x["doc_id"].cast("string")), ",").alias("line"))
    return lines.select("source", F.inline(files.order_line("line"))).select("source", F.col("rank").cast("long").alias("rank"), "original_index")


@query(r"""
SELECT doc_id, 1::BIGINT AS blocks, length(regexp_extract(f, '(?is)```txt\n(.*?)\n```', 1))::BIGINT AS inner_chars, (doc_id + 1)::VARCHAR || '/9' AS score
FROM (SELECT doc_id, '[{"relevance_score": "' || (doc_id + 1) || '/9", "evidence_text": "e"}]' || chr(10) || chr(10) || '```txt' || chr(10) || text || chr(10) || '```' || chr(10) AS f FROM documents)""")
def pretty_parse(spark, sf_dir):
    file = F.concat(F.lit('[{"relevance_score": "'), (F.col("doc_id") + 1).cast("string"), F.lit('/9", "evidence_text": "e"}]\n\n```txt\n'), F.col("text"), F.lit("\n```\n"))
    parsed = _docs(spark, sf_dir).select("doc_id", files.pretty(file).alias("p"))
    return parsed.select("doc_id", F.col("p.blocks").cast("long").alias("blocks"), F.length("p.inner").cast("long").alias("inner_chars"), F.get("p.rows", F.lit(0))["relevance_score"].alias("score"))


@query(f"SELECT doc_id, {TOKENS}::BIGINT AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.token_count("text").alias("n_tokens"))


_SPANS = r"""
pieces AS (
  SELECT doc_id, length(text) AS total, 'l' AS kind, unnest(string_split_regex(text, '[\n\r]')) AS piece, generate_subscripts(string_split_regex(text, '[\n\r]'), 1) AS k FROM documents
  UNION ALL
  SELECT doc_id, length(text), 'w', unnest(string_split_regex(text, '[ \t\n]')), generate_subscripts(string_split_regex(text, '[ \t\n]'), 1) FROM documents),
placed AS (SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM pieces),
kept AS (SELECT *, s + length(piece) AS e, count(*) OVER (PARTITION BY doc_id, kind) AS n FROM placed WHERE piece <> ''),
lines AS (SELECT doc_id, max(n) FILTER (kind = 'l') AS n_lines FROM kept GROUP BY doc_id),
spans AS (SELECT kept.* FROM kept JOIN lines USING (doc_id) WHERE (kind = 'l') = (coalesce(n_lines, 0) >= 3))"""


def _span_frame(docs, each, schema):
    return by_row(docs.select("doc_id", "text"), each, schema)


@query(f"WITH {_SPANS} SELECT doc_id, count(*) AS n_spans, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM spans GROUP BY doc_id")
def spans(spark, sf_dir):
    def each(doc_id, t):
        found = splitter.spans(t or "")
        yield doc_id, len(found), sum(a for a, _ in found), sum(b for _, b in found)

    return _span_frame(_docs(spark, sf_dir), each, "doc_id long, n_spans long, starts long, ends long").filter("n_spans > 0")


@query(f"""WITH {_SPANS}, best AS (SELECT doc_id, arg_min(e, (abs(e - total // 2), e)) AS cut FROM spans WHERE e < total AND n > 1 GROUP BY doc_id)
SELECT doc_id, coalesce(cut, -1)::BIGINT AS cut FROM documents LEFT JOIN best USING (doc_id)""")
def fallback_split(spark, sf_dir):
    def each(doc_id, t):
        yield doc_id, splitter.delimiter_split(t or "")

    return _span_frame(_docs(spark, sf_dir), each, "doc_id long, cut long")


@query()
def center_window(spark, sf_dir):
    def each(doc_id, t):
        found = splitter.center_window(t or "", 200)
        yield doc_id, len(found), splitter.count_tokens(found)

    return _span_frame(_docs(spark, sf_dir), each, "doc_id long, window_chars long, window_tokens long")


@query("""
SELECT doc_id, list_sort(list_distinct([c FOR c IN [0, n // 3, n // 2, n // 3, n + 5, n] IF c > 0 AND c < n])) AS inner_cuts, n AS last_cut
FROM (SELECT doc_id, length(text) AS n FROM documents)""")
def boundaries(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("length"))
    docs = docs.withColumn("cuts", F.expr("array(0L, length div 3, length div 2, length div 3, length + 5, length)"))
    found = docs.select("doc_id", splitter.boundaries().alias("b"))
    return found.select("doc_id", F.slice("b", F.lit(2), F.size("b") - 2).alias("inner_cuts"), F.element_at("b", -1).alias("last_cut"))


@query(r"""
WITH s AS (SELECT doc_id, unnest(range(0, length(text), 3000)) AS lo, text FROM documents),
t AS (SELECT doc_id, lo, least(lo + 3000, length(text)) AS hi, len(regexp_extract_all(substring(text, lo + 1, 3000), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r]')) AS tokens FROM s)
SELECT doc_id, min(lo)::BIGINT AS lo, arg_min(hi, lo)::BIGINT AS hi FROM t WHERE tokens > 600 GROUP BY doc_id""")
def oversized(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter("length(text) > 0").withColumn("b", F.expr("concat(sequence(0L, length(text) - 1L, 3000L), array(cast(length(text) as bigint)))"))
    cut = splitter.ordered_segments(docs.select("doc_id", F.col("b").alias("boundaries")))
    cut = cut.join(docs.select("doc_id", "text"), "doc_id").withColumn("tokens", text.token_count(F.substring("text", F.col("lo") + 1, F.col("hi") - F.col("lo"))))
    return splitter.oversized(cut, 600)


@query()
def split_documents(spark, sf_dir):
    return splitter.split_documents(_docs(spark, sf_dir)).drop("body")


@query("SELECT doc_id, length(text)::BIGINT AS chars, sha256(text) AS sha, true AS within FROM documents WHERE length(text) > 0")
def split_invariants(spark, sf_dir):
    chunks = splitter.split_documents(_docs(spark, sf_dir))
    parts = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("lo", "body"))).alias("p"), F.max("tokens").alias("most"), F.sum(F.col("hi") - F.col("lo")).alias("chars"))
    return parts.select("doc_id", "chars", F.sha2(F.array_join(F.transform("p", lambda x: x["body"]), ""), 256).alias("sha"), (F.col("most") <= splitter.MAX_TOKENS).alias("within"))


@query(r"""
WITH p AS (SELECT doc_id, text, replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS s FROM documents)
SELECT doc_id, '[BEGIN_ANCHOR len=' || length(text) || ']' || CASE WHEN length(s) > 140 THEN left(s, 70) || ' … ' || right(s, 70) ELSE s END || '[END_ANCHOR]' AS preview FROM p""")
def anchor_preview(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.anchor_preview("text").alias("preview"))


@query()
def split_text_even(spark, sf_dir):
    """Parts of a text for highlighting: equal shares of characters, moved past the end of the line."""

    def parts(t: str, n: int) -> list[int]:
        at = [0]
        for _ in range(n - 1):
            end = t.find("\n", at[-1] + len(t) // n)
            at.append(len(t) if end < 0 else end + 1)
        return [*at, len(t)]

    def each(doc_id, t):
        yield doc_id, parts(t or "", max(1, -(-splitter.count_tokens(t or "") // 500)))

    return _span_frame(_docs(spark, sf_dir), each, "doc_id long, ends array<long>")


@query("SELECT doc_id, string_split(text, chr(10))[1] AS header, CASE WHEN contains(text, chr(10)) THEN length(text) - length(string_split(text, chr(10))[1]) - 1 ELSE 0 END::BIGINT AS body_chars FROM documents")
def chunk_header(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.header_line("text").alias("header"), F.length(text.body("text")).cast("long").alias("body_chars"))


@query(r"""
WITH e AS (SELECT event_id, ['true', '"true"', '"false"', 'false', '1', '""', '" TRUE "', 'null'][(event_id % 8 + 1)::INT] AS flag FROM events)
SELECT event_id, flag = 'true' AS positive, flag IN ('true', '"true"', '" TRUE "') AS lenient, flag IN ('true', '"true"', '"false"', '1', '" TRUE "') AS truthy FROM e""")
def truthy_flag(spark, sf_dir):
    values = F.array(*map(F.lit, ("true", '"true"', '"false"', "false", "1", '""', '" TRUE "', "null")))
    events = table(spark, sf_dir, "events").select("event_id", F.get(values, (F.col("event_id") % 8).cast("int")).alias("flag"))
    return events.select("event_id", text.strict_true("flag").alias("positive"), text.lenient_true("flag").alias("lenient"), text.truthy("flag").alias("truthy"))


_OPEN, _CLOSE = text.OPEN_TAG, text.CLOSE_TAG
_TAGGED = f"""
tagged AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '{_OPEN}' || left(text, 10) || '{_CLOSE}' || substring(text, 11) WHEN 2 THEN '{_OPEN}' || text
  WHEN 3 THEN '{_OPEN}a{_OPEN}b{_CLOSE}{_CLOSE}' || text ELSE '{_CLOSE}' || text || '{_OPEN}' END AS t FROM documents)"""


def _tagged(docs):
    pieces = [F.col("text"), F.concat(F.lit(_OPEN), F.left("text", F.lit(10)), F.lit(_CLOSE), F.expr("substring(text, 11)")), F.concat(F.lit(_OPEN), "text"), F.concat(F.lit(f"{_OPEN}a{_OPEN}b{_CLOSE}{_CLOSE}"), "text"), F.concat(F.lit(_CLOSE), "text", F.lit(_OPEN))]
    kind = F.col("doc_id") % 5
    return docs.withColumn("t", F.when(kind == 0, pieces[0]).when(kind == 1, pieces[1]).when(kind == 2, pieces[2]).when(kind == 3, pieces[3]).otherwise(pieces[4]))


@query(f"WITH {_TAGGED} SELECT doc_id, doc_id % 5 < 2 AS ok, doc_id % 5 = 1 AS ok_some FROM tagged")
def validate_tags(spark, sf_dir):
    return _tagged(_docs(spark, sf_dir)).select("doc_id", text.valid_tags("t").alias("ok"), text.valid_tags("t", require=True).alias("ok_some"))


@query("SELECT doc_id, 1 + CASE WHEN doc_id % 5 = 1 AND length(text) > 10 THEN 1 ELSE 0 END::BIGINT AS n_runs, CASE WHEN doc_id % 5 = 1 THEN least(length(text), 10) ELSE 0 END::BIGINT AS marked FROM documents WHERE doc_id % 5 < 2 AND length(text) > 0")
def mark_runs(spark, sf_dir):
    runs = _tagged(_docs(spark, sf_dir)).filter("length(text) > 0").filter(text.valid_tags("t")).select("doc_id", text.mark_runs("t").alias("r"))
    marked = F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s + F.when(x["marked"], F.length(x["segment"])).otherwise(0))
    return runs.select("doc_id", F.size("r").cast("long").alias("n_runs"), marked.alias("marked"))


@query(r"""
WITH r AS (SELECT doc_id, lpad((doc_id % 1000000)::VARCHAR, 6, '0') AS page, text FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN nullif(length(regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')), 0) END::BIGINT AS md_chars FROM r""")
def md_extract(spark, sf_dir):
    page = F.lpad((F.col("doc_id") % 1000000).cast("string"), 6, "0")
    start, end = (F.concat(F.lit(f"<<<MD_{x} page="), page, F.lit(">>>\n")) for x in ("START", "END"))
    kind = F.col("doc_id") % 3
    answer = F.when(kind == 0, F.concat(F.lit("Sure.\n"), start, "text", F.lit("\n"), end)).when(kind == 1, F.concat(start, "text")).otherwise(F.concat(start, start, "text", end))
    return _docs(spark, sf_dir).select("doc_id", F.length(text.page_markdown(answer, page)).cast("long").alias("md_chars"))


@query(r"SELECT page_id, page_id % 3 <> 0 AS visible FROM pages")
def visible_path(spark, sf_dir):
    path = F.regexp_extract("url", "https?://[^/]+/([^?]*)", 1)
    paths = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a/.b/"), path)).otherwise(path).alias("path"))
    return paths.select("page_id", text.visible("path").alias("visible"))


@query(r"WITH s AS (SELECT regexp_extract(url, '([^/?]+)(\?.*)?$', 1) AS stem FROM pages) SELECT stem, count(*) AS n FROM s GROUP BY stem HAVING count(*) > 1")
def stem_collisions(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", r"([^/?]+)(\?.*)?$", 1).alias("stem")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT page_id, url FROM pages ORDER BY lower(url), url")
def path_sort(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").orderBy(text.folded_path("url"), "url")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events""")
def extract_json(spark, sf_dir):
    answer = F.concat(F.lit("Here it is: "), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit("} nothing {")), F.lit(" done."))
    found = table(spark, sf_dir, "events").select("event_id", text.embedded_json(answer).alias("j"))
    return found.select("event_id", F.try_variant_get(F.try_parse_json("j"), "$.k", "long").alias("k"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN text END AS inside, CASE WHEN doc_id % 3 = 0 THEN text END AS strict FROM documents")
def codeblock(spark, sf_dir):
    fence = F.when(F.col("doc_id") % 3 == 0, "```txt\n").when(F.col("doc_id") % 3 == 1, "```\n").otherwise("")
    answer = F.concat(F.lit("Rewritten:\n"), fence, "text", F.lit("\n```"))
    return _docs(spark, sf_dir).select("doc_id", text.code_block(answer).alias("inside"), text.code_block(answer, strict=True).alias("strict"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') END AS thought FROM documents")
def think_extract(spark, sf_dir):
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<think>\n"), "text", F.lit("\n</THINK> so"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", text.thinking(answer).alias("thought"))


@query(f"SELECT doc_id, CASE WHEN t < 600 THEN 1 ELSE (t + 499) // 500 END::BIGINT AS parts FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def parts_needed(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.token_count("text").alias("t")).select("doc_id", numbers.parts_needed("t", 600, 500).alias("parts"))


@query("SELECT doc_id, sha256(text) AS sha, base64(encode(text)) AS head FROM documents")
def sha_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"), F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\\r\\n]", "").alias("head"))


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM a)
SELECT page_id, trim(regexp_replace(t, '[ \t\n\r]+', ' ', 'g')) AS plain FROM b""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text("html").alias("plain"))


@query("SELECT event_id, round((event_id % 500) * 1e9 / (floor(value)::BIGINT * 1000000), 6) AS tok_s FROM events WHERE value >= 1")
def llm_stats(spark, sf_dir):
    stats = table(spark, sf_dir, "events").select("event_id", F.expr("event_id % 500").alias("n"), F.expr("cast(floor(value) as bigint) * 1000000").alias("ns"))
    return stats.filter("ns > 0").select("event_id", F.round(numbers.tokens_per_second("n", "ns"), 6).alias("tok_s"))


@query("SELECT event_id, (sign(n) * ((abs(n) + 3) // 7))::BIGINT AS q FROM (SELECT event_id, event_id - 500 AS n FROM events)")
def round_div(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") - 500).alias("n")).select("event_id", numbers.round_div("n", "7").alias("q"))


@query()
def wrap_lines(spark, sf_dir):
    """Every document whole, its first ten characters marked."""
    marked = F.concat(F.lit(_OPEN), F.left("text", F.lit(10)), F.lit(_CLOSE), F.expr("substring(text, 11)"))
    return layout.wrapped_lines(_docs(spark, sf_dir).select("doc_id", marked.alias("text")))


@query()
def measure_pages(spark, sf_dir):
    rows = F.to_json(F.array(F.struct("doc_id", "source", "lang")))
    return layout.measured(_docs(spark, sf_dir).select("doc_id", rows.alias("json"), "text"))


@query(f"SELECT doc_id, max(tokens) <= 600 AS complete FROM (SELECT doc_id, unnest([len(regexp_extract_all(substring(text, k * 3000 + 1, 3000), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r]')) FOR k IN range(0, length(text) // 3000 + 1)]) AS tokens FROM documents WHERE length(text) > 0) GROUP BY doc_id")
def all_complete(spark, sf_dir):
    """Whether every segment of a document is within the bound, at cuts every 3,000 characters."""
    docs = _docs(spark, sf_dir).filter("length(text) > 0").withColumn("lo", F.explode(F.expr("sequence(0L, length(text) - 1L, 3000L)")))
    segments = docs.select("doc_id", text.token_count(F.substring("text", F.col("lo").cast("int") + 1, F.lit(3000))).alias("tokens"))
    return segments.groupBy("doc_id").agg(F.bool_and(F.col("tokens") <= 600).alias("complete"))


@query("SELECT doc_id, length(text) + 11 >= 0.98 * (length(text) + 40 + 11) AS long_enough FROM documents")
def length_ratio(spark, sf_dir):
    """Whether a repetition that lacks 40 characters is within 98 % of the fenced text."""
    return _docs(spark, sf_dir).select("doc_id", text.long_enough(F.length("text"), F.length("text") + 40).alias("long_enough"))
