"""Queries of prefix sums, as-of lookups, context windows and the search pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import embedding_splitter as es
from lectern.operators import windows
from lectern.plans import search
from lectern.plans.catalog import TOKENS, query, table
from lectern.plans.shared import materialize

BUDGET = 8192


def _chunks(spark, sf_dir):
    return search.chunks_of(table(spark, sf_dir, "documents"))


def _sums(spark, sf_dir):
    return materialize(windows.with_prefix_sums(_chunks(spark, sf_dir).select("corpus", "i", "tokens")), "prefix-sums")


_SUMS = f"""
c AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id, text, {TOKENS}::BIGINT AS tokens FROM documents),
s AS (SELECT i, doc_id, text, tokens, (sum(tokens) OVER (ORDER BY i) - tokens)::BIGINT AS lo, (sum(tokens) OVER (ORDER BY i))::BIGINT AS hi FROM c),
bounds AS (SELECT i AS b, lo AS p FROM s UNION ALL SELECT max(i) + 1, max(hi) FROM s),
steps AS (SELECT p, max(b) AS b FROM bounds GROUP BY p)"""

_STEP = 7 * BUDGET // 10 - 3 * BUDGET // 10
_WINDOWS = f"""{_SUMS},
n AS (SELECT count(*) AS n FROM s),
r AS (SELECT i, lo + hi AS mid2, n, (sign(lo + hi - {BUDGET}) * ((abs(lo + hi - {BUDGET}) + {_STEP}) // {2 * _STEP}) * {_STEP})::BIGINT AS snap FROM s, n),
r0 AS (SELECT r.*, least(n - 1, greatest(0, coalesce(steps.b, -1))) AS s0 FROM r ASOF LEFT JOIN steps ON r.snap >= steps.p),
tries AS (SELECT *, unnest([0, 1, 2]) AS k FROM r0),
starts AS (SELECT *, CASE k WHEN 2 THEN i ELSE s0 + k END AS st FROM tries),
limits AS (SELECT starts.*, bounds.p AS ps FROM starts JOIN bounds ON bounds.b = st WHERE st < n),
ends AS (SELECT limits.*, greatest(st + 1, least(n, steps.b)) AS en FROM limits ASOF JOIN steps ON limits.ps + {BUDGET} >= steps.p),
scored AS (SELECT ends.*, bounds.p AS pe, mid2 - 2 * ps AS off2 FROM ends JOIN bounds ON bounds.b = en),
ranked AS (SELECT i, st, en, row_number() OVER (PARTITION BY i ORDER BY CASE WHEN k = 2 OR (st <= i AND i < en) THEN 0 ELSE 1 END, k = 2,
  CASE WHEN off2 < {2 * (3 * BUDGET // 10)} THEN {2 * (3 * BUDGET // 10)} - off2 WHEN off2 > {2 * (7 * BUDGET // 10)} THEN off2 - {2 * (7 * BUDGET // 10)} ELSE 0 END,
  {BUDGET} - (pe - ps), abs(ps - snap), st) AS place FROM scored),
win AS (SELECT i, st AS start, en AS stop FROM ranked WHERE place = 1)"""


@query(f"WITH {_SUMS} SELECT i, doc_id, lo, hi FROM s")
def prefix_sums(spark, sf_dir):
    return windows.with_prefix_sums(_chunks(spark, sf_dir)).select("i", "doc_id", "lo", "hi")


@query(f"WITH {_SUMS} SELECT sum(tokens)::BIGINT AS tokens, count(*) AS chunks FROM s")
def corpus_stats(spark, sf_dir):
    return _chunks(spark, sf_dir).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("chunks"))


@query(f"""WITH {_SUMS}, x AS (SELECT i, i * 700 - 350 AS x FROM s)
SELECT x.i, x.x, steps.b::BIGINT AS b FROM x ASOF LEFT JOIN steps ON x.x >= steps.p""")
def asof_boundary(spark, sf_dir):
    sums = _sums(spark, sf_dir)
    points = sums.select("corpus", "i", F.expr("i * 700 - 350").alias("x"))
    return windows.as_of(points, "x", windows.boundaries(sums), "p", "b", "b").select("i", "x", "b")


@query(f"""WITH {_SUMS}, n AS (SELECT count(*) AS n FROM s)
SELECT s.i, greatest(s.i + 1, least(n, steps.b))::BIGINT AS stop FROM (SELECT s.*, n FROM s, n) s ASOF JOIN steps ON s.lo + {BUDGET} >= steps.p""")
def end_boundary(spark, sf_dir):
    sums = _sums(spark, sf_dir)
    points = sums.select("corpus", "i", (F.col("lo") + BUDGET).alias("x"))
    found = windows.as_of(points, "x", windows.boundaries(sums), "p", "b", "b")
    found = found.join(sums.groupBy("corpus").agg(F.count("*").alias("n")), "corpus")
    return found.select("i", F.greatest(F.col("i") + 1, F.least("n", "b")).alias("stop"))


@query(f"WITH {_WINDOWS} SELECT i, start, stop FROM win")
def stable_window(spark, sf_dir):
    return windows.stable_windows(_chunks(spark, sf_dir), BUDGET).select("i", "start", "stop")


@query(f"WITH {_WINDOWS} SELECT count(*) FILTER (was <> start) AS misses FROM (SELECT start, lag(start) OVER (ORDER BY i) AS was FROM win)")
def cache_misses(spark, sf_dir):
    return windows.cache_misses(windows.stable_windows(_chunks(spark, sf_dir), BUDGET)).select("misses")


@query(f"WITH {_WINDOWS} SELECT start, stop, unnest(range(start, stop)) AS i FROM (SELECT DISTINCT start, stop FROM win)")
def context_members(spark, sf_dir):
    return windows.context_members(windows.stable_windows(_chunks(spark, sf_dir), BUDGET)).select("start", "stop", "i")


@query(f"""WITH {_WINDOWS}
SELECT start, stop, sha256(string_agg(text, chr(10) || '---' || chr(10) ORDER BY s.i)) AS context_sha FROM (SELECT DISTINCT start, stop FROM win) w JOIN s ON s.i >= start AND s.i < stop GROUP BY start, stop""")
def context_text(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return windows.context_texts(windows.stable_windows(chunks, BUDGET), chunks).select("start", "stop", F.sha2("context", 256).alias("context_sha"))


INTENT = "the general public license version"
_JUDGED = """
hits AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: w IN ('the', 'general', 'public', 'license', 'version')) AS h FROM documents),
firsts AS (SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS evidence FROM (SELECT doc_id, w, min(k) AS k FROM (SELECT doc_id, unnest(h) AS w, generate_subscripts(h, 1) AS k FROM hits) GROUP BY doc_id, w) GROUP BY doc_id),
judged AS (SELECT doc_id, len(h) >= 20 AS is_relevant, len(h) || ' hits' AS summary, coalesce(evidence, '') AS evidence FROM hits LEFT JOIN firsts USING (doc_id))"""


@query(f"WITH {_JUDGED} SELECT doc_id, is_relevant, summary, evidence FROM judged")
def judge_lexical(spark, sf_dir):
    from lectern.models import lexical_judgement

    return table(spark, sf_dir, "documents").select("doc_id", lexical_judgement(F.col("text"), INTENT, 20).alias("j")).select("doc_id", "j.*")


@query(f"""WITH {_WINDOWS}, {_JUDGED}
SELECT s.i, s.doc_id, w.start, w.stop, c.context_chars, j.summary, j.evidence FROM s JOIN win w USING (i) JOIN judged j USING (doc_id)
JOIN (SELECT start, stop, (sum(length(text)) + 5 * (count(*) - 1))::BIGINT AS context_chars FROM (SELECT DISTINCT start, stop FROM win) x JOIN s ON s.i >= start AND s.i < stop GROUP BY start, stop) c USING (start, stop)
WHERE j.is_relevant""")
def search_pass(spark, sf_dir):
    """The flagship: every document is a chunk; windows, contexts, judgement, positives."""
    found = search.search(table(spark, sf_dir, "documents"), INTENT, BUDGET, least=20, positives=True)
    return found.select("i", "doc_id", "start", "stop", F.length("context").cast("long").alias("context_chars"), "summary", "evidence")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS}::BIGINT AS n FROM documents)
SELECT doc_id, a AS t_start, least(a + 384, n) AS t_end, (a + least(a + 384, n)) // 2 AS t_center FROM (SELECT doc_id, n, unnest(range(0, n, 128)) AS a FROM t)""")
def embed_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.token_count("text").alias("n")).filter("n > 0")
    starts = docs.withColumn("t_start", F.explode(F.expr("sequence(0L, n - 1L, 128L)")))
    return starts.select("doc_id", "t_start", F.expr("least(t_start + 384, n)").alias("t_end"), F.expr("(t_start + least(t_start + 384, n)) div 2").alias("t_center"))


@query(f"""WITH d AS (SELECT doc_id, {TOKENS}::BIGINT AS n FROM documents),
t AS (SELECT doc_id, n, unnest(range(256, n + 1, 256)) AS t FROM d),
c AS (SELECT doc_id, n, t, [k FOR k IN range(0, (n - 1) // 128 + 1) IF (k * 128 + least(k * 128 + 384, n)) // 2 < t] AS l, [k FOR k IN range(0, (n - 1) // 128 + 1) IF (k * 128 + least(k * 128 + 384, n)) // 2 >= t] AS r FROM t)
SELECT doc_id, t, array_to_string(l[greatest(1, len(l) - 4):], ',') AS lefts, array_to_string(r[1:5], ',') AS rights FROM c""")
def nearest_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.token_count("text").alias("n")).filter("n >= 256")
    points = docs.withColumn("t", F.explode(F.expr("sequence(256L, n, 256L)")))
    left, right = es.nearest_windows("n", "t", 384, 128, 5)
    line = lambda c: F.array_join(c.cast("array<string>"), ",")
    return points.select("doc_id", "t", line(left).alias("lefts"), line(right).alias("rights"))


@query()
def boundary_scores(spark, sf_dir):
    return es.grid_scores(table(spark, sf_dir, "documents"))


@query()
def choose_cuts(spark, sf_dir):
    return es.split_by_embedding(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, length(text)::BIGINT AS chars, sha256(text) AS sha FROM documents")
def embedding_chunks(spark, sf_dir):
    """The chunks of each document join to its text."""
    chunks = es.chunks_by_embedding(table(spark, sf_dir, "documents"))
    parts = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("local", "body"))).alias("p"), F.sum(F.col("hi") - F.col("lo")).alias("chars"))
    return parts.select("doc_id", "chars", F.sha2(F.array_join(F.transform("p", lambda x: x["body"]), ""), 256).alias("sha"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, b.vec_id, list_dot_product(q.v, b.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(b.v, b.v)) AS c FROM e q, e b WHERE q.vec_id % 50 = 0 AND b.vec_id <> q.vec_id)
SELECT query_id, vec_id, rank, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search.cosine_topk(vectors.filter("vec_id % 50 = 0"), vectors, 5)
