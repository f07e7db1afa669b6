"""From positives and their order to files for reading."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import body, header_line, html_to_text, strip
from lectern.models import highlighted
from lectern.operators.present import PART, even_parts, grouped, strictly_increasing, with_neighbours
from lectern.plans import asked
from lectern.plans.shared import materialize
from lectern.sources.books import pretty_file, yellow_file

Clean = Callable[[Column], Column]


def pretty_books(judgements: DataFrame, chunks: DataFrame, order: DataFrame, clean: Clean = html_to_text, part: int = PART, cleaner: Callable[[str], str] | None = None) -> DataFrame:
    """group_id, rows, text, file of each group of neighbouring positives, best first.

    judgements: num, evidence (one row per record, with ordinal); chunks: num, filename, content (header line and body); order:
    num, rank. A group comes with the chunks right before and after it; large groups are cleaned in even parts of at most
    ``part`` chunks, which are joined by blanks. Parts are cleaned by ``clean``, an expression, or by ``cleaner``, a function that
    asks a model. The members of a group must have increasing numbers.
    """
    hits = judgements.groupBy("num").agg(F.array_sort(F.collect_list(F.struct("ordinal", "evidence"))).alias("_e"))
    hits = hits.withColumn("evidence_text", F.array_join(F.array_distinct(F.transform("_e", lambda x: x["evidence"])), " | ")).drop("_e")
    ranked = hits.join(order, "num").withColumn("family", F.lit("chunks"))
    total = order.count()
    groups = materialize(grouped(ranked, ["family"]), "groups")
    strictly_increasing(groups, ["island"], "num")
    place = F.row_number().over(Window.partitionBy("island").orderBy("num")) - 1
    members = groups.withColumn("_part", even_parts(F.col("size"), place, part))
    texts = with_neighbours(members.select(F.lit(0).alias("corpus"), "island", "num"), chunks.select(F.lit(0).alias("corpus"), "num", "content"))
    texts = texts.join(members.select("island", "num", "_part"), ["island", "num"], "left")
    sides = Window.partitionBy("island").orderBy("num").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.coalesce("_part", F.when(F.col("num") < F.first("num", ignorenulls=True).over(sides) + 1, F.lit(1)).otherwise(F.max("_part").over(sides)))
    parts = texts.withColumn("_part", own).groupBy("island", "_part").agg(F.array_sort(F.collect_list(F.struct("num", body("content").alias("b")))).alias("_t"))
    raw = parts.select("island", "_part", F.array_join(F.transform("_t", lambda x: x["b"]), "").alias("_raw"))
    cleaned = raw.select("island", "_part", clean(F.col("_raw")).alias("_c")) if cleaner is None else asked.cleaned(raw, cleaner, "_raw", "_c")
    whole = cleaned.groupBy("island").agg(F.array_sort(F.collect_list(F.struct("_part", "_c"))).alias("_w"))
    whole = whole.select("island", F.array_join(F.transform("_w", lambda x: x["_c"]), " ").alias("text"))
    row = F.struct(
        F.concat(F.col("rank").cast("string"), F.lit(f"/{total}")).alias("relevance_score"),
        "evidence_text",
        F.col("filename").alias("chunk_filename"),
        strip(header_line("content")).alias("chunk_info"),
    )
    rows = groups.join(chunks, "num").groupBy("island", "group_rank").agg(F.array_sort(F.collect_list(F.struct("num", row.alias("row")))).alias("_r"))
    rows = rows.select("island", F.col("group_rank").alias("group_id"), F.transform("_r", lambda x: x["row"]).alias("rows"))
    out = rows.join(whole, "island").withColumn("file", pretty_file(F.col("rows"), F.col("text")))
    return out.select("group_id", "rows", "text", "file")


def yellow_books(books: DataFrame, query: str, highlighter: Callable[[str, Sequence[str]], str] | None = None) -> DataFrame:
    """group_id, file: pretty files with what serves the query highlighted; the rows stay as they are.

    By default the terms of the query are; ``highlighter`` asks a model, with the evidence of the group's rows.
    """
    prefix = F.substring_index("file", "```txt\n", 1)
    if highlighter is not None:
        found = asked.highlighted(books.withColumn("evidences", F.transform("rows", lambda x: x["evidence_text"])), highlighter)
        return found.select("group_id", yellow_file(prefix, F.col("highlighted")).alias("file"))
    return books.select("group_id", yellow_file(prefix, highlighted(F.col("text"), query)).alias("file"))
