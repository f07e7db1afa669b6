"""Grouping, evidence and packing of what was found, for reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import body, unique_join
from lectern.models import LecternError
from lectern.operators.ordered import prefix_sums, ranged
from lectern.operators.windows import islands
from lectern.plans.shared import materialize, shuffle_partitions

#: Most chunks of a group that are cleaned in one call, and most content pages of a cover.
PART, COVER_PAGES = 5, 20


def grouped(hits: DataFrame, family: list[str]) -> DataFrame:
    """Add ``island``, ``size`` and ``group_rank``: runs of neighbouring hits, in the order of their best rank."""
    runs = islands(hits, family, "num")
    groups = runs.groupBy(*family, "island").agg(F.count("*").alias("size"), F.min("rank").alias("best"))
    groups = prefix_sums(ranged(materialize(groups, "group-sizes"), ["best"]), "_range", ["best", *family, "island"], F.lit(1).cast("long"), None, "_before")
    return runs.join(groups.withColumn("group_rank", F.col("_before") + 1).drop("_before", "_range"), [*family, "island"])


def strictly_increasing(rows: DataFrame, group: list[str], num: str) -> None:
    """Refuses rows of a group that share a number: in the order of their numbers these must grow."""
    odd = rows.groupBy(*group, num).agg(F.count("*").alias("_n")).filter("_n > 1").limit(1).collect()
    if odd:
        raise LecternError("the numbers of a group do not increase", **{c: odd[0][c] for c in [*group, num]})


def even_parts(n: Column, place: Column, size: int = PART) -> Column:
    """1-based part of a 0-based place when n items go into ceil(n / size) parts, the first ones longer by one if need be."""
    parts = F.ceil(n / size).cast("long")
    short, longer = F.floor(n / parts), n % parts
    return F.when(place < longer * (short + 1), F.floor(place / (short + 1))).otherwise(longer + F.floor((place - longer * (short + 1)) / short)).cast("long") + 1


def with_neighbours(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of each group and those right before and after it, where they exist; members and chunks: corpus, num."""
    keys = members.select("corpus", "island", F.explode(F.array(F.col("num") - 1, F.col("num"), F.col("num") + 1)).alias("num")).distinct()
    return keys.join(chunks, ["corpus", "num"])


def group_text(context: DataFrame) -> DataFrame:
    """corpus, island, text: the bodies of the chunks of a group and its neighbours, in order."""
    parts = context.groupBy("corpus", "island").agg(F.array_sort(F.collect_list(F.struct("num", body("text").alias("body")))).alias("_p"))
    return parts.select("corpus", "island", F.array_join(F.transform("_p", lambda x: x["body"]), "").alias("text"))


def evidence(judgements: DataFrame) -> DataFrame:
    """filename, evidence: the different pieces of evidence of a file in the order of the records."""
    parts = judgements.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("ordinal", "evidence"))).alias("_p"))
    return parts.select("filename", unique_join(F.transform("_p", lambda x: x["evidence"])).alias("evidence"))


def rank_display(rows: Column) -> Column:
    """'#a · #b' of array<struct<num, den>> in order of num, with denominators if they differ."""
    ordered = F.array_sort(rows)
    same = F.size(F.array_distinct(F.transform(rows, lambda x: x["den"]))) <= 1
    short = F.transform(ordered, lambda x: F.concat(F.lit("#"), x["num"].cast("string")))
    full = F.transform(ordered, lambda x: F.concat(F.lit("#"), x["num"].cast("string"), F.lit("/"), x["den"].cast("string")))
    return F.array_join(F.when(same, short).otherwise(full), " · ")


def _transition(pages: list[int], most: int) -> tuple[list[int], list[int]]:
    """For every state before some groups, the state after them and the covers that begin: state 0 is none yet, s + 1 a sum of s pages."""
    total, covers = list(range(-1, most + 2)), [0] * (most + 3)
    for n in pages:
        for i, was in enumerate(total):
            if was < 0 or (was > 0 and was + n > most):
                total[i] = min(n, most + 1)
                covers[i] += 1
            else:
                total[i] = min(was + n, most + 1)
    return [x + 1 for x in total], covers


def _by_key(batches, width: int):
    """(first ``width`` columns, rows of the others) of consecutive rows that agree in them."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != now:
                if rows:
                    yield now, rows
                now, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield now, rows


def _out(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def plan_covers(groups: DataFrame, book: str = "book", most: int = COVER_PAGES, block: int = 4096) -> DataFrame:
    """book, ordinal, cover: next fit; a cover is closed when the next group would exceed its pages. groups: book, ordinal, pages.

    Next fit is sequential, but its state is a number of pages up to ``most``. So a book is cut into blocks of ordinals; each
    gives, for every state before it, the state after it and the covers begun; the blocks of a book are run through in order, a
    row for each; then every block is packed from its known state. No task holds more than a block of a book's groups.
    """
    import pyarrow as pa

    spark = groups.sparkSession
    rows = materialize(groups.select(F.col(book).cast("string").alias("book"), F.expr(f"floor(ordinal / {block})").alias("block"), F.col("ordinal").cast("long").alias("ordinal"), F.col("pages").cast("long").alias("pages")), "cover-groups")
    n = shuffle_partitions(spark)
    dealt = rows.repartition(n, "book", "block").sortWithinPartitions("book", "block", "ordinal").select("book", "block", "ordinal", "pages")

    def pass_over(batches):
        schema = pa.schema([("book", pa.string()), ("block", pa.int64()), ("after", pa.list_(pa.int32())), ("covers", pa.list_(pa.int64()))])
        for (name, at), found in _by_key(batches, 2):
            yield _out([(name, at, *_transition([p for _, p in found], most))], schema)

    def chain(batches):
        schema = pa.schema([("book", pa.string()), ("block", pa.int64()), ("state", pa.int32()), ("cover", pa.int64())])
        now, state, cover = None, 0, 0
        for batch in batches:
            out = []
            for name, at, after, covers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name,) != now:
                    now, state, cover = (name,), 0, 0
                out.append((name, at, state, cover))
                state, cover = after[state], cover + covers[state]
            yield _out(out, schema)

    def pack(batches):
        schema = pa.schema([("book", pa.string()), ("ordinal", pa.int64()), ("cover", pa.int64())])
        for (name, _), found in _by_key(batches, 2):
            total, cover, out = found[0][2] - 1, found[0][3], []
            for ordinal, pages, _, _ in found:
                if total < 0 or (total > 0 and total + pages > most):
                    total, cover = pages, cover + 1
                else:
                    total += pages
                total = min(total, most + 1)
                out.append((name, ordinal, cover))
            yield _out(out, schema)

    steps = materialize(dealt.mapInArrow(pass_over, "book string, block long, after array<int>, covers array<long>"), "cover-blocks")
    chained = steps.repartition(n, "book").sortWithinPartitions("book", "block").mapInArrow(chain, "book string, block long, state int, cover long")
    on = rows["book"].eqNullSafe(F.col("_b")) & (rows["block"] == F.col("_k"))
    both = rows.join(chained.withColumnsRenamed({"book": "_b", "block": "_k"}), on).repartition(n, "book", "block").sortWithinPartitions("book", "block", "ordinal")
    packed = both.select("book", "block", "ordinal", "pages", "state", "cover").mapInArrow(pack, "book string, ordinal long, cover long")
    return packed.select(F.col("book").cast(groups.schema[book].dataType).alias(book), "ordinal", "cover")


def cover_ranges(covers: DataFrame, book: str = "book") -> DataFrame:
    """first, last page of each cover's content: every cover has one page of its own. covers: book, cover, pages."""
    blocks = covers.withColumn("_range", F.expr("floor(cover / 4096)"))
    found = prefix_sums(blocks, "_range", ["cover"], F.col("pages") + 1, [book], "_before")
    return found.select(book, "cover", "pages", (F.col("_before") + 2).alias("first_page"), (F.col("_before") + 1 + F.col("pages")).alias("last_page"))
