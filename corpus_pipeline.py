"""From raw documents to an encoded mix: five stages over the tables of a folder.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs.
All but the last return the columns of ``documents``:

1. toxicity: documents predicted toxic go; the classifier learns from ``labels`` and the stage's own documents.
2. near_duplicates: of every group that links of Jaccard similarity 4/5 on five-word shingles connect, the row with the least
   doc_id stays (null is the least); of rows that share a doc_id and their group, one. Rows without words are in no group and
   stay, as do rows of different groups that share a doc_id or have none.
3. repeats: words in windows of 35 that occur more than once leave the texts; ``n_chars`` is that of what is left. Texts that
   lose every word stay as empty documents.
4. mix: documents stay as often as the mix to target weights takes them whole, rounded up to whole documents, once at least if
   it takes any of their words; documents that the mix takes nothing of go. Repeats are rows of their own. Each row counts by
   itself, whatever its doc_id.
5. encode: doc_id, n_tokens and digests of ids and decoded text.

Stages take extra columns and leave them out. Null and empty texts pass the first three stages; the mix takes none of their words,
so that they end there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, jaccard, mixing, substrings, toxicity
from lectern.plans.shared import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(_columns(docs), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    given = docs.withColumn("_given", F.col("doc_id")).withColumn("_like", F.xxhash64("text", *rest))
    rows, sets, _ = jaccard.linked(given, "_given", "_like", *rest)
    # Groups go by the number of a row of theirs. Rows that tie go by a hash of their columns, so that no text is moved to choose.
    grouped = rows.select("row", "doc_id", "_like", "s0", "s1").join(sets.select("s0", "s1", "root").hint("merge"), ["s0", "s1"], "left")
    first = F.min(F.struct("doc_id", "_like", "row"))["row"]
    kept = grouped.groupBy(F.coalesce("root", "row").alias("_group")).agg(first.alias("row")).select("row")
    return rows.drop("doc_id").withColumnRenamed("_given", "doc_id").join(kept.hint("merge"), "row").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(_columns(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Numbered as they are written: the numbers are unique, and stay. All is decided on numbers, and each text is moved once.
    rows = materialize(_columns(docs).withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    taken = mixing.taken_words(*mixing.mix(rows, row="_row")).filter("taken > 0")
    times = taken.select("_row", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    return rows.join(times.hint("merge"), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", drop_repeats), ("mix", mix), ("encode", encode)]
#: The stages learn, sample and hash; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
