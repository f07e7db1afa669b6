"""Streaming forms of the stateful steps: documents that arrive are split and judged once, and journaled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.models import lexical_judgement
from lectern.operators.splitter import split_documents


def judged_stream(docs: DataFrame, query: str, least: int = 1) -> DataFrame:
    """doc_id, local, is_relevant, summary, evidence of the chunks of a (streaming) table of documents."""
    chunks = split_documents(docs)
    return chunks.select("doc_id", "local", lexical_judgement(F.col("body"), query, least).alias("_j")).select("doc_id", "local", "_j.*")


def start_journal(judgements: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append judgements to a journal, one Parquet commit per micro-batch. A batch that is replayed replaces its own files."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return judgements.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events per window of time and type, with a watermark for late ones; works on streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
