"""Runs of a search: what to judge next, and replaying journals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.models import LecternError
from lectern.operators.windows import number_rows


@dataclass(frozen=True)
class RunMeta:
    """What a run is about; a run is resumed only under the same one."""

    query: str
    original_total_chunks: int
    run_total_chunks: int
    pass_number: int = 1

    def same_corpus(self, chunks: int) -> None:
        if self.original_total_chunks != chunks:
            raise LecternError("the corpus has changed since the run began", had=self.original_total_chunks, has=chunks)


def status(meta: DataFrame, judgements: DataFrame) -> DataFrame:
    """run, total, judged, complete: complete from as many judgements as the run has chunks, repeats counted."""
    n = judgements.groupBy("run").agg(F.count("*").alias("judged"))
    return meta.join(n, "run", "left").select("run", "total", F.coalesce("judged", F.lit(0)).alias("judged"), (F.coalesce("judged", F.lit(0)) >= F.col("total")).alias("complete"))


def pending(selected: DataFrame, judgements: DataFrame) -> DataFrame:
    """Positions of a run that have no judgement yet."""
    return selected.join(judgements.select("run", "position").distinct(), ["run", "position"], "left_anti")


def refined(chunks: DataFrame, judgements: DataFrame) -> DataFrame:
    """The chunks that were judged relevant, with their position in the next run (1-based)."""
    kept = chunks.join(judgements.filter("is_relevant"), "original_index", "left_semi")
    return number_rows(kept, "original_index", "_place").withColumn("position", F.col("_place") + 1).drop("_place")


def selected(positions: DataFrame, chunks: DataFrame, strict: bool = True) -> DataFrame:
    """The chunks of the selected positions; a missing one is an error."""
    if strict and not positions.join(chunks, "original_index", "left_anti").isEmpty():
        raise LecternError("selected chunks are missing")
    return positions.join(chunks, "original_index")


def latest(journal: DataFrame, key: str, ordinal: str = "line_no") -> DataFrame:
    """The last record of each key."""
    rest = [c for c in journal.columns if c != key]
    return journal.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(key, "_r.*")


def plan(meta: DataFrame, judgements: DataFrame, newest: str | None) -> str:
    """fresh, refine or resume: what the newest run asks for."""
    if newest is None:
        return "fresh"
    row = status(meta.filter(F.col("run") == newest), judgements.filter(F.col("run") == newest)).first()
    if row is None:
        raise LecternError("the run has no meta record", run=newest)
    return "refine" if row["complete"] else "resume"


def follows_schedule(journal: DataFrame, schedule: DataFrame) -> bool:
    """The recorded comparisons are a prefix of the schedule; both: pair_index, left, right."""
    odd = journal.join(schedule.withColumnsRenamed({"left": "_l", "right": "_r"}), "pair_index", "left").filter("not (left <=> _l and right <=> _r)")
    n, top = journal.agg(F.count("*"), F.max("pair_index")).first()
    return odd.isEmpty() and (n == 0 or top == n - 1)
