"""Whole programs over files: each reads what the one before has written."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import filename_parts, token_count
from lectern.models import Judge, LecternError, hits, judged, lexical_judgement, lexical_winner
from lectern.operators import windows
from lectern.operators.splitter import Proposer, delimiter_split, numbered_chunks, split_documents
from lectern.plans import asked
from lectern.plans.present import pretty_books, yellow_books
from lectern.plans.rank import rank_items
from lectern.plans.shared import materialize
from lectern.sources.books import first_query, raw_entry, read_records, write_text
from lectern.sources.files import append_record, chunk_files, next_name, order_csv, text_files, write_chunks
from lectern.sources.files import pretty as parsed

#: Chunks that are judged by a model before their judgements are written to the journal.
PART = 256


def split(spark: SparkSession, paths: list[str], output: str, propose: Proposer = delimiter_split) -> int:
    """Chunk files of the text files, numbered over all of them in the order given; returns how many."""
    for p in paths:
        if not Path(p).is_file():
            raise LecternError("no such file", path=p)
    order = {str(Path(p).resolve()): i for i, p in enumerate(paths)}
    texts = text_files(spark, [f"file://{p}" for p in order]).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    ids = spark.createDataFrame([(p, i) for p, i in order.items()], "path string, doc_id long")
    docs = materialize(texts.join(ids, "path"), "texts")
    chunks = split_documents(docs, propose=propose).join(docs.select("doc_id", F.col("path").alias("source")), "doc_id")
    chunks = materialize(numbered_chunks(chunks), "chunks")
    write_chunks(chunks, f"{output}/chunks")
    return chunks.count()


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """corpus, i, original_index, filename, text, tokens; tokens count the header as well."""
    rows = chunk_files(spark, folder)
    return materialize(rows.select(F.lit(0).alias("corpus"), (F.col("original_index") - 1).cast("long").alias("i"), "original_index", "filename", F.col("content").alias("text"), token_count("content").alias("tokens")), "chunk-files")


def newest(folder: str) -> Path | None:
    found = sorted(Path(folder).glob("*.jsonl"))
    return found[-1] if found else None


def search(spark: SparkSession, folder: str, runs: str, query: str, about: str, budget: int, least: int, judge: Judge | None = None) -> str:
    """One pass: a fresh run, a run over the positives of the last one, or the rest of one that is not complete.

    Chunks are judged by the terms of the query, or by ``judge`` in the context of their windows, a part of the run at a time; each
    part is appended to the journal before the next begins, so that a lost run repeats one part at most.
    """
    chunks = _chunks(spark, folder)
    total = chunks.count()
    last = newest(runs)
    records = read_records(last, strict=False) if last else []
    done = [r for r in records if r.get("type") == "judgement"]
    if last is None:
        meta = {"original_total_chunks": total, "selected_indices": list(range(1, total + 1)), "pass_number": 1}
    else:
        if not records or records[0].get("type") != "meta":
            raise LecternError("the run has no meta record", run=last.name)
        meta = records[0]
        if meta["original_total_chunks"] != total:
            raise LecternError("the corpus has changed since the run began", had=meta["original_total_chunks"], has=total)
    path = last or Path(runs) / next_name(None)
    if last and len(done) >= meta["run_total_chunks"]:
        kept = [r["original_index"] for r in done if r["is_relevant"] is True]
        if not kept:
            return "nothing is left to refine"
        meta, done, path = {"original_total_chunks": total, "selected_indices": sorted(kept), "pass_number": meta["pass_number"] + 1}, [], Path(runs) / next_name(last.name)
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        created = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        meta = {"type": "meta", "created_at": created, "query": query, "context": about, "run_total_chunks": len(meta["selected_indices"]), "delimiter": "\x1e"} | meta
        append_record(str(path), meta)
    judged = {r["position_in_run"] for r in done}
    todo = [(p, i) for p, i in enumerate(meta["selected_indices"], 1) if p not in judged]
    if not todo:
        return str(path)
    pending = spark.createDataFrame(todo, "position long, original_index int")
    placed = materialize(windows.stable_windows(chunks, budget), "windows")
    rows = chunks.join(pending, "original_index").join(placed, ["corpus", "i"])
    if judge is None:
        rows = rows.select("position", "original_index", "filename", lexical_judgement(F.col("text"), query, least).alias("j")).select("position", "original_index", "filename", "j.*")
        parts = [rows]
    else:
        rows = materialize(rows, "pending")
        top = todo[-1][0]
        parts = [_asked(rows.filter(F.col("position").between(at, at + PART - 1)), chunks, judge) for at in range(todo[0][0], top + 1, PART)]
    for part in parts:
        for r in materialize(part, "judgements").orderBy("position").toLocalIterator():  # a run file is one append-only text
            append_record(str(path), {"type": "judgement", "position_in_run": r["position"], "original_index": r["original_index"], "filename": r["filename"], "is_relevant": r["is_relevant"], "summary": r["summary"], "evidence": r["evidence"]})
    return str(path)


def _asked(rows: DataFrame, chunks: DataFrame, judge: Judge) -> DataFrame:
    """position, original_index, filename, is_relevant, summary, evidence by a judge that reads the context of each chunk."""
    near = rows.join(windows.context_texts(rows, chunks), ["corpus", "start", "stop"])
    return judged(near.repartitionByRange("start").sortWithinPartitions("start", "i"), judge, keep=("position", "original_index", "filename"))


def _positives(runs: str) -> tuple[Path, list[dict]]:
    """The newest run, and its positive judgements in the order of the chunks, each chunk once."""
    last = newest(runs)
    if last is None:
        raise LecternError("there is no run", folder=runs)
    records = read_records(last)
    first_query(records)
    found = {r["original_index"]: r for r in records if r.get("type") == "judgement" and r.get("is_relevant") is True}
    if not found:
        raise LecternError("the run has no positives", run=last.name)
    return last, [found[i] for i in sorted(found)]


def raw(spark: SparkSession, folder: str, runs: str, output: str) -> int:
    """One text of the positives of the newest run: each judgement as a line of JSON, its chunk, a blank line; returns how many."""
    last, found = _positives(runs)
    if Path(output).exists():
        raise LecternError("refusing to overwrite", path=output)
    records = spark.createDataFrame([(r["original_index"], json.dumps(r, ensure_ascii=False)) for r in found], "original_index int, record string")
    rows = _chunks(spark, folder).join(records, "original_index").select("original_index", raw_entry(F.col("record"), F.col("text")).alias("entry"))
    rows = materialize(rows, "raw")
    if rows.count() != len(found):
        raise LecternError("chunks of the run are missing", run=last.name)
    Path(output).parent.mkdir(parents=True, exist_ok=True)
    part = Path(output).with_suffix(".part")
    with part.open("w", encoding="utf-8") as f:
        f.writelines(r["entry"] for r in rows.orderBy("original_index").toLocalIterator())
    part.replace(output)
    return len(found)


def _written(folder: str) -> int:
    """Files 000001.txt and on that a folder has; a gap is an error."""
    names = sorted(p.name for p in Path(folder).glob("*.txt")) if Path(folder).is_dir() else []
    if names != [f"{i:06d}.txt" for i in range(1, len(names) + 1)]:
        raise LecternError("the files of the output are not without gaps", folder=folder)
    return len(names)


def _write_books(books: DataFrame, output: str, done: int) -> int:
    """A file for each group that is not there yet, in order; returns how many there are then."""
    for r in books.filter(F.col("group_id") > done).select("group_id", "file").orderBy("group_id").toLocalIterator():
        write_text(Path(output) / f"{r['group_id']:06d}.txt", r["file"])
        done = r["group_id"]
    return done


def pretty(spark: SparkSession, folder: str, runs: str, order: str, output: str, cleaner: Callable[[str], str] | None = None) -> int:
    """A file for each group of neighbouring positives, best first: rows with evidence, and the cleaned text. Goes on where it was left."""
    _, found = _positives(runs)
    judgements = spark.createDataFrame([(r["original_index"], i, str(r.get("evidence", ""))) for i, r in enumerate(found)], "num long, ordinal int, evidence string")
    ranks = [int(x) for x in Path(order).read_text(encoding="utf-8").strip().split(",")]
    if len({*ranks}) != len(ranks) or {*ranks} != {r["original_index"] for r in found}:
        raise LecternError("the order is not that of the run's positives", path=order)
    ordered = spark.createDataFrame([(n, i) for i, n in enumerate(ranks, 1)], "num long, rank long")
    chunks = _chunks(spark, folder).select(F.col("original_index").cast("long").alias("num"), "filename", F.col("text").alias("content"))
    books = pretty_books(judgements, chunks, ordered, cleaner=cleaner)
    return _write_books(materialize(books, "pretty"), output, _written(output))


def yellow(spark: SparkSession, folder: str, query: str, output: str, highlighter: Callable[[str, Sequence[str]], str] | None = None) -> int:
    """The pretty files with what serves the query highlighted. Goes on where it was left; ends with as many files as it read."""
    _written(folder)
    done = _written(output)
    texts = text_files(spark, f"file://{Path(folder).resolve()}")
    books = texts.select(filename_parts(F.element_at(F.split("path", "/"), -1))["num"].alias("group_id"), F.col("text").alias("file"), parsed(F.col("text")).alias("_p"))
    books = books.select("group_id", "file", F.col("_p.rows").alias("rows"), F.col("_p.inner").alias("text")).filter(F.col("group_id") > done)
    return _write_books(materialize(yellow_books(books, query, highlighter), "yellow"), output, done)


def rank(spark: SparkSession, folder: str, runs: str, query: str, output: str, decide: Callable[[dict, dict], tuple[str, str]] | None = None) -> str:
    """order.csv of the positives of the newest run: more hits of the ranking query first, or as ``decide`` judges pairs."""
    last, kept = _positives(runs)
    chosen = spark.createDataFrame([(r["original_index"], str(r.get("summary", "")), str(r.get("evidence", ""))) for r in kept], "original_index int, summary string, evidence string")
    items = _chunks(spark, folder).join(chosen, "original_index").select(F.col("original_index").cast("long").alias("item"), "filename", "summary", "evidence", "text", F.size(hits(F.col("text"), query)).alias("score"))
    items = materialize(items, "items")
    if items.count() != len(kept):
        raise LecternError("chunks of the run are missing", run=last.name)
    score = items.select("item", "score")

    def judge(games: DataFrame) -> DataFrame:
        both = games.join(score.toDF("left", "_ls"), "left").join(score.toDF("right", "_rs"), "right")
        return both.withColumn("winner", lexical_winner(F.col("_ls"), F.col("left"), F.col("_rs"), F.col("right"))).drop("_ls", "_rs")

    ranks = materialize(rank_items(items, asked.pair_judge(items, decide) if decide else judge).select("rank", F.col("item").alias("original_index")), "order")
    write_text(output, order_csv(ranks).first()["line"] + "\n")
    return output
