"""Scans and sinks of the file formats that runs, chunks and books are kept in.

Every scan carries an ordinal, since order is data here. Strict scans fail on any malformed record, lenient ones skip it.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import code_block, code_blocks, universal_newlines, visible
from lectern.models import LecternError
from lectern.operators.ordered import prefix_sums

RS = "\x1e"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files: undecodable bytes dropped, line ends made uniform."""

    def decode(batches):
        for rows in batches:
            yield rows.assign(text=[b.decode("utf-8", "ignore") for b in rows.pop("content")])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return raw.mapInPandas(decode, "path string, text string").withColumn("text", universal_newlines("text"))


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, path of a list with one path per line; blank lines ignored. A list is a small file, read as one."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n?|\n")).alias("ordinal", "path"))
    return lines.select("ordinal", F.trim("path").alias("path")).filter("path <> ''")


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """original_index (1-based over sorted names), filename, content of a directory of chunks."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("content"))
    # The beginning of a name is a bucket of the sorted order.
    files = prefix_sums(files.withColumn("_range", F.substring("filename", 1, 4)), "_range", ["filename"], F.lit(1).cast("long"), None, "_before")
    return files.select("filename", "content", (F.col("_before") + 1).cast("int").alias("original_index"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One text file per chunk (filename, header, body), next to each other; refuses to overwrite."""
    if Path(path).exists() and any(Path(path).iterdir()):
        raise LecternError("the output is not empty", path=path)
    os.makedirs(path, exist_ok=True)

    def write(rows: Iterator) -> None:
        for r in rows:
            at = Path(path) / r["filename"]
            part = at.with_suffix(f".{os.getpid()}.part")
            part.write_text(f"{r['header']}\n{r['body']}", encoding="utf-8")
            part.replace(at)  # a task that runs again writes the same file again

    chunks.select("filename", "header", "body").foreachPartition(write)


def records(text: Column | str, separator: str = RS) -> Column:
    """The records of a journal held in one string: array<struct<ordinal, record>>, blank ones left out."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.split(t, separator), lambda x, i: F.struct(i.alias("ordinal"), F.trim(F.regexp_replace(x, "^[\\r\\n]+", "")).alias("record")))
    return F.filter(parts, lambda x: x["record"] != "")


def journal(spark: SparkSession, path: str, strict: bool = False, separator: str = RS) -> DataFrame:
    """ordinal, record (JSON object) of a journal; a run is one file that is appended to record by record, and read in splits."""
    # Splits of one file are read in their order, so the numbers grow along the file, with gaps.
    lines = spark.read.text(path, lineSep=separator).withColumn("ordinal", F.monotonically_increasing_id())
    lines = lines.select("ordinal", F.trim(F.regexp_replace("value", "^[\\r\\n]+", "")).alias("record")).filter("record <> ''")
    object_ = F.coalesce(F.schema_of_variant(F.try_parse_json("record")).startswith("OBJECT"), F.lit(False))
    if strict and not lines.filter(~object_).isEmpty():
        raise LecternError("malformed record", path=path)
    return lines.filter(object_)


def append_record(path: str, record: dict, separator: str = RS) -> None:
    """Append one record and wait until it is on disk."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, ensure_ascii=False) + separator + "\n")
        f.flush()
        os.fsync(f.fileno())


def newest_name(names: DataFrame, column: str = "name", strict: bool = True) -> DataFrame:
    """newest: the greatest number among names of four digits (strict), or the last name in the order of characters."""
    if not strict:
        return names.agg(F.max(column).alias("newest"))
    ok = names.filter(F.regexp_like(column, F.lit(r"^\d{4}\.jsonl$")))
    return ok.agg(F.max_by(column, F.regexp_extract(column, r"^(\d+)", 1).cast("int")).alias("newest"))


def next_name(newest: str | None, files: int = 0) -> str:
    stem = (newest or "0").split(".")[0]
    return f"{(int(stem) if stem.isdigit() else files) + 1:04d}.jsonl"


def order_line(line: Column | str) -> Column:
    """array<struct<rank, original_index>> of a line of integers, most relevant first."""
    c = F.col(line) if isinstance(line, str) else line
    return F.transform(F.split(F.trim(c), ","), lambda x, i: F.struct((i + 1).alias("rank"), F.trim(x).cast("long").alias("original_index")))


def order_csv(ranks: DataFrame) -> DataFrame:
    """line: the original_index of all rows in order of rank; refuses repeated ranks or items. An order fits one line."""
    n, r, i = ranks.agg(F.count("*"), F.countDistinct("rank"), F.countDistinct("original_index")).first()
    if not n == r == i:
        raise LecternError("the order is not a permutation")
    parts = ranks.agg(F.array_sort(F.collect_list(F.struct("rank", "original_index"))).alias("_p"))
    return parts.select(F.array_join(F.transform("_p", lambda x: x["original_index"].cast("string")), ",").alias("line"))


PRETTY_ROW = "array<struct<relevance_score string, evidence_text string, chunk_filename string, chunk_info string>>"


def pretty(text: Column | str) -> Column:
    """struct<prefix, rows, inner, blocks> of a file with a JSON list and one text block."""
    t = F.col(text) if isinstance(text, str) else text
    prefix = F.rtrim(F.substring_index(t, "```", 1))
    return F.struct(prefix.alias("prefix"), F.from_json(prefix, PRETTY_ROW).alias("rows"), code_block(t, strict=True).alias("inner"), code_blocks(t).alias("blocks"))


def visible_pdfs(base: str) -> list[str]:
    """Relative paths of the PDF files below a folder that no segment hides, sorted by folded and by raw path."""
    found = []
    for folder, inner, names in os.walk(base):
        inner[:] = [d for d in inner if not d.startswith(".")]
        found += [os.path.relpath(os.path.join(folder, n), base) for n in names if n.lower().endswith(".pdf") and not n.startswith(".")]
    return sorted(found, key=lambda p: (p.casefold(), p))


def manifest(paths: list[str], base: str) -> dict:
    stems: dict[str, str] = {}
    for p in paths:
        if (other := stems.setdefault(Path(p).stem, p)) != p:
            raise LecternError("two files would give the same output", first=other, second=p)
    return {"type": "manifest", "base_dir": base, "pdf_count": len(paths), "pdfs_sha256": hashlib.sha256("\n".join(paths).encode()).hexdigest(), "pdfs": paths}


def visible_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    return paths.filter(visible(column))
