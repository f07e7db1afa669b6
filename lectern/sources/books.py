"""Formats of the later stages: cut journals, rank journals, raw, pretty and yellow files, pages, books."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.models import LecternError


# --- cut journals ---


def cut_meta(records: DataFrame) -> DataFrame:
    """path, meta: the first meta record of each journal; records: path, ordinal, record."""
    kind = F.try_variant_get(F.try_parse_json("record"), "$.type", "string")
    return records.filter(kind == "meta").groupBy("path").agg(F.min_by("record", "ordinal").alias("meta"))


def cut_positions(records: DataFrame) -> DataFrame:
    """path, ordinal, pos of the cut records; positions that are not integers, and unknown types, are passed over."""
    v = F.try_parse_json("record")
    pos = F.when(F.schema_of_variant(F.try_variant_get(v, "$.pos", "variant")) == "BIGINT", F.try_variant_get(v, "$.pos", "long"))
    found = records.filter(F.try_variant_get(v, "$.type", "string") == "cut").select("path", "ordinal", pos.alias("pos"))
    return found.filter("pos is not null")


# --- rank journals ---

#: The record types of a rank journal, and the stages each may have.
RANK_TYPES = {"skeleton": None, "topset": None, "cmp": ("skeleton", "topfull"), "bt_summary": ("skeleton", "topfull"), "probe": ("bracket",), "confirm": ("bracket",), "bracket_decision": ("bracket",)}


@dataclass
class RankJournal:
    meta: dict = field(default_factory=dict)
    skeleton: list[int] | None = None
    topset: dict | None = None
    games: dict[str, list[dict]] = field(default_factory=lambda: {"skeleton": [], "topfull": []})
    orders: dict[str, list[int]] = field(default_factory=dict)
    probes: dict[tuple[int, int], dict] = field(default_factory=dict)
    confirms: dict[tuple[int, int], list[dict]] = field(default_factory=dict)
    tiers: dict[int, int] = field(default_factory=dict)


def replay(records: list[dict]) -> RankJournal:
    """State of a ranking from its journal, which is as long as its comparisons; unknown types, stages and repeats are errors."""
    out = RankJournal(meta=records[0] if records else {})
    for r in records[1:]:
        kind, stage = r.get("type"), r.get("stage")
        if kind not in RANK_TYPES or (RANK_TYPES[kind] and stage not in RANK_TYPES[kind]):
            raise LecternError("unknown record", type=kind, stage=stage)
        if kind in ("skeleton", "topset"):
            if getattr(out, kind) is not None:
                raise LecternError("repeated record", type=kind)
            setattr(out, kind, [int(i) for i in r["ids"]] if kind == "skeleton" else r)
        elif kind == "cmp":
            out.games[stage].append(r)
        elif kind == "bt_summary":
            if stage in out.orders or not isinstance(r.get("order"), list):
                raise LecternError("repeated or broken summary", stage=stage)
            out.orders[stage] = [int(i) for i in r["order"]]
        elif kind == "probe":
            out.probes[int(r["item"]), int(r["pivot"])] = r
        elif kind == "confirm":
            out.confirms.setdefault((int(r["item"]), int(r["against"])), []).append(r)
        else:
            out.tiers[int(r["item"])] = int(r["tier"])
    return out


def same_meta(stored: dict, current: dict, but: tuple[str, ...] = ("created_at",)) -> None:
    """A ranking is resumed only under the configuration it was begun with."""
    odd = sorted(k for k in {*stored, *current} - {*but} if stored.get(k) != current.get(k))
    if odd:
        raise LecternError("the configuration has changed", fields=odd)


# --- files for reading ---


def raw_entry(record: Column, text: Column) -> Column:
    return F.concat(record, F.lit("\n"), text, F.lit("\n\n"))


def pretty_file(rows: Column, text: Column) -> Column:
    """A list of rows as indented JSON, a blank line, the text in a block."""
    return F.concat(F.to_json(rows, {"pretty": "true"}), F.lit("\n\n```txt\n"), text, F.lit("\n```\n"))


def yellow_file(prefix: Column, text: Column) -> Column:
    """The prefix of a pretty file as it is, and the highlighted text in place of the old one."""
    return F.concat(prefix, F.lit("```txt\n"), text, F.lit("\n```\n"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """document, markdown: the pages of a document in order, blank lines between; pages: document, page_index, md."""
    parts = pages.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page_index", F.regexp_replace("md", r"\s+$", "").alias("md")))).alias("_p"))
    return parts.select("document", F.array_join(F.transform("_p", lambda x: x["md"]), "\n\n").alias("markdown"))


def gaps(names: DataFrame, column: str = "filename") -> DataFrame:
    """missing: the numbers below the greatest that no name has; a resumable output has none."""
    numbers = names.select(F.regexp_extract(column, r"^(\d{6})\.txt$", 1).alias("_n")).filter("_n <> ''").select(F.col("_n").cast("long").alias("n")).distinct()
    most = numbers.agg(F.max("n")).first()[0] or 1
    return names.sparkSession.range(1, most).select(F.col("id").alias("missing")).join(numbers.withColumnRenamed("n", "missing"), "missing", "left_anti")


def unmatched(left: DataFrame, right: DataFrame, key: str = "filename") -> DataFrame:
    """Names that only one side has, and which: a one-to-one match has none."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(True)), right.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer").filter("_a is null or _b is null")
    return both.select(key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("only"))


def write_text(path: str | Path, text: str) -> None:
    """All or nothing: written next to its place and moved there; refuses to overwrite."""
    path = Path(path)
    if path.exists():
        raise LecternError("refusing to overwrite", path=str(path))
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.part")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)


def first_query(records: list[dict]) -> str:
    """The query in the first record of a journal."""
    if not records or not isinstance(records[0].get("query"), str):
        raise LecternError("the journal does not begin with a query")
    return records[0]["query"]


def read_records(path: str | Path, strict: bool = True, separator: str | None = "\x1e") -> list[dict]:
    """The records of one journal on the driver, for planning a run; a journal's own size bounds them."""
    text = Path(path).read_text(encoding="utf-8")
    parts = text.split(separator) if separator else text.splitlines()
    out = []
    for part in filter(None, map(str.strip, parts)):
        try:
            found = json.loads(part)
        except ValueError as e:
            if strict:
                raise LecternError("malformed record", path=str(path)) from e
            continue
        if not isinstance(found, dict):
            if strict:
                raise LecternError("a record is not an object", path=str(path))
            continue
        out.append(found)
    return out


def log_name(pdf: str) -> str:
    """Log file of a converted file: its stem and eight digits of a digest of its path, so that equal stems differ."""
    import hashlib

    return f"{re.sub(r'[^A-Za-z0-9._-]+', '_', Path(pdf).stem)}-{hashlib.sha256(pdf.encode()).hexdigest()[:8]}.log"


# --- optional: pages of PDF files, and books ---


def page_images(pdfs: DataFrame, long_side: int = 4096, oversample: int = 2) -> DataFrame:
    """path, page_index, png, width, height of every page; needs PyMuPDF and Pillow on the workers. pdfs: path, content."""

    def render(batches):
        import io

        import fitz
        import pandas as pd
        from PIL import Image

        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as book:
                    for i, page in enumerate(book):
                        scale = oversample * long_side / max(page.rect.width, page.rect.height)
                        shot = page.get_pixmap(matrix=fitz.Matrix(scale, scale), alpha=False)
                        image = Image.frombytes("RGB", (shot.width, shot.height), shot.samples)
                        size = tuple(max(1, round(x * long_side / max(image.size))) for x in image.size)
                        image, out = image.resize(size, Image.LANCZOS), io.BytesIO()
                        image.save(out, "PNG")
                        yield pd.DataFrame({"path": [path], "page_index": [i], "png": [out.getvalue()], "width": [size[0]], "height": [size[1]]})

    return pdfs.select("path", "content").mapInPandas(render, "path string, page_index int, png binary, width int, height int")


def draw_book(lines: list[dict], path: str, height: float = 841.89, margin: float = 60.0, leading: float = 11.7) -> None:
    """A PDF of laid-out lines (line, marked_chars), the last step of a book; needs reportlab on the driver."""
    from reportlab.pdfgen import canvas

    book, y = canvas.Canvas(path), height - margin
    for line in lines:
        if y - leading < margin:
            book.showPage()
            y = height - margin
        y -= leading
        book.setFont("Helvetica-Bold" if line["marked_chars"] else "Helvetica", 9.4)
        book.drawString(54, y, line["line"])
    book.save()
