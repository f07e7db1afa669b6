"""From folders of PDF files to Markdown: what is to be converted, page by page, resumably."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.models import LecternError
from lectern.operators.runs import latest
from lectern.sources.books import joined_pages
from lectern.sources.files import manifest, visible_pdfs


def planned(base: str, stored: dict | None) -> dict:
    """The manifest of a folder; a stored one must be equal, or the run is refused."""
    found = manifest(visible_pdfs(base), base)
    if stored is not None and stored["pdfs_sha256"] != found["pdfs_sha256"]:
        had, has = set(stored["pdfs"]), set(found["pdfs"])
        raise LecternError("the folder has changed", missing=sorted(had - has)[:20], added=sorted(has - had)[:20])
    return found


def to_convert(pdfs: DataFrame, log: DataFrame) -> DataFrame:
    """The files (pdf) whose last status is not success; log: pdf, status, line_no."""
    done = latest(log, "pdf").filter("status = 'success'")
    return pdfs.join(done, "pdf", "left_anti")


def transcribed(pages: DataFrame, transcribe: Callable[[str, int], tuple[str, int]], done: DataFrame | None = None) -> DataFrame:
    """document, page_index, md, md_sha256, attempts of the pages (document, page_index, png) that are not done yet."""
    if done is not None:
        pages = pages.join(done, ["document", "page_index"], "left_anti")

    def run(batches):
        import base64
        import hashlib

        import pandas as pd

        for rows in batches:
            out = [(d, i, *transcribe(base64.b64encode(png).decode(), i + 1)) for d, i, png in zip(rows["document"], rows["page_index"], rows["png"], strict=True)]
            yield pd.DataFrame([(d, i, md, hashlib.sha256(md.encode()).hexdigest(), n) for d, i, md, n in out], columns=["document", "page_index", "md", "md_sha256", "attempts"])

    return pages.select("document", "page_index", "png").mapInPandas(run, "document string, page_index int, md string, md_sha256 string, attempts int")


def documents(pages: DataFrame) -> DataFrame:
    """document, markdown of whole documents, blank pages left out of the text."""
    return joined_pages(pages.withColumn("md", F.when(F.col("md") == "<!-- PAGE BLANK -->", "").otherwise(F.col("md"))))


def read_pdfs(spark: SparkSession, base: str) -> DataFrame:
    """path, content of the visible files below a folder."""
    paths = visible_pdfs(base)
    return spark.read.format("binaryFile").load([f"{base}/{p}" for p in paths]).select("path", "content")
