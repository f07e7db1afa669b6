"""All queries of the library by name, and the SQL that each is held against."""

from __future__ import annotations

import functools
import io
import os
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import queries_present, queries_rank, queries_runs, queries_text, queries_windows  # noqa: F401  they list themselves
from lectern.plans.catalog import ORACLE_SQL, QUERIES  # noqa: F401
from lectern.plans.shared import shared_path

Query = Callable[[SparkSession, str], DataFrame]

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless the path that the driver's JVM hands them has it: once per application."""
    app = spark.sparkContext.applicationId
    known = spark._jvm.java.lang.System.getenv("PYTHONPATH") or ""
    if app in _shipped or str(ROOT) in known.split(os.pathsep):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted([*ROOT.glob("lectern/**/*.py"), *ROOT.glob("corpus_pipeline.py")]):
            z.write(p, p.relative_to(ROOT))
    path = f"{shared_path(spark, 'code')}.zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shipped(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
