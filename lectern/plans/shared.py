"""Tables that outlive executors: written to the folder the cluster shares, then reread."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a folder of our own only where that is unset and there is one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lectern-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder.

    A lost executor then costs the rereading of a file split, not the recomputation of the plan above it,
    and a table that several later stages use is computed once.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ranges_for(spark: SparkSession, amount: int, each: int) -> int:
    """Tasks for a step that sorts or writes ``amount`` rows or bytes: those of a shuffle, or more if a task would get over ``each``."""
    return max(shuffle_partitions(spark), min(-(-amount // each), 1 << 17))


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is, unless it is read by fewer tasks than there are cores: then its rows are dealt over all of them.

    For steps that cost far more per row than a shuffle. A large input is split finely by the scan already and is left alone.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
