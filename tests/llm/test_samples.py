"""Low hashes: all of a small table, few of a large one whatever its partitions, and the lowest."""

from pyspark.sql import functions as F

from lectern.llm.samples import SPARE, low


def test_low_hashes(spark):
    rows = spark.range(0, 200_000, numPartitions=40).select("id", F.xxhash64("id").alias("h"))
    found = [r["h"] for r in rows.filter(low(F.col("h"), 100, 200_000)).orderBy("h").collect()]
    assert 100 <= len(found) <= 2 * SPARE * 100
    assert found == [r["h"] for r in rows.orderBy("h").limit(len(found)).collect()]
    assert rows.limit(150).filter(low(F.col("h"), 100, 150)).count() == 150
    assert rows.filter("id < 0").filter(low(F.col("h"), 100, 0)).count() == 0
