"""Global order without a single task: ranges, row numbers and prefix sums in two levels.

A window without a partition key sorts the whole input in one task. Here rows are first put into buckets whose
order is known (value ranges or leading digits of a hash), each bucket is numbered or summed by itself, and the
offsets of the buckets come from a second, small table with one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.shared import ranges_for, shuffle_partitions

#: Leading hexadecimal digits of a hash that name its bucket: 4,096 buckets per group.
HASH_DIGITS = 3
#: A balanced tree of comparisons stays within one generated method up to about this many ranges; more take two levels.
MAX_RANGES = 1024
#: Rows of a range, which a task sorts, if shuffles have no more partitions than that takes.
RANGE_ROWS = 1 << 22
#: Keys that are sampled for each range.
KEYS_PER_RANGE = 40


def range_bounds(df: DataFrame, keys: list[Column], n: int, count: int | None = None, seed: int = 7) -> list[tuple]:
    """At most ``n - 1`` increasing values of ``keys`` (numbers) that cut the ``count`` rows of ``df`` into ranges of similar counts.

    The bounds come from a sample of ``KEYS_PER_RANGE`` rows a range, which is all that the driver sees; every row has a range.
    """
    if n < 2:
        return []
    return _cut(_sampled(df, keys, n, df.count() if count is None else count, seed), n)


def bounds_by_size(df: DataFrame, keys: list[Column], size: Column, each: int, seed: int = 7) -> list[tuple]:
    """As ``range_bounds``, with as many ranges as shuffles have partitions, or more if one would hold over ``each`` of the sum of ``size``.

    The sum is estimated from the sample, so that no pass is made for it.
    """
    n, count = shuffle_partitions(df.sparkSession), df.count()
    found = _sampled(df, [*keys, size], n, count, seed)
    whole = sum(r[-1] for r in found) * count // max(1, len(found))
    if (wanted := ranges_for(df.sparkSession, whole, each)) > n:
        n, found = wanted, _sampled(df, [*keys, size], wanted, count, seed)
    return _cut([r[:-1] for r in found], n)


def _sampled(df: DataFrame, columns: list[Column], n: int, count: int, seed: int) -> list[tuple]:
    share = KEYS_PER_RANGE * n / max(1, count)
    some = df.filter(F.rand(seed) < share) if share < 1 else df
    return [tuple(r) for r in some.select(*[c.alias(f"k{i}") for i, c in enumerate(columns)]).collect()]


def _cut(keys: list[tuple], n: int) -> list[tuple]:
    keys = sorted(keys, key=lambda r: [(x is not None, x) for x in r])
    return list(dict.fromkeys(keys[i * len(keys) // n] for i in range(1, n) if keys))


def byte_keys(data: Column) -> list[Column]:
    """Two numbers in the order of the first fourteen bytes of binary ``data``."""
    part = lambda at: F.conv(F.rpad(F.hex(F.substring(data, at, 7)), 14, "0"), 16, 10).cast("long")
    return [part(1), part(8)]


def _literal(bound: tuple) -> Column:
    return F.struct(*[F.lit(x).cast("long").alias(f"k{i}") for i, x in enumerate(bound)])


def with_range(df: DataFrame, keys: list[Column], bounds: list[tuple], out: str) -> DataFrame:
    """Add ``out``: the 0-based number of the range that holds the ``keys`` (longs), that is how many bounds are not above them; null is least."""
    key = F.struct(*[k.cast("long").alias(f"k{i}") for i, k in enumerate(keys)])
    step = -(-(len(bounds) + 1) // MAX_RANGES)
    coarse = bounds[step - 1 :: step]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= _literal(coarse[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    if step == 1:
        return df.withColumn(out, tree(0, len(coarse)).cast("int"))
    # The bounds between two coarse ones are looked up: a table of as many rows as there are coarse ranges.
    parts = [(i, [dict(zip([f"k{j}" for j in range(len(keys))], b, strict=True)) for b in bounds[i * step : (i + 1) * step - 1]]) for i in range(len(coarse) + 1)]
    kind = ",".join(f"k{i}:bigint" for i in range(len(keys)))
    fine = df.sparkSession.createDataFrame(parts, f"__coarse int, __fine array<struct<{kind}>>")
    found = df.withColumn("__coarse", tree(0, len(coarse)).cast("int")).join(F.broadcast(fine), "__coarse")
    return found.withColumn(out, (F.col("__coarse") * step + F.size(F.filter("__fine", lambda b: b <= key))).cast("int")).drop("__coarse", "__fine")


def ranged(df: DataFrame, keys: list[str], out: str = "_range") -> DataFrame:
    """Add ``out``, a bucket for ``prefix_sums``: the range of the integer ``keys`` that the row is in, whatever their values."""
    columns = [F.col(k).cast("long") for k in keys]
    narrow = df.select(*columns).toDF(*keys)
    count = narrow.count()
    return with_range(df, columns, range_bounds(narrow, columns, ranges_for(df.sparkSession, count, RANGE_ROWS), count), out)


def prefix_sums(df: DataFrame, bucket: str, order: list, value: Column, group: list[str] | None = None, out: str = "before") -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows of the same group that come earlier.

    ``bucket`` must be a column that never decreases along the order, with few values for the rows that there are, as ``ranged``
    gives. Only the table of bucket sums (one row per group and bucket) is ordered as a whole; the rows themselves are sorted
    within (group, bucket).
    """
    group = group or []
    rows = df.withColumn("__v", value)
    sums = rows.groupBy(*group, bucket).agg(F.sum("__v").alias("__s"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    earlier = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"__g_{g}") for g in group], F.col(bucket).alias("__b"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__off")
    )
    local = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col(bucket).eqNullSafe(F.col("__b"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return (
        rows.withColumn("__in", F.coalesce(F.sum("__v").over(local), F.lit(0)))
        .join(offsets, on)
        .withColumn(out, F.col("__in") + F.col("__off"))
        .drop("__v", "__in", "__off", "__b", *[f"__g_{g}" for g in group])
    )
