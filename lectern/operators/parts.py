"""Python kernels over rows with texts: Arrow batches are worked on in parts of bounded bytes.

A batch holds up to 10,000 rows, as many as there are in small tables; as Python strings, with what a kernel makes of them, it takes
several times its bytes. Of a part only that much is held at once, and freed memory is given back after each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from lectern.llm.words import release
from lectern.plans.shared import spread

#: Most bytes of a part; a row that is longer is a part by itself.
PART_BYTES = 2 << 20


def row_bytes(batch) -> np.ndarray:
    """Bytes of the strings of each row, and a few for the rest."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = lambda t: pa.types.is_string(t) or pa.types.is_large_string(t) or pa.types.is_binary(t) or pa.types.is_large_binary(t)
    lengths = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns if text(c.type)]
    return sum(lengths, np.full(batch.num_rows, 16, np.int64))


def parts(batches, size: int = PART_BYTES) -> Iterator:
    """Arrow batches cut into parts of at most ``size`` bytes, wherever the long rows stand."""
    for batch in batches:
        ends, at = row_bytes(batch).cumsum(), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end
        release()


def by_row(df: DataFrame, each: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows (tuples as in ``schema``) that ``each`` gives for the values of every row of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for part in parts(batches):
            out = [x for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for x in each(*row)]
            columns = zip(*out, strict=True) if out else [()] * len(kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return spread(df).mapInArrow(run, schema)
