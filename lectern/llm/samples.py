"""Bounded samples by hash, of which no task or driver holds more than a small multiple, however many partitions a table has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hashes expected below the bound for each that is wanted, so that too few are as good as never there.
SPARE = 2


def low(hashed: Column, wanted: int, distinct: int) -> Column:
    """Whether a hash of 64 bits is among the lowest, of which ``SPARE * wanted`` are expected if there are ``distinct`` of them.

    With as few hashes as that, or fewer, all are. A limit behind this filter gets few rows from all partitions together; without
    it, each partition gives the limit as many rows as are wanted.
    """
    if distinct <= SPARE * wanted:
        return F.lit(True)
    return hashed < F.lit(-(2**63) + SPARE * wanted * 2**64 // distinct)
