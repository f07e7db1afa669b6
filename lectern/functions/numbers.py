"""Integer arithmetic. Arguments are SQL expressions, so that they stay BIGINT throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_div(n: str, d: str) -> Column:
    """n / d to the nearest integer, halves away from zero; ``d`` is positive."""
    return F.expr(f"cast(sign({n}) as bigint) * ((abs({n}) + {d} div 2) div {d})")


def parts_needed(tokens: str, single: int = 6000, part: int = 5000) -> Column:
    """Parts a text is worked on in: one below ``single`` tokens, else as many as ``part`` tokens go into it, rounded up."""
    return F.expr(f"if({tokens} < {single}, 1, ({tokens} + {part - 1}) div {part})").cast("long")


def tokens_per_second(tokens: str, nanoseconds: str) -> Column:
    return F.expr(f"if({nanoseconds} > 0, {tokens} * 1e9 / {nanoseconds}, null)").cast("double")


def backoff_seconds(attempt: str, most: int = 8) -> Column:
    return F.expr(f"least(pow(2, {attempt} - 1), {most})").cast("double")
