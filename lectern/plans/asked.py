"""Steps behind a chat service as functions of tables: splitting, pair judging, cleaning and highlighting.

Each takes a table and a callable of ``lectern.chat`` (or any with its signature) and asks it once for each row, in Arrow batches. What a step
has answered is written before it is used, so that no row is asked twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.rank import PairJudge as Judge
from lectern.plans.shared import materialize

#: What a pair judge may read of an item.
SEEN = ("filename", "summary", "evidence", "text")


def pair_judge(items: DataFrame, decide: Callable[[dict, dict], tuple[str, str]]) -> Judge:
    """A judge of games (left, right) from one of two items (``item`` and any of ``SEEN``): adds winner and rationale.

    Games are dealt by their left item, whose text so opens the prompts of neighbours. An item that is not known, and a judge
    that gives no winner, are errors.
    """
    seen = [c for c in SEEN if c in items.columns]

    def play(games: DataFrame) -> DataFrame:
        # Written: the columns of both items are moved to the games, and an item may play very often.
        left = items.select(F.col("item").alias("left"), F.struct(*seen).alias("_l"))
        right = items.select(F.col("item").alias("right"), F.struct(*seen).alias("_r"))
        both = games.join(left, "left", "left").join(right, "right", "left").repartition("left").sortWithinPartitions("left", "right")

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    answers = []
                    for a, b in zip(part.column("_l").to_pylist(), part.column("_r").to_pylist(), strict=True):
                        if a is None or b is None:
                            raise KeyError("a game has an item that is not there")
                        answers.append(decide(a, b))
                    keep = [n for n in part.schema.names if n not in ("_l", "_r")]
                    columns = [*[part.column(n) for n in keep], pa.array([w for w, _ in answers], pa.string()), pa.array([r for _, r in answers], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, "winner", "rationale"])

        kinds = dict(both.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in both.columns if c not in ("_l", "_r"))
        return materialize(both.mapInArrow(run, f"{schema}, winner string, rationale string"), "games")

    return play


def mapped(rows: DataFrame, out: str, ask: Callable[..., str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``out``: the answer of ``ask`` to the values of ``columns``, one call for each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                answers = [ask(*values) for values in zip(*(part.column(c).to_pylist() for c in columns), strict=True)]
                keep = [n for n in part.schema.names if n != out]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], pa.array(answers, pa.string())], names=[*keep, out])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rows.columns if c != out), f"`{out}` string"])
    return materialize(rows.mapInArrow(run, schema), "answers")


def cleaned(parts: DataFrame, cleaner: Callable[[str], str], text: str = "text", out: str = "cleaned") -> DataFrame:
    """``parts`` with ``out``: their texts as prose."""
    return mapped(parts, out, cleaner, [text])


def highlighted(books: DataFrame, highlighter: Callable[[str, Sequence[str]], str], text: str = "text", evidences: str = "evidences", out: str = "highlighted") -> DataFrame:
    """``books`` with ``out``: their texts with tags around what serves the intent; ``evidences``: array<string>."""
    return mapped(books, out, highlighter, [text, evidences])
