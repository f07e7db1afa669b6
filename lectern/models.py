"""Model-backed steps as interfaces, each with a deterministic offline form.

Every interface takes and gives columns of a batch, so that one call of a worker serves many rows. Retries and what happens
when they are used up are a wrapper's business: a judge that never answers counts as yes, a pair judge that never answers
stops the run, a cleaner gives back its input.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LecternError(RuntimeError):
    """An error with the place it happened at: phase, file, group and so on."""

    def __init__(self, message: str, **context: object):
        super().__init__(message + "".join(f" [{k}={v}]" for k, v in context.items()))
        self.context = context


# --- lexical forms, as columns: they are part of the plan and cost no Python ---


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[a-z0-9_]+", query.lower())))


def hits(text: Column, query: str) -> Column:
    """The words of a text that are terms of the query, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"))
    return F.filter(words, lambda w: w.isin(terms_of(query)))


def lexical_judgement(text: Column, query: str, least: int = 1) -> Column:
    """struct<is_relevant, summary, evidence>: relevant from ``least`` hits on; the evidence is the terms hit, in order."""
    found = hits(text, query)
    return F.struct(
        (F.size(found) >= least).alias("is_relevant"),
        F.concat(F.size(found).cast("string"), F.lit(" hits")).alias("summary"),
        F.array_join(F.array_distinct(found), " ").alias("evidence"),
    )


def lexical_winner(left_score: Column, left_id: Column, right_score: Column, right_id: Column) -> Column:
    """'left' or 'right': the higher score, then the lower id; a strict total order."""
    return F.when((left_score > right_score) | ((left_score == right_score) & (left_id < right_id)), "left").otherwise("right")


def highlighted(text: Column, query: str) -> Column:
    """The text with every term of the query between highlight tags."""
    terms = "|".join(sorted(terms_of(query), key=len, reverse=True))
    return F.regexp_replace(text, f"(?i)(?<![A-Za-z0-9_])({terms})(?![A-Za-z0-9_])", "<mark-yellow>$1</mark-yellow>") if terms else text


# --- models behind a chat service ---


class Judge(Protocol):
    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows with the inputs of the prompt -> is_relevant, summary, evidence."""


@dataclass(frozen=True)
class ModelOptions:
    """What a service is asked for by default; -1 predicts without a limit."""

    context: int = 32_768
    predict: int = 4_096
    temperature: float | None = None
    top_p: float | None = None
    top_k: int | None = None
    thinking: str = "toggle"  # toggle, always, never, high


#: Sampling options of known models, by whether they think.
MODELS: dict[str, dict[bool, ModelOptions]] = {
    "qwen3:32b": {True: ModelOptions(32768, 28672, 0.6, 0.95, 20), False: ModelOptions(32768, 28672, 0.7, 0.8, 20)},
    "qwen3:30b-a3b-thinking-2507": {True: ModelOptions(140000, 81920, 0.6, 0.95, 20, "always")},
    "qwen3:30b-a3b-instruct-2507": {False: ModelOptions(140000, 81920, 0.7, 0.8, 20, "never")},
    "glm-4-32b": {False: ModelOptions(32768, 28672, thinking="never")},
    "gemma3:27b": {False: ModelOptions(32768, 8192, thinking="never")},
    "qwen3-vl:32b-instruct": {False: ModelOptions(39000, 34904, 1.0, 1.0, 40, "never")},
    "qwen3-vl:32b-thinking": {True: ModelOptions(39000, 34904, 1.0, 0.95, 20, "always")},
    "seed-oss-36b": {True: ModelOptions(16000, 11264, 1.1, 0.95), False: ModelOptions(16000, 11264, 0.3, 0.95)},
    "gpt-oss:20b": {True: ModelOptions(131072, -1, 1.0, 1.0, 0, "high")},
}


@dataclass(frozen=True)
class ChatClient:
    """One request to a chat service; made anew in each Python worker from this frozen description."""

    host: str
    model: str
    timeout: float = 900.0
    think: bool = True
    extra: dict = field(default_factory=dict)

    def options(self) -> ModelOptions:
        known = MODELS.get(self.model.lower())
        if known is None:
            raise LecternError("unknown model", model=self.model)
        return known.get(self.think) or next(iter(known.values()))

    def payload(self, messages: list[dict], most_tokens: int | None = None, as_json: bool = False) -> dict:
        o = self.options()
        thinks = o.thinking == "always" or o.thinking == "high" or (o.thinking == "toggle" and self.think)
        named = {"num_ctx": o.context, "num_predict": o.predict, "temperature": o.temperature, "top_p": o.top_p, "top_k": o.top_k}
        if most_tokens and not thinks:
            named["num_predict"] = most_tokens
        body = {"model": self.model, "messages": [dict(m) for m in messages], "stream": False, "options": {k: v for k, v in named.items() if v is not None} | self.extra}
        if o.thinking == "high":
            body["think"] = "high"
        elif o.thinking == "toggle":
            body["think"] = self.think
        if as_json and not thinks:
            body["format"] = "json"
        return body

    def __call__(self, messages: list[dict], most_tokens: int | None = None, as_json: bool = False) -> dict:
        data = json.dumps(self.payload(messages, most_tokens, as_json), ensure_ascii=False).encode()
        request = urllib.request.Request(f"{self.host.rstrip('/')}/api/chat", data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
            return json.load(answer)


def content_of(answer: dict) -> str:
    """The text of an answer; one that ran out of tokens is refused."""
    if answer.get("done_reason") == "length":
        raise LecternError("ran out of tokens")
    return answer.get("message", {}).get("content", "")


@dataclass(frozen=True)
class ChatJudge:
    """Asks a chat service whether a section serves an intent. The shared part of the prompt comes first, for prefix caches."""

    client: ChatClient
    query: str
    about: str = ""

    def messages(self, row: dict) -> list[dict]:
        text = (
            f"Background of the corpus: {self.about}\nWhat is looked for: {self.query}\n\nSurrounding text:\n{row.get('context', '')}\n\n"
            f"Section to judge ({row.get('filename', '')}):\n{row['text']}\n\n"
            'Answer with one JSON object {"summary": ..., "evidence": ..., "is_relevant": true or false}; the summary in about seven sentences, the evidence in about five.'
        )
        return [{"role": "user", "content": text}]

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([self.one(r) for r in rows.to_dict("records")])

    def one(self, row: dict) -> dict:
        text = content_of(self.client(self.messages(row), 2048, as_json=True))
        found = json.loads(text[text.index("{") : text.rindex("}") + 1])
        return {"is_relevant": bool(found["is_relevant"]), "summary": str(found.get("summary", "")), "evidence": str(found.get("evidence", ""))}


def retried(call: Callable[[pd.DataFrame], pd.DataFrame], rows: pd.DataFrame, tries: int, otherwise: Callable[[dict, Exception], dict] | None, wait: Callable[[int], float] | None = None) -> pd.DataFrame:
    """``call`` on each row, up to ``tries`` times; then ``otherwise``, or the last error if there is none. Adds ``fallback``."""
    out = []
    for row in rows.to_dict("records"):
        for attempt in range(1, tries + 1):
            try:
                out.append(call(pd.DataFrame([row])).to_dict("records")[0] | {"fallback": False})
                break
            except Exception as error:  # noqa: BLE001  any failure of a model counts as one try
                if attempt == tries:
                    if otherwise is None:
                        raise LecternError("no answer", tries=tries) from error
                    out.append(otherwise(row, error) | {"fallback": True})
                elif wait:
                    time.sleep(wait(attempt))
    return pd.DataFrame(out)


def fail_open(row: dict, error: Exception) -> dict:
    """A section that can't be judged stays in: the next pass may drop it."""
    return {"is_relevant": True, "summary": "", "evidence": f"not judged: {error}"}


def judged(chunks: DataFrame, judge: Judge, keep: Sequence[str] = ("corpus", "i"), tries: int = 5) -> DataFrame:
    """The ``keep`` columns with is_relevant, summary, evidence, fallback; the judge sees all columns of ``chunks``."""
    kinds = dict(chunks.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", is_relevant boolean, summary string, evidence string, fallback boolean"

    def run(batches):
        for rows in batches:
            if len(rows):
                answers = retried(judge, rows, tries, fail_open)
                yield pd.concat([rows[list(keep)].reset_index(drop=True), answers[["is_relevant", "summary", "evidence", "fallback"]]], axis=1)

    return chunks.mapInPandas(run, schema)
