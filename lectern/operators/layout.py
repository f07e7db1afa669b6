"""Wrapping of lines and measuring of pages, in Arrow batches; the width of a text is a parameter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.parts import by_row

Width = Callable[[str], float]


@dataclass(frozen=True)
class Page:
    """Fixed values, in points: an A4 page with its margins and fonts."""

    height: float = 841.89
    width: float = 595.28
    left: float = 54.0
    right: float = 54.0
    top: float = 60.0
    bottom: float = 60.0
    body: float = 9.4
    mono: float = 8.8
    leading: float = 1.24
    paragraph: float = 6.0

    @property
    def usable(self) -> float:
        return self.width - self.left - self.right


def fixed_width(size: float, share: float = 0.6) -> Width:
    """All characters as wide as a share of the font size."""
    return lambda text: len(text) * size * share


def _fitting(text: str, most: float, width: Width) -> int:
    """Longest prefix of a text that fits, but one character at least."""
    lo, hi = 1, len(text)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if width(text[:mid]) <= most else (lo, mid - 1)
    return lo


def wrap(text: str, most: float, width: Width) -> Iterator[str]:
    """Lines of one paragraph: words and the blanks between them as long as they fit, over-long words broken."""
    line = ""
    for token in re.findall(r"\s+|\S+", text):
        if width(line + token) <= most:
            line += token
            continue
        if line:
            yield line
        while token and width(token) > most:
            at = _fitting(token, most, width)
            yield token[:at]
            token = token[at:]
        line = token
    if line:
        yield line


def wrap_body(runs: list[tuple[str, bool]], most: float, width: Width) -> list[list[tuple[str, bool]]]:
    """Lines of (segment, marked) pieces; a line feed ends the line and adds an empty one."""
    lines: list[list[tuple[str, bool]]] = [[]]
    used = 0.0
    for text, marked in runs:
        for token in re.findall(r"\n|[^\S\n]+|\S+", text):
            if token == "\n":
                lines += [[], []]
                used = 0.0
                continue
            while token:
                w = width(token)
                if used + w <= most:
                    lines[-1].append((token, marked))
                    used, token = used + w, ""
                elif lines[-1]:
                    lines.append([])
                    used = 0.0
                else:
                    at = _fitting(token, most, width)
                    lines[-1].append((token[:at], marked))
                    lines.append([])
                    token = token[at:]
    return lines


def runs_of(text: str) -> list[tuple[str, bool]]:
    return [(x, i % 2 == 1) for i, x in enumerate(re.split("</?mark-yellow>", text)) if x]


#: Tokens of a run's paragraph, and the places between them.
_token = re.compile(r"[^\S\n]+|\S+")
_BETWEEN = r"(?:\Z|(?<=\S)(?=\s)|(?<=\s)(?=\S))"


def body_lines(runs: list[tuple[str, bool]], most: float, size: float, share: float = 0.6) -> tuple[list[str], list[int]]:
    """Text and marked characters of the lines of ``wrap_body`` where ``fixed_width`` holds, a line at a time and not a token.

    A line is the longest stretch that ends between two tokens, or as many characters of an over-long token as fit. Where so many
    characters are just as wide as the line that sums of widths may round either way, the sums decide.
    """
    fit = int(most / (size * share))
    if fit < 1 or not 1e-6 < most / (size * share) - fit < 1 - 1e-6:
        found = wrap_body(runs, most, fixed_width(size, share))
        return ["".join(x for x, _ in line) for line in found], [sum(len(x) for x, m in line if m) for line in found]
    whole = re.compile(rf"(?s:.{{1,{fit}}}){_BETWEEN}|(?s:.{{{fit}}})")
    lines, marks = [""], [0]
    for text, marked in runs:
        for k, paragraph in enumerate(text.split("\n")):
            if k:
                lines += ["", ""]
                marks += [0, 0]
            at = 0
            if lines[-1]:  # the line that the run before has begun
                for m in _token.finditer(paragraph):
                    if len(lines[-1]) + m.end() > fit:
                        break
                    at = m.end()
                lines[-1] += paragraph[:at]
                marks[-1] += at * marked
                if at == len(paragraph):
                    continue
                lines.append("")
                marks.append(0)
            found = whole.findall(paragraph, at)
            if found:
                lines[-1:] = found
                marks[-1:] = [len(x) for x in found] if marked else [0] * len(found)
    return lines, marks


def pages_of(json_text: str, text: str, page: Page = Page()) -> int:
    """Content pages of a group: a title line, its rows in the mono font and its body."""
    mono = sum(max(1, len(list(wrap(x, page.usable, fixed_width(page.mono))))) for x in json_text.split("\n"))
    body = len(body_lines(runs_of(text), page.usable, page.body)[0])
    pages, y = 1, page.height - page.top
    for lines, leading in ((1, page.body * page.leading), (mono, page.mono * page.leading), (body, page.body * page.leading)):
        for _ in range(lines):
            if y - leading < page.bottom:
                pages, y = pages + 1, page.height - page.top
            y -= leading
        y -= page.paragraph
    return pages


def wrapped_lines(texts: DataFrame, page: Page = Page()) -> DataFrame:
    """doc_id, line_no, line, marked_chars of every line of the bodies of ``texts`` (doc_id, text)."""

    def each(doc_id, text):
        lines, marks = body_lines(runs_of(text or ""), page.usable, page.body)
        return zip(repeat(doc_id), range(len(lines)), lines, marks)

    return by_row(texts.select("doc_id", "text"), each, "doc_id long, line_no int, line string, marked_chars int")


def measured(groups: DataFrame, page: Page = Page()) -> DataFrame:
    """doc_id, pages of ``groups`` (doc_id, json, text)."""

    def each(doc_id, json, text):
        yield doc_id, pages_of(json or "", text or "", page)

    return by_row(groups.select(F.col("doc_id").cast("long").alias("doc_id"), "json", "text"), each, "doc_id long, pages int")
