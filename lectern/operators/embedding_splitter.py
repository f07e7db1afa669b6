"""Splitting by embeddings: windows, boundary strengths on a grid, cuts by dynamic programming, nudging.

All of one document happens in one worker, in vectors: the averages of cosines that all boundaries need come from running sums
of the windows' vectors, so that memory grows with the document's length and not with its square.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.parts import by_row
from lectern.operators.splitter import _token


@dataclass(frozen=True)
class Settings:
    """Window lengths and strides in tokens, neighbours on each side, and the chooser's limits."""

    coarse: tuple[int, int] = (384, 128)
    fine: tuple[int, int] = (176, 64)
    grid: int = 16
    coarse_sides: int = 5
    fine_sides: int = 4
    delta: float = 1e-6
    most: int = 1024
    least: int = 320
    target: int = 900
    penalty: float = 0.002
    nudge: int = 32
    #: Cross pairs join the farthest on the left with the nearest on the right, by rank; or else nearest with nearest.
    nearest_pairs: bool = False


def window_starts(length: int, size: int, stride: int) -> np.ndarray:
    """start, end, center of the windows over ``length`` tokens; the last ones may be short."""
    start = np.arange(0, length, stride)
    end = np.minimum(start + size, length)
    return np.stack([start, end, (start + end) // 2], 1)


class _Blocks:
    """Sums of blocks of the matrix of cosines of unit vectors, many at once: products of running sums, the matrix is never made."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.upto = np.concatenate((np.zeros((1, vectors.shape[1])), vectors.cumsum(0)))
        self.own = np.concatenate(([0.0], np.cumsum((vectors * vectors).sum(1))))
        self.steps = np.concatenate(([0.0], np.cumsum((vectors[:-1] * vectors[1:]).sum(1))))

    def sum(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Rows a to b, columns c to d."""
        return ((self.upto[b] - self.upto[a]) * (self.upto[d] - self.upto[c])).sum(1)

    def mean_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mean cosine of the pairs within a to b; 1 if there is no pair."""
        n = b - a
        return np.where(n < 2, 1.0, (self.sum(a, b, a, b) - self.own[b] + self.own[a]) / np.maximum(n * (n - 1), 1))

    def mean_steps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mean cosine of neighbours within a to b; 1 if there are none."""
        steps = self.steps
        n, a = b - a - 1, np.minimum(a, len(steps) - 1)
        return np.where(n < 1, 1.0, (steps[a + np.maximum(n, 0)] - steps[a]) / np.maximum(n, 1))

    def mean_across(self, at: np.ndarray, m: np.ndarray, nearest: bool) -> np.ndarray:
        """Mean cosine of m pairs across ``at``: by rank, or nearest with nearest."""
        out = np.zeros(len(at))
        for i in range(int(m.max(initial=0))):
            use = i < m
            left = at[use] - 1 - i if nearest else at[use] - m[use] + i
            out[use] += (self.vectors[left] * self.vectors[at[use] + i]).sum(1)
        return out / np.maximum(m, 1)


def boundary_scores(length: int, coarse: np.ndarray, fine: np.ndarray, s: Settings = Settings()) -> dict[int, float]:
    """Strength of a boundary at each grid point, from unit vectors of the coarse and the fine windows."""
    grid = np.arange(s.grid, length + 1, s.grid)
    c, f = (np.searchsorted(window_starts(length, *w)[:, 2], grid) for w in (s.coarse, s.fine))
    c0, c1 = np.maximum(0, c - s.coarse_sides), np.minimum(len(coarse), c + s.coarse_sides)
    f0, f1 = np.maximum(0, f - s.fine_sides), np.minimum(len(fine), f + s.fine_sides)
    m = np.minimum(f - f0, f1 - f)
    whole, close = _Blocks(coarse), _Blocks(fine)
    across = whole.sum(c0, c, c, c1) / np.maximum((c - c0) * (c1 - c), 1)
    novelty = np.maximum(0.0, (whole.mean_pairs(c0, c) + whole.mean_pairs(c, c1)) / 2 - across)
    strength = novelty * close.mean_steps(f0, f) * close.mean_steps(f, f1) / (close.mean_across(f, m, s.nearest_pairs) + s.delta)
    strength = np.where((c == c0) | (c == c1) | (m == 0), 0.0, strength)
    return dict(zip(grid.tolist(), strength.tolist(), strict=True))


def choose_cuts(length: int, strength: dict[int, float], s: Settings = Settings()) -> list[int]:
    """Grid points, 0 and the length included, of greatest total strength less the penalty for lengths off the target."""
    grid = np.array([*range(0, length, s.grid), length])
    gain = np.array([strength.get(int(t), 0.0) for t in grid])
    best, back = np.full(len(grid), -np.inf), np.full(len(grid), -1)
    best[0] = 0.0
    for i in range(1, len(grid)):
        lo, hi = np.searchsorted(grid, grid[i] - s.most), np.searchsorted(grid, grid[i] - s.least, side="right")
        if lo < hi:
            span = grid[i] - grid[lo:hi]
            # The nearest of equal predecessors wins.
            value = (best[lo:hi] + gain[i] - s.penalty * np.abs(span - s.target))[::-1]
            k = int(value.argmax())
            if value[k] > -np.inf:
                best[i], back[i] = value[k], hi - 1 - k
    out, i = [length], int(back[-1])
    while i > 0:
        out.append(int(grid[i]))
        i = int(back[i])
    return sorted({0, *out})


def nudged(cuts: list[int], length: int, strength: dict[int, float], s: Settings = Settings()) -> list[int]:
    """Inner cuts moved to the strongest grid point nearby, and a short tail joined to what is before it if that fits."""
    new = list(cuts)
    for i in range(1, len(new) - 1):
        lo, hi = (max(0, new[i] - s.nudge) // s.grid * s.grid, min(length, new[i] + s.nudge) // s.grid * s.grid)
        allowed = [t for t in range(lo, hi + 1, s.grid) if 0 < t - new[i - 1] <= s.most and 0 < new[i + 1] - t <= s.most]
        top = max(allowed, key=lambda t: (strength.get(t, 0.0), -t), default=new[i])
        if strength.get(top, 0.0) > strength.get(new[i], 0.0):
            new[i] = top
    if len(new) >= 3 and new[-1] - new[-2] < s.least and new[-1] - new[-3] <= s.most:
        del new[-2]
    return new


def hashed_vectors(tokens: list[str], windows: np.ndarray, size: int = 64) -> np.ndarray:
    """The default embedding of windows of tokens: signed counts of hashed tokens, of unit length."""
    h = np.fromiter((zlib.crc32(t.encode()) for t in tokens), np.int64, len(tokens))
    # Windows begin and end at multiples of a unit of tokens, but for the end of the text, where the last unit is short.
    unit = int(np.gcd.reduce([len(tokens) if len(windows) < 2 else int(windows[1, 0]), *np.unique(windows[:, 0]).tolist(), *np.unique(windows[windows[:, 1] < len(tokens), 1]).tolist()])) or 1
    units = -(-len(tokens) // unit)
    counts = np.bincount(np.arange(len(tokens)) // unit * size + h % size, np.where(h & 0x80000000, 1.0, -1.0), units * size).reshape(units, size)
    counts = np.concatenate((np.zeros((1, size)), counts.cumsum(0)))
    out = counts[-(-windows[:, 1] // unit)] - counts[windows[:, 0] // unit]
    norm = np.sqrt((out * out).sum(1))
    return np.where(norm[:, None] > 0, out / np.maximum(norm, 1e-9)[:, None], size**-0.5)


def _scored(text: str | None, s: Settings) -> tuple[int, dict[int, float]]:
    """Tokens of a text, and the strengths of its grid points."""
    tokens = [t.lower() for t in _token.findall(text or "")]
    if not tokens:
        return 0, {}
    return len(tokens), boundary_scores(len(tokens), *[hashed_vectors(tokens, window_starts(len(tokens), *w)) for w in (s.coarse, s.fine)], s)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def split_by_embedding(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, cuts (token places), strengths of ``docs`` (doc_id, text), by the default embedding."""

    def each(doc_id, text):
        n, strength = _scored(text, s)
        at = nudged(choose_cuts(n, strength, s), n, strength, s) if n else [0]
        yield doc_id, n, at, [round(strength.get(t, 0.0), 9) for t in at]

    return by_row(_rows(docs), each, "doc_id long, n_tokens long, cuts array<int>, strengths array<double>")


def char_spans(text: str, cuts: list[int], overlap: int = 0) -> list[tuple[int, int]]:
    """Chunks as characters: each begins with the first token after its cut, ``overlap`` tokens earlier but for the first one.

    What stands between two tokens belongs to the earlier chunk, so chunks without overlap join to the text.
    """
    starts = [m.start() for m in _token.finditer(text)]
    begin = lambda t: 0 if t <= 0 else len(text) if t >= len(starts) else starts[t]
    return [(begin(a - overlap if i else 0), begin(b)) for i, (a, b) in enumerate(pairwise(cuts))]


def chunks_by_embedding(docs: DataFrame, overlap: int = 0, s: Settings = Settings()) -> DataFrame:
    """doc_id, local, lo, hi, body of every chunk of ``docs`` (doc_id, text)."""

    def each(doc_id, text):
        text = text or ""
        n, strength = _scored(text, s)
        at = nudged(choose_cuts(n, strength, s), n, strength, s) if n else [0, 0]
        spans = char_spans(text, at, overlap) if n else [(0, len(text))]
        return ((doc_id, i, lo, hi, text[lo:hi]) for i, (lo, hi) in enumerate(spans, 1))

    return by_row(_rows(docs), each, "doc_id long, local int, lo int, hi int, body string")


def grid_scores(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, t, strength at every grid point."""

    def each(doc_id, text):
        return ((doc_id, t, round(x, 9)) for t, x in _scored(text, s)[1].items())

    return by_row(_rows(docs), each, "doc_id long, t int, strength double")


def nearest_windows(length: str, t: str, size: int, stride: int, sides: int) -> tuple[F.Column, F.Column]:
    """Numbers of the last windows with their center before ``t`` and of the first ones from it on, by arithmetic alone.

    Centers of whole windows are start + size / 2; the short ones at the end are checked one by one.
    """
    starts = F.sequence(F.lit(0), F.expr(f"greatest(0, ({length} - 1) div {stride})"))
    center = lambda k: (k * stride + F.least(k * stride + size, F.col(length))).cast("long")  # noqa: E731  twice the center
    before = F.filter(starts, lambda k: F.shiftright(center(k), 1) < F.col(t))
    after = F.filter(starts, lambda k: F.shiftright(center(k), 1) >= F.col(t))
    return F.slice(before, F.greatest(F.lit(1), F.size(before) - sides + 1), F.lit(sides)), F.slice(after, 1, sides)
