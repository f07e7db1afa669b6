"""Words of a text, hashes of runs of words in vectors, and Arrow batches cut to bounded bytes.

Words are runs of anything but the ASCII spaces (blank, tab to carriage return). Each word has a hash of 128 bits; the hash of
a run is built from those of its words by doubling, with a finalizer at every step, so that no structure of the words, such
as repeats or mirrored patterns, makes different runs collide.
"""

from __future__ import annotations

import ctypes

import numpy as np
from xxhash import xxh3_128_digest

#: Most bytes of a batch that a kernel works on at once; a longer text is worked on by itself.
SLICE_BYTES = 2 << 20

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` neighbours of ``x``, along the first axis; none if there are fewer."""
    if len(x) < n:
        return x[:0]
    out, have, part, width = None, 0, x, 1
    while width <= n:
        if n & width:
            out = part if out is None else mix(out[: len(part) - have] * _LEFT + part[have:] * _RIGHT)
            have += width
        if 2 * width <= n:
            part = mix(part[:-width] * _LEFT + part[width:] * _RIGHT)
        width *= 2
    return out[: len(x) - n + 1]


class Words:
    """The words of one text."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.hashes = np.frombuffer(b"".join(map(xxh3_128_digest, self.words)), "<u8").reshape(-1, 2)

    def __len__(self) -> int:
        return len(self.words)

    def grams(self, n: int) -> np.ndarray:
        """Hashes of 64 bits of all runs of ``n`` words; none if there are fewer words."""
        return run_hashes(self.hashes[:, 0], n)

    def wide_grams(self, n: int) -> np.ndarray:
        """Hashes of 128 bits of all runs of ``n`` words, as two columns."""
        return run_hashes(self.hashes, n)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Give freed memory back to the system, so that a worker that waits holds no more than it uses."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches, size: int = SLICE_BYTES):
    """Arrow batches cut into parts of about ``size`` bytes, so that what a kernel holds besides the batch is bounded."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(size, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        release()


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node of its component, given the edges between ``a`` and ``b``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        if (least == label[a]).all() and (least == label[b]).all():
            return label
        # Roots are hooked as well, so that a component needs few rounds however long it is.
        for at in (a, b, label[a], label[b]):
            np.minimum.at(label, at, least)
        label = label[label]
