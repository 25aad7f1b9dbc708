"""Hashes of words and of runs of words for many texts at once, worked out over flat arrays of bytes.

A word is a run of bytes other than space and 09-0D. Its hash is a polynomial over a table of its bytes, mixed; a run's hash is a
polynomial over the hashes of its words, mixed again. All arithmetic is modulo 2**64 and vectorised: prefix sums give every word's
polynomial, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time. A longer text is cut at spaces; only a single longer word needs more.
PIECE = 1 << 20
_ODD, _RUN = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the input; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class Words:
    """Word hashes of Arrow columns; holds the tables of powers between batches."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _flat(self, flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word of texts that lie one after another; ``edges`` are their first bytes."""
        if len(self.up) < len(flat):
            size = max(len(flat), PIECE)
            self.up, self.down = powers(_ODD, size), powers(pow(_ODD, -1, 1 << 64), size)
        fresh = np.zeros(len(flat) + 1, bool)
        fresh[edges] = fresh[-1] = True
        solid = np.zeros(len(flat) + 2, bool)
        solid[1:-1] = ~_SPACE[flat]
        begin = np.flatnonzero(solid[1:-1] & (fresh[:-1] | ~solid[:-2]))
        stop = np.flatnonzero(solid[1:-1] & (fresh[1:] | ~solid[2:])) + 1
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(_BYTE[flat] * self.up[: len(flat)], out=total[1:])
        return mixed((total[stop] - total[begin]) * self.down[begin]), begin

    def of(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, word hashes, number of words of each row) for consecutive rows. Null texts have no words."""
        column = column.cast(pa.large_binary())
        column = column.fill_null(b"") if column.null_count else column
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
            flat = data[offsets[at] : offsets[to]]
            if to == at + 1:
                words = np.concatenate([np.zeros(0, np.uint64), *(self._flat(p, np.zeros(1, np.int64))[0] for p in cut(flat))])
                yield at, words, np.array([len(words)])
            else:
                words, begin = self._flat(flat, offsets[at:to] - offsets[at])
                yield at, words, np.diff(np.append(np.searchsorted(begin, offsets[at:to] - offsets[at]), len(words)))
            at = to


def cut(text: np.ndarray) -> Iterator[np.ndarray]:
    """A text in pieces of about PIECE bytes that end between words."""
    at = 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        while to < len(text) and not _SPACE[text[to]]:
            gap = np.flatnonzero(_SPACE[text[to : to + PIECE]])
            to = to + int(gap[0]) if len(gap) else min(len(text), to + PIECE)
        yield text[at:to]
        at = to


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at each word; the last size - 1 are of no use."""
    out, factors = np.zeros(len(words), np.uint64), powers(_RUN, size + 1)
    for j in range(min(size, len(words))):
        out[: len(words) - j] += words[j:] * factors[j + 1]
    return mixed(out)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of the ``width`` values that begin at each place, the leftmost of equals; the last see fewer."""
    best, place, reach = values, np.arange(len(values)), 1
    while reach < min(width, len(values)):
        step = min(reach, width - reach)
        ahead = best[step:] < best[:-step]
        best, place = (np.append(np.where(ahead, x[step:], x[:-step]), x[-step:]) for x in (best, place))
        reach += step
    return place
