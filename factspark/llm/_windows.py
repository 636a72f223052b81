"""Super-k-mers over token sequences, vectorised with numpy.

A window of ``width`` tokens is represented by its minimiser: the smallest hash
among its ``gram``-token grams. Equal windows have equal minimisers wherever
they stand, so windows can be compared bucket by bucket, and consecutive windows
that share a minimiser travel as one piece of text.
"""

from __future__ import annotations

import numpy as np

from ._text import BASE, INVERSE, mix64, powers

#: Windows in one piece at most, so that periodic text does not make huge pieces.
LONGEST_RUN = 64
#: Counters of the sketch of gram frequencies; its size does not grow with the corpus.
SKETCH_BITS = 18
#: A gram is frequent if its counter exceeds this many times the mean counter ...
HOT_FACTOR = 8
#: ... and this many occurrences.
HOT_LEAST = 64


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hash) of the words of a byte buffer."""
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    prefix = np.zeros(len(buffer) + 1, dtype=np.uint64)
    up = powers(BASE, len(buffer))
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up, out=prefix[1:])
    down = powers(INVERSE, len(buffer) + 1)
    return starts, ends, mix64((prefix[ends] - prefix[starts]) * down[starts])


def token_grams(tokens: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` 64-bit tokens."""
    n = len(tokens) - gram + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    prefix = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(tokens * powers(BASE, len(tokens)), out=prefix[1:])
    return mix64((prefix[gram:] - prefix[:n]) * powers(INVERSE, n))


def byte_grams(buffer: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` bytes (a multiple of eight)."""
    n = len(buffer) - gram + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(0, gram, 8):
        eight = np.ndarray((n,), dtype="<u8", buffer=buffer, offset=k, strides=(1,))
        out = (out ^ eight) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(35)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x) - width + 1
    if n < 1:
        return x[:0]
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[width - done : width - done + n])


def rank_grams(grams: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    """63-bit order of the grams; frequent ones (a bitmap by sketch cell) come last."""
    order = grams >> np.uint64(2)
    if hot is not None:
        order |= hot[(grams & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(62)
    return order


def runs(minimisers: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of runs of windows with one minimiser; ``limits`` are positions where a run must end."""
    n = len(minimisers)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = minimisers[1:] != minimisers[:-1]
    new[limits[limits < n]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    if count.max() > LONGEST_RUN:
        pieces = -(-count // LONGEST_RUN)
        index = np.repeat(np.arange(len(first)), pieces)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, count = first[index] + step * LONGEST_RUN, np.minimum(LONGEST_RUN, count[index] - step * LONGEST_RUN)
    return first, count
