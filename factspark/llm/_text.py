"""Tokenising shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes 0x09-0x0D and 0x20 separate words. ``bytes.split()`` uses the same six.
SPACES = r"[\x20\x09-\x0D]+"
#: Everything in ASCII but digits and letters separates words (after lower-casing A-Z).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """The words between ASCII white space; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACES), ""), F.array().cast("array<string>"))


def alnum_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), NON_WORD), ""), F.array().cast("array<string>"))


def _odd_power_table(bits: int = 64) -> tuple[np.uint64, np.uint64]:
    base = 0x9E3779B97F4A7C15 | 1
    return np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


BASE, INVERSE = _odd_power_table()


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
