"""Bitmaps of bounded size that say which hashes are surely not among some keys, and hashes of runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap sent to Python workers: so many for each key, within these bounds (8 KB to 16 MB).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27


def key_bitmap(keys: DataFrame, key: Column, n: int) -> np.ndarray:
    """A bitmap of the low bits of 64-bit hashes; its size follows their number n up to a bound.

    `may_hold` is false only for hashes that are surely not there; a bitmap at its bound only lets more pass."""
    size = min(max(1 << (max(n, 1) * BITS_A_KEY - 1).bit_length(), LEAST_BITS), MOST_BITS)
    place = key.bitwiseAND(F.lit(size - 1))
    words = keys.select(place.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
    table, out = words.toArrow(), np.zeros(size >> 6, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """hashes: unsigned."""
    at = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def run_hashes(words: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For n from 1 to most: n and the hashes of all runs of n words, from unsigned hashes of the words."""
    mixed = words
    for n in range(1, min(most, len(words)) + 1):
        if n > 1:
            mixed = mixed[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[n - 1 :]
        final = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        yield n, final ^ (final >> np.uint64(32))
