"""Words of many texts at once, as arrays: their places and 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Characters that are read at a time, but for longer texts.
PART = 400_000
ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]
#: What a character is; upper case is also what makes it lower.
WORD, SPACE, LINE, END, CLOSER, UPPER = (np.uint8(x) for x in (1, 2, 4, 8, 16, 32))
_U32, _U31, _U29 = np.uint64(32), np.uint64(31), np.uint64(29)
_known: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U32)) * ODD[2]
    return (x ^ (x >> _U29)) * ODD[1]


def _kinds() -> np.ndarray:
    """For each code point what it is: A-Z, a-z, digits and all beyond 127 make words; white space is as in str.isspace."""
    if not _known:
        kinds = np.full(0x110000, WORD)
        kinds[[c for c in range(128) if not chr(c).isalnum()]] = 0
        kinds[[c for c in range(0x3001) if chr(c).isspace()]] |= SPACE
        for marks, kind in (("\n", LINE), (".!?…", END), ("\"'”’)]", CLOSER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER)):
            kinds[[ord(c) for c in marks]] |= kind
        _known.append(kinds)
    return _known[0]


def runs(there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From and to of the runs of true."""
    edge = np.zeros(len(there) + 2, bool)
    edge[1:-1] = there
    edge = np.flatnonzero(edge[1:] != edge[:-1])
    return edge[::2], edge[1::2]


#: Primes below 2**31: products of two residues fit 64 bits.  A modulus of 2**64 would let patterned texts collide.
PRIMES = (np.uint64(2147483647), np.uint64(2147483629))


class Powers:
    """Powers of two numbers and of their inverses, each modulo a prime."""

    def __init__(self, *bases: int):
        self.n, self.numbers = 1, [(p, np.uint64(b), np.uint64(pow(b, -1, int(p)))) for p, b in zip(PRIMES, bases, strict=True)]
        self.table = [[np.ones(1, np.uint64)] * 2 for _ in PRIMES]

    def upto(self, n: int) -> list[list[np.ndarray]]:
        while n > self.n:
            for (p, *numbers), row in zip(self.numbers, self.table, strict=True):
                row[:] = [np.concatenate([x, x * np.uint64(pow(int(b), self.n, int(p))) % p]) for x, b in zip(row, numbers, strict=True)]
            self.n *= 2
        return [[x[:n] for x in row] for row in self.table]

    def runs(self, h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the runs start:stop of h: 62 bits, mixed with the length."""
        out = (stop - start).astype(np.uint64) * ODD[2]
        for shift, (p, *_), (up, down) in zip((np.uint64(0), _U31), self.numbers, self.upto(len(h) + 1), strict=True):
            before = np.append(np.uint64(0), np.cumsum(h % p * up[: len(h)] % p, dtype=np.uint64))
            out = out + ((before[stop] - before[start]) % p * down[start] % p << shift)
        return mixed(out)


POWERS = [Powers(1103515245, 1664525363), Powers(1597334677, 747796405)]


@dataclass
class Words:
    kinds: np.ndarray  # of all characters; one more stands between two texts
    stops: np.ndarray  # characters before the end of each text
    starts: np.ndarray  # characters before each word
    hashes: np.ndarray
    firsts: np.ndarray  # words before each text, and all


def read(texts: list[str]) -> Words:
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _kinds()[codes]
    starts, ends = runs((kinds & WORD) != 0)
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    return Words(kinds, stops, starts, _hashes(codes + (kinds & UPPER), starts, ends), np.append(0, np.searchsorted(starts, stops)))


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Sums over the letters of a word, each mixed with its place in the word."""
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), step):  # bounds the memory
        a, b = starts[k : k + step], ends[k : k + step]
        sizes = b - a
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        letters = codes[at + np.repeat(a, sizes)].astype(np.uint64)
        sums = np.add.reduceat(mixed(letters * ODD[0] + at.astype(np.uint64) * ODD[1]), first, dtype=np.uint64)
        out[k : k + step] = mixed(sums ^ sizes.astype(np.uint64) * ODD[2])
    return out


def digests(texts: list[str], found: Words) -> list[tuple[int, int] | None]:
    """A 128-bit keyless cryptographic digest of each text's words as they are read (lower case, one mark between); None
    without words."""
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    word = (found.kinds & WORD) != 0
    kept = word.copy()
    kept[1:] |= word[:-1]  # the character behind a word stands for the gap
    letters = np.where(word, codes + (found.kinds & UPPER), 0).astype("<u4")[kept]
    before = np.append(0, np.cumsum(kept))
    froms = before[np.append(0, found.stops[:-1] + 1)].tolist()
    blob, out = letters.tobytes(), []
    for a, b, words in zip(froms, before[np.minimum(found.stops + 1, len(kept))].tolist(), np.diff(found.firsts).tolist(), strict=True):
        text = blob[4 * a : 4 * b]
        # the last word of the last text has nothing behind it
        digest = hashlib.blake2b(text if text.endswith(bytes(4)) else text + bytes(4), digest_size=16).digest()
        out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)) if words else None)
    return out


def shingles(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of n words within a text."""
    start = np.arange(max(0, len(found.hashes) - n + 1))
    owner = np.repeat(np.arange(len(found.firsts) - 1), np.diff(found.firsts))[: len(start)]
    start = start[start + n <= found.firsts[owner + 1]]
    return start, POWERS[0].runs(found.hashes, start, start + n)


def in_parts(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows and texts of the texts that are not empty, so many characters at a time, which bounds the memory."""
    rows, texts, chars = [], [], 0
    for row, text in enumerate(batch.column(column)):
        if text := text.as_py():
            rows.append(row), texts.append(text)
            chars += len(text)
        if texts and (chars > PART or row + 1 == len(batch)):
            yield np.array(rows), texts
            rows, texts, chars = [], [], 0
