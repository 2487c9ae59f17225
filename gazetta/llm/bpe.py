"""Byte-level BPE: texts to the token ids of a public vocabulary, and ids back to texts.

Method: the symbols of a word are the leaves' neighbours in a segment tree over adjacent pairs.  A leaf holds its
pair's rank and place, an inner node the smaller of its two children, so the root is the leftmost pair of the lowest
rank.  A merge changes three leaves; each climbs to the root in logarithmic steps.  It ends when the root holds no pair.

Texts stay in the rows they came in: one pass, no shuffle, nothing gathered.  A worker keeps the ids of short words it
has seen, up to a bound in bytes; what it forgets is merged again.  Long texts are read in slices that end where a token
always ends, so the memory follows the text and the ids, not the words.

Defined cases: null text counts as empty; empty text has no ids and decodes to empty text; an empty table gives no rows;
repeated rows come back each; very long texts, also such without white space, are encoded whole; strings of added tokens
are read as these tokens; ids that the vocabulary lacks decode to nothing, bytes that are no UTF-8 to U+FFFD; kept columns
pass through under any names, also such as the results have (the results then stand last).
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: The white space that the vocabulary's split pattern knows.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_IS_SPACE = re.compile(f"[{_SPACE}]").match
#: Between text and white space every token ends.
_END = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: The split pattern, as kinds of characters; `pieces` reads it.  's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
_ENDINGS_1, _ENDINGS_2 = "stmd", ("re", "ve", "ll")
#: Characters from here on are asked of the tokenizers library, whose Unicode tables may be older.
_LATE = 0x530
_BLANK, _WHITE, _LETTER, _NUMBER, _OTHER = range(5)
#: Characters whose words are looked up together, about.
SLICE_CHARS = 1 << 21
#: Bytes that one worker keeps of words and their ids, about.
KEPT_BYTES = 96 << 20
#: Words of at most so many bytes are merged many at a time (so many at most); longer ones, which are few, one by one.
_LONG, _TOGETHER = 64, 4096
#: Words of more symbols keep their trees in packed arrays.
_PACKED_FROM = 4096

_NONE = (1 << 63) - 1
_PLACE = (1 << 32) - 1


def merge(symbols: list[int], ranks: dict[int, int], made: Sequence[int]) -> list[int]:
    """The symbols after all merges.  ranks: the rank of a pair (left << 32 | right); made: the symbol that a rank makes."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size) if n < _PACKED_FROM else array("q", [_NONE]) * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        if (r := rank(symbols[i] << 32 | symbols[i + 1])) is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    if tree[1] == _NONE:
        return symbols
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

    def put(place: int, r: int | None) -> None:
        at = size + place
        tree[at] = _NONE if r is None else r << 32 | place
        while at > 1:
            least = min(tree[at], tree[at ^ 1])
            at >>= 1
            if tree[at] == least:
                return
            tree[at] = least

    while (root := tree[1]) != _NONE:
        i = root & _PLACE
        gone = after[i]
        symbols[i] = made[root >> 32]
        follows = after[i] = after[gone]
        put(gone, None)
        if follows < n:
            before[follows] = i
            put(i, rank(symbols[i] << 32 | symbols[follows]))
        else:
            put(i, None)
        if (ahead := before[i]) >= 0:
            put(ahead, rank(symbols[ahead] << 32 | symbols[i]))
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class Vocabulary:
    """A vocabulary file of the tokenizers library; keeps the ids (little-endian 32-bit) of words up to a bound."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added, split = spec["model"], spec["added_tokens"], spec["pre_tokenizer"] or {}
        plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or spec["normalizer"] or any(model.get(k) for k in options) or not plain:
            raise ValueError(f"{path}: only byte-level BPE without normaliser, prefix space and stripping is read")
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        ids: dict[str, int] = model["vocab"]
        letters = _byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.bytes = np.array([ids[letters[b]] for b in range(256)], np.int64)
        self.ranks = {ids[a] << 32 | ids[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = np.array([*self.ranks, _NONE], np.int64)  # the last one stands for pairs that follow all others
        by_key = np.argsort(keys)
        self.pairs, self.pair_ranks = keys[by_key], by_key
        self.first = self.look_up(np.repeat(self.bytes, 256), np.tile(self.bytes, 256))  # of pairs of bytes
        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.late: dict[int, int] = {}
        early = [regex.match(r"(\x20)|(\s)|(\p{L})|(\p{N})|(?s:(.))", chr(c)).lastindex - 1 for c in range(_LATE)]
        self.early = np.array([*early, _OTHER], np.int8)
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.find_added = re.compile("|".join(map(re.escape, longest_first))).search if added else lambda text, at=0: None
        bytes_of = {c: b for b, c in letters.items()}
        tokens = {i: bytes(bytes_of[c] for c in t) if all(c in bytes_of for c in t) else t.encode() for t, i in (ids | {t["content"]: t["id"] for t in added}).items()}
        texts = [tokens.get(i, b"") for i in range(max(tokens) + 1)] + [b""]  # the last one stands for all ids beyond
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts, self.letters = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(texts), np.uint8)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1: no such pair."""
        keys = left << 32 | right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], -1)

    def _kinds(self, chars: np.ndarray) -> np.ndarray:
        kinds = self.early[np.minimum(chars, _LATE)]
        if len(at := np.flatnonzero(chars >= _LATE)):
            some, which = np.unique(chars[at], return_inverse=True)
            kinds[at] = np.array([self._late(c) for c in some.tolist()], np.int8)[which]
        return kinds

    def _late(self, c: int) -> int:
        if c not in self.late:
            if _IS_SPACE(chr(c)):
                self.late[c] = _WHITE
            else:
                self.late[c] = next((kind for kind, x in ((_LETTER, "a"), (_NUMBER, "1")) if len(self.split(x + chr(c))) == 1), _OTHER)
        return self.late[c]

    def pieces(self, chars: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Where the pieces begin that the split pattern finds in each of the parts (which begin at ``parts``)."""
        n = len(chars)
        kinds, first = self._kinds(chars), np.zeros(n + 3, bool)
        first[parts], first[n:] = True, True
        white = kinds <= _WHITE
        same = np.where(white, np.int8(_WHITE), kinds)
        begins = first[:n].copy()
        begins[1:] |= same[1:] != same[:-1]
        tails = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])  # the last of white space before text
        begins[tails] = True
        begins[tails[kinds[tails] == _BLANK] + 1] = False
        quotes = np.flatnonzero((chars == ord("'")) & begins)
        if len(quotes):
            padded = np.concatenate([chars, np.zeros(2, chars.dtype)])
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = np.isin(one, [ord(c) for c in _ENDINGS_1]) & ~first[quotes + 1]
            long = np.any([(one == ord(a)) & (two == ord(b)) for a, b in _ENDINGS_2], axis=0) & ~first[quotes + 1] & ~first[quotes + 2]
            begins[quotes[short | long] + 1] = False
            ends = np.concatenate([quotes[short] + 2, quotes[long] + 3])
            begins[ends[ends < n]] = True
        return np.flatnonzero(begins)

    def _learn(self, words: list[bytes]) -> None:
        """Ids of pieces that are not kept."""
        sizes = np.array([len(b) for b in words], np.int64)
        order, at = np.argsort(sizes, kind="stable"), 0
        for size in (1 << k for k in range(_LONG.bit_length())):
            end = int(np.searchsorted(sizes[order], size, "right"))
            for i in range(at, end, _TOGETHER):
                some = [words[k] for k in order[i : min(i + _TOGETHER, end)].tolist()]
                self.young.update(zip(some, self._merged(some, size), strict=True))
            at = end
        for k in order[at:].tolist():
            symbols = self.bytes[np.frombuffer(words[k], np.uint8)].tolist()
            self.young[words[k]] = array("I", merge(symbols, self.ranks, self.made)).tobytes()
        self.held += 200 * len(words) + 5 * int(sizes.sum())

    def _merged(self, words: list[bytes], size: int) -> list[bytes]:
        """`merge` for many words of at most ``size`` bytes at once: a row of the arrays each, a merge a row in every step."""
        n = np.array([len(b) for b in words], np.int64)
        letters = np.frombuffer(b"".join([b.ljust(size, b"\0") for b in words]), np.uint8).reshape(-1, size).astype(np.int64)
        symbols, places = self.bytes[letters], np.arange(size)
        alive = places < n[:, None]
        after, before = np.tile(places + 1, (len(words), 1)), np.tile(places - 1, (len(words), 1))
        after[np.arange(len(words)), n - 1] = size
        tree = np.full((len(words), 2 * size), _NONE, np.int64)
        rank = self.first[letters[:, :-1] << 8 | letters[:, 1:]]
        tree[:, size:-1] = np.where((rank >= 0) & alive[:, 1:], rank << 32 | places[:-1], _NONE)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        flat = [x.reshape(-1) for x in (tree, symbols, after, before, alive)]
        nodes, symbol, following, preceding, living = flat
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            root = nodes[rows * 2 * size + 1]
            here, leaf = rows * size, rows * 2 * size
            i, new = root & _PLACE, self.made[root >> 32]
            gone = following[here + i]
            follows, ahead = following[here + gone], preceding[here + i]
            symbol[here + i], following[here + i], living[here + gone] = new, follows, False
            last, first = follows == size, ahead < 0
            follows, ahead = np.where(last, 0, follows), np.where(first, i, ahead)
            preceding[(here + follows)[~last]] = i[~last]
            right, left = self.look_up(new, symbol[here + follows]), self.look_up(symbol[here + ahead], new)
            nodes[leaf + size + gone] = _NONE
            nodes[leaf + size + ahead] = np.where(left < 0, _NONE, left << 32 | ahead)
            nodes[leaf + size + i] = np.where(last | (right < 0), _NONE, right << 32 | i)  # after ahead, which is i where none is
            climbing = [size + gone, size + i, size + ahead]
            for _ in range(size.bit_length() - 1):
                climbing = [at >> 1 for at in climbing]
                for at in climbing:
                    nodes[leaf + at] = np.minimum(nodes[leaf + 2 * at], nodes[leaf + 2 * at + 1])
            rows = rows[nodes[leaf + 1] != _NONE]
        ids, ends = symbols[alive].astype("<u4").tobytes(), np.cumsum(alive.sum(1) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; pieces that are new are merged together, a slice at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, chars = [], 0
        for i, text in enumerate(texts):
            for part in self._slices(text or ""):
                if part in self.added:
                    self._write(waiting, out)
                    out[i].append(self.added[part])
                    waiting, chars = [], 0
                    continue
                waiting.append((i, part))
                chars += len(part)
                if chars > SLICE_CHARS:
                    self._write(waiting, out)
                    waiting, chars = [], 0
        self._write(waiting, out)
        return [b"".join(x) for x in out]

    def _write(self, waiting: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        if not waiting:
            return
        text = "".join([part for _, part in waiting])
        ends = np.cumsum([len(part) for _, part in waiting])
        parts, letters = np.concatenate([[0], ends[:-1]]), text.encode()
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = self.pieces(chars, parts)
        firsts = np.searchsorted(at, parts)  # the first piece of each part
        if len(letters) > len(chars):
            place = np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))
            at = np.where(at > 0, place[at - 1], 0)
        which, words = _distinct(letters, at, np.diff(at, append=len(letters)))
        found = self._known(words)
        sizes = np.array([len(x) for x in found], np.int64) >> 2
        ids = _gathered(np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, sizes, which).tobytes()
        stops = np.cumsum(np.add.reduceat(sizes[which], firsts) * 4).tolist()
        for (i, _), a, b in zip(waiting, [0, *stops], stops, strict=False):
            out[i].append(ids[a:b])

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of pieces.  Those used since the last change of generations are young; old ones that are not used again are forgotten."""
        if self.held > KEPT_BYTES // 2:
            self.young, self.old, self.held = {}, self.young, 0
        get, old, unknown = self.young.get, self.old.get, []
        for w in words:
            if get(w) is None:
                if (ids := old(w)) is None:
                    unknown.append(w)
                else:
                    self.young[w] = ids
                    self.held += 200 + 5 * len(w)
        self._learn(unknown)
        return [self.young[w] for w in words]

    def _slices(self, text: str) -> Iterator[str]:
        """Added tokens, and what lies between them in parts that end where tokens do."""
        at = 0
        while at < len(text):
            found = self.find_added(text, at)
            stop = found.start() if found else len(text)
            while at < stop:
                end = _END.search(text, at + SLICE_CHARS, stop)
                yield text[at : (at := end.start() if end else stop)]
            if found:
                yield found[0]
                at = found.end()

    def decode(self, ids: bytes) -> str:
        numbers, parts = np.frombuffer(ids, "<u4"), []
        for at in range(0, len(numbers), SLICE_CHARS):
            some = np.minimum(numbers[at : at + SLICE_CHARS], len(self.starts) - 1)
            parts.append(_gathered(self.letters, self.starts, self.sizes, some).tobytes())
        return b"".join(parts).decode("utf-8", "replace")


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of values (start, size) that ``which`` names, one after the other."""
    size = sizes[which]
    shift = starts[which] - np.cumsum(size) + size
    return values[np.arange(int(size.sum())) + np.repeat(shift, size)]


def _distinct(letters: bytes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Which of the different words each word is, and these.  Words of at most 16 bytes are two numbers and a size."""
    padded = np.frombuffer(letters + bytes(16), np.uint8)
    eight = np.ndarray(len(letters) + 8, "<u8", padded.data, strides=(1,))
    short = np.flatnonzero(size <= 16)
    bits = 8 * np.arange(17, dtype=np.uint64)
    masks = np.array([(1 << int(b)) - 1 if b < 64 else (1 << 64) - 1 for b in bits], np.uint64)
    low = eight[at[short]] & masks[np.minimum(size[short], 8)]
    high = eight[at[short] + 8 * (size[short] > 8)] & masks[np.maximum(size[short] - 8, 0)]
    mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high + size[short].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    _, first, inverse = np.unique(mixed, return_index=True, return_inverse=True)
    same = (low[first][inverse] == low) & (high[first][inverse] == high) & (size[short][first][inverse] == size[short])
    which = np.empty(len(at), np.int64)
    which[short] = inverse
    starts, stops = at.tolist(), (at + size).tolist()
    words = [letters[starts[k] : stops[k]] for k in short[first].tolist()]
    others: dict[bytes, int] = {}
    for k in np.concatenate([short[~same], np.flatnonzero(size > 16)]).tolist():  # longer ones, and such as share a hash
        which[k] = others.setdefault(letters[starts[k] : stops[k]], len(words) + len(others))
    return which, [*words, *others]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Read once a worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def default_path() -> str:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json")


def encode(df: DataFrame, path: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep``, n_tokens (long) and ids (binary, little-endian unsigned 32-bit).  path: on every executor."""
    path = path or default_path()

    def judge(texts: list) -> list[pa.Array]:
        ids = vocabulary(path).encode(texts)
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

    return _mapped(df, text_col, keep, "n_tokens long, ids binary", judge)


def decode(df: DataFrame, path: str | None = None, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and decoded (string); null ids decode to empty text."""
    path = path or default_path()

    def judge(ids: list) -> list[pa.Array]:
        words = vocabulary(path)
        return [pa.array([words.decode(x) if x else "" for x in ids], pa.string())]

    return _mapped(df, ids_col, keep, "decoded string", judge)


def _mapped(df: DataFrame, col: str, keep: list[str] | None, fields: str, judge: Callable[[list], list]) -> DataFrame:
    """`map_texts` by the places of the columns, so that names may differ in case alone or clash with the results."""
    keep = df.columns if keep is None else keep
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    out = map_texts(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), names[col], [names[c] for c in keep], fields, judge)
    return out.toDF(*keep, *[x.split()[0] for x in fields.split(", ")])
