"""Best-fit packing: documents become token pieces that share sequences of a fixed length.

Method (best-two-fit): a bin is filled greedily, always with the longest piece that still fits; if a gap is left,
the bin's smallest piece is replaced by two unpacked pieces that fit the gap thus expanded more tightly.

Every choice depends on piece lengths alone, so it is made once on the histogram of lengths (at most ``capacity``
entries, whatever the corpus): a bin's pattern of lengths is repeated for as long as the lengths it uses last, which
is what bin-by-bin filling would do.  Pieces then find their place from their rank among the pieces of their length;
ranks are made in buckets of bounded size, so a length that a third of all pieces have still spreads over tasks.

Ties: of pairs that fit equally the one with the longest piece; of pieces of one length the smallest id, piece and ids first.

Defined cases: null text is empty text; empty text is one piece holding the end token alone; an empty table gives no
rows; repeated rows are packed each; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_fields, materialise, rank_key, tasks

CAPACITY = 2048
END_TOKEN = 0
#: Pieces ranked in one bucket at most, on average; there are at least as many buckets as shuffle partitions.
RANK_ROWS = 200_000
#: Bytes that one worker keeps of chunks and their ids, about; longer chunks are not kept.
_CACHE_BYTES, _CACHED_CHARS = 96 << 20, 64
#: What the byte-level vocabulary reads apart at white space; both halves of a text cut there encode alone.
_CHUNKS = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+").findall
_ODD = re.compile(r"[\x1c-\x1f]|<\|endoftext\|>")


class _Encoder(dict):
    """Text to little-endian 32-bit ids.  Keeps the ids of chunks already seen, up to a bound."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        super().__init__()
        self.tokenizer, self.held = tokenizer, 0
        self._whole = None
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})._core_bpe.encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self._fast(chunk)).tobytes()
        if len(chunk) <= _CACHED_CHARS:
            self.held += 180 + 2 * len(chunk) + len(ids)
            if self.held > _CACHE_BYTES:
                self.clear()
                self.held = 0
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            if self._whole is None:
                from tokenizers import Tokenizer

                self._whole = Tokenizer.from_file(self.tokenizer)
            return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, _CHUNKS(text)))


_encoders: dict[tuple, _Encoder] = {}


def _encoder(*spec: str) -> _Encoder:
    if spec not in _encoders:
        _encoders[spec] = _Encoder(*spec)
    return _encoders[spec]


def default_tokenizer() -> tuple[str, str, str]:
    """Paths of the public byte-level vocabulary and its rank file, and its split pattern."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def tokenise(docs: DataFrame, tokenizer: tuple[str, str, str], capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens.  Of a document that is cut, only the first piece is shorter."""
    end = array("I", [END_TOKEN]).tobytes()
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    fields = arrow_fields(source, ["__id"]) + ", piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*tokenizer)
        for batch in batches:
            row, piece, start, length, crc, blobs = [], [], [], [], [], []
            for i, value in enumerate(batch.column("__text")):
                text = value.as_py()
                ids = (encoder.encode(text) if text else b"") + end
                total = len(ids) // 4
                at, n, k = 0, total % capacity or capacity, 0
                while at < total:
                    part = ids[4 * at : 4 * (at + n)]
                    row.append(i), piece.append(k), start.append(at), length.append(n), crc.append(zlib.crc32(part))
                    if keep_ids:
                        blobs.append(part)
                    at, n, k = at + n, capacity, k + 1
            arrays = [batch.column("__id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            names = ["__id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(blobs, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    return source.mapInArrow(run, fields)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best-two-fit on a histogram {length: pieces}: [(pattern {length: pieces in a bin}, number of such bins)]."""
    left = {k: v for k, v in histogram.items() if v}
    there = sum(1 << k for k in left)  # bit k: a piece of length k is left
    runs: list[tuple[dict[int, int], int]] = []

    def longest(most: int, taken: Counter) -> int:
        mask = there & ((1 << (most + 1)) - 1)
        while mask:
            k = mask.bit_length() - 1
            if left[k] > taken[k]:
                return k
            mask ^= 1 << k
        return 0

    while left:
        taken: Counter = Counter()
        gap = capacity
        while gap and (k := longest(gap, taken)):
            n = min(left[k] - taken[k], gap // k)
            taken[k] += n
            gap -= n * k
        if gap:
            small = min(taken)
            for total in range(small + gap, small, -1):  # the tightest first
                pair = next(((x, total - x) for x in range(total - 1, (total - 1) // 2, -1) if _free(left, taken, x, total - x)), None) if _may_pair(there, total) else None
                if pair:
                    taken[small] -= 1
                    taken.update(pair)
                    taken = +taken
                    break
        times = min(left[k] // n for k, n in taken.items())
        runs.append((dict(taken), times))
        for k, n in taken.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
                there ^= 1 << k
    return runs


def _free(left: dict[int, int], taken: Counter, x: int, y: int) -> bool:
    return left.get(x, 0) - taken[x] >= 1 + (x == y) and left.get(y, 0) - taken[y] >= 1


def _may_pair(there: int, total: int) -> bool:
    """Whether any two lengths that are left add up to total."""
    low = there & ((1 << total) - 1)
    flipped = int(bin(low | 1 << total)[2:][::-1], 2) >> 0  # bit total-k is set where bit k was
    return bool(low & flipped & ~1)


def places(runs: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """A row for each length and run, in order: length, first rank that goes there, first bin, pieces in a bin, offset in a bin."""
    rows, used, bins = [], Counter(), 0
    for pattern, times in runs:
        at = 0
        for k in sorted(pattern, reverse=True):
            rows.append((k, used[k], bins, pattern[k], at))
            used[k] += pattern[k] * times
            at += k * pattern[k]
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: tuple[str, str, str] | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialise(tokenise(docs, tokenizer or default_tokenizer(), capacity, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan_bins(histogram, capacity))
    buckets = max(-(-sum(histogram.values()) // RANK_ROWS), tasks(docs.sparkSession))
    rows = pieces.withColumn("__bucket", F.pmod(F.xxhash64("__id", "piece", "start"), F.lit(buckets)))
    here = Window.partitionBy("length", "__bucket")
    rows = rows.withColumn("__rank", F.row_number().over(here.orderBy(rank_key(F.col("__id")), "piece", "ids_crc32")).cast("long") - 1)
    sizes = pieces.withColumn("__bucket", F.pmod(F.xxhash64("__id", "piece", "start"), F.lit(buckets))).groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = rows.join(sizes, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    lengths, ranks, bins, each, offsets = table.T
    step = np.int64(1) << 40  # length and rank in one sorted number; fewer than 2**40 pieces have one length
    keys = lengths * step + ranks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            at = np.searchsorted(keys, n * step + rank, "right") - 1
            inner = rank - ranks[at]
            where = [pa.array(bins[at] + inner // each[at], pa.int64()), pa.array(offsets[at] + (inner % each[at]) * n, pa.int64())]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + where, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    out = rows.select("__id", "piece", "start", "length", "ids_crc32", "__rank")
    return out.mapInArrow(place, arrow_fields(out, out.columns[:-1]) + ", sequence_id long, offset long").withColumnRenamed("__id", id_col)
