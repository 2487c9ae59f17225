"""Benchmark decontamination by a prefix-filtered containment join.

An item's windows are its runs of ``window`` consecutive words; an item with fewer words, but some, is one window.  The
elements of a window are its shingles, runs of ``shingle`` words (the whole window where it is shorter).  A document
holds a window only if it holds all its shingles, so with shingles ordered by rarity the first one alone is a necessary
prefix: the one in the fewest documents, counted over all documents.

Documents and windows meet in an equi-join on the hash of that shingle.  A document's row holds the words around the
shingle; the window's length and the shingle's place in it bound where the window could lie, and the words there are
compared one by one.

The corpus is read a fixed number of times, however large the benchmark: once to count, once to find prefixes, once for
the result.  Tasks know the shingles sought by a bitmap whose size has a bound; a full one lets more pass and changes no
result.  The table of windows is broadcast only if its text is at most ``broadcast_bytes``, otherwise the join is a
sort-merge join, whose hot keys can be split.

Defined cases: null and empty texts have no words (no hit, no window); rows with a null item id still mark words but
are not listed; repeated items count once; an empty benchmark leaves all documents clean; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_bitmap, map_texts, materialise, may_hold, numbered, possible, shuffled
from .words import in_parts, read, shingles

WINDOW = 10
SHINGLE = 5
BROADCAST_BYTES = 8 << 20
#: A-Z lower-cased; digits, a-z and all bytes of other characters are word bytes; the rest become spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_NONE = _digest([])
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """benchmark: item, text.  Each window once: its words, their number n, the hashes of its shingles, its items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in in_parts(batch):
                found = read(texts)
                lists = [words_of(t) for t in texts]
                owner, words, hashes = [], [], []
                for i, mine in enumerate(lists):
                    if not mine:
                        continue
                    one = read([texts[i]]) if len(texts) > 1 else found
                    m = min(shingle, len(mine))
                    _, h = shingles(one, m)
                    n = min(window, len(mine))
                    for k in range(len(mine) - n + 1):
                        owner.append(rows[i]), words.append(b" ".join(mine[k : k + n]).decode()), hashes.append(h[k : k + n - m + 1].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(owner, pa.int64())), pa.array(words, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], names=["item", "words", "hashes"])

    each = benchmark.mapInArrow(cut, "item string, words string, hashes array<long>")
    return each.groupBy("words").agg(F.first("hashes").alias("hashes"), F.collect_set("item").alias("items"))


def _counts(docs: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """docs: text.  h, n: for each shingle hash that the bitmap lets pass the number of texts that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in in_parts(batch):
                found = read(texts)
                parts = []
                for m in sizes:
                    start, h = shingles(found, m)
                    here = may_hold(shared.value, h)
                    start, h = start[here], h[here]
                    order = np.lexsort((h, owner := np.searchsorted(found.firsts, start, "right")))
                    h, owner = h[order], owner[order]
                    parts.append(h[np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]])  # once a text
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    return docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _occurrences(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """docs: uid, text.  Where a shingle stands that the bitmap lets pass: uid, h, at, and the words around it with their first place."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in in_parts(batch):
                found = read(texts)
                owner, hashes, at, first, around = [], [], [], [], []
                for m in sizes:
                    start, h = shingles(found, m)
                    here = may_hold(shared.value, h)
                    start, h = start[here], h[here].view(np.int64)
                    mine, known = np.searchsorted(found.firsts, start, "right") - 1, -1
                    for i, k, x in zip(mine.tolist(), (start - found.firsts[mine]).tolist(), h.tolist()):
                        if i != known:
                            known, words = i, words_of(texts[i])
                        low = max(0, k - window + m)
                        owner.append(rows[i]), hashes.append(x), at.append(k), first.append(low), around.append(b" ".join(words[low : k + window]).decode())
                yield pa.RecordBatch.from_arrays([batch.column("uid").take(pa.array(owner, pa.int64())), pa.array(hashes, pa.int64()), pa.array(at, pa.int32()), pa.array(first, pa.int32()), pa.array(around, pa.string())], names=["uid", "h", "at", "first", "around"])

    return docs.mapInArrow(look, "uid long, h long, at int, first int, around string")


def _united(values: list[dict]) -> list[pa.Array]:
    spans = [united((s["start"], s["end"]) for s in v["spans"]) for v in values]
    items = [sorted(v["items"]) for v in values]
    columns = [([sum(b - a for a, b in x) for x in spans], pa.int64()), ([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS), (items, pa.list_(pa.string()))]
    columns += [([len(x) for x in items], pa.int64()), ([_digest(x) for x in items], pa.string())]
    return [pa.array(x, kind) for x, kind in columns]


def contaminated(docs: DataFrame, benchmark: DataFrame, uid_col: str, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """docs with row numbers as from `numbered`.  uid, n_hit, hit_spans, items, n_items, items_sha256 of the texts that hold a window; None where there is no window."""
    rows = docs.select(F.col(f"`{uid_col}`").alias("uid"), F.col(f"`{text_col}`").alias("text"))
    benchmark = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    windows = materialise(_windows(benchmark, window, shingle), "windows")
    shape = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length("words") + 64 + 24 * F.size("items")).alias("bytes")).first()
    if not shape["n"]:
        return None
    lengths = [r["n"] for r in windows.select(F.size(F.split("words", " ")).alias("n")).distinct().collect()]  # at most `window` rows
    sizes = sorted({min(shingle, n) for n in lengths})
    elements = windows.select("words", F.posexplode("hashes").alias("place", "h"))
    sought = materialise(elements.select("h").distinct(), "shingles")
    counts = _counts(rows.select("text"), key_bitmap(sought, F.col("h"), sought.count()), sizes)
    counts = materialise(counts.join(shuffled(sought), "h", "left_semi"), "counts")
    rarest = elements.join(shuffled(counts), "h", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place")).alias("x"))
    prefixes = rarest.where("x.n > 0").select("words", F.col("x.h").alias("h"), F.col("x.place").alias("place"))
    prefixes = materialise(prefixes.join(windows.select("words", "items"), "words"), "prefixes")
    bitmap = key_bitmap(prefixes, F.col("h"), prefixes.count())
    found = materialise(_occurrences(rows.select("uid", "text"), bitmap, sizes, window), "prefixes-met")
    side = F.broadcast(prefixes) if shape["bytes"] <= broadcast_bytes else shuffled(prefixes)
    start, n, around = F.col("at") - F.col("place"), F.size(F.split("words", " ")), F.split("around", " ")
    met = found.join(side, "h").select("uid", start.alias("start"), (start + n).alias("end"), "words", "items", (start - F.col("first") + 1).alias("from"), n.alias("n"), around.alias("around"))
    bounded = (F.col("from") >= 1) & (F.col("from") + F.col("n") - 1 <= F.size("around"))
    held = met.where(bounded).where(F.array_join(F.slice("around", F.greatest("from", F.lit(1)), F.col("n")), " ") == F.col("words"))
    held = materialise(held.select("uid", "start", "end", "items"), "hits")
    of_text = held.groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    of_text = of_text.select("uid", F.struct("spans", "items").alias("all"))
    fields = "n_hit long, hit_spans array<struct<start:int,end:int>>, items array<string>, n_items long, items_sha256 string"
    return materialise(map_texts(of_text, "all", ["uid"], fields, _united), "contaminated")


def _n_words(texts: list[str | None]) -> list[pa.Array]:
    return [pa.array(np.diff(read([t or "" for t in texts]).firsts), pa.int64())]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES, extra: list[str] | None = None) -> DataFrame:
    """One row per document: id, the ``extra`` columns of docs (but those named like a result), n_words, n_hit, hit_spans (word places, end exclusive), items (sorted), n_items, items_sha256, contaminated."""
    rows = numbered(docs, "__uid")
    hits = contaminated(rows, benchmark, "__uid", text_col, item_col, item_text_col, window, shingle, broadcast_bytes)
    made = ["n_words", "n_hit", "hit_spans", "items", "n_items", "items_sha256", "contaminated"]
    keep = [id_col, *[c for c in extra or [] if c not in made and c != id_col]]
    clean = [F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<struct<start:int,end:int>>").alias("hit_spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_items"), F.lit(_NONE).alias("items_sha256")]
    names = made[1:-1]
    if hits is None:
        return map_texts(rows, text_col, keep, "__n_words long", _n_words).select(*[F.col(f"`{c}`") for c in keep], F.col("__n_words").alias("n_words"), *clean, F.lit(False).alias("contaminated"))
    hits = hits.select(F.col("uid").alias("__uid"), F.struct(*names).alias("__hit"))
    halves = possible(rows, F.col("__uid"), hits, F.col("__uid"))
    touched = halves.where("__possible").join(shuffled(hits), "__uid", "left")
    both = touched.unionByName(halves.where("not __possible").withColumn("__hit", F.lit(None).cast(hits.schema["__hit"].dataType)))
    values = [F.coalesce(F.col(f"__hit.{n}"), c).alias(n) for n, c in zip(names, clean, strict=True)]
    both = both.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])], "__hit")
    counted = map_texts(both, text_col, [*keep, "__hit"], "__n_words long", _n_words)
    return counted.select(*[F.col(f"`{c}`") for c in keep], F.col("__n_words").alias("n_words"), *values, F.col("__hit").isNotNull().alias("contaminated"))
