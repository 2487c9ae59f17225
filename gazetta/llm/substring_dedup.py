"""Substring dedup over sliding sentence spans.

A text is cut into sentences in two ways, and what either finds goes.  The first cuts after . ! ? with the marks that
follow and at line ends, and a sentence longer than ``longest`` words every ``longest`` words.  The second takes a single
line end as white space, so line breaks may differ, and cuts long sentences where the hash of two words is the least
among its neighbours, which a passage keeps wherever it begins; pieces still longer are cut every ``longest`` words.
A run is at least ``sentences`` consecutive sentences with words that have at least ``words`` words.  Spans are the
shortest run from each sentence and the shortest run up to each sentence, which together cover all that any run seen
before covers.  Span hashes (128 bits over the lower-cased words) are joined over the whole corpus; a sentence is
removed if a span that covers it occurred before, that is, at a smaller (id, file order, place).

Two readings: the first counts 64-bit hashes of spans alone; the second makes the spans again and sends on only those
whose hash may be among the repeated ones, by a bitmap of bounded size.  Spans that may be repeated then meet their
first occurrence in a join of two tables, so a passage that a third of all documents hold is split over tasks.

Defined cases: null text stays null; texts too short for one span stay as they are; repeated rows count as later
occurrences, ties in id go by file order, null ids come last; an empty table gives no rows; further columns pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, key_bitmap, map_texts, materialise, may_hold, numbered, possible, shuffled
from .words import CLOSER, END, LINE, ODD, PART, POWERS, SPACE, in_parts, mixed, read, runs

SENTENCES = 2
WORDS = 20
LONGEST = 16
#: A cut's hash is the least among so many words on either side.
NEAR = 4


class Cutter:
    """Texts to sentences and spans.  Places of words are their numbers in the text."""

    def __init__(self, sentences: int = SENTENCES, words: int = WORDS, longest: int = LONGEST):
        self.given = sentences, words, longest

    def __reduce__(self):
        return Cutter, self.given

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
        """texts: none empty.  Hashes of all words, the number of the first word of each text (and of all words), and for each
        way of cutting the text, the first word, the number of words, from and to (characters of all texts, each with one more
        between) of each sentence."""
        found = read(texts)
        kinds, starts, h, stops = found.kinds, found.starts, found.hashes, found.stops
        from_, to = runs((kinds & SPACE) != 0)  # white space ends a sentence after its marks, or by its line ends
        before = np.maximum(from_ - 1, 0)
        for _ in range(8):
            before = np.maximum(before - ((kinds[before] & CLOSER) != 0), 0)
        if len(before) and (kinds[before[before > 0]] & CLOSER).any():  # many in a row
            before = np.maximum.accumulate(np.where(kinds & CLOSER, 0, np.arange(len(kinds))))[np.maximum(from_ - 1, 0)]
        lines = np.flatnonzero(kinds & LINE)
        lines = np.searchsorted(lines, to) - np.searchsorted(lines, from_)
        marked = (from_ > 0) & ((kinds[before] & END) != 0)
        one, two = (np.union1d(to[marked | (lines >= n)], stops) for n in (1, 2))
        ways = [self._pieces(one, starts, stops)]
        cuts = self._cuts(two, starts, h)
        if len(cuts) or len(one) != len(two) or len(ways[0][0]) > len(one):
            ways.append(self._pieces(np.union1d(two, starts[cuts]), starts, stops))
        return h, found.firsts, ways

    def _pieces(self, ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
        begins = np.append(0, ends[:-1])
        begins[1:] += np.isin(ends[:-1], stops)
        upto = np.searchsorted(starts, ends)
        first = np.append(0, upto[:-1])
        longest = self.given[2]
        parts = np.maximum(1, -(-(upto - first) // longest))
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        words = np.repeat(first, parts) + longest * inner
        start = np.where(inner == 0, np.repeat(begins, parts), starts[np.minimum(words, len(starts) - 1)] if len(starts) else 0)
        stop = np.append(start[1:], ends[-1])
        last = np.cumsum(parts) - 1
        stop[last] = ends
        return np.searchsorted(stops, start), words, np.minimum(np.repeat(upto, parts) - words, longest), start, stop

    def _cuts(self, ends: np.ndarray, starts: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Words before which a long sentence is cut."""
        n = len(h)
        bounds = np.unique(np.concatenate([[0], np.searchsorted(starts, ends), [n]]))
        long = np.diff(bounds) > self.given[2]
        if not long.any():
            return np.zeros(0, np.int64)
        pair = np.full(n, np.iinfo(np.uint64).max)
        pair[1:] = mixed(h[:-1] * ODD[0] ^ h[1:])
        pair[bounds[:-1]] = np.iinfo(np.uint64).max
        least = np.repeat(long, np.diff(bounds))
        for k in range(1, NEAR + 1):
            least[k:] &= pair[k:] < pair[:-k]
            least[:-k] &= pair[:-k] <= pair[k:]
        at = np.flatnonzero(least)
        mine = np.searchsorted(bounds, at, "right") - 1
        return at[(at - bounds[mine] >= NEAR) & (bounds[mine + 1] - at >= NEAR)]

    def spans(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Text, from, to (its words) and two hashes of the shortest runs from each and up to each sentence that have one."""
        h, firsts, ways = self.read(texts)
        least, words, _ = self.given
        found = []
        for text, first, count, _, _ in ways:
            worded = count > 0
            owner, at = text[worded], np.append(first[worded], len(h))
            k = np.arange(len(owner))
            end = np.maximum(k + least, np.searchsorted(at, at[:-1] + words))
            good = end <= np.searchsorted(at, firsts[owner + 1])
            found.append((at[k[good]] << 32) | at[end[good]])
            start = np.minimum(k + 1 - least, np.searchsorted(at, at[1:] - words, "right") - 1)
            good = start >= np.searchsorted(at, firsts[owner])
            found.append((at[start[good]] << 32) | at[k[good] + 1])
        both = np.unique(np.concatenate(found))
        start, stop = both >> 32, both & 0xFFFFFFFF
        owner = np.searchsorted(firsts, start, "right") - 1
        hashes = [powers.runs(h, start, stop) for powers in POWERS]
        return owner, start - firsts[owner], stop - firsts[owner], *hashes

    def without(self, texts: list[str], gone: list[list[dict]]) -> list[tuple[str, int, int, list[dict]]]:
        """For each text what stays without the spans (words) that go, its sentences, those of which something goes, and what goes in characters."""
        _, firsts, ways = self.read(texts)
        begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
        bounds = [np.searchsorted(w[0], np.arange(len(texts) + 1)) for w in ways]
        out = []
        for i, (text, spans) in enumerate(zip(texts, gone, strict=True)):
            parts = [[x[b[i] : b[i + 1]] for x in w[1:]] for w, b in zip(ways, bounds, strict=True)]
            ranges: list[dict] = []
            if not spans:
                out.append((text, len(parts[0][0]), 0, ranges))
                continue
            begins, ends = {}, {}  # the first way of cutting counts first
            for first, count, start, stop in reversed(parts):
                worded = count > 0
                begins |= dict(zip((first[worded] - firsts[i]).tolist(), (start[worded] - begin[i]).tolist()))
                ends |= dict(zip(((first + count)[worded] - firsts[i]).tolist(), (stop[worded] - begin[i]).tolist()))
            for a, b in sorted((begins[s["start"]], ends[s["stop"]]) for s in spans):
                if ranges and a <= ranges[-1]["stop"]:
                    ranges[-1]["stop"] = max(b, ranges[-1]["stop"])
                else:
                    ranges.append({"start": a, "stop": b})
            kept = zip([0, *[r["stop"] for r in ranges]], [*[r["start"] for r in ranges], len(text)])
            _, _, start, stop = parts[0]
            after = np.searchsorted(np.array([r["stop"] for r in ranges]), start - begin[i], "right")
            hit = np.append([r["start"] for r in ranges], len(text) + 1)[after] < stop - begin[i]
            out.append(("".join([text[a:b] for a, b in kept]), len(start), int(hit.sum()), ranges))
        return out


def sentences_of(text: str, longest: int = LONGEST) -> list[tuple[int, int, int, int]]:
    """(from, to, first word, number of words) of each sentence, the first way; places in characters, white space after it included."""
    _, _, ways = Cutter(longest=longest).read([text])
    first, count, start, stop = (x.tolist() for x in ways[0][1:])
    return list(zip(start, stop, first, count, strict=True))


#: Columns that are added; ones of docs with these names give way.
RESULTS = ("n_sentences", "n_removed", "removed_spans")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, words: int = WORDS, longest: int = LONGEST) -> DataFrame:
    """All columns of docs with the text deduplicated, and n_sentences, n_removed (long), removed_spans (characters of the old text)."""
    docs, names, back = by_place(docs, RESULTS)
    id_col, text_col = names[id_col], names[text_col]
    rows = numbered(docs, "__uid").withColumn("__none", F.col(f"`{id_col}`").isNull())
    context, cutter = docs.sparkSession.sparkContext, Cutter(sentences, words, longest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in in_parts(batch):
                h, times = np.unique(cutter.spans(texts)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times > 1)], names=["h1", "more"])

    counts = rows.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "h1 long, more boolean")
    twice = materialise(counts.groupBy("h1").agg(F.count("*").alias("n"), F.max("more").alias("more")).where((F.col("n") > 1) | F.col("more")).select("h1"), "twice")
    shared = context.broadcast(key_bitmap(twice, F.col("h1"), twice.count()))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in in_parts(batch):
                some = cutter.spans(texts)
                repeated = may_hold(shared.value, some[3])
                owner, start, stop, h1, h2 = (x[repeated] for x in some)
                at = pa.array(rows[owner])
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *[batch.column(c).take(at) for c in ("none", "id", "uid")], pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["h1", "h2", "none", "id", "uid", "start", "stop"])

    source = rows.select(F.col("__none").alias("none"), F.col(f"`{id_col}`").alias("id"), F.col("__uid").alias("uid"), F.col(f"`{text_col}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    found = materialise(source.mapInArrow(spans, f"h1 long, h2 long, none boolean, id {kind}, uid long, start int, stop int"), "spans")
    place = F.struct("none", "id", "uid", "start")
    repeated = found.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where(F.col("copies") > 1)
    repeated = materialise(repeated.select("h1", "h2", F.col("first.uid").alias("first_uid"), F.col("first.start").alias("first_start")), "repeated")
    later = found.join(shuffled(repeated), ["h1", "h2"]).where((F.col("uid") != F.col("first_uid")) | (F.col("start") != F.col("first_start")))
    gone = materialise(later.select("uid", "start", "stop"), "gone").groupBy(F.col("uid").alias("__uid")).agg(F.collect_list(F.struct("start", "stop")).alias("__gone"))
    halves = possible(rows, F.col("__uid"), gone, F.col("__uid"))
    touched = halves.where("__possible").join(shuffled(gone), "__uid", "left")
    both = touched.unionByName(halves.where("not __possible").withColumn("__gone", F.lit(None).cast(gone.schema["__gone"].dataType)))
    both = both.withColumn("__both", F.struct(F.col(f"`{text_col}`").alias("text"), F.col("__gone").alias("gone")))
    others = [c for c in docs.columns if c != text_col]

    def cut(values: list[dict]) -> list[pa.Array]:
        full = [v for v in values if v["text"]]
        found = iter(cutter.without([v["text"] for v in full], [v["gone"] or [] for v in full]) if full else [])
        done = [next(found) if v["text"] else (v["text"], 0, 0, []) for v in values]
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return [pa.array(x, kind) for x, kind in zip(zip(*done), (pa.string(), pa.int64(), pa.int64(), span), strict=True)]

    out = map_texts(both, "__both", others, "__new string, n_sentences long, n_removed long, removed_spans array<struct<start:bigint,stop:bigint>>", cut, PART)
    order = [F.col("__new").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*order, *RESULTS).select(*back, *RESULTS)
