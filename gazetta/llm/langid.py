"""Language identification by language-bitmask n-gram filters.

Fitting: character n-grams are counted for each language over a bounded sample of labelled documents; an n-gram
belongs to each language in which it comes at least ``share`` times as often as in the language that uses it most.
The filter is a bit-sliced Bloom filter: a slot holds one bit per language, so one look-up per hash gives all
languages of an n-gram at once (the AND of its slots).

Scoring: over all n-grams of the whole text, a language's count is the number of masks with its bit; as a share
``fill ** hashes`` of foreign n-grams hits a language by chance, the count is corrected to
``(count - n * fp) / (1 - fp)``.  The largest corrected count decides; ties go to the language with more documents,
then by name.  The score is the winner's part of all corrected counts; the evidence is the winner's corrected count as a
part of the text's own n-grams, which does not fall with the number of languages.

Defined cases: null text or text without any letter: ``und`` with score 0; without labelled rows all are ``und``;
empty table: no rows; further columns are ignored; repeated rows are each judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise
from .words import PART, in_parts

UNDETERMINED = "und"
#: Documents for each language that fitting expects to read (rows are taken by a hash of id and text).
SAMPLE_DOCS = 1500
SLOT_BITS = 20
ORDERS = (3, 4)
SHARE = 0.25
LEAST = 3
#: N-grams that are hashed at a time, also of one long text.
STEP = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Bool for each code point: is it a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _ngrams(texts: list[str], orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, at most STEP at a time: hashes of all n-grams and the number of the text they stand in.  Runs of other characters than letters count as one space."""
    parts = [np.frombuffer(("\n" + t.lower() + "\n").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    codes = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    is_letter = _letter_table()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of others stays, as a space
    if len(owner):
        edge = np.flatnonzero(np.diff(owner)) + 1
        keep[edge] = True
        keep[0] = True
    codes = np.where(is_letter, codes, np.uint32(32))[keep]
    owner = owner[keep]
    for n in orders:
        for at in range(0, len(codes) - n + 1, STEP):
            part, of = codes[at : at + STEP + n - 1].astype(np.uint64), owner[at : at + STEP + n - 1]
            h = np.full(len(part) - n + 1, np.uint64(n))
            for k in range(n):
                h = (h ^ part[k : len(h) + k]) * _MIX
                h ^= h >> np.uint64(29)
            same = of[: len(h)] == of[n - 1 :]
            yield h[same], of[: len(h)][same]


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (h >> np.uint64(4)) & mask, (h >> np.uint64(34)) & mask


@dataclass
class LanguageFilters:
    languages: list[str]
    words: np.ndarray  # (64-bit words, slots)
    bits: int
    orders: tuple[int, ...]
    false_positive: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the number of n-grams in the language's filter, and per text all n-grams."""
        out, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for h, owner in _ngrams(texts, self.orders):
            total += np.bincount(owner, minlength=len(texts))
            one, two = _slots(h, self.bits)
            for w, row in enumerate(self.words):
                found = row[one] & row[two]
                for b in range(min(64, len(self.languages) - 64 * w)):
                    out[:, 64 * w + b] += np.bincount(owner[(found & found.dtype.type(1 << b)) != 0], minlength=len(texts))
        return out, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For each text its language, score and evidence."""
        whole = [t or "" for t in texts]
        if not self.languages:
            return [UNDETERMINED] * len(whole), np.zeros(len(whole)), np.zeros(len(whole))
        found, total = self.counts(whole)
        right = np.clip((found - total[:, None] * self.false_positive) / (1 - self.false_positive), 0, None)
        best, sums = right.argmax(1), right.sum(1)
        score = np.where(sums > 0, right.max(1) / np.where(sums > 0, sums, 1), 1 / len(self.languages))
        known = np.array([any(map(str.isalpha, t)) for t in whole], bool)
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, np.minimum(score, 1.0), 0.0), np.where(known, np.minimum(right.max(1) / np.maximum(total, 1), 1.0), 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None, sample_docs: int = SAMPLE_DOCS, bits: int = SLOT_BITS, orders: tuple[int, ...] = ORDERS, share: float = SHARE, least: int = LEAST) -> LanguageFilters:
    """Learn the filters.  Reads about ``sample_docs`` documents per language, whole; what comes back to the driver is at most one row per slot."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"), (F.lit(True) if where is None else where).alias("__use"))
    rows = rows.where(F.col("__use") & F.col("__lang").isNotNull() & (F.col("__lang") != UNDETERMINED))
    sizes = sorted(((r["n"], r["__lang"]) for r in rows.groupBy("__lang").agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[0], x[1]))
    languages = [lang for _, lang in sizes]
    if not languages:
        return LanguageFilters([], np.zeros((1, 1 << bits), np.uint64), bits, orders)
    place = {lang: i for i, lang in enumerate(languages)}
    limit = {lang: int(min(1.0, sample_docs / n) * (1 << 30)) for n, lang in sizes}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("__lang").to_pylist()
            for rows, texts in in_parts(batch, "__text"):
                by_lang: dict[str, list[str]] = {}
                for row, text in zip(rows.tolist(), texts, strict=True):
                    by_lang.setdefault(langs[row], []).append(text)
                for lang, some in by_lang.items():
                    for h, _ in _ngrams(some, orders):
                        values, n = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.full(len(values), place[lang], "i4")), pa.array(n, pa.int64())], names=["h", "lang", "n"])

    cut = F.create_map(*[x for lang, n in limit.items() for x in (F.lit(lang), F.lit(n))])
    sample = rows.where(F.pmod(F.xxhash64("__id", "__text"), F.lit(1 << 30)) < cut[F.col("__lang")])
    grams = sample.select("__lang", "__text").mapInArrow(count, "h long, lang int, n long").groupBy("h", "lang").agg(F.sum("n").alias("n"))
    grams = materialise(grams, "ngrams")
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    weight = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(1.0 / n))]) if totals else F.create_map(F.lit(-1), F.lit(0.0))
    grams = grams.withColumn("rate", F.col("n") * weight[F.col("lang")])
    top = grams.groupBy("h").agg(F.max("rate").alias("most"))
    member = grams.where(F.col("n") >= least).join(top, "h").where(F.col("rate") >= share * F.col("most"))
    mask = (1 << bits) - 1
    slot = F.explode(F.array(F.shiftrightunsigned("h", 4).bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 34).bitwiseAND(F.lit(mask))))
    table = member.select(slot.alias("slot"), F.floor(F.col("lang") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, lang % 64)").alias("bit")).groupBy("slot", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    words = np.zeros((-(-len(languages) // 64), 1 << bits), kind)
    word, slots, found = (table.column(c).to_numpy() for c in ("word", "slot", "bits"))
    words[word, slots] = found.view(np.uint64).astype(kind)
    fill = np.array([np.count_nonzero(words[i // 64] & kind(1 << (i % 64))) / (1 << bits) for i in range(len(languages))])
    return LanguageFilters(languages, words, bits, orders, np.minimum(fill**2, 0.999))


def predict(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (by default all but clashing ones), lang_pred, score and evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def judge(texts: list[str | None]) -> list[pa.Array]:
        langs, scores, evidence = shared.value.predict(texts)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(evidence, pa.float64())]

    return map_texts(docs, text_col, [c for c in docs.columns if c not in ("lang_pred", "score", "evidence")] if keep is None else keep, "lang_pred string, score double, evidence double", judge, PART)
