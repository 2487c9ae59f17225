"""Cases that went wrong once: patterned texts that hash alike, pairs that fit a gap of one token, workers that took too much memory."""

import random
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from gazetta.llm import langid, line_dedup, near_dedup, packing, substring_dedup, words


def _thue_morse(n, a, b):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


@pytest.mark.parametrize("join", ["", " "])
def test_patterned_texts_are_not_alike(spark, join):
    """A word of 1,024 letters, or 1,024 words, against its complement: no word or shingle in common."""
    names = ("a", "b") if not join else ("left", "right")
    texts = [join.join(_thue_morse(1024, *names)), join.join(_thue_morse(1024, *names[::-1]))]
    longer = [join.join(_thue_morse(4096, *names)), join.join(_thue_morse(4096, *names[::-1]))]
    rows = list(enumerate([*texts, *longer, texts[0].upper()]))
    out = {r.id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].class_id == out[4].class_id == 0 and out[0].class_id != out[2].class_id
    if not join:
        assert [out[i].class_size for i in range(5)] == [2, 1, 1, 1, 2]
    found = words.read([*texts, *longer])
    assert len(set(words.digests([*texts, *longer], found))) == 4
    if join:
        for powers in words.POWERS:
            assert len(set(powers.runs(found.hashes, found.firsts[:-1], found.firsts[1:]).tolist())) == 4


def test_hashes_of_words_and_runs():
    """Equal ones hash alike wherever they stand; different ones differ."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "ab", "ba", "b", "aab", "É", "漢"]) for _ in range(60)) for _ in range(30)]
    found = words.read(texts)
    flat = [w for t in texts for w in t.split()]
    assert len(set(zip(flat, found.hashes.tolist()))) == len(set(flat)) == len(set(found.hashes.tolist()))
    start = np.array(sorted(rng.sample(range(len(flat) - 8), 400)))
    stop = start + np.array([rng.randint(0, 8) for _ in start])
    for powers in words.POWERS:
        h = powers.runs(found.hashes, start, stop).tolist()
        runs = [tuple(flat[a:b]) for a, b in zip(start, stop)]
        assert len(set(zip(runs, h))) == len(set(runs)) == len(set(h))


def test_digests_follow_the_words():
    """What stands between words does not count, where one ends does; batches do not matter."""
    texts = ["One, two.", "one two", " ONE\n\ntwo!", "onetwo", "one two x", "...", "x"]
    whole = words.digests(texts, words.read(texts))
    assert whole[0] == whole[1] == whole[2] and len(set(whole)) == 5 and whole[5] is None
    for t, d in zip(texts, whole):
        assert words.digests([t], words.read([t])) == [d]


def _bin_by_bin(lengths, capacity):
    """Best-two-fit over a list: every bin greedily, then the smallest piece for the two that fit best."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        taken, gap = [], capacity
        for k in list(left):
            if k <= gap:
                taken.append(k)
                left.remove(k)
                gap -= k
        small = min(taken)
        pairs = [(x + y, x, y) for i, x in enumerate(left) for y in left[i + 1 :] if small < x + y <= small + gap]
        if gap and pairs:
            _, x, y = max(pairs)
            taken.remove(small)
            left.remove(x), left.remove(y)
            left = sorted([*left, small], reverse=True)
            taken += [x, y]
        bins.append(sorted(taken))
    return sorted(bins)


def test_two_fit_against_lists():
    rng = random.Random(2)
    cases = [([6, 3, 2, 2], 10), ([50, 40, 21, 20], 100)]
    cases += [([rng.randint(1, c) for _ in range(rng.randint(1, 30))], c) for c in (rng.choice([7, 10, 31, 100]) for _ in range(400))]
    for lengths, capacity in cases:
        histogram = {k: lengths.count(k) for k in set(lengths)}
        runs = packing.plan_bins(histogram, capacity)
        bins = sorted(sorted(k for k, n in pattern.items() for _ in range(n)) for pattern, times in runs for _ in range(times))
        assert bins == _bin_by_bin(lengths, capacity)
    assert {2, 3} == {k for k in (2, 3) if any(k in p for p, _ in packing.plan_bins({6: 1, 3: 1, 2: 2}, 10))}
    assert {6: 1, 2: 2} in [p for p, _ in packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)]
    assert {50: 1, 21: 1, 20: 1} in [p for p, _ in packing.plan_bins({50: 1, 40: 1, 21: 1, 20: 1}, 100)]


def test_clashing_columns(spark):
    """Columns named like helpers, results or file metadata, or like others in another case."""
    passage = "This is a first long sentence of some twelve words that stands in all texts.\nAnother long one of as many words follows it here and ends the passage."
    rows = [(i, f"own {i}\n{passage}\nline of {i}", *"abcdefg", i) for i in range(6)]
    names = ["doc_id", "text", "__word", "__at", "_metadata", "TEXT", "__uid", "__gone", "n_removed", "lines_removed"]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} {k}" for i, k in enumerate(["long", *["string"] * 8, "long"]))).toDF(*names)
    for operator, added in ((substring_dedup.substring_dedup, substring_dedup.RESULTS), (line_dedup.line_dedup, line_dedup.RESULTS)):
        out = operator(df)
        kept = [c for c in names if c not in added]
        assert out.columns == [*kept, *added]
        found = sorted(tuple(r) for r in out.collect())
        assert len(found) == 6 and [r[2] for r in found] == ["a"] * 6 and [r[5] for r in found] == ["d"] * 6
        assert any(r[1] != row[1] for r, row in zip(found, rows))


def _filters():
    return langid.LanguageFilters(["a", "b"], np.random.RandomState(1).randint(0, 4, (1, 1 << 12)).astype("u1"), 12, langid.ORDERS, np.array([0.1, 0.2]))


def test_ngrams_are_read_in_steps(monkeypatch):
    """Steps lose and double no n-gram, also where a text ends in them; their memory is bounded for one long text too."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé .1漢") for _ in range(rng.randrange(60))) for _ in range(50)] + ["", "a", "ab"]
    whole = _filters().counts(texts)
    alone = [_filters().counts([t]) for t in texts]
    assert (whole[0] == np.concatenate([x[0] for x in alone])).all() and (whole[1] == np.concatenate([x[1] for x in alone])).all()
    for step in (1, 2, 7):
        monkeypatch.setattr(langid, "STEP", step)
        assert all((x == y).all() for x, y in zip(whole, _filters().counts(texts)))
    monkeypatch.undo()
    long = "word and " * 300_000
    _filters().counts(["a"])
    tracemalloc.start()
    try:
        _filters().counts([long])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 35 * len(long)


def test_kept_text_is_sent_once(spark):
    docs = spark.createDataFrame([(1, "one text", "a"), (2, None, None), (3, "", "b")], "doc_id long, text string, lang string")
    out = langid.predict(docs, _filters())
    plan = out._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() != "MapInArrow":
        plan = plan.children().apply(0)
    assert plan.children().apply(0).output().size() == len(docs.columns)
    assert [tuple(r)[:3] for r in out.orderBy("doc_id").collect()] == [(1, "one text", "a"), (2, None, None), (3, "", "b")]
    few = langid.predict(docs, _filters(), keep=["doc_id"])
    assert few.columns == ["doc_id", "lang_pred", "score", "evidence"]
    assert {r.doc_id: r.lang_pred for r in few.collect()} == {r.doc_id: r.lang_pred for r in out.collect()}


def test_pipeline_sends_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, "some words of a text", "en") for i in range(8)], "doc_id long, text string, lang string")
    try:
        for given, least in (("10000", 1000), ("7", 7), ("0", 1000)):
            spark.conf.set(key, given)
            corpus_pipeline.language_id(spark, docs, "")
            assert int(spark.conf.get(key)) == least
    finally:
        spark.conf.unset(key)
