"""BPE against the tokenizers library: words, merges, round trips and the defined cases."""

import hashlib
import random
import struct

import numpy as np
import pytest

from gazetta.llm import bpe
from gazetta.llm.queries import QUERIES

LETTERS = "abcdefghij 's't're'll  \n\n\t\r\x1c\x85\xa0　 éßñ漢字かな١٢٣½😀👍🏽‍!?.,;<|endoftext|>0123\x00�ՙ́՘₏Ᲊ"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary(bpe.default_path())


def _texts(n, most, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) if rng.random() < 0.97 else "<|endoftext|>" for _ in range(rng.randint(0, most))) for _ in range(n)]


def _ids(blob):
    return list(struct.unpack(f"<{len(blob) // 4}I", blob))


def _plain_merge(symbols, ranks, made):
    """The leftmost pair of the lowest rank, looked for anew each time."""
    symbols = list(symbols)
    while found := min(((ranks[k], i) for i, k in enumerate(a << 32 | b for a, b in zip(symbols, symbols[1:])) if k in ranks), default=None):
        symbols[found[1] : found[1] + 2] = [made[found[0]]]
    return symbols


def test_tree_against_plain_search():
    """Made-up merges, so that pairs overlap, tie and follow from each other; sizes around powers of two."""
    rng = random.Random(1)
    for _ in range(400):
        ranks, made = {}, []
        for new in range(4, 4 + rng.randint(0, 12)):
            pair = rng.randrange(new) << 32 | rng.randrange(new)
            if pair not in ranks:
                ranks[pair] = len(made)
                made.append(new)
        symbols = [rng.randrange(4) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33, 64]))]
        assert bpe.merge(list(symbols), ranks, made) == _plain_merge(symbols, ranks, made)


def test_many_words_at_once(words):
    """The rows of the arrays and the single trees agree."""
    rng = random.Random(2)
    some = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 64))).encode() for _ in range(500)]
    for w, ids in zip(some, words._merged(some, 64), strict=True):
        assert _ids(ids) == bpe.merge([int(words.bytes[c]) for c in w], words.ranks, words.made)


def test_pieces(words):
    """Several parts read together are split as the library splits each of them."""
    rng = random.Random(8)
    parts = [t for t in _texts(300, 12, 9) + ["it's", "I'VE", "'tis", "we''ll", " 's", "a'r", "'", "x've're", "²½a", "a ", " \n", "\n a"] if t]
    rng.shuffle(parts)
    starts, at = [], 0
    for p in parts:
        starts += [at + a for _, (a, _) in words.split(p)]
        at += len(p)
    chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    begins = np.cumsum([0, *map(len, parts)])[:-1]
    assert words.pieces(chars, begins).tolist() == starts


def test_against_library(library, words, monkeypatch):
    texts = _texts(4000, 30) + _texts(40, 3000)
    for slice_chars, kept in ((1 << 20, 96 << 20), (50, 20_000)):
        monkeypatch.setattr(bpe, "SLICE_CHARS", slice_chars)
        monkeypatch.setattr(bpe, "KEPT_BYTES", kept)
        out = words.encode(texts)
        for t, ids in zip(texts, out, strict=True):
            assert _ids(ids) == library.encode(t, add_special_tokens=False).ids, t
            assert words.decode(ids) == t
        assert words.held < 100_000 or kept > 100_000


def test_decoding_any_ids(library, words):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.randrange(50_300) for _ in range(rng.randint(0, 12))]
        assert words.decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids, skip_special_tokens=False)


def test_long_texts(library, words):
    """Without any white space, and with nothing else."""
    rng = random.Random(6)
    for text in ("".join(rng.choice("abcdefgh") for _ in range(60_000)), "ab" * 40_000, " " * 50_000, "\n \n" * 9_000 + "x"):
        assert _ids(words.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_refused(tmp_path):
    import json

    spec = json.load(open(bpe.default_path(), encoding="utf-8"))
    (tmp_path / "x.json").write_text(json.dumps(spec | {"normalizer": {"type": "NFC"}}))
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(str(tmp_path / "x.json"))


def test_frames(spark, library):
    """Nulls, empty and long texts, repeated rows, clashing names, an empty table."""
    texts = [None, "", " ", "a b", "a b", "x" * 5000, *_texts(50, 40)]
    rows = [(i if i != 2 else None, t, 7, b"z", ["ids"], "d") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, __text int, __k0 binary, ids array<string>, Text string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    out = bpe.decode(bpe.encode(df)).toDF("doc_id", "text", "a", "b", "c", "d", "n_tokens", "ids", "decoded").collect()
    assert len(out) == len(rows)
    expected = {(r[0], r[1]): library.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    for r in out:
        assert _ids(bytes(r["ids"])) == expected[r["doc_id"], r["text"]] and r["n_tokens"] == len(r["ids"]) // 4
        assert r["decoded"] == (r["text"] or "") and (r["d"], r["a"]) == ("d", 7)
    assert bpe.decode(bpe.encode(df.where("false"))).collect() == []


def test_query(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate([None, "", "naïve <|endoftext|> text", *_texts(30, 60)])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in QUERIES["op12_bpe_round_trip"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids) and out[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
