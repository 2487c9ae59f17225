"""Facts read from free text: repaired encodings, positions, elevations, names; each against plain Python."""

import html
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from gazetta.functions import bitmaps, elevation, positions, repair
from gazetta.operators import coords, gazetteer


def _apply(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


def _misread(text, code):
    """UTF-8 bytes read in a single-byte code page; bytes it lacks stay control characters."""
    return "".join(bytes([b]).decode(code, "ignore") or chr(b) for b in text.encode())


LETTERS = "aé漢ñ°—“”€ŽŸ😀 ÀÿçßΩж ż"


def test_repair_undoes_damage(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts = [t for t in texts if not re.search("[\xc2-\xf4][€ŽŸ“”—\x80-\xbf]", t)]  # such as would read as damage themselves
    assert len(texts) > 200
    for code in ("cp1252", "latin-1"):
        damaged = [_misread(t, code) for t in texts]
        assert _apply(spark, repair.remade, damaged) == texts
        assert _apply(spark, repair.remade, [_misread(t, code) for t in damaged]) == texts
    assert _apply(spark, repair.remade, texts) == texts


@pytest.mark.parametrize(
    ("damaged", "mended", "flagged"),
    [
        ("Â°", "°", False), ("cafÃ©", "café", False), ("Ã‚Â°", "°", False), ("École", "École", False), ("„é“", "„é“", False), ("Ã©é", "Ã©é", True),
        ("Ã", "Ã", False), ("x�", "x�", True), ("a\x92b", "a\x92b", True), (None, None, False), ("", "", False), ("&Acirc;&deg;C", "°C", False),
    ],
)
def test_repair_cases(spark, damaged, mended, flagged):
    assert _apply(spark, repair.cleaned, [damaged]) == [mended]
    assert _apply(spark, lambda t: repair.suspicious(repair.cleaned(t)), [damaged]) == [flagged]


def test_references(spark):
    known = ["&deg;", "&amp;deg;", "&#150;", "&#xB0;", "&#XE9;", "&eacute;&Eacute;", "&lt;b&gt;", "a & b", "&&amp;", "&#128512;", "&nbsp;", "&apos;"]
    assert _apply(spark, repair.unreferenced, known) == [html.unescape(t) for t in known]
    unknown = ["&bogus;", "&#0;", "&#xD800;", "&#1114112;", "&deg", "&;", "& #176;"]
    assert _apply(spark, repair.unreferenced, unknown) == unknown


def test_positions_round_trip(spark):
    """Within what the last digit written is worth, in many ways of writing."""
    rng = random.Random(4)
    marks = [("°", "'", '"'), ("º ", "′ ", "″"), (" deg ", " min ", " sec "), ("d", "m", "s"), ("° ", "’", "''")]
    texts, truth = [], []
    for _ in range(300):
        (d, m, s), parts, digits, comma = rng.choice(marks), rng.randint(1, 3), rng.randint(0, 4), rng.random() < 0.3
        before, order, full = rng.random() < 0.4, rng.random() < 0.8, rng.random() < 0.3
        written, values = [], []
        for most, plus, minus in ((89, "N", "S"), (179, "E", "W")):
            numbers = [rng.randint(0, most), rng.randint(0, 59), rng.randint(0, 59)][:parts]
            last = numbers[-1] + (rng.randrange(10**digits) / 10**digits)
            shown = [str(x) for x in numbers[:-1]] + [f"{last:.{digits}f}".replace(".", "," if comma else ".")]
            side = rng.choice([plus, minus])
            name = {"N": "North", "S": "South", "E": "East", "W": "West"}[side] if full else side
            body = "".join(x + y for x, y in zip(shown, (d, m, s))).strip()
            written.append(f"{name} {body}" if before else f"{body} {name}")
            values.append(sum(x / 60**k for k, x in enumerate([*numbers[:-1], last])) * (1 if side == plus else -1))
        unit = 1 / 60 ** (parts - 1) / 10**digits
        pair = written if order else written[::-1]
        texts.append(f"Hill at {pair[0]}{rng.choice([', ', '; ', ' ', ' / ', ' and '])}{pair[1]}. Further 5 km")
        truth.append((*values, unit))
    for text, found, (lat, lon, unit) in zip(texts, _apply(spark, positions.positions, texts), truth, strict=True):
        assert len(found) == 1, text
        assert abs(found[0].lat - lat) < 1e-9 and abs(found[0].lon - lon) < 1e-9 and abs(found[0].unit - unit) < 1e-12, text


def test_no_positions(spark):
    none = [None, "", "91°N 3°E", "27°61'N 3°E", "27.5°30'N 3°E", "27°59'N", "10°N 20°N", "3°N 181°E", "25° C and 30° C", "27°59'N then 300 m up 15°22'W", "1234°N 5°E"]
    assert _apply(spark, positions.positions, none) == [[]] * len(none)
    two = _apply(spark, positions.positions, ["from 1°N 2°E to 3°30'S 4°W"])[0]
    assert [(p.lat, p.lon) for p in two] == [(1.0, 2.0), (-3.5, -4.0)]


def test_positions_before_the_model(spark):
    """Given coordinates and grid references go first; the verbatim text counts."""
    rows = [(1, "Hill 10°30'N 20°E", None, "5", "6"), (2, "Hill SK4480", "1°N 2°E", None, None), (3, "Hill", "1°30'N 2°E", None, None), (4, "Hill", None, None, None)]
    out = coords.preprocess(spark.createDataFrame(rows, "_row long, `Locality verbatim` string, verbatimCoordinates string, Latitude string, Longitude string")).orderBy("_row").collect()
    assert [r.pre_source for r in out] == ["coordinates_provided", "grid_reference_converted", "coordinates_extracted", "needs_ai_processing"]
    assert (out[2].pre_lat, out[2].pre_lon, out[2].pre_radius, out[2].pre_confidence) == (1.5, 2.0, None, "high")
    context = coords.preprocess(spark.createDataFrame(rows[2:3], "_row long, `Locality verbatim` string, verbatimCoordinates string, Latitude string, Longitude string")).select(coords.prompt_context()).first()[0]
    assert "1.500000, 2.000000" in context


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        ("elevation 450m", 450, 450), ("1000-1400ft", 304.8, 426.72), ("alt. 1,200 ft.", 365.76, 365.76), ("450 m a.s.l.", 450, 450), ("between 300 and 400 m", 300, 400),
        ("Elev: 1200 to 1500 feet, 5 km N", 365.76, 457.2), ("100 m - 200 m", 100, 200), ("350 ft - 120 m", 106.68, 120), ("about 2 m tall, altitude 900'", 274.32, 274.32),
        ("1 200 m", 1200, 1200), ("10 m from road, 300m", 300, 300), ("20 m. W. Kampala, alt 30 m", 30, 30), ("c. 800m", 800, 800),
        ("5km north of Darwin", None, None), ("20 m. W. Kampala", None, None), ("30 meters east of bridge", None, None), ("12000 m", None, None), ("depth 30 m", None, None),
        ("pond 20 m deep", None, None), ("room 12 men", None, None), ("400-300 m", None, None), (None, None, None), ("", None, None),
    ],
)
def test_elevations(spark, text, low, high):
    found = _apply(spark, elevation.elevation, [text])[0]
    if low is None:
        assert found is None
    else:
        assert (round(found.low, 6), round(found.high, 6), round(found.meters, 6)) == (low, high, round((low + high) / 2, 6)) and found.original in text


def test_vice_counties(spark):
    found = _apply(spark, gazetteer.vice_counties, ["VC1 and v.c. 113", "VC 0, VC114, XVC5, VC55a", "VC 25, VC25", None])
    assert [[(v.number, v.name) for v in x] for x in found] == [[(1, "West Cornwall"), (113, "Channel Islands")], [], [(25, "East Suffolk")], []]


def _brute_matches(text, phrases):
    """All phrases tried at every word, from left to right."""
    cut = lambda t: re.findall(r"[^\W_]+(?:[-'’/][^\W_]+)*\.?", t)
    bare = lambda w: w.removesuffix(".").lower()
    words, out, at = cut(text), [], 0
    while at < len(words):
        best = None
        for p in phrases:
            q = cut(p)
            here = words[at : at + len(q)]
            if q and len(here) == len(q) and all(bare(a) == bare(b) and (a.endswith(".") or not b.endswith(".")) for a, b in zip(here, q)):
                rank = (len(q), sum(b.endswith(".") for b in q))
                best = max(best or (rank, p), (rank, p), key=lambda x: x[0])
        if best:
            out.append((at, best[0][0], best[1]))
        at += best[0][0] if best else 1
    return out


@pytest.mark.parametrize("small", [True, False])
def test_longest_match(spark, monkeypatch, small):
    """Random phrases of few words, so that they overlap, nest and begin alike; broadcast and shuffled."""
    monkeypatch.setattr(gazetteer, "BROADCAST_BYTES", 1 << 20 if small else 0)
    rng = random.Random(8)
    words = ["lake", "Lake", "st.", "st", "new", "upper", "o'hara", "x"]
    phrases = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(40)})
    phrases = list({tuple((w.removesuffix(".").lower(), w.endswith(".")) for w in p.split()): p for p in phrases}.values())
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "id long, t string, entry string")
    dictionary = spark.createDataFrame([(p, len(p)) for p in phrases], "phrase string, n int")
    out = {r.id: [(m.start, m.size, m.entry.phrase) for m in r.found] for r in gazetteer.matches(df, dictionary, "id", "t").collect()}
    expected = {i: m for i, t in enumerate(texts) if (m := _brute_matches(t or "", phrases))}
    assert out == expected and len(expected) > 40


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_part_of_a_dictionary_is_broadcast(spark, monkeypatch, bits):
    """The commonest phrases stay where the texts are, the others are shuffled; a full bitmap lets all pass: the same matches."""
    monkeypatch.setattr(gazetteer, "BROADCAST_BYTES", 700)
    monkeypatch.setattr(gazetteer, "SHARE_COUNTED", 1.0)
    monkeypatch.setattr(bitmaps, "LEAST_BITS", bits)
    monkeypatch.setattr(bitmaps, "MOST_BITS", bits)
    split = []
    monkeypatch.setattr(gazetteer, "_common", lambda *a, f=gazetteer._common: split.append(f(*a)) or split[-1])
    rng = random.Random(9)
    words = ["lake", "Lake", "st.", "st", "new", "upper", "o'hara", "x", "straße", "Ås"]
    phrases = list({tuple((w.removesuffix(".").lower(), w.endswith(".")) for w in p): " ".join(p) for p in ([rng.choice(words) for _ in range(rng.randint(1, 3))] for _ in range(40))}.values())
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    dictionary = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    out = {r.id: [(m.start, m.size, m.entry.phrase) for m in r.found] for r in gazetteer.matches(df, dictionary, "id", "t").collect()}
    assert out == {i: m for i, t in enumerate(texts) if (m := _brute_matches(t or "", phrases))}
    assert 0 < split[0].count() < len(phrases) / 2


def test_runs_that_are_no_phrase_are_not_shuffled(spark, monkeypatch):
    """Of 40,000 runs of two and three words two are phrases; the join gets few others."""
    seen = []
    monkeypatch.setattr(gazetteer, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(gazetteer, "_held", lambda c, e, f=gazetteer._held: seen.append(c) or f(c, e))
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    dictionary = spark.createDataFrame([("W3x7 w3x8",), ("w99x197 w99x198 w99x199",), ("not there",)], "phrase string")
    found = gazetteer.matches(df, dictionary, "id", "t").collect()
    assert sorted((r.id, m.start, m.size) for r in found for m in r.found) == [(3, 7, 2), (99, 197, 3)]
    assert sum(c.count() for c in seen) < 100


def test_expansion(spark):
    texts = ["Hispan., Prov. Jaen, Mt. Mulhacen.", "R. Ouse, Hunts. Is it?", "Pyr. or., L. Bleu.", "Italia. Gallia", None, "", "  no\tphrase  ", "Co. Durham; Pt. 3 Co Mayo", "VC VC"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = [r.x for r in gazetteer.expanded(df, gazetteer.abbreviations(spark), "id", "t", "x").orderBy("id").collect()]
    assert out == ["Spain, Province Jaen, Mount Mulhacen.", "River Ouse, Huntingdonshire Is it?", "Pyrénées-Orientales, Lake Bleu.", "Italy. France", None, "", "  no\tphrase  ", "County Durham; Point 3 Co Mayo", "Vice County Vice County"]
    none = gazetteer.abbreviations(spark).where("false")
    assert [r.x for r in gazetteer.expanded(df, none, "id", "t", "x").orderBy("id").collect()] == texts


def test_fixed_values():
    assert len(gazetteer.VICE_COUNTIES) == 113 and len(set(gazetteer.VICE_COUNTIES)) == 113
    assert all(a != b for (a, _), (b, _) in itertools.combinations(gazetteer.ABBREVIATIONS, 2))


def test_values_are_computed_once(spark):
    """Expressions with lambdas are interpreted: a value mentioned twice is computed twice, and rounds multiply."""
    assert str(repair.remade(F.col("t"), 2)).count("regexp_extract_all") == 2
    assert str(repair.remade(repair.unreferenced(F.col("t")), 2)).count("regexp_extract_all") == 3
    assert str(positions.positions(F.col("t"))).count("regexp_extract_all") == 2


def test_runs_of_many_alphabets(spark):
    """Long runs without suspect characters, between damaged ones, stay as they are."""
    good = "ascii " * 5000 + "漢字 mixed " * 5000
    df = spark.createDataFrame([(good + "é".encode().decode("latin-1") + good, good + "é" + good)], "hurt string, want string")
    assert df.where(repair.remade(F.col("hurt")) == F.col("want")).count() == 1
