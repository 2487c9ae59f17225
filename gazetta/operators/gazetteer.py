"""Names in text: vice-county numbers, and dictionaries of phrases of any size (the longest match wins).

A dictionary is a table.  Texts are cut into words once; every run of as many words as some phrase has is held to a bitmap
of the phrases' hashes, whose size has a bound, and those that it lets pass are looked up by an equi-join on the words
themselves.  So the work follows the words of the texts, not texts times phrases, and what is shuffled follows the matches;
a bitmap at its bound only lets more pass.  Dictionaries are broadcast only up to BROADCAST_BYTES of phrases, which is
checked; of larger ones that much is, the phrases that are commonest in a part of the texts, and runs that may be one of the
others are joined by shuffling, where adaptive execution splits phrases that very many texts hold.  Which phrases are
broadcast changes no result.  Only matches are gathered, by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bitmaps import key_bitmap, may_hold, run_hashes
from ..functions.text import ref
from ..session import materialise

#: Bytes of phrases sent to every executor at most.
BROADCAST_BYTES = 16 << 20
#: Share of the texts by which the commonest phrases of a larger dictionary are told; all texts are searched for all phrases.
SHARE_COUNTED = 1 / 32
#: A word: letters and digits, joined by single marks, and a full stop right behind it (of an abbreviation or a sentence).
WORD = r"[\p{L}\p{N}]+(?:[-'’/][\p{L}\p{N}]+)*\.?"
GAP = r"[^\p{L}\p{N}]+"

#: The vice-counties 1 to 113.
VICE_COUNTIES = (
    "West Cornwall", "East Cornwall", "South Devon", "North Devon", "South Somerset", "North Somerset", "North Wiltshire", "South Wiltshire",
    "Dorset", "Isle of Wight", "South Hampshire", "North Hampshire", "West Sussex", "East Sussex", "East Kent", "West Kent", "Surrey",
    "South Essex", "North Essex", "Hertfordshire", "Middlesex", "Berkshire", "Oxfordshire", "Buckinghamshire", "East Suffolk", "West Suffolk",
    "East Norfolk", "West Norfolk", "Cambridgeshire", "Bedfordshire", "Huntingdonshire", "Northamptonshire", "East Gloucestershire",
    "West Gloucestershire", "Monmouthshire", "Herefordshire", "Worcestershire", "Warwickshire", "Staffordshire", "Shropshire", "Glamorgan",
    "Breconshire", "Radnorshire", "Carmarthenshire", "Pembrokeshire", "Cardiganshire", "Montgomeryshire", "Merionethshire", "Caernarvonshire",
    "Denbighshire", "Flintshire", "Anglesey", "South Lincolnshire", "North Lincolnshire", "Leicestershire", "Nottinghamshire", "Derbyshire",
    "Cheshire", "South Lancashire", "West Lancashire", "South-east Yorkshire", "North-east Yorkshire", "South-west Yorkshire",
    "Mid-west Yorkshire", "North-west Yorkshire", "County Durham", "South Northumberland", "North Northumberland", "Westmorland", "Cumberland",
    "Isle of Man", "Dumfriesshire", "Kirkcudbrightshire", "Wigtownshire", "Ayrshire", "Renfrewshire", "Lanarkshire", "Peeblesshire",
    "Selkirkshire", "Roxburghshire", "Berwickshire", "East Lothian", "Midlothian", "West Lothian", "Fifeshire", "Stirlingshire",
    "West Perthshire", "Mid Perthshire", "East Perthshire", "Angus", "Kincardineshire", "South Aberdeenshire", "North Aberdeenshire",
    "Banffshire", "Moray", "East Inverness-shire", "West Inverness-shire", "Argyll", "Dunbartonshire", "Clyde Isles", "Kintyre",
    "South Ebudes", "Mid Ebudes", "North Ebudes", "West Ross", "East Ross", "East Sutherland", "West Sutherland", "Caithness",
    "Outer Hebrides", "Orkney", "Shetland", "Channel Islands",
)
#: Abbreviations of countries, counties, administrative units and features, and what they stand for.
ABBREVIATIONS = (
    ("Hispan.", "Spain"), ("Hispania", "Spain"), ("Germ.", "Germany"), ("Germania", "Germany"), ("Ital.", "Italy"), ("Italia", "Italy"),
    ("Graecia", "Greece"), ("Grecia", "Greece"), ("Gallia", "France"), ("Hunts.", "Huntingdonshire"), ("Bucks", "Buckinghamshire"),
    ("Heref.", "Herefordshire"), ("Herefs.", "Herefordshire"), ("Aberdeens.", "Aberdeenshire"), ("B.Alp", "Basses-Alpes"), ("Pyr. or.", "Pyrénées-Orientales"),
    ("Co.", "County"), ("Prov.", "Province"), ("Pr.", "Province"), ("Dept.", "Department"), ("Distr.", "District"), ("VC", "Vice County"),
    ("Mt.", "Mount"), ("Mts.", "Mountains"), ("R.", "River"), ("L.", "Lake"), ("Lk.", "Lake"), ("Is.", "Island"), ("Isl.", "Island"), ("Pt.", "Point"),
)
_NUMBERED = r"(?i)(?<![\p{L}\p{N}])v\.?\s?c\.?\s?(\d{1,3})(?![\p{L}\p{N}])"


def vice_counties(text: Column) -> Column:
    """array of struct(number, name) of the vice-counties whose numbers a text gives (VC5, VC 12, v.c. 3), in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_NUMBERED), F.lit(1))
    names = F.split(F.lit("|".join(VICE_COUNTIES)), r"\|")
    each = F.transform(F.array_distinct(F.transform(found, lambda n: n.cast("int"))), lambda n: F.struct(n.alias("number"), F.get(names, n - 1).alias("name")))
    return F.filter(each, lambda v: v["name"].isNotNull())


def with_vice_county(df: DataFrame, text_col: str, region_col: str = "region", notes_col: str = "notes") -> DataFrame:
    """Adds region (the first vice-county's name) and notes (its number, and whether the text names no county besides)."""
    first = F.get(vice_counties(ref(text_col)), F.lit(0))
    alone = F.regexp_replace(ref(text_col), _NUMBERED, "").rlike(r"\p{L}")
    note = F.concat(F.lit("VC "), F.col("__vc.number").cast("string"), F.when(F.col("__alone"), F.lit(" (county name inferred)")).otherwise(F.lit("")))
    return df.withColumn("__vc", first).withColumn("__alone", ~alone).withColumns({region_col: F.col("__vc.name"), notes_col: note}).drop("__vc", "__alone")


def abbreviations(spark: SparkSession) -> DataFrame:
    """The dictionary of fixed abbreviations: phrase, expansion."""
    return spark.createDataFrame(list(ABBREVIATIONS), "phrase string, expansion string")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _bare(words: Column, exact_case: bool) -> Column:
    """The words as they are compared: without a full stop behind them."""
    return F.transform(words, lambda w: F.rtrim(w, F.lit(".")) if exact_case else F.lower(F.rtrim(w, F.lit("."))))


def _stops(words: Column) -> Column:
    return F.transform(words, lambda w: w.endswith("."))


def _entries(dictionary: DataFrame, phrase_col: str, exact_case: bool) -> DataFrame:
    """One row a key and its full stops: the entry, of phrases with the same words and stops the first in order, and its rank in the key: those that ask for more stops are higher."""
    rows = dictionary.select(_words(ref(phrase_col)).alias("words"), F.struct(*[ref(c) for c in dictionary.columns]).alias("entry"), ref(phrase_col).alias("phrase"))
    rows = rows.where(F.size("words") > 0).select(F.array_join(_bare(F.col("words"), exact_case), " ").alias("key"), _stops(F.col("words")).alias("dots"), "phrase", "entry")
    rows = rows.groupBy("key", "dots").agg(F.min_by("entry", F.struct("phrase", F.to_json("entry"))).alias("entry"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.size(F.filter("dots", lambda d: d)), F.to_json("entry"))))


def matches(df: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, phrase_col: str = "phrase", exact_case: bool = False) -> DataFrame:
    """One row for each row of df that holds a phrase: id and found, an array of struct(start, size, entry, stop), in order.

    start and size count words; stop: a full stop that is not the phrase's ends the last one.  Matches do not overlap: from left to right, the longest at each place wins.  A full stop in
    a phrase must be in the text; one in the text need not be in the phrase.  id: unique, not null."""
    entries = _entries(dictionary, phrase_col, exact_case)
    hashes = materialise(entries.select("key", _whole(_hashes(F.split("key", " "))).alias("h"), F.size("dots").alias("n"), (F.octet_length("key") + 64).alias("bytes")), "phrases")
    shape = hashes.groupBy("n").agg(F.sum("bytes").alias("bytes")).collect()  # one row for each length of phrases
    sizes = sorted(r["n"] for r in shape)
    rows = df.select(ref(id_col).alias("id"), ref(text_col).alias("text"))
    if sum(r["bytes"] for r in shape) <= BROADCAST_BYTES:
        held = _held(_candidates(rows, hashes, sizes, exact_case), F.broadcast(entries))
    else:
        common = _common(_candidates(rows.sample(SHARE_COUNTED, 7), hashes, sizes, exact_case), hashes)
        near, far = ([t.join(F.broadcast(common), "key", how) for t in (hashes, entries)] for how in ("left_semi", "left_anti"))
        held = _held(_candidates(rows, near[0], sizes, exact_case), F.broadcast(near[1])).unionByName(_held(_candidates(rows, far[0], sizes, exact_case), far[1].hint("merge")))
    # in order; the longest first, and of entries that differ in full stops alone, the one that asks for most of them
    place = F.struct((-F.col("start")).alias("back"), "size", "rank", "entry", "stop")
    by_place = held.repartition("id").groupBy("id").agg(F.sort_array(F.collect_list(place), asc=False).alias("all"))
    kind = by_place.schema["all"].dataType.simpleString()
    kept = F.aggregate("all", F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("kept")), lambda a, m: F.when(-m["back"] >= a["end"], F.struct((m["size"] - m["back"]).alias("end"), F.concat(a["kept"], F.array(m)).alias("kept"))).otherwise(a))
    found = F.transform(kept["kept"], lambda m: F.struct((-m["back"]).alias("start"), m["size"].alias("size"), m["entry"].alias("entry"), m["stop"].alias("stop")))
    return by_place.select(F.col("id").alias(id_col), found.alias("found"))


def _candidates(rows: DataFrame, hashes: DataFrame, sizes: list[int], exact_case: bool) -> DataFrame:
    """rows: id, text.  The runs of words that may be a phrase: id, start, key and there (which words end with a full stop)."""
    both = hashes.select(F.explode(F.array("h", F.shiftrightunsigned("h", 32))).alias("h"))  # two bits for each phrase
    bitmap = rows.sparkSession.sparkContext.broadcast(key_bitmap(both, F.col("h"), 2 * hashes.count()))
    cut = rows.select("id", _words(F.col("text")).alias("words")).select("id", _bare(F.col("words"), exact_case).alias("bare"), _stops(F.col("words")).alias("stops"))
    cut = cut.select("id", "bare", "stops", _possible(_hashes(F.col("bare")), bitmap, sizes).alias("runs"))
    each = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), F.array_join(F.slice("bare", r["start"] + 1, r["size"]), " ").alias("key"), F.slice("stops", r["start"] + 1, r["size"]).alias("there")))
    return cut.select("id", F.explode(each).alias("run")).select("id", "run.*")


def _common(candidates: DataFrame, hashes: DataFrame) -> DataFrame:
    """The keys met most often, as many as BROADCAST_BYTES hold."""
    met = materialise(candidates.groupBy("key").agg(F.count("*").alias("met")).join(hashes.groupBy("key").agg(F.sum("bytes").alias("bytes")).hint("merge"), "key").withColumn("much", F.floor(F.log2("met"))), "phrases-met")
    least, room = 64, BROADCAST_BYTES
    for r in met.groupBy("much").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("much")).collect():  # at most 64 rows
        if (room := room - r["bytes"]) < 0:
            break
        least = r["much"]
    return met.where(F.col("much") >= least).select("key")


def _held(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """The candidates that are phrases: id, start, size, rank, entry and stop."""
    met = candidates.join(entries, "key").where(F.forall(F.arrays_zip("there", "dots"), lambda z: z["there"] | ~z["dots"]))
    ends = F.element_at("there", -1) & ~F.element_at("dots", -1)
    return met.select("id", "start", F.size("dots").alias("size"), "rank", "entry", ends.alias("stop"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _cut(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All hashes one after another, unsigned, and where each row's begin and end."""
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[at[0] : at[-1]].view(np.uint64), at - at[0]


def _whole(phrases: Column) -> Column:
    """The hash of a phrase, from its words' hashes."""

    def run(rows: pa.Array) -> pa.Array:
        words, at = _cut(rows)
        sizes, out = np.diff(at), np.zeros(len(rows), np.uint64)
        for n, hashes in run_hashes(words, max(sizes, default=0)):
            out[sizes == n] = hashes[at[:-1][sizes == n]]
        return pa.array(out.view(np.int64))

    return F.arrow_udf(run, "long")(phrases)


def _possible(words: Column, bitmap: Broadcast, sizes: list[int]) -> Column:
    """All runs, of as many words as some phrase has, that the bitmap lets pass, from the words' hashes."""

    def run(rows: pa.Array) -> pa.Array:
        words, at = _cut(rows)
        ends, starts, lengths = np.repeat(at[1:], np.diff(at)), [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for n, hashes in run_hashes(words, max(sizes, default=0)):
            if n in sizes:
                place = np.flatnonzero(may_hold(bitmap.value, hashes))
                place = place[may_hold(bitmap.value, hashes[place] >> np.uint64(32))]
                starts.append(place := place[place + n <= ends[place]])
                lengths.append(np.full(len(place), n, np.int32))
        order = np.argsort(place := np.concatenate(starts), kind="stable")
        place, size = place[order], np.concatenate(lengths)[order]
        cuts = np.searchsorted(place, at)
        start = (place - np.repeat(at[:-1], np.diff(cuts))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(size)], ["start", "size"]))

    return F.arrow_udf(run, "array<struct<start:int,size:int>>")(words)


def expanded(df: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, out_col: str, phrase_col: str = "phrase", value_col: str = "expansion", exact_case: bool = True) -> DataFrame:
    """Adds the text with every phrase of the dictionary replaced by its value; all else stays as it is, null stays null."""
    found = matches(df, dictionary, id_col, text_col, phrase_col, exact_case)
    places = F.map_from_entries(F.transform("found", lambda m: F.struct(m["start"], F.struct(m["size"].alias("size"), F.concat(m["entry"][value_col].cast("string"), F.when(m["stop"], ".").otherwise("")).alias("value")))))
    found = found.select(ref(id_col).alias("__id"), places.alias("__places"))
    met = df.join(found, ref(id_col) == F.col("__id"), "left")
    pieces = F.regexp_extract_all(ref(text_col), F.lit(f"{WORD}|{GAP}"), F.lit(0))
    # (next word's number, words still to leave out, text so far)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        here = F.try_element_at("__places", a["n"])
        word = p.rlike(r"^[\p{L}\p{N}]")
        replaced = F.struct((a["n"] + 1).alias("n"), (here["size"] - 1).alias("skip"), F.concat(a["out"], F.array(here["value"])).alias("out"))
        passed = F.struct((a["n"] + 1).alias("n"), (a["skip"] - 1).alias("skip"), a["out"].alias("out"))
        kept = F.struct((a["n"] + word.cast("int")).alias("n"), a["skip"].alias("skip"), F.concat(a["out"], F.array(p)).alias("out"))
        return F.when(word & (a["skip"] > 0), passed).when(~word & (a["skip"] > 0), a).when(word & here.isNotNull(), replaced).otherwise(kept)

    text = F.when(F.col("__places").isNull(), ref(text_col)).otherwise(F.array_join(F.aggregate(pieces, start, step)["out"], ""))
    return met.withColumn(out_col, text).drop("__id", "__places")
