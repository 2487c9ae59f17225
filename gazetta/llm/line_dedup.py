"""Line dedup over content-defined chunks of lines.

A text is a list of lines.  A rolling hash over the hashes of two successive lines chooses boundaries: a chunk starts
where that hash is less than those before and after it, so boundaries depend on content alone, shift with it, and no
chunk has fewer than two lines.  Chunks that occur more than once in the corpus are found by hash and confirmed by their
bytes; all occurrences but the first (by id, then file order, then place) go.

A passage's lines before its first and after its last boundary lie in chunks that differ, as do all lines of a passage
without a boundary.  An exact check follows for them: of every two successive lines that are not both in a chunk that
goes, all occurrences but the first go too, again found by hash and confirmed by bytes.  So every run of two or more lines
seen before goes from its first line to its last; of each line one copy stays.

Only built-in functions run on the executors.  Chunks are counted by hash with map-side aggregation; occurrences are
joined to the repeated hashes, both read from tables, so a chunk that a third of all documents hold is split.

Defined cases: null text stays null and empty text stays empty; chunks of white space only are never removed by
themselves (of three or more successive blank lines the inner ones stay); a pair that overlaps its own first occurrence
is no copy; repeated rows count as further occurrences; ties in id are broken by file order; null ids come last; an empty
table gives no rows; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, materialise, numbered, possible, shuffled

PAIR = 2


def _at(start: Column, text: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), text.alias("chunk"))


def content_chunks(lined: DataFrame) -> DataFrame:
    """lined: lines (two or more) and others.  The others, start, n (lines) and chunk, its lines marked C (the first) or L.

    No lambda looks into another array, so the work is linear.  The outer form keeps the optimizer from making the whole list
    once more in a filter before it is unfolded; what it adds for empty lists, a null, fails the test for white space."""
    others = [c for c in lined.columns if c != "lines"]
    n = F.size("lines")
    hashed = lined.withColumn("h", F.transform("lines", lambda x: F.xxhash64(x)))
    rolled = hashed.withColumn("r", F.zip_with(F.slice("h", F.lit(1), n - 1), F.slice("h", F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))).drop("h")
    inner = F.greatest(n - 3, F.lit(0))
    below = [F.zip_with(F.slice("r", F.lit(2), inner), F.slice("r", F.lit(k), inner), lambda a, b: a < b) for k in (1, 3)]
    marked = rolled.withColumn("least", F.zip_with(*below, lambda a, b: a & b)).drop("r")
    marks = F.concat(F.array(F.lit("C"), F.lit("L")), F.transform("least", lambda x: F.when(x, F.lit("C")).otherwise(F.lit("L"))), F.array(F.lit("L")))
    marked = marked.withColumn("marks", F.slice(marks, F.lit(1), n)).drop("least")
    starts = F.filter(F.transform("marks", lambda m, i: F.when(m == "C", i)), lambda i: i.isNotNull())
    chunks = F.split(F.array_join(F.zip_with("marks", "lines", lambda m, x: F.concat(m, x)), "\n"), "\n(?=C)", -1)
    each = marked.select(*others, F.inline_outer(F.zip_with(starts, chunks, _at)))
    return each.where(F.col("chunk").rlike(r"(?:^|\n)[CL][^\n]*\S")).withColumn("n", F.length("chunk") - F.length(F.replace("chunk", F.lit("\n"))) + 1)


def pairs_of_lines(lined: DataFrame) -> DataFrame:
    """lined: lines (two or more), within (starts of pairs that are left out) and others.  The others, start, n (2) and chunk."""
    others = [c for c in lined.columns if c not in ("lines", "within")]
    n = F.size("lines")
    pairs = F.zip_with(F.slice("lines", F.lit(1), n - 1), F.slice("lines", F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit("\n"), b))
    paired = lined.withColumn("pairs", F.transform(pairs, lambda x, i: _at(i, x)))
    left = F.transform(F.array_except(F.sequence(F.lit(0), n - 2), "within"), lambda i: F.get(F.col("pairs"), i))
    each = paired.withColumn("left", F.when(F.size("within") > 0, left).otherwise(F.col("pairs"))).select(*others, F.inline_outer("left"))
    return each.where(F.col("chunk").rlike(r"\S")).withColumn("n", F.lit(PAIR))


def _later(counted: DataFrame, chunks: DataFrame) -> DataFrame:
    """counted: chunk; chunks: uid, id, start, n, chunk.  uid, start, n of the occurrences that go."""
    digest = F.xxhash64("chunk")
    repeated = materialise(counted.select(digest.alias("digest")).groupBy("digest").agg(F.count("*").alias("copies")).where(F.col("copies") > 1).select("digest"), "chunks")
    maybe = possible(chunks.withColumn("digest", digest), F.col("digest"), repeated, F.col("digest")).where("__possible")  # only these texts are sent
    place = F.struct(F.col("id").isNull().alias("none"), "id", "uid", "start")
    found = materialise(maybe.join(shuffled(repeated), "digest").select("digest", place.alias("place"), "n", "chunk"), "occurrences")
    firsts = found.groupBy("digest", "chunk").agg(F.min("place").alias("first"), F.count("*").alias("copies")).where(F.col("copies") > 1)  # by bytes
    apart = (F.col("place.uid") != F.col("first.uid")) | (F.col("place.start") >= F.col("first.start") + F.col("n"))
    return materialise(found.join(shuffled(firsts), ["digest", "chunk"]).where(apart).select(F.col("place.uid").alias("uid"), F.col("place.start").alias("start"), "n"), "gone")


def _with(rows: DataFrame, gone: DataFrame, uid: str, name: str) -> DataFrame:
    """rows with the list ``name`` of what goes (start, n), null where nothing does."""
    lists = gone.groupBy(F.col("uid").alias(uid)).agg(F.collect_list(F.struct("start", "n")).alias(name))
    halves = possible(rows, F.col(uid), gone, F.col("uid"))
    touched = halves.where("__possible").join(shuffled(lists), uid, "left")
    return touched.unionByName(halves.where("not __possible").withColumn(name, F.lit(None).cast(lists.schema[name].dataType)))


#: Columns that are added; ones of docs with these names give way.
RESULTS = ("lines_removed", "chunks_removed")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with the text deduplicated, and lines_removed (long), chunks_removed (long, runs of lines that went)."""
    docs, names, back = by_place(docs, RESULTS)
    id_col, text_col = names[id_col], names[text_col]
    rows = numbered(docs, "__uid")
    texts = rows.select(F.col("__uid").alias("uid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.contains("text", F.lit("\n")))
    lines = F.split("text", "\n", -1)
    chunks = content_chunks(texts.select("uid", "id", lines.alias("lines")))
    in_chunks = _later(chunks, chunks)
    within = F.flatten(F.transform(F.coalesce("gone", F.array().cast("array<struct<start:int,n:int>>")), lambda g: F.sequence(g["start"], g["start"] + g["n"] - 2)))
    lined = _with(texts, in_chunks, "uid", "gone").select("uid", "id", lines.alias("lines"), within.alias("within"))
    all_pairs = texts.select(lines.alias("lines"), F.array().cast("array<int>").alias("within"))
    in_pairs = _later(pairs_of_lines(all_pairs), pairs_of_lines(lined))
    out = _with(rows, in_chunks.unionByName(in_pairs), "__uid", "__gone").withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split(F.col(f"`{text_col}`"), "\n", -1)))
    out = out.withColumn("__gone", F.array_distinct(F.flatten(F.transform("__gone", lambda g: F.sequence(g["start"], g["start"] + g["n"] - 1)))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone")), lambda i: F.get(F.col("__lines"), i))
    text = F.when(F.col("__gone").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    starts = F.array_except("__gone", F.transform("__gone", lambda x: x + 1))  # lines that went and follow none that went
    counts = [F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size(x)).cast("long").alias(c) for c, x in (("lines_removed", F.col("__gone")), ("chunks_removed", starts))]
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *counts).select(*back, *RESULTS)
