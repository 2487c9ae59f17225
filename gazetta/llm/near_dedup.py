"""Near-duplicate classes by improved consistent weighted sampling (ICWS).

Shingles are runs of five words (a shorter text is one shingle); a shingle's weight is its count in the document times
the mean inverse document frequency of its words.  Frequencies are counted over all documents; a word in fewer than
one of ``rare`` documents gets the frequency 1 / ``rare``, which bounds the table of words that must be known.  (The
frequency of whole shingles would depend on the size of the copy group itself: the larger the group, the less its
common text would weigh against each copy's edits, and its members would no longer be found alike.)

Each of ``bands * rows`` samples draws a shingle and a level with probability proportional to weight, so two
documents agree on a sample with probability equal to their weighted Jaccard similarity.  Documents that agree on a
whole band are candidates.  Candidates are verified by exact weighted Jaccard similarity; classes are the connected
components of the verified links.  The same rule holds for groups of every size.

Copies (same word sequence) are one node from the start.  Each bucket's nodes are first compared with its head, the
member that shares most bands with others.  Where a bucket then still holds several classes, its nodes are joined on
their prefixes.  With shingles ordered by rarity, let ``rest`` be a node's weight from a shingle on.  At the first
shingle that two nodes share, all they share lies in both rests; for the similarity to be reached the lesser rest must be
``similar / (1 + similar)`` of both weights together, hence twice that of the lighter node's own and ``similar`` of the
heavier one's.  Only nodes of different classes that share a bucket and such a shingle are compared: edits make shingles
that are rarer than what copies share, so nodes that just miss the threshold hardly ever meet.  So no pair within a class
is made, every candidate pair that could join two classes is compared, and no task holds more than one node and a block
of others.

Defined cases: null, empty and word-less texts are classes of their own; the class id is the smallest id in the class
(null ids last; a class of null ids has a null class id); repeated rows are copies; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, joined_by_hot_key, materialise, numbered, possible, shuffled
from .words import digests, in_parts, read

SHINGLE = 5
SIMILAR = 0.8
BANDS = 16
ROWS = 4
RARE = 1000
#: Nodes compared in one task with one other; a text of more than LONG characters is compared in a task of its own.
BLOCK = 64
LONG = 1 << 16
#: Slots of the counts that order shingles by rarity.
RARITY_SLOTS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


# --- weights -------------------------------------------------------------------------------------------------------


def word_weights(docs: DataFrame, text_col: str, rare: int = RARE) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes in order and weights of the words in at least one of ``rare`` documents (at most ``rare`` x the mean words of a document), and the weight of all others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in in_parts(batch):
                found = read(texts)
                owner = np.repeat(np.arange(len(texts)), np.diff(found.firsts))
                order = np.lexsort((found.hashes, owner))
                h, owner = found.hashes[order], owner[order]
                once = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
                h, n = np.unique(h[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    total = docs.count()
    common = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * rare >= total).toArrow()
    words, n = common.column("word").to_numpy().view(np.uint64), common.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], np.log(1 + total / n[order]), math.log(1 + rare)


class Shingler:
    """Texts to weighted shingle sets."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, other: float):
        self.words, self.weights, self.other = words, weights, other

    def of_hashes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct shingles and their weights, from hashes of the words."""
        weights = np.full(len(hashes), self.other)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
            weights[known] = self.weights[at[known]]
        n = min(SHINGLE, len(hashes))
        size = len(hashes) - n + 1
        h = np.full(size, np.uint64(n))
        w = np.zeros(size)
        for k in range(n):
            h = (h ^ hashes[k : k + size]) * _MIX
            h ^= h >> np.uint64(31)
            w += weights[k : k + size]
        found, at, count = np.unique(h, return_index=True, return_counts=True)
        return found, count * w[at] / n

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.of_hashes(read([text]).hashes)


# --- signatures ----------------------------------------------------------------------------------------------------


class Sampler:
    """ICWS: for sample i, r and c are Gamma(2, 1), b uniform, all fixed by the shingle; level t = floor(ln w / r + b);
    the shingle with the least ln c - r (t - b) - r is drawn.  Quantiles of r and ln c come from tables of 2**16."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 1):
        self.bands, self.rows = bands, rows
        rng = np.random.RandomState(seed)
        self.seeds = rng.randint(1, 2**62, bands * rows).astype(np.uint64)
        at = (np.arange(1 << 16) + 0.5) / (1 << 16)
        gamma = np.empty(1 << 16)
        low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
        for _ in range(60):  # Gamma(2, 1): F(x) = 1 - (1 + x) exp(-x)
            mid = (low + high) / 2
            below = 1 - (1 + mid) * np.exp(-mid) < at
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        gamma[:] = (low + high) / 2
        self.r, self.inverse, self.ln_c = gamma.astype("f4"), (1 / gamma).astype("f4"), np.log(gamma).astype("f4")

    def _levels(self, hashes: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (hashes[:, None] ^ self.seeds[None, :]) * _MIX
        x ^= x >> np.uint64(32)
        x *= _MIX2
        x ^= x >> np.uint64(29)
        low = np.uint64(0xFFFF)
        pick = (x & low).astype(np.uint16)
        b = ((x >> np.uint64(16)) & low).astype("f4") * np.float32(1 / 65536)
        c = self.ln_c[(x >> np.uint64(32)).astype(np.uint16)]
        r = self.r[pick]
        t = np.floor(ln_w[:, None] * self.inverse[pick] + b)
        return c - r * (t - b + 1), t

    def signature(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """64-bit drawn (shingle, level) for each sample."""
        ln_w = np.log(weights).astype("f4")
        best, drawn = None, None
        for at in range(0, len(hashes), 512):  # small blocks stay in the cache
            part = hashes[at : at + 512]
            a, t = self._levels(part, ln_w[at : at + 512])
            k = a.argmin(0)
            cols = np.arange(len(k))
            value = a[k, cols]
            mine = (part[k] ^ (t[k, cols].astype(np.int64).view(np.uint64) * _MIX2)) * _MIX
            if best is None:
                best, drawn = value, mine
            else:
                less = value < best
                best, drawn = np.where(less, value, best), np.where(less, mine, drawn)
        return drawn

    def band_hashes(self, drawn: np.ndarray) -> np.ndarray:
        drawn = drawn.reshape(self.bands, self.rows)
        h = np.arange(1, self.bands + 1).astype(np.uint64) * _MIX2
        for k in range(self.rows):
            h = (h ^ drawn[:, k]) * _MIX
            h ^= h >> np.uint64(32)
        return h.view(np.int64)


def _signatures(rows: DataFrame, shingler: Shingler, sampler: Sampler) -> DataFrame:
    """rows: uid, none, id, text.  uid, none, id, k1, k2 (a digest of the word sequence; null without words), bands."""
    shared = rows.sparkSession.sparkContext.broadcast((shingler, sampler))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sample = shared.value
        for batch in batches:
            k1, k2, bands = ([None] * len(batch) for _ in range(3))
            for at, texts in in_parts(batch):
                found = read(texts)
                first, last, keys = found.firsts[:-1], found.firsts[1:], digests(texts, found)
                for i, row in enumerate(at.tolist()):
                    if first[i] < last[i]:
                        k1[row], k2[row] = keys[i]
                        bands[row] = sample.band_hashes(sample.signature(*shingles.of_hashes(found.hashes[first[i] : last[i]])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("uid", "none", "id")], pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["uid", "none", "id", "k1", "k2", "bands"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("uid", "none", "id", "text").mapInArrow(run, f"uid long, none boolean, id {kind}, k1 long, k2 long, bands array<long>")


# --- components ----------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """links: a, b.  (node, label) for every node in a link; the label is the smallest node connected to it.

    Each step takes the least label among neighbours and then the label of that label, so paths halve.  Nodes with many
    neighbours and labels of many nodes are joined apart."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "edges")
    many = hot_keys(both, "b")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        seen = joined_by_hot_key(both, labels.select(F.col("node").alias("b"), "label"), "b", many).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        least = seen.unionByName(labels.withColumn("old", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        least = materialise(least, "labels")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = materialise(joined_by_hot_key(least, jump, "label").select("node", F.col("next").alias("label"), "old"), "labels")
        if labels.where(F.col("label") != F.col("old")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


# --- verification --------------------------------------------------------------------------------------------------


def similar_links(left: list[tuple], right: list[tuple], least: float) -> list[tuple[int, int]]:
    """(node, hashes, weights, class) lists.  A link for each pair at least that similar that joins two classes not yet joined here."""
    if not left or not right:
        return []
    hashes = np.concatenate([x[1] for x in right])
    weights = np.concatenate([x[2] for x in right])
    owner = np.repeat(np.arange(len(right)), [len(x[1]) for x in right])
    order = np.argsort(hashes, kind="stable")
    hashes, weights, owner = hashes[order], weights[order], owner[order]
    sums = np.array([x[2].sum() for x in right])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for node, h, w, group in left:
        start, stop = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        count = stop - start
        total = int(count.sum())
        if not total:
            continue
        at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
        shared = np.bincount(owner[at], np.minimum(weights[at], np.repeat(w, count)), len(right))
        for j in np.flatnonzero(shared >= (least - 1e-9) * (w.sum() + sums - shared)):
            a, b = root(group), root(right[j][3])
            if a != b:
                parent[a] = b
                out.append((node, right[j][0]))
    return out


def _compare(tasks: DataFrame, texts: DataFrame, shingler: Shingler, least: float) -> DataFrame:
    """tasks: t1, t2, node, side (0 left, 1 right, 2 both), label.  Verified links a, b."""
    shared = tasks.sparkSession.sparkContext.broadcast(shingler)

    def run(table: pa.Table) -> pa.Table:
        shingles, left, right = shared.value, [], []
        for node, side, label, text in zip(*[table.column(c).to_pylist() for c in ("node", "side", "label", "text")], strict=True):
            item = (node, *shingles.of(text), label)
            if side != 1:
                left.append(item)
            if side != 0:
                right.append(item)
        found = similar_links(left, right, least)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return tasks.join(shuffled(texts), "node").groupBy("t1", "t2").applyInArrow(run, "a long, b long")


def _block(node: str, chars: str, size, block: int):
    """The task of a node among ``size`` others that are compared with the same one; long texts have tasks of their own."""
    return F.when(F.col(chars) > LONG, -1 - F.col(node)).otherwise(F.pmod(F.xxhash64(node), F.ceil(size / block)))


def _prefixes(texts: DataFrame, shingler: Shingler, similar: float) -> DataFrame:
    """texts: node, text.  node, weight, and for its first shingles by rarity token and rest (the weight from there on), down to ``similar`` of the weight.

    Rarity is taken from counts in a fixed number of slots; any order that all nodes share gives every similar pair."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(shingler)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(RARITY_SLOTS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                slots = (shared.value.of(text.as_py())[0] & np.uint64(RARITY_SLOTS - 1)).astype(np.int64)
                np.add.at(n, slots, 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])

    table = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most RARITY_SLOTS rows
    counts = np.zeros(RARITY_SLOTS, np.int64)
    counts[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    rarity = context.broadcast(counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
                h, w = shared.value.of(text.as_py())
                order = np.lexsort((h, rarity.value[(h & np.uint64(RARITY_SLOTS - 1)).astype(np.int64)]))
                total = w.sum()
                rest = total - np.cumsum(w[order]) + w[order]
                first = rest >= similar * total * (1 - 1e-6)
                tokens = h[order][first].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), node)), pa.array(np.full(len(tokens), total)), pa.array(tokens), pa.array(rest[first])], names=["node", "weight", "token", "rest"])

    return texts.select("node", "text").mapInArrow(cut, "node long, weight double, token long, rest double")


def _open_pairs(members: DataFrame, labels: DataFrame, texts: DataFrame, shingler: Shingler, similar: float) -> DataFrame | None:
    """a, b, label_a, label_b: nodes of different classes that share a bucket and a prefix shingle."""
    now = materialise(members.join(shuffled(labels), "node", "left").select("bucket", "node", "size", F.coalesce("label", "node").alias("label")), "labelled")
    several = now.where("size > 2").groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("bucket")
    mine = materialise(joined_by_hot_key(now, several, "bucket").select("bucket", "node", "label"), "open")
    if mine.isEmpty():
        return None
    nodes = materialise(mine.groupBy("node").agg(F.first("label").alias("label"), F.collect_list("bucket").alias("buckets")), "open-nodes")  # at most `bands` buckets
    tokens = _prefixes(texts.join(shuffled(nodes.select("node")), "node"), shingler, similar)
    tokens = materialise(tokens.join(shuffled(nodes.select("node", "label")), "node"), "tokens")
    counts = tokens.groupBy("token", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("token").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("classes")).where("classes > 1").select("token", F.col("top.label").alias("main"))
    shared = materialise(joined_by_hot_key(tokens, materialise(main, "main"), "token"), "shared")
    light = shared.where(F.col("rest") >= 2 * similar / (1 + similar) * F.col("weight") * (1 - 1e-6)).select(*[F.col(c).alias(f"{c}_x") for c in shared.columns])
    heavy = shared.select(*[F.col(c).alias(f"{c}_y") for c in shared.columns])
    ordered = (F.col("weight_x") < F.col("weight_y")) | (F.col("weight_x") == F.col("weight_y")) & (F.col("node_x") < F.col("node_y"))
    enough = F.least("rest_x", "rest_y") >= similar / (1 + similar) * (F.col("weight_x") + F.col("weight_y")) * (1 - 1e-6)
    may = (F.col("token_x") == F.col("token_y")) & (F.col("label_x") != F.col("label_y")) & ordered & enough
    x_minor, y_minor = F.col("label_x") != F.col("main_x"), F.col("label_y") != F.col("main_y")
    met = [light.where(x_minor).join(shuffled(heavy), may), light.where(~x_minor).join(shuffled(heavy.where(y_minor)), may)]
    pairs = met[0].select("node_x", "node_y").unionByName(met[1].select("node_x", "node_y"))
    pairs = pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(shuffled(nodes.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"), F.col("buckets").alias(f"buckets_{side}"))), side)
    return pairs.where(F.arrays_overlap("buckets_a", "buckets_b")).select("a", "b", "label_a", "label_b")


# --- the operator --------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, rare: int = RARE, block: int = BLOCK, uid_col: str | None = None) -> DataFrame:
    """One row per row of docs: uid (``uid_col``, row numbers as from `numbered`, or its place in docs), id, class_id, class_size, stays (true for one row of each class)."""
    given = docs if uid_col else numbered(docs, "__uid")
    all_rows = given.select(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{uid_col or '__uid'}`").alias("uid"))
    shingler = Shingler(*word_weights(given, text_col, rare))
    sigs = materialise(_signatures(all_rows, shingler, Sampler(bands, rows)), "signatures")
    place = F.struct("none", "id", "uid")
    nodes = sigs.where(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(F.min("uid").alias("node"), F.min(place).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")
    links = materialise(_links(all_rows, nodes, shingler, similar, block), "links")
    labels = components(links)
    classed = nodes.drop("bands").join(shuffled(labels), "node", "left").withColumn("class", F.coalesce("label", "node"))
    classed = materialise(classed.select("k1", "k2", "first", "copies", "class"), "classed")
    classes = materialise(classed.groupBy("class").agg(F.min("first").alias("stays"), F.sum("copies").alias("class_size")), "classes")
    classed = materialise(joined_by_hot_key(classed, classes, "class").select("k1", "k2", "stays", "class_size"), "classes")
    found = sigs.where(F.col("k1").isNotNull()).select("uid", "id", "k1", "k2").join(shuffled(classed), ["k1", "k2"])
    found = found.select("uid", "id", F.col("stays.id").alias("class_id"), "class_size", (F.col("uid") == F.col("stays.uid")).alias("stays"))
    alone = sigs.where(F.col("k1").isNull()).select("uid", "id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("stays"))
    return found.unionByName(alone)


def _links(all_rows: DataFrame, nodes: DataFrame, shingler: Shingler, similar: float, block: int) -> DataFrame:
    each = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = materialise(each.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1), "buckets")
    maybe = possible(each, F.col("bucket"), shared, F.col("bucket")).where("__possible").select("node", "bucket")
    members = materialise(maybe.join(shuffled(shared), "bucket"), "members")  # bucket, node, size
    shares = materialise(members.groupBy("node").agg(F.sum("size").alias("shares")), "shares")
    held = possible(all_rows.select(F.col("uid").alias("node"), "text"), F.col("node"), shares, F.col("node")).where("__possible")
    texts = materialise(held.select("node", "text", F.length("text").alias("chars")).join(shuffled(shares.select("node")), "node"), "texts")
    heads = members.join(shuffled(shares), "node").groupBy("bucket").agg(F.max(F.struct("shares", (-F.col("node")).alias("minus"))).alias("head"))
    heads = materialise(heads.select("bucket", (-F.col("head.minus")).alias("head")), "heads")
    stars = joined_by_hot_key(members, heads, "bucket").where(F.col("node") != F.col("head")).groupBy("head", "node").agg(F.max("size").alias("size"))
    links = _compared(stars.select(F.col("head").alias("x"), F.col("node").alias("y"), F.col("head").alias("label_x"), F.col("node").alias("label_y"), "size"), texts, shingler, similar, block)
    pairs = _open_pairs(members, components(links), texts, shingler, similar)
    if pairs is None:
        return links
    pairs = materialise(pairs, "pairs")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("size"))
    more = joined_by_hot_key(pairs, sizes, "a").select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("label_a").alias("label_x"), F.col("label_b").alias("label_y"), "size")
    return links.unionByName(_compared(more, texts, shingler, similar, block))


def _compared(pairs: DataFrame, texts: DataFrame, shingler: Shingler, similar: float, block: int) -> DataFrame:
    """pairs: x, y, label_x, label_y, size (at least the number of pairs of x).  Verified links a, b."""
    right = pairs.join(shuffled(texts.select(F.col("node").alias("y"), "chars")), "y")
    right = right.select(F.col("x").alias("t1"), _block("y", "chars", F.col("size"), block).cast("long").alias("t2"), F.col("y").alias("node"), F.lit(1).alias("side"), F.col("label_y").alias("label"), F.col("label_x"))
    right = materialise(right, "tasks")
    left = right.select("t1", "t2", F.col("t1").alias("node"), F.lit(0).alias("side"), F.col("label_x").alias("label")).distinct()
    return materialise(_compare(left.unionByName(right.drop("label_x")), texts, shingler, similar), "links")
