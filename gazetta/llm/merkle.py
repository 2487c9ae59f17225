"""Merkle manifest: a hash tree over the rows of each group, a tree over the groups' roots, and a proof for every row.

Method (radix-ranked trie): a row's place in its group comes from histograms of the digits of its id.  One scan counts
rows by (group, leading digits); the counts are added up digit by digit to a trie, and going down, every node learns how
many rows stand before it from the at most 256 siblings under its parent.  Nodes small enough are ranked inside; larger
ones (ids that very many different rows share) go on with the digits of the leaf's digest.  So ranks are exact, nothing is
sorted as a whole and no group, however large, meets in one task.  The digits of a rank to the base of the fanout are then
the keys of the tree's nodes: rows meet by all but their last digits (the longest prefix), LEVELS levels at a time, until
one node of each group is left.  The trie's way back down gives each node the siblings above it, each row its proof.

Digests are lowercase hex sha256; inputs are concatenated, digests as hex text.  Leaf: each field `-` if null, else its UTF-8
byte count, `:` and its value.

Defined cases: rows without id come first in their group, the null group first of the groups; rows that share group and id
stand in the order of their leaf digests, so the root does not depend on files or partitions; equal rows are leaves of
their own, next to each other; empty and very long texts are fields like others; an empty table gives no rows.  Columns
are taken by place, so further columns of any name do no harm.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shuffled

FANOUT = 3
#: Levels of a tree that are made together: FANOUT ** LEVELS nodes meet in one row.
LEVELS = 4
RUN = FANOUT**LEVELS
#: Hex digits of a step in the histograms: a node has at most 16 ** DIGITS children.
DIGITS = 2
#: Entries that are ranked in one place at most; nodes with more get children.
BUCKET = 512
#: Copies of one row that are written out from one place at a time.
_COPIES = 10_000
#: Digests of the rows of a run.
_HEX_ITEMS = "transform(items, x -> lower(hex(x.h)))"
_PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def entries(df: DataFrame, id_col: str, group_col: str, fields: list[str], tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row for each different leaf of a group: g (its group's key), id, leaf, other (the digest of the leaf as tampered
    with, null where nothing was) and n (how many rows it stands for).  The only pass over whole rows.

    tampered: the changed value of fields, where: for which rows; both over columns named as in df."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    changed = {f: f"t{i}" for i, f in enumerate(tampered or {})}
    rows = df.select("*", *[v.alias(changed[f]) for f, v in (tampered or {}).items()], (F.lit(False) if where is None else F.coalesce(where, F.lit(False))).alias("touched"))
    rows = rows.toDF(*[f"c{i}" for i in range(len(df.columns))], *changed.values(), "touched")
    source = F.col(names[group_col]).cast("string")
    differs = reduce(or_, [~F.col(names[f]).eqNullSafe(F.col(new)) for f, new in changed.items()], F.lit(False))
    leaf = digest(*[_field(F.col(names[f])) for f in fields])
    other = F.when(F.col("touched") & differs, digest(*[_field(F.col(changed.get(f, names[f]))) for f in fields]))
    leaves = rows.select(F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("g"), F.col(names[id_col]).alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("other"))
    return materialise(leaves.groupBy("g", "id", "leaf").agg(F.first("other").alias("other"), F.count("*").alias("n")), "leaves")


def _id_digits(kind: T.DataType) -> tuple[Column, int]:
    """Ids as text whose bytewise order is theirs, null first, and how much of it tells ids apart (about, if they are no
    integers): 16 hex digits of integers, the hex digits of other ids and an end mark."""
    if isinstance(kind, T.IntegralType):
        digits, width = F.lpad(F.hex(F.col("id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), 17
    else:
        digits, width = F.concat(F.hex(F.col("id").cast("string")), F.lit("!")), 65
    return F.coalesce(F.concat(F.lit("="), digits), F.lit("-" + "0" * (width - 1))), width


def _prefix(col: str, n: int) -> Column:
    return F.substring(col, 1, n)


def _counted(rows: DataFrame, prefix: Column, entries: Column, n: str) -> DataFrame:
    return rows.groupBy("g", prefix.alias("prefix")).agg(entries.alias("entries"), F.sum(n).alias("n"))


def _below(children: DataFrame, parents: DataFrame, length: int) -> DataFrame:
    """Children (g, prefix, entries, n) with what stands before them in their group, and the group's total."""
    tops = parents.select("g", F.col("prefix").alias("parent"), "before", "total")
    met = shuffled(children.withColumn("parent", _prefix("prefix", length))).join(shuffled(tops), ["g", "parent"])
    earlier = Window.partitionBy("g", "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    return met.select("g", "prefix", "entries", "n", (F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("before"), "total")


def ranked(rows: DataFrame, start: int, first: int) -> DataFrame:
    """rows (read from a table: g, key, unique in its group, n, and others) with r, the place of the first of its n rows in
    the order of keys, and the group's total.

    start: the length of what all keys begin with; first: that of the prefixes that one scan counts."""
    lengths = [*range(first, start, -DIGITS), 0]
    levels = [materialise(_counted(rows, _prefix("key", first), F.count("*"), "n"), "digits")]
    for length in lengths[1:-1]:
        levels.append(materialise(_counted(levels[-1], _prefix("prefix", length), F.sum("entries"), "n"), "digits"))
    placed = levels[-1].groupBy("g").agg(F.sum("n").alias("total")).select("g", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"), "total")
    for children, length in zip(reversed(levels), reversed(lengths[1:]), strict=True):
        placed = materialise(_below(children, placed, length), "trie")
    out, length, rest = None, first, rows
    while True:
        inside = Window.partitionBy("g", "prefix").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        small = placed.where(F.col("entries") <= BUCKET).select("g", "prefix", "before", "total")
        met = shuffled(rest.withColumn("prefix", _prefix("key", length))).join(shuffled(small), ["g", "prefix"])
        r = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
        part = met.select(*[c for c in rows.columns], r.alias("r"), "total")
        out = part if out is None else out.unionByName(part)
        large = placed.where(F.col("entries") > BUCKET)
        if large.isEmpty():
            return out
        rest = materialise(rest.withColumn("prefix", _prefix("key", length)).join(shuffled(large.select("g", "prefix")), ["g", "prefix"], "left_semi").select(*rows.columns), "rest")
        length += DIGITS
        placed = materialise(_below(_counted(rest, _prefix("key", length), F.count("*"), "n"), large, length - DIGITS), "trie")


#: Levels above a group's leaves until one node is left, over its total.
_DEPTH = f"size(filter(array({', '.join(f'{FANOUT**k}L' for k in range(40))}), x -> x < total))"


def _parents(nodes: str) -> Column:
    return F.expr(f"transform(sequence(0, (size({nodes}) - 1) div {FANOUT}), i -> sha2(array_join(slice({nodes}, cast(i * {FANOUT} + 1 as int), {FANOUT}), ''), 256))")


@dataclass
class Tree:
    """levels: tables of runs of nodes (g, idx, total, items, the levels a1 to a3 made of them, steps, top); tops: g, total, top."""

    levels: list[DataFrame]
    tops: DataFrame


def tree(nodes: DataFrame, tall: int) -> Tree:
    """nodes: g, p, total, h (binary) and a payload; tall: levels of the largest group."""
    levels, tops = [], None
    while True:
        at = len(levels) * LEVELS
        payload = F.col("payload") if "payload" in nodes.columns else F.lit(None).cast("boolean").alias("payload")
        runs = nodes.groupBy("g", F.expr(f"p div {RUN}").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("p", "h", payload))).alias("items"), F.first("total").alias("total"))
        runs = runs.withColumn("steps", F.expr(f"least({_DEPTH} - {at}, {LEVELS})"))
        runs = runs.withColumn("a0", F.expr(_HEX_ITEMS))
        for k in range(LEVELS):
            runs = runs.withColumn(f"a{k + 1}", _parents(f"a{k}"))
        top = "case steps " + " ".join(f"when {k} then a{k}[0]" for k in range(LEVELS + 1)) + " end as top"
        runs = materialise(runs.selectExpr("g", "idx", "total", "items", "steps", *[f"a{k}" for k in range(1, LEVELS)], top), "runs")
        levels.append(runs)
        done = runs.where(f"{_DEPTH} <= {at + LEVELS}").select("g", "total", "top")
        tops = done if tops is None else tops.unionByName(done)
        if tall <= at + LEVELS:
            return Tree(levels, tops)
        nodes = runs.where(f"{_DEPTH} > {at + LEVELS}").select("g", F.col("idx").alias("p"), "total", F.unhex("top").alias("h"))


def _local(place: str) -> str:
    """The siblings of a run's node at this place, level by level within the run."""
    found = []
    for k in range(LEVELS):
        at = f"cast({place} div {FANOUT**k} as int)"
        left, right = f"slice(a{k}, {at} - {at} % {FANOUT} + 1, {at} % {FANOUT})", f"slice(a{k}, {at} + 2, {FANOUT - 1} - {at} % {FANOUT})"
        found.append(f"struct(array_join({left}, '') as left, array_join({right}, '') as right)")
    return f"slice(array({', '.join(found)}), 1, steps)"


def paths(made: Tree, above: DataFrame | None = None) -> DataFrame:
    """Every leaf of the tree: g, p, h, payload, its path (siblings left and right, level by level) and what else above has.

    above: one row for each group: g, up (the path above its top node) and further columns; None: nothing is above."""
    extra = [c for c in above.columns if c not in ("g", "up")] if above is not None else []
    below = None
    for i in reversed(range(len(made.levels))):
        runs = made.levels[i]
        last = f"{_DEPTH} <= {(i + 1) * LEVELS}"
        met = runs.where(last).withColumn("up", F.array().cast(_PATH)) if above is None else shuffled(runs.where(last)).join(shuffled(above), "g")
        if below is not None:
            inner = below.select("g", F.col("p").alias("idx"), F.col("path").alias("up"), *extra)
            met = met.unionByName(shuffled(runs.where(f"not {last}")).join(shuffled(inner), ["g", "idx"]))
        met = met.withColumn("a0", F.expr(_HEX_ITEMS))
        items = f"explode(transform(items, x -> struct(x.p as p, x.h as h, x.payload as payload, concat({_local(f'(x.p % {RUN})')}, up) as path))) as x"
        below = met.selectExpr("g", *extra, items).select("g", "x.*", *extra)
    return below


def folded(leaf: str, path: str) -> Column:
    """The root that a leaf (hex) and its siblings lead to."""
    return F.expr(f"aggregate({path}, {leaf}, (at, s) -> sha2(concat(s.left, at, s.right), 256))")


def _tall(total: int) -> int:
    n = 0
    while FANOUT**n < total:
        n += 1
    return n


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each of the n rows that an entry stands for, with its place p."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_COPIES}")))
    each = F.explode(F.expr(f"sequence(r + b * {_COPIES}, least(r + n, r + (b + 1) * {_COPIES}) - 1)"))
    return rows.withColumn("b", block).withColumn("p", each).drop("b")


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: list[str] | None = None, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row for each row of df: id, group, place, leaf, subroot, root, path (array of the siblings left and right of each
    node from the leaf up to the root), folded_root (of the leaf as tampered with, where it was) and verified."""
    leaves = entries(df, id_col, group_col, fields or df.columns, tampered, where)
    kind = leaves.schema["id"].dataType
    digits, width = _id_digits(kind)
    ends = leaves.where("id is not null").select(digits.alias("k")).agg(F.min("k"), F.max("k")).first()
    start = min(len(os.path.commonprefix([ends[0] or "", ends[1] or ""])), width - DIGITS)
    first = max(width - DIGITS, start + DIGITS) if isinstance(kind, T.IntegralType) else start + DIGITS
    rows = ranked(leaves.withColumn("key", F.concat(digits, F.hex("leaf"))), start, first)
    rows = materialise(rows.select("g", "id", "leaf", "other", "n", "r", "total"), "ranks")
    largest = rows.agg(F.max("total")).first()[0] or 0
    docs = tree(_copies(rows).select("g", "p", "total", F.col("leaf").alias("h"), F.struct("id", "other").alias("payload")), _tall(largest))

    tops = materialise(docs.tops.select(F.lit("").alias("g"), F.col("g").alias("name"), F.unhex("top").alias("h"), F.concat(F.hex("g"), F.lit("!")).alias("key"), F.lit(1).cast("long").alias("n")), "subroots")
    groups = ranked(tops, 0, DIGITS)
    over = tree(groups.select("g", F.col("r").alias("p"), "total", "h", F.struct("name").alias("payload")), _tall(tops.count()))
    root = over.tops.select("top").first()
    above = paths(over).select(F.col("payload.name").alias("g"), F.col("path").alias("up"), _hex(F.col("h")).alias("subroot"))

    out = paths(docs, materialise(above, "above"))
    out = out.select(F.col("payload.id").alias("id"), F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("group"), F.col("p").alias("place"), _hex(F.col("h")).alias("leaf"), "subroot", F.lit(root and root[0]).alias("root"), "path", _hex(F.coalesce("payload.other", "h")).alias("other"))
    out = out.withColumn("folded_root", folded("other", "path")).drop("other")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: str) -> Column:
    """The digest of all siblings, from the leaf to the root, left to right."""
    return F.expr(f"sha2(array_join(transform({path}, s -> concat(s.left, s.right)), ''), 256)")
