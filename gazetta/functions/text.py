"""Text and number rules shared by all operators, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that str.split() knows, as a Java character class.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: The same characters one by one.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that it uses more than once.  Expressions with lambdas are interpreted, where every mention of a
    value computes it again, and mentions within mentions multiply."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ref(name: str) -> Column:
    """A column by its exact name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def pytrim(c: Column) -> Column:
    """Trim as Python's str.strip() does."""
    return F.btrim(c, F.lit(SPACES))


def nonblank(c: Column) -> Column:
    """The raw value, or null if it is null or white space only."""
    return F.when(pytrim(c.cast("string")) != "", c.cast("string"))


def first_nonblank(columns: Iterable[str], aliases: Iterable[str]) -> Column:
    """The raw value of the first alias that is there and not blank; resolved at plan time from the columns."""
    there = [nonblank(ref(a)) for a in aliases if a in set(columns)]
    return F.coalesce(*there) if len(there) > 1 else there[0] if there else F.lit(None).cast("string")


def normalised(c: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed: one part of a place key."""
    return F.lower(F.regexp_replace(pytrim(F.coalesce(c, F.lit(""))), f"{SPACE}+", " "))


def number(c: Column) -> Column:
    """A double where the trimmed text is a plain decimal number, else null."""
    text = pytrim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def safe_id(c: Column) -> Column:
    """Ids of up to 64 letters, digits, _ and - stay; others become gz_ and 24 hex digits of their SHA-1."""
    return F.when(c.rlike(r"\A[A-Za-z0-9_-]{1,64}\z"), c).otherwise(F.concat(F.lit("gz_"), F.substring(F.sha1(c), 1, 24)))


def model_slug(c: Column) -> Column:
    """Letters, digits, _ and - of a name, lower-cased."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", ""))


def safe_filename(c: Column) -> Column:
    """Base name without unusual characters and leading dots."""
    base = F.regexp_extract(F.regexp_replace(c, r"\\", "/"), r"([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._ ()-]", "_"), r"^\.+", "")


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters (100 if there is no text), and 100 for the response."""
    return F.when(F.length(c) > 0, F.floor(F.length(c) / 4)).otherwise(F.lit(100)).cast("long") + 100
