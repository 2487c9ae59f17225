"""Damaged text: bytes of one encoding read in another, character references, stray white space.

Only built-in expressions.  A suspect run, that is, characters one after the other which a single-byte code page has above
ASCII, is turned back into its bytes and read as UTF-8; the result counts only if the whole run is valid.  Text without
damage stays as it is, since single accented letters are no valid UTF-8."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, once, pytrim

#: What the bytes 0x80 to 0x9F mean in Windows-1252; a blank where it has nothing (the byte's own control character).
_CP1252 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"
_PAIRS = [(c, chr(0x80 + i)) for i, c in enumerate(_CP1252) if c != " "]
_SPECIAL, _CONTROL = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)
#: Characters above ASCII of the code page; the shape of a UTF-8 sequence.
_HIGH = f"\\x{{80}}-\\x{{FF}}{_SPECIAL}"
_LATER = f"\\x{{80}}-\\x{{BF}}{''.join(a for a, b in _PAIRS)}"
_SUSPECT = f"(?:[\\x{{C2}}-\\x{{DF}}][{_LATER}]|[\\x{{E0}}-\\x{{EF}}][{_LATER}]{{2}}|[\\x{{F0}}-\\x{{F4}}][{_LATER}]{{3}})"
#: Most text is ASCII, which one range tells; the other class asks for every special character in turn.
_RUNS = f"[{_HIGH}]+|(?:[\\x00-\\x7F]++|[^{_HIGH}]++)++"
#: Named character references (HTML 4 and apos), as JSON of name to character.
_NAMED = json.dumps({k: chr(v) for k, v in html.entities.name2codepoint.items()} | {"apos": "'"})
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _reread(run: Column) -> Column:
    """The run's bytes read as UTF-8, or null if they are none."""
    return F.try_validate_utf8(F.encode(F.translate(run, _SPECIAL, _CONTROL), "ISO-8859-1").cast("string"))


def remade(text: Column, rounds: int = 2) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1252 (`Ã©`, `Â°`), put right; ``rounds``: how often it may have happened."""
    def mended(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(_RUNS), F.lit(0))
        return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{_SUSPECT}"), F.coalesce(_reread(p), p)).otherwise(p)), "")

    for _ in range(rounds):
        text = once(text, lambda t: F.when(t.rlike(_SUSPECT), mended(t)).otherwise(t))
    return text


def _character(code: Column) -> Column:
    """The character of a code point, null if there is none; 128 to 159 mean Windows-1252, as in browsers."""
    there = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(there, F.translate(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), _CONTROL, _SPECIAL))


def unreferenced(text: Column) -> Column:
    """Character references (`&deg;`, `&#176;`, `&#xB0;`) decoded once; unknown ones stay."""
    named = F.from_json(F.lit(_NAMED), "map<string,string>")

    def decoded(p: Column) -> Column:
        decimal = _character(F.regexp_extract(p, r"^&#([0-9]+);$", 1).try_cast("int"))
        hexadecimal = _character(F.conv(F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]+);$", 1), 16, 10).try_cast("int"))
        name = F.try_element_at(named, F.regexp_extract(p, r"^&([A-Za-z][A-Za-z0-9]*);$", 1))
        return F.when(p.rlike(f"^{_REFERENCE}$"), F.coalesce(F.when(p.startswith("&#x") | p.startswith("&#X"), hexadecimal).when(p.startswith("&#"), decimal).otherwise(name), p)).otherwise(p)

    def all_decoded(t: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(f"{_REFERENCE}|[^&]+|&"), F.lit(0)), decoded), "")

    return once(text, lambda t: F.when(t.contains("&"), all_decoded(t)).otherwise(t))


def suspicious(text: Column) -> Column:
    """Whether something is still damaged: replacement characters, control characters, or bytes that did not read as UTF-8."""
    return F.coalesce(text.rlike(f"\\x{{FFFD}}|[\\x00-\\x08\\x0E-\\x1B\\x{{7F}}-\\x{{84}}\\x{{86}}-\\x{{9F}}]|{_SUSPECT}"), F.lit(False))


def cleaned(text: Column) -> Column:
    """References, encoding, then white space: one space between words, none around."""
    return pytrim(F.regexp_replace(remade(unreferenced(text)), f"{SPACE}+", " "))
