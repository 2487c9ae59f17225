"""Model responses: fences, the first JSON object in a text, error messages, token usage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RESPONSE
from .text import number, pytrim

MAX_DEPTH = 12
_NUMERIC = ("latitude", "longitude", "elevation_meters", "coordinate_radius_meters")


def strip_fences(text: Column) -> Column:
    """Without a leading ```name line and a trailing fence."""
    text = pytrim(F.coalesce(text, F.lit("")))
    return pytrim(F.regexp_replace(F.regexp_replace(text, r"\A```[^\n]*\n?", ""), r"\n?```\z", ""))


def first_object(text: Column, stripped: bool = False) -> Column:
    """JSON text of the first object in a text that may have prose around it, or null.

    Parsing starts at the first brace and stops at the object's end, so strings with braces and text after the object
    do no harm.  A text that is a JSON array as a whole has none.  Where a brace in prose comes first, see
    :func:`rescan_objects`.  ``stripped``: the text is a column without fences already, which spares repeated work."""
    text = text if stripped else strip_fences(text)
    at = F.instr(text, "{")
    found = F.try_parse_json(F.substring(text, at, F.length(text)))
    array = text.startswith("[") & F.try_parse_json(text).isNotNull()
    return F.when((at > 0) & ~array, F.to_json(found))


def object_in(text: str | None) -> str | None:
    """The first JSON object in a text, trying every brace."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    try:
        whole = json.loads(text)
        return json.dumps(whole, ensure_ascii=False) if isinstance(whole, dict) else None
    except ValueError:
        pass
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            return json.dumps(found, ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
    return None


def rescan_objects(text: Column) -> Column:
    """Fallback for texts with a brace before the object."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(object_in)

    return _iterating(run, "string")(text)


def _iterating(f: Callable, kind: str) -> Callable[[Column], Column]:
    return F.pandas_udf(f, kind)


def texts_in(payload: object) -> list[str]:
    """Every string under a "text" key in the order of the document; what lies deeper than MAX_DEPTH is left out."""
    found, waiting = [], [("", payload, 0)]
    while waiting:
        key, value, depth = waiting.pop()
        if isinstance(value, str):
            found += [value] * (key == "text")
        elif depth <= MAX_DEPTH and isinstance(value, (dict, list)):
            inner = value.items() if isinstance(value, dict) else (("", v) for v in value)
            waiting += [(k, v, depth + 1) for k, v in inner][::-1]
    return found


def deep_texts(payload: Column) -> Column:
    """All "text" strings of a JSON payload of unknown shape."""

    def one(payload: str | None) -> list[str]:
        try:
            return texts_in(json.loads(payload)) if payload else []
        except ValueError:
            return []

    def run(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in payloads:
            yield batch.map(one)

    return _iterating(run, "array<string>")(payload)


def candidate_text(payload: Column) -> Column:
    """Joined text parts of the first candidate; empty if there are none."""
    as_parts = F.from_json(F.get_json_object(payload, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    as_list = F.from_json(F.get_json_object(payload, "$.candidates[0].content"), "array<struct<text:string>>")
    parts = F.coalesce(as_parts, as_list, F.array().cast("array<struct<text:string>>"))
    return pytrim(F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), ""))


def error_message(payload: Column) -> Column:
    """error.message, else a plain error, else the finish reason, else empty."""
    finish = F.coalesce(F.get_json_object(payload, "$.response.candidates[0].finishReason"), F.get_json_object(payload, "$.candidates[0].finishReason"))
    plain = F.get_json_object(payload, "$.error")
    plain = F.when(~plain.startswith("{") & (plain != ""), plain)
    return F.coalesce(F.get_json_object(payload, "$.error.message"), plain, F.when(finish != "", F.concat(F.lit("finishReason="), finish)), F.lit(""))


def token_usage(payload: Column) -> Column:
    """struct(input_tokens, output_tokens, total_tokens, cached_tokens, token_source) by the provider's layout."""

    def n(path: str) -> Column:
        return F.coalesce(F.get_json_object(payload, path).try_cast("long"), F.lit(0).cast("long"))

    def there(path: str) -> Column:
        return F.get_json_object(payload, path).isNotNull()

    def usage(source: str, given: str, made: str, total: Column, cached: str) -> Column:
        return F.struct(n(given).alias("input_tokens"), n(made).alias("output_tokens"), total.alias("total_tokens"), n(cached).alias("cached_tokens"), F.lit(source).alias("token_source"))

    none = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("input_tokens", "output_tokens", "total_tokens", "cached_tokens")], F.lit("unknown").alias("token_source"))
    messages = usage("claude", "$.usage.input_tokens", "$.usage.output_tokens", n("$.usage.input_tokens") + n("$.usage.output_tokens"), "$.usage.cache_read_input_tokens")
    chat = usage("openai", "$.usage.prompt_tokens", "$.usage.completion_tokens", n("$.usage.total_tokens"), "$.usage.prompt_tokens_details.cached_tokens")
    keyed = usage("gemini", "$.usageMetadata.promptTokenCount", "$.usageMetadata.candidatesTokenCount", n("$.usageMetadata.totalTokenCount"), "$.usageMetadata.cachedContentTokenCount")
    return F.when(there("$.usage.input_tokens"), messages).when(there("$.usage.prompt_tokens"), chat).when(there("$.usageMetadata"), keyed).otherwise(none)


def object_map(found: Column) -> Column:
    """The fields of a JSON object text, parsed once; make it a column before its fields are used."""
    return F.from_json(found, "map<string,string>")


def response_fields(fields_of: Column) -> Column:
    """struct of the response fields in an object map: required ones default to empty, numbers that do not parse to null."""
    fields = []
    for f in RESPONSE:
        raw = fields_of[f.name]
        if f.name in _NUMERIC:
            raw = number(raw)
        elif f.name in ("country", "state", "region", "sector", "exact_site"):
            raw = F.coalesce(raw, F.lit(""))
        fields.append(raw.alias(f.name))
    return F.when(fields_of.isNotNull(), F.struct(*fields))
