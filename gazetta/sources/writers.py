"""Writers: distributed tables, and single ordered files for exchange (with a BOM where spreadsheets need one).

Rows become text on the executors in every case; a single file is put together from their parts byte by byte."""

from __future__ import annotations

import csv
import io
import os
import re
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.text import number, ref
from ..operators.resolve import ordered_columns, to_darwin_core

_COORDINATES = ("Latitude", "Longitude", "latitude", "longitude", "decimalLatitude", "decimalLongitude", "lat", "lon", "long")


def separator(path: str) -> str:
    return "\t" if path.lower().endswith((".tsv", ".txt")) else ","


def write_delimited(df: DataFrame, path: str, fieldnames: list[str] | None = None) -> None:
    """A folder of delimited files, written by all tasks."""
    chosen = fieldnames or [c for c in df.columns if c != S.ROW]
    df.select(*[ref(c) for c in chosen]).write.csv(path, sep=separator(path), header=True, escape='"', emptyValue="")


def _prepared(df: DataFrame, darwin_core: bool, fieldnames: list[str] | None) -> DataFrame:
    rows = df.orderBy(S.ROW) if S.ROW in df.columns else df
    order = rows
    names = fieldnames or ordered_columns([c for c in df.columns if c != S.ROW])
    order = order.select(*[ref(c) for c in names if c in df.columns])
    if darwin_core:
        order = to_darwin_core(order)
        order = order.select(*[ref(c) for c in ordered_columns(order.columns, True)])
    return order


def joined_files(spark: SparkSession, parts: str, path: str, head: bytes, tail: bytes = b"", skip: int = 0) -> str:
    """One file from a folder of parts, copied as bytes in the order of their numbers; ``skip`` bytes at their start are left out."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    source = hadoop.fs.Path(parts)
    names = [str(x.getPath().getName()) for x in source.getFileSystem(conf).listStatus(source)]
    found = sorted((n for n in names if n.startswith("part-")), key=lambda n: int(n.split("-")[1]))
    target = hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs = hadoop.fs.FileSystem.getLocal(conf).getRaw() if fs.getUri().getScheme() == "file" else fs  # no checksum file beside it
    out = fs.create(target, True)
    try:
        out.write(bytearray(head))
        for name in found:
            part = source.getFileSystem(conf).open(hadoop.fs.Path(f"{parts}/{name}"))
            while skip and part.read() >= 0:
                skip -= 1
            hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            part.close()
        out.write(bytearray(tail))
    finally:
        out.close()
    source.getFileSystem(conf).delete(source, True)
    return path


def write_file(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file as it is."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    out.write(bytearray(data))
    out.close()
    return path


def _written(lines: DataFrame, path: str, head: bytes, tail: bytes = b"", skip: int = 0) -> str:
    """Lines (one text column, in order) written by all tasks, then put together."""
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines.write.text(parts)
    return joined_files(lines.sparkSession, parts, path, head, tail, skip)


def _as_text(df: DataFrame, name: str) -> Column:
    kind, value = df.schema[name].dataType, ref(name)
    if isinstance(kind, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    return F.to_json(value) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else value.cast("string")


def delimited_lines(df: DataFrame, sep: str) -> DataFrame:
    """One text column: the rows as delimited lines; fields with a separator, quote or line break are quoted."""
    fields = [F.coalesce(_as_text(df, c), F.lit("")) for c in df.columns]
    quoted = [F.when(f.rlike(f'[{sep}"\r\n]'), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f) for f in fields]
    return df.select(F.concat_ws(sep, *quoted).alias("value"))


def export_delimited(df: DataFrame, path: str, darwin_core: bool = False, fieldnames: list[str] | None = None) -> str:
    """One UTF-8 file with a BOM."""
    rows, sep, head = _prepared(df, darwin_core, fieldnames), separator(path), io.StringIO()
    csv.writer(head, delimiter=sep, lineterminator="\n").writerow(rows.columns)
    return _written(delimited_lines(rows, sep), path, head.getvalue().encode("utf-8-sig"))


def export_json(df: DataFrame, path: str, darwin_core: bool = False) -> str:
    """One JSON array, a record a line; nulls and other alphabets kept."""
    rows = _prepared(df, darwin_core, None)
    record = F.to_json(F.struct(*[ref(c) for c in rows.columns]), {"ignoreNullFields": "false"})
    return _written(rows.select(F.concat(F.lit(","), record).alias("value")), path, b"[\n", b"]", 1)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def geojson_features(df: DataFrame) -> DataFrame:
    """One column: the JSON of a point feature for each row whose coordinates are numbers; 0 is a number."""
    names = [c for c in df.columns if c != S.ROW]
    lat = next((c for c in ("Latitude", "decimalLatitude", "latitude", "lat") if c in names), None)
    lon = next((c for c in ("Longitude", "decimalLongitude", "longitude", "lon") if c in names), None)
    if not lat or not lon:
        return df.select(F.lit("").alias("feature")).limit(0)
    keep = [c for c in names if c not in _COORDINATES]
    y, x = number(ref(lat)), number(ref(lon))
    properties: Column = F.struct(*[ref(c).alias(c) for c in keep])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"), properties.alias("properties"))
    rows = df.where(y.isNotNull() & x.isNotNull())
    return rows.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"), *([S.ROW] if S.ROW in df.columns else []))


def export_geojson(df: DataFrame, path: str, darwin_core: bool = False) -> str:
    features = geojson_features(to_darwin_core(df.drop(S.ROW)) if darwin_core else df)
    rows = features.orderBy(S.ROW) if S.ROW in features.columns else features
    return _written(rows.select(F.concat(F.lit(","), "feature").alias("value")), path, b'{"type":"FeatureCollection","features":[\n', b"]}", 1)


def with_extension(base: str, extension: str) -> str:
    """Appends; dots in the name are part of it."""
    return f"{base}.{extension.lstrip('.')}"


def export_all(df: DataFrame, base: str, formats: list[str], darwin_core: bool = False) -> tuple[list[str], list[str]]:
    """(paths written, formats unknown).  The rows are computed once."""
    makers = {"csv": export_delimited, "tsv": export_delimited, "json": export_json, "geojson": export_geojson}
    cached = df.persist()
    try:
        done = [makers[f](cached, with_extension(base, f), darwin_core) for f in formats if f in makers]
    finally:
        cached.unpersist()
    return done, [f for f in formats if f not in makers]


def chat_request(custom_id: Column, model: Column, prompt: Column, max_tokens: Column) -> Column:
    """One line of a chat-style request file."""
    message = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    body = F.struct(model.alias("model"), message.alias("messages"), max_tokens.alias("max_completion_tokens"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


def keyed_request(key: Column, prompt: Column, max_tokens: Column) -> Column:
    """One line of a keyed request file."""
    contents = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(prompt.alias("text"))).alias("parts")))
    return F.to_json(F.struct(key.alias("key"), F.struct(contents.alias("contents"), F.struct(max_tokens.alias("maxOutputTokens")).alias("generationConfig")).alias("request")))


def request_struct(custom_id: Column, prompt: Column, max_tokens: Column, model: Column) -> Column:
    """In-memory request: custom_id and params."""
    return F.struct(custom_id.alias("custom_id"), F.struct(model.alias("model"), max_tokens.alias("max_tokens"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages")).alias("params"))


def write_requests(lines: DataFrame, path: str) -> None:
    """A folder of JSON-lines files from one text column."""
    lines.write.text(path)


def slug(name: str) -> str:
    return "".join(c for c in name if c.isalnum() or c in "_-").lower()


def dated_output(folder: str, dataset: str, model: str, now: datetime) -> str:
    name = f"{os.path.splitext(os.path.basename(dataset))[0]}_{slug(model)}"
    return os.path.join(folder, f"{now:%Y%m%d}_{name}", f"{name}_{now:%Y%m%d_%H%M%S}.tsv")


def default_candidates(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path) + "_candidates.tsv"


def default_expanded(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path) + "_georeferenced.tsv"
