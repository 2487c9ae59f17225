"""Readers: delimited text, JSON, GeoJSON, folders of them."""

from __future__ import annotations

import csv
import io
import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.text import nonblank, number, pytrim, ref
from ..operators.resolve import has_identifier_column, has_locality_column, with_row
from . import json_lists
from .records import BOM, in_file_order, lines, parsed, records

DELIMITERS = ("\t", ",", "|", ";")
NUMERIC = ("Latitude", "Longitude", "Coordinate_Radius_Meters", "Elevation")
LISTS = ("records", "data", "results")
#: Bytes of a JSON file that is parsed whole at most.  There Spark fetches the text of every number and list from the file anew,
#: some 4 KB each time, so a task reads many times its file.
WHOLE_BYTES = 256 << 10


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).limit(1).first()
    return (row.value or "").removeprefix(BOM) if row else ""


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent of tab, comma, bar and semicolon in the first line; ties in that order; comma if none."""
    return best_delimiter(first_line(spark, path))


def best_delimiter(line: str) -> str:
    best = max(DELIMITERS, key=line.count)
    return best if line.count(best) else ","


def has_quoted_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a field may go on in the next line: some line holds an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, line_breaks: bool | None = None) -> DataFrame:
    """All columns as text, names exactly as in the header, quotes doubled, line breaks inside quotes, BOM or not.

    The header is read on its own, so that names that differ only in case, or repeat, stay what they are.  Files are split
    over tasks; line breaks inside quotes (looked for unless ``line_breaks`` says) cost a pass over the lines in order."""
    sep = delimiter or detect_delimiter(spark, path)
    line = first_line(spark, path)
    if not line.strip():
        return spark.createDataFrame([], T.StructType([]))
    names = header_names(line, sep)
    if has_quoted_line_breaks(spark, path) if line_breaks is None else line_breaks:
        return parsed(records(lines(spark, path), sep), names, sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).csv(path, header=True, sep=sep, quote='"', escape='"', encoding="UTF-8", enforceSchema=True, mode="PERMISSIVE")
    return in_file_order(rows)


def header_names(line: str, sep: str) -> list[str]:
    """The names in a header; repeated ones are numbered."""
    names, seen = [], {}
    for n in next(csv.reader(io.StringIO(line.rstrip("\r")), delimiter=sep)):
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}.{seen[n]}")
    return names


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """A result table: blanks become null, the four number columns numbers where they parse."""
    df = read_delimited(spark, path, "\t")
    return df.select(*[(number(ref(c)) if c in NUMERIC else nonblank(ref(c)) if c != "_row" else ref(c)).alias(c) for c in df.columns])


def read_json_records(spark: SparkSession, path: str, split: bool | None = None) -> DataFrame:
    """A list of records; an object with records, data or results; or GeoJSON, whose points fill in missing coordinates.

    Files beyond WHOLE_BYTES or one task (or where ``split`` says so) are cut into records, by many tasks if they fill them;
    smaller ones are parsed whole.  Both give the same rows, but that line breaks between the parts of a value become blanks where a list of
    mixed kinds comes as raw text."""
    if split is None:
        most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
        split = not files(spark, path).where(F.col("size") > min(most, WHOLE_BYTES)).isEmpty()
    if split:
        for keys, geo in ((("features",), True), (LISTS, False)):
            if (rows := json_lists.read(spark, path, keys)) is not None:
                if geo and "geometry" not in rows.schema["r"].dataType.names:  # the root is a list of plain records
                    geo = False
                return _features(rows.withColumnRenamed("r", "f")) if geo else rows.select("r.*", S.ROW)
    raw = spark.read.json(path, multiLine=True, primitivesAsString=True)
    if "features" in raw.columns:
        return _features(with_row(raw.select(F.explode("features").alias("f")).where("f is not null")))
    for name in LISTS:
        if name in raw.columns and isinstance(raw.schema[name].dataType, T.ArrayType):
            return with_row(raw.select(F.explode(name).alias("r")).where("r is not null").select("r.*"))
    return with_row(raw)


def _features(each: DataFrame) -> DataFrame:
    """The properties of GeoJSON features f, with coordinates from points where they have none."""
    props = each.schema["f"].dataType["properties"].dataType.names
    lon, lat = F.get("f.geometry.coordinates", F.lit(0)), F.get("f.geometry.coordinates", F.lit(1))
    own = [F.col("f.properties")[p].alias(p) for p in props if p not in ("Latitude", "Longitude")]
    place = [F.coalesce(F.col("f.properties")[n], v).alias(n) if n in props else v.alias(n) for n, v in (("Latitude", lat), ("Longitude", lon))]
    return each.select(*own, *place, S.ROW)


def load_records(spark: SparkSession, path: str) -> DataFrame:
    return read_json_records(spark, path) if path.lower().endswith((".json", ".geojson")) else read_delimited(spark, path)


DATASET = "filename string, filepath string, delimiter string, row_count long, columns array<string>, has_locality boolean, has_barcode boolean, file_size long"


def files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, name, size, modified of the files in a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def discover_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """One row per delimited file, by name.  Files that cannot be read are left out.

    All files are read together: one scan for first lines and line counts, a second one over those files whose quoted fields
    may hold line breaks.  What reaches the driver is a row a file."""
    found = files(spark, folder).where(F.lower("name").rlike(r"\.(csv|tsv|txt)$") & (F.col("size") > 0)).orderBy("name").collect()
    if not found:
        return spark.createDataFrame([], DATASET)
    text = lines(spark, [f.path for f in found])
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1
    facts = text.groupBy("__file").agg(F.min_by("value", S.ROW).alias("first"), F.count_if(F.trim(F.regexp_replace("value", "\r$", "")) != "").alias("n"), F.max(odd).alias("odd"))
    heads = {unquote(r["__file"]): r for r in facts.collect()}
    heads = {f.path: heads[unquote(f.path)] for f in found if unquote(f.path) in heads and heads[unquote(f.path)]["first"].strip()}
    separators = {path: best_delimiter(r["first"]) for path, r in heads.items()}
    counts = {path: r["n"] - 1 for path, r in heads.items()}
    if quoted := {path: separators[path] for path, r in heads.items() if r["odd"]}:
        whole = records(lines(spark, list(quoted)), {heads[p]["__file"]: s for p, s in quoted.items()})
        by_file = {r["__file"]: r["n"] for r in whole.where(~F.col("header") & (F.trim("value") != "")).groupBy("__file").agg(F.count("*").alias("n")).collect()}
        counts |= {p: by_file.get(heads[p]["__file"], 0) for p in quoted}
    rows = []
    for f in found:
        if f.path in heads:
            columns = header_names(heads[f.path]["first"], separators[f.path])
            rows.append((f.name, f.path, separators[f.path], counts[f.path], columns, has_locality_column(columns), has_identifier_column(columns), f.size))
    return spark.createDataFrame(rows, DATASET)


def discover_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Result files under a folder, newest first: no progress files, read-mes, GeoJSON, job folders or empty files."""
    kept = files(spark, folder, True).where(F.lower("name").rlike(r"\.(csv|tsv|txt|json)$") & ~F.lower("name").rlike(r"_progress\.tsv$|^readme\.txt$") & ~F.col("path").contains("/batch_jobs/") & (F.col("size") > 0))
    return kept.orderBy(F.desc("modified"), "path")


def header_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "_row"]


def parse_json_list(text: str) -> list:
    """Records of a JSON text, for the driver."""
    data = json.loads(text)
    if isinstance(data, dict):
        data = next((data[k] for k in LISTS if isinstance(data.get(k), list)), [])
    return [r for r in data if isinstance(r, dict)]


def trimmed_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


__all__ = ["detect_delimiter", "discover_datasets", "discover_outputs", "files", "load_records", "pytrim", "read_delimited", "read_json_records", "read_progress"]
