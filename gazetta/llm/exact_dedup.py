"""Exact deduplication as a stateful stream.

A stream over the table's files keeps, without expiry and on disk (RocksDB state store), one entry per content digest:
how many rows have it and the smallest (id, file, row) among them, which is the stable identifier and the content
locator of the row that stays.  Started again on the same state folder, the stream reads only files it has not seen.

Every hit is then checked on its full bytes: each further row is joined to the text of the row that stays, read through
its locator if it came with another table over the same state, and rows that share a digest but not the text (a
collision) are grouped by the text itself.

Texts count as equal when they are identical after each run of space and \\x09-\\x0D has become one space.

Several tables over one state: each call returns one row per row of its own table; a row equal to one of an earlier table
gets that row's id as keep_id and is not kept.  If the earlier file is gone, the digest alone decides.  A later row with a
smaller id takes its group over; results returned before do not change.

Defined cases: null text is empty text; of rows with the same id and text the first in file order stays; rows with a
null id stay only if their group has no other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path, possible, shuffled

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk set aside
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(place.alias("place"), normalised(F.col(text_col)).alias("norm")).withColumn("digest", digest(F.col("norm")))


def _fs(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _streamed(path: str) -> str:
    """The path as a pattern that nothing else fits: so it may be a single file, and another one the next time."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/{{{re.sub(r'([*?,{}\[\]\\])', r'\\\1', name)}}}"


def update_state(spark: SparkSession, path: str, state_dir: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, max_bytes_per_trigger: str | None = None) -> DataFrame:
    """Run the stream over the files not seen yet.  All groups: digest, first (the place of the row that stays), n."""
    path = path.rstrip("/")
    batch = spark.read.parquet(path)
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(batch.schema).option("maxFileAge", "36500d")  # by default files 7 days older than the newest are left out
        if max_bytes_per_trigger:
            reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
        groups = _rows(reader.parquet(_streamed(path)), id_col, text_col, digest).groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n"))
        sink = groups.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/stream").trigger(availableNow=True)
        sink.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{state_dir}/groups/batch={i}")).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return read_groups(spark, f"{state_dir}/groups", groups.schema.simpleString()[7:-1])


def read_groups(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The latest row of each digest.  What the batches since the last call wrote is merged into one table `upto=<batch>`."""
    fs, p = _fs(spark, path)
    names = [str(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
    done = [n for n in names if n.startswith("upto=") and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1])]
    upto = max((int(n[5:]) for n in done), default=-1)
    later = sorted(int(n[6:]) for n in names if n.startswith("batch=") and int(n[6:]) > upto)
    parts = [f"upto={upto}"] * (upto >= 0) + [f"batch={i}" for i in later]
    fields = ", ".join(f"{name} {kind}" for name, kind in (x.split(":", 1) for x in _top(schema)))
    reader = spark.read.schema(fields)
    if not parts:
        return spark.createDataFrame([], fields)
    if len(parts) > 1:
        rows = reader.parquet(*[f"{path}/{x}" for x in parts])
        latest = rows.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))  # both only grow better with time
        parts = [f"upto={later[-1]}"]
        latest.write.mode("overwrite").parquet(f"{path}/{parts[0]}")
    for n in names:
        if n not in parts:
            fs.delete(_fs(spark, f"{path}/{n}")[1], True)
    return reader.parquet(f"{path}/{parts[0]}")


def _top(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def _elsewhere(spark: SparkSession, members: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame | None:
    """digest, norm of the rows that stay but came with another table, read through their locators."""
    groups = members.where("n > 1").select("digest", "first").distinct()
    files = groups.select(F.col("first.file").alias("file")).distinct().join(members.select(F.col("place.file").alias("file")).distinct(), "file", "left_anti")
    there = [f for r in files.collect() if (f := r["file"]) and _fs(spark, f)[0].exists(_fs(spark, f)[1])]  # names of files only
    if not there:
        return None
    rows = _rows(spark.read.parquet(*there), id_col, text_col, digest)
    return rows.join(shuffled(groups), "digest").where(F.col("place") == F.col("first")).select("digest", "norm")


def exact_dedup(spark: SparkSession, path: str, state_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, max_bytes_per_trigger: str | None = None) -> DataFrame:
    """One row per row of the table: id, keep_id, group_size, kept, digest."""
    state_dir, path = state_dir or new_path(spark, "dedup-state"), path.rstrip("/")
    groups = update_state(spark, path, state_dir, id_col, text_col, digest, max_bytes_per_trigger)
    rows = _rows(spark.read.parquet(path), id_col, text_col, digest)
    repeated = groups.where(F.col("n") > 1)
    rows = possible(rows, F.col("digest"), repeated, F.col("digest")).withColumn("norm", F.when(F.col("__possible"), F.col("norm")))  # only these texts are sent
    joined = rows.join(shuffled(groups), "digest").select("digest", "place", "first", "n", (F.col("place") == F.col("first")).alias("kept"), F.when(F.col("n") > 1, F.col("norm")).alias("norm"))
    joined = materialise(joined, "members")  # texts only of rows in groups
    hits = joined.where((F.col("n") > 1) & ~F.col("kept"))
    stays = joined.where((F.col("n") > 1) & F.col("kept")).select("digest", "norm")
    elsewhere = _elsewhere(spark, joined, id_col, text_col, digest)
    stays = (stays if elsewhere is None else stays.unionByName(elsewhere)).withColumnRenamed("norm", "stays_norm")
    checked = hits.join(shuffled(stays), "digest", "left").withColumn("same", F.coalesce(F.col("norm") == F.col("stays_norm"), F.lit(True)))
    checked = materialise(checked.select("digest", "place", "first", "n", "kept", "same", F.when(~F.col("same"), F.col("norm")).alias("norm")), "checked")
    alone = joined.where((F.col("n") == 1) | F.col("kept")).select("digest", "place", "first", "n")
    good = alone.unionByName(checked.where("same").select("digest", "place", "first", "n"))
    odd = checked.where(~F.col("same"))
    if not odd.isEmpty():
        fewer = odd.groupBy("digest").agg(F.count("*").alias("fewer"))
        good = good.join(fewer, "digest", "left").withColumn("n", F.col("n") - F.coalesce("fewer", F.lit(0))).drop("fewer")
        own = odd.groupBy("digest", "norm").agg(F.min("place").alias("first"), F.count("*").alias("n"))
        good = good.unionByName(odd.select("digest", "place", "norm").join(own, ["digest", "norm"]).select("digest", "place", "first", "n"))
    return good.select(F.col("place.id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == F.col("first")).alias("kept"), "digest")
