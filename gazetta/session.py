"""Session settings the engine relies on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Column names are data here (`Country` and `country` may both exist), so they are compared exactly.
CONF = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "gazetta", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=CONF | conf).getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """The same settings on a session made elsewhere."""
    for k, v in CONF.items():
        spark.conf.set(k, v)
    return spark


_own_dir: list[str] = []
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is unset, a session on one machine gets a folder of its own; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="gazetta-"))
    return _own_dir[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    if not _paths:
        atexit.register(_clear, spark)
    _paths.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _paths[-1]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clear(spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    try:
        for path in _paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may already be gone when the interpreter ends
        return
