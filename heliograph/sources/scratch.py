"""Intermediate tables in storage that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def setting(spark: SparkSession, key: str) -> str | None:
    """A setting of the session or its context; null where it is unset and has no default."""
    try:
        return spark.conf.get(key)
    except Exception as e:
        if "SQL_CONF_NOT_FOUND" not in str(e):
            raise
        return spark.sparkContext.getConf().get(key)


def shared_root(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share (spark.checkpoint.dir).

    Only where that setting is missing (tests on one machine) a local temporary folder is used.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = setting(spark, "spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="heliograph-")
        _roots[app] = f"{base.rstrip('/')}/heliograph-{app}"
        atexit.register(_clean, spark, _roots[app])
    return _roots[app]


def remove(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clean(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, root)


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The table, written once (in folders ``by`` some columns) and read back: whatever is computed from it sees the same rows, and a lost executor repeats no more than one stage."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
