"""Shared plumbing of the corpus operators: tables, shared storage, folds, Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm import textkit

#: Rows and bytes of one Arrow batch: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 2 << 20

_roots: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="heliograph-"), "heliograph.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share (spark.checkpoint.dir).

    Only where that setting is missing (tests on one machine) a local temporary folder is used.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _conf(spark, "spark.checkpoint.dir")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="heliograph-")
        _roots[app] = f"{base.rstrip('/')}/heliograph-{app}"
        atexit.register(_clean, spark, _roots[app])
    return _roots[app]


def _conf(spark: SparkSession, key: str) -> str | None:
    try:
        return spark.conf.get(key)
    except Exception as e:  # an unset key without a default
        if "SQL_CONF_NOT_FOUND" not in str(e):
            raise
        return None


def remove(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clean(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, root)


class Shelf:
    """Intermediate tables of one operator call, in shared storage.

    ``put`` writes a DataFrame and reads it back, which cuts its lineage: a lost executor
    never forces more than the stage at hand to be run again. ``clear`` drops what is on
    the shelf but the tables named in ``keep``; what is kept goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.paths = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}", {}

    def put(self, key: str, df: DataFrame, options: dict | None = None) -> DataFrame:
        self.paths[key] = path = f"{self.root}/{key}"
        writer = df.write.mode("overwrite")
        for k, v in (options or {}).items():
            writer = writer.option(k, v)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keys: str) -> None:
        remove(self.spark, *(self.paths.pop(k) for k in keys if k in self.paths))

    def clear(self, *keep: str) -> None:
        self.drop(*(k for k in list(self.paths) if k not in keep))


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids give null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(parts)


def in_fold(doc_id: Column | str, parts: int, which: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == which, F.lit(False))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and bytes.

    The two limits are session settings; they are lowered here, never raised.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(conf.get(key)).rstrip("bB") or 0)
        if now <= 0 or now > most:
            conf.set(key, str(most))

    def run(it):
        # what is freed goes back to the system, not to a pool of the worker's
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from fn(it)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives the memory of a task back: workers stay for the next stages, beside the executor's heap."""
    textkit.TABLES.shrink()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A new schema with further fields (``StructType.add`` would change a DataFrame's own)."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(ddl).fields])


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of the table has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def share_under(df: DataFrame, key: Column, bound: int, rows: int) -> DataFrame:
    """At most about ``bound`` of ``rows`` rows, chosen by a hash of ``key``: all of them if there are no more."""
    if rows <= bound:
        return df
    top = 1 << 30
    return df.filter(F.pmod(F.xxhash64(key, F.lit("share")), F.lit(top)) < int(top * bound / rows))
