"""Updates as rewrites: replace, delete, evict, merge, dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.sources.scratch import written


def replace_by_key(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of the fresh keys are replaced."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def delete_keys(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key).distinct(), key, "left_anti")


def evict_older(obs: DataFrame, vectors: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Rows from before ``cutoff`` go, and the vectors that are left without a row."""
    kept = obs.filter(F.col("ts") >= cutoff)
    return kept, vectors.join(kept.select(F.col("id").alias("obs_id")), "obs_id", "left_semi")


def with_ids(existing: DataFrame, fresh: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """Dense ids that follow the largest one, in the given order; ties are in no particular order.

    Row numbers without one global sort task: rows are range-partitioned by the order and a hash
    of the row, so that a frequent value is split, and sorted within. They are written once with
    their partition and place in it; counts and ids both come from that copy, so they fit each
    other however often it is read. Only a count for each partition reaches the driver.
    """
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).first()["m"]
    by = [*[F.col(c) for c in order], F.xxhash64(*[F.col(f"`{c}`") for c in fresh.columns])]
    # the identifier has the partition in its upper bits and the place in the lower 33
    placed = written(fresh.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place__", F.monotonically_increasing_id()), "placed")
    part, nth = F.shiftright("place__", 33), F.col("place__").bitwiseAND((1 << 33) - 1)
    counts = {r["part__"]: r["count"] for r in placed.groupBy(part.alias("part__")).count().collect()}
    before, total = [], top
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    if not before:
        return fresh.withColumn(id_col, F.lit(None).cast("long"))
    offsets = fresh.sparkSession.createDataFrame(before, "part__ long, before__ long")
    return placed.withColumn("part__", part).join(F.broadcast(offsets), "part__").withColumn(id_col, F.col("before__") + nth + 1).drop("part__", "place__", "before__")


def upsert_sessions(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Started stays as it was; a new branch or folder wins if it is there."""
    e, f = existing.alias("e"), fresh.alias("f")
    both = e.join(f, F.col("e.id") == F.col("f.id"), "full_outer")
    pick = lambda c, first, second: F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c)
    return both.select(pick("id", "e", "f"), pick("started_ts", "e", "f"), pick("branch", "f", "e"), pick("cwd", "f", "e"))


def cache_split(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (with emb) and misses of wanted (key, ...) in a cache (key, emb)."""
    both = wanted.join(cache.select("key", "emb"), "key", "left")
    return both.filter("emb is not null"), both.filter("emb is null").drop("emb")


def add_synonym(synonyms: DataFrame, a: str, b: str) -> DataFrame:
    return synonyms.unionByName(synonyms.sparkSession.createDataFrame([(a, b), (b, a)], "term string, expansion string")).dropDuplicates()


def remove_synonym(synonyms: DataFrame, term: str, expansion: str | None = None) -> DataFrame:
    """The pair in both directions, or every row that touches the term."""
    t, e = F.col("term"), F.col("expansion")
    gone = (t == term) | (e == term) if expansion is None else ((t == term) & (e == expansion)) | ((t == expansion) & (e == term))
    return synonyms.filter(~gone)
