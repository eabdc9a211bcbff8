"""Joins on paths: the longest root that holds each path, stale files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixes(path: Column) -> Column:
    """The path's own components, one more each, up to the whole path: /a, /a/b, /a/b/c."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def longest_root(rows: DataFrame, roots: DataFrame, path_col: str = "path", default: str | None = None) -> DataFrame:
    """Adds ``root``: of roots (root) the longest that holds the path by components, or the default.

    An equi-join of the path's prefixes with the roots, so neither side has to be small; a path has
    as many prefixes as components.
    """
    whole = rows.select(F.col(path_col).alias("path__")).distinct().filter("path__ is not null")
    known = roots.select(F.rtrim("root", F.lit("/")).alias("prefix__"), "root").groupBy("prefix__").agg(F.min("root").alias("root"))
    best = whole.select("path__", F.explode(prefixes(F.col("path__"))).alias("prefix__")).join(known, "prefix__").groupBy("path__").agg(F.max_by("root", F.length("prefix__")).alias("root"))
    out = rows.join(best, rows[path_col] == best["path__"], "left").drop("path__")
    return out if default is None else out.withColumn("root", F.coalesce("root", F.lit(default)))


def with_stale(rows: DataFrame, files: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds ``stale`` to rows (path): files that are unknown, missing on disk, or of another time or size (path, mtime_us, size)."""
    was = files.select(F.col("path").alias("p1__"), F.struct("mtime_us", "size").alias("was__"))
    now = listing.select(F.col("path").alias("p2__"), F.struct("mtime_us", "size").alias("now__"))
    out = rows.join(was, rows["path"] == F.col("p1__"), "left").join(now, rows["path"] == F.col("p2__"), "left")
    return out.withColumn("stale", ~F.coalesce(F.col("was__") == F.col("now__"), F.lit(False))).drop("p1__", "p2__", "was__", "now__")
