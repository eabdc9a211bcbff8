"""Rank fusion, path boost, diversification, budgeted prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
DIGITS = 9


def fuse(streams: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(qid, id, score): reciprocal ranks of streams (qid, id, rank) summed by id.

    A union and one aggregation stand for the outer join: one shuffle, with partial sums.
    """
    all_ = streams[0].select("qid", "id", "rank")
    for s in streams[1:]:
        all_ = all_.unionByName(s.select("qid", "id", "rank"))
    return all_.groupBy("qid", "id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), DIGITS).alias("score"))


def boost(fused: DataFrame, matches: Column, weight: float) -> DataFrame:
    return fused.withColumn("score", F.round(F.col("score") + F.lit(weight) * matches, DIGITS)) if weight > 0 else fused


def diversify(fused: DataFrame, group: str, cap: int | None, limit: int) -> DataFrame:
    """The first ``cap`` of each group in order, then the overflow in order, up to ``limit``; with position from 1.

    No cap, or 0, is a plain top list. Input: (qid, id, score, group); ties by id.
    """
    order = [F.desc("score"), F.asc("id")]
    late = F.lit(False)
    if cap:
        fused = fused.withColumn("rn__", F.row_number().over(Window.partitionBy("qid", group).orderBy(*order)))
        late = F.col("rn__") > cap
    out = fused.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(late, *order)).cast("long"))
    return out.filter(F.col("position") <= limit).drop("rn__")


def capped(fused: DataFrame, group: str, cap: int, limit: int) -> DataFrame:
    """At most ``cap`` of each group, without backfill."""
    order = [F.desc("score"), F.asc("id")]
    kept = fused.withColumn("rn__", F.row_number().over(Window.partitionBy("qid", group).orderBy(*order))).filter(F.col("rn__") <= cap).drop("rn__")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long")).filter(F.col("position") <= limit)


def within_budget(lines: DataFrame, header: str, budget: int) -> DataFrame:
    """The prefix of lines (qid, position, line) that fits with the header into four bytes a token."""
    used = F.sum(F.octet_length("line").cast("long")).over(Window.partitionBy("qid").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used + len(header.encode())).filter(F.col("used") <= budget * 4)
