"""Retrieval metrics, timing summaries, histograms and churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_any(ranks: Column, k: int) -> Column:
    return F.exists(ranks, lambda r: r <= k).cast("double")


def reciprocal_rank(ranks: Column) -> Column:
    return F.when(F.size(ranks) > 0, F.lit(1.0) / F.array_min(ranks)).otherwise(0.0)


def precision(ranks: Column, k: int) -> Column:
    return F.size(F.filter(ranks, lambda r: r <= k)) / F.lit(float(k))


def ndcg(ranks: Column, gold: Column, k: int) -> Column:
    gain = F.aggregate(F.filter(ranks, lambda r: r <= k), F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + F.lit(1.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(gold, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + F.lit(1.0)))
    return F.when(gold > 0, gain / ideal).otherwise(0.0)


def evaluate(records: DataFrame, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """Means over records (gold_total, gold_ranks): R@5/10/20, NDCG@10, MRR, P@5; 0 if there are none."""
    r, g = F.col("gold_ranks"), F.col("gold_total")
    cols = {"r_at_5": recall_any(r, 5), "r_at_10": recall_any(r, 10), "r_at_20": recall_any(r, 20), "ndcg_at_10": ndcg(r, g, 10), "mrr": reciprocal_rank(r), "p_at_5": precision(r, 5)}
    grouped = (records.rollup if rollup else records.groupBy)(*(by or []))
    return grouped.agg(F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n) for n, c in cols.items()])


def nearest_rank(sorted_values: Column, p: float) -> Column:
    """sorted[round((n - 1) p)], half away from zero."""
    return F.element_at(sorted_values, (F.round((F.size(sorted_values) - 1) * F.lit(p)) + 1).cast("int"))


def summary(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Total, mean, nearest-rank p50 and p95, maximum, and share of the grand total by group.

    Exact ranks without an array of a group's values: equal values are counted first, and the
    rank is found in the running counts.
    """
    counted = values.groupBy(*group, value).agg(F.count("*").alias("c__"))
    w = Window.partitionBy(*group)
    running = counted.withColumn("upto__", F.sum("c__").over(w.orderBy(value))).withColumn("n__", F.sum("c__").over(w))
    at = lambda p: F.min(F.when(F.col("upto__") >= F.round((F.col("n__") - 1) * F.lit(p)) + 1, F.col(value)))
    v = F.col(value) * F.col("c__")
    out = running.groupBy(*group).agg(F.sum("c__").alias("n"), F.sum(v).alias("total"), (F.sum(v) / F.sum("c__")).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("max"))
    return out.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))


def power_bucket(n: Column) -> Column:
    """1, 2-4, 5-8, 9-16, ... 65-128, 129+"""
    out = F.lit("129+")
    for top in (128, 64, 32, 16, 8, 4):
        low = 2 if top == 4 else top // 2 + 1
        out = F.when(n <= top, F.lit(f"{low}-{top}")).otherwise(out)
    return F.when(n <= 1, "1").otherwise(out)


def churn(events: DataFrame, window_s: int) -> DataFrame:
    """Counts by path, by root and by kind in one pass, and changes a minute."""
    per_min = F.round(F.count("*") * F.lit(60.0) / window_s, 6) if window_s else F.lit(0.0)
    return events.groupingSets([["path"], ["root"], ["kind"]], "path", "root", "kind").agg(F.count("*").alias("n"), per_min.alias("per_min"))


def counters(events: DataFrame, by: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """A row for each value of ``by`` with the number of events of each outcome."""
    return events.groupBy(by).pivot(outcome, outcomes).count().na.fill(0, outcomes)


def last_errors(events: DataFrame, n: int = 8, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last n rows; each task keeps its own last n."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)


def rolling_counts(events: DataFrame, keys: list[str], sec: str, order: str, window_s: int, most: int | None = None) -> DataFrame:
    """Adds ``in_window``: a key's events in the ``window_s`` seconds up to each one, at most ``most``.

    A frequent key is no single task: time is cut into slots of the window's length, each event is
    copied to the next slot, and a window never looks back further than that.
    """
    slot = F.floor(F.col(sec) / max(window_s, 1)).cast("long")
    copies = events.withColumn("slot__", F.explode(F.array(slot, slot + 1))).withColumn("own__", F.col("slot__") == slot)
    w = Window.partitionBy(*keys, "slot__").orderBy(sec).rangeBetween(-window_s, 0)
    counted = copies.withColumn("in_window", F.count("*").over(w)).filter("own__").drop("slot__", "own__")
    return counted if most is None else counted.withColumn("in_window", F.least("in_window", F.lit(most)))
