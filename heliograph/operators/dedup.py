"""Deduplication against the last accepted occurrence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_S = 300


def accepted_times(times: Column, window: int = WINDOW_S) -> Column:
    """Of a sorted array of seconds those that are kept: a duplicate within ``window`` (included) of the last kept one is dropped and doesn't extend it."""

    @F.pandas_udf("array<bigint>")
    def run(rows: pd.Series) -> pd.Series:
        def kept(t) -> list[int]:
            out: list[int] = []
            for x in t:
                if not out or x - out[-1] > window:
                    out.append(int(x))
            return out

        return rows.map(kept)

    return run(times)


def dedup_window(rows: DataFrame, keys: list[str], ts: str, order: str, window: int = WINDOW_S) -> DataFrame:
    """Rows marked ``fresh``; of a key's rows at one second only the first by ``order`` can be.

    The fold needs a key's times in one array, but only of runs in which neighbours are within
    the window: a longer gap always makes the next row fresh. So keys are cut into runs first,
    and an array holds one run.
    """
    w = Window.partitionBy(*keys).orderBy(ts, order)
    gap = F.col(ts) - F.lag(ts).over(w)
    runs = rows.withColumn("run__", F.sum((F.coalesce(gap, F.lit(window + 1)) > window).cast("int")).over(w)).withColumn("nth__", F.row_number().over(Window.partitionBy(*keys, ts).orderBy(order)))
    names = [f"key{i}__" for i in range(len(keys))]
    kept = runs.filter("nth__ = 1").groupBy(*keys, "run__").agg(F.array_sort(F.collect_list(F.col(ts).cast("long"))).alias("t__")).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.explode(accepted_times(F.col("t__"), window)).alias("kept__"))
    joined = runs.join(kept, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [F.col(ts) == F.col("kept__")], "left")
    return joined.select(*rows.columns, ((F.col("nth__") == 1) & F.col("kept__").isNotNull()).alias("fresh"))
