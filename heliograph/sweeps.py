"""Measurements over source trees: phases of indexing, tokens of chunks, embedding by batch size."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.operators import metrics
from heliograph.operators.chunker import chunks
from heliograph.sources.embed import Provider, embed
from heliograph.sources.readers import Config, read_sources
from heliograph.sources.scratch import written

#: Nearest-rank percentiles of token counts.
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def _files(spark: SparkSession, roots: list[str], config: Config) -> DataFrame:
    out = None
    for root in roots:
        one = read_sources(spark, root, config)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("there is no root")
    return out


def language_breakdown(made: DataFrame) -> DataFrame:
    """(language, files, chunks) of chunks (path, language), most files first."""
    return made.groupBy("language").agg(F.count_distinct("path").alias("files"), F.count("*").alias("chunks")).orderBy(F.desc("files"), "language")


def call_sizes(made: DataFrame, bucket: Callable[[Column], Column] = metrics.power_bucket) -> DataFrame:
    """(bucket, calls, chunks, call_share, chunk_share): how many chunks a file's embedding call has."""
    by = made.groupBy("path").agg(F.count("*").alias("n")).groupBy(bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("calls"), F.sum("n").alias("chunks"))
    totals = by.agg(F.sum("calls").alias("c"), F.sum("chunks").alias("k"))
    return by.join(F.broadcast(totals)).select("bucket", "calls", "chunks", F.round(F.col("calls") / F.col("c"), 6).alias("call_share"), F.round(F.col("chunks") / F.col("k"), 6).alias("chunk_share"))


def code_index(spark: SparkSession, provider: Provider, roots: list[str], config: Config | None = None) -> dict:
    """Seconds of each phase of an index run over the roots, which is thrown away; the slowest files and what was made."""
    phases, config = {}, config or Config()

    def timed(name: str, df: DataFrame) -> DataFrame:
        began = time.perf_counter()
        out = written(df, f"sweep-{name}")
        phases[name] = round(time.perf_counter() - began, 3)
        return out

    files = timed("read", _files(spark, roots, config))
    made = timed("chunk", chunks(files, provider.count_tokens, provider.max_tokens))
    timed("embed", made.select("path", embed(F.col("body"), provider).alias("emb")))
    total = sum(phases.values()) or 1.0
    largest = made.groupBy("path").agg(F.count("*").alias("chunks"), F.sum(F.length("body")).alias("chars")).orderBy(F.desc("chars"), "path").limit(10)
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {"seconds": phases, "share": {k: round(v / total, 6) for k, v in phases.items()}, "files": files.count(), "chunks": made.count(), "languages": rows(language_breakdown(made)), "call_sizes": rows(call_sizes(made)), "largest_files": rows(largest)}


def token_counts(made: DataFrame, provider: Provider) -> DataFrame:
    """(path, qualified, tokens) of chunks."""

    @F.pandas_udf(T.LongType())
    def count(texts):
        return texts.map(lambda t: provider.count_tokens(t or ""))

    return made.select("path", "qualified", count("body").alias("tokens"))


def token_summary(counted: DataFrame, cap: int) -> DataFrame:
    """(n, mean, p50 .. p999, max, over_cap, over_pct) of token counts, exact, without an array of them all.

    Equal counts are put together first: their number is bounded by the largest count.
    """
    by = counted.groupBy("tokens").agg(F.count("*").alias("c"))
    whole = by.agg(F.sum("c").alias("n"), (F.sum(F.col("tokens") * F.col("c")) / F.sum("c")).alias("mean"), F.max("tokens").alias("max"), F.sum(F.when(F.col("tokens") > cap, F.col("c")).otherwise(0)).alias("over_cap"), F.array_sort(F.collect_list(F.struct("tokens", "c"))).alias("all"))
    at = lambda p: F.aggregate("all", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("v")), lambda s, x: F.struct((s["upto"] + x["c"]).alias("upto"), F.when(s["v"].isNotNull(), s["v"]).when(s["upto"] + x["c"] >= F.round((F.col("n") - 1) * F.lit(p)) + 1, x["tokens"]).alias("v")))["v"]
    return whole.select("n", F.round("mean", 6).alias("mean"), *[at(p).alias(k) for k, p in PERCENTILES.items()], "max", "over_cap", F.round(100 * F.col("over_cap") / F.col("n"), 6).alias("over_pct"))


def tokens(spark: SparkSession, provider: Provider, roots: list[str], config: Config | None = None) -> dict:
    """Token counts of chunks without the token cap, and the largest ones beyond it."""
    counted = written(token_counts(chunks(_files(spark, roots, config or Config())), provider), "sweep-tokens")
    cap = max(1, provider.max_tokens - 8)
    over = counted.filter(F.col("tokens") > cap).orderBy(F.desc("tokens"), "path", "qualified").limit(20)
    return {"cap": cap, **counted.transform(lambda d: token_summary(d, cap)).first().asDict(), "over": [r.asDict() for r in over.collect()]}


def pool(spark: SparkSession, n: int) -> DataFrame:
    """(id, body): n made-up chunks of different lengths."""
    return spark.range(n).select("id", F.concat(F.lit("fn item_"), F.col("id").cast("string"), F.lit("() {\n"), F.repeat(F.lit("    call(value);\n"), (F.col("id") % 40 + 1).cast("int")), F.lit("}\n")).alias("body"))


def embed_sweep(spark: SparkSession, provider: Provider, sizes: list[int], n: int = 512) -> list[dict]:
    """Seconds and chunks a second of embedding the same chunks in batches of each size."""
    from heliograph.sources.embed import embed_table

    out = []
    for size in sizes:
        began = time.perf_counter()
        embed_table(pool(spark, n), provider, "body", "emb", size).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        out.append({"batch": size, "seconds": round(took, 3), "per_s": round(n / took, 1)})
    return out
