"""Evaluation of retrieval: question sets with their own haystacks, and a query bank over a code index.

Every ranking here is a real search; ranks of what is expected are counted in it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.functions.text import default_tokens, path_tokens, segment_matches, session_body
from heliograph.functions.vectors import dot_i8, quantize_i8
from heliograph.operators import bm25, fusion, metrics, vector
from heliograph.plans.recall import CodeRecallConfig, Mode, RecallConfig, expanded_text, recall_code
from heliograph.sources.embed import Provider, embed
from heliograph.sources.readers import markdown_table, question_sessions

MODES = ("bm25", "vector", "hybrid", "int8", "int8_hybrid")


# --- rankings -------------------------------------------------------------------------------
def spaced_scores(corpus: DataFrame, queries: DataFrame, analyze: Callable[[Column], Column] = default_tokens) -> DataFrame:
    """BM25 (qid, id, score) of corpus (space, id, body) for queries (qid, text), each in the space of its own number: sizes and frequencies are the space's."""
    parts = corpus.select("space", "id", analyze(F.coalesce("body", F.lit(""))).alias("tokens"))
    sizes = parts.groupBy("space").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    terms = bm25.query_terms(queries, analyze).withColumnRenamed("qid", "space")
    tf = parts.select("space", "id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(terms, ["space", "term"]).groupBy("space", "term", "id", "dl", "qtf").agg(F.count("*").alias("tf"))
    df = tf.groupBy("space", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") * (bm25.K1 + 1) / (F.col("tf") + bm25.K1 * (1 - bm25.B + bm25.B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, ["space", "term"]).join(sizes, "space").groupBy("space", "id").agg(F.round(F.sum(part), bm25.DIGITS).alias("score"))
    return scored.withColumnRenamed("space", "qid")


def session_ranking(sessions: DataFrame, questions: DataFrame, provider: Provider, config: RecallConfig | None = None, limit: int = 20, synonyms: DataFrame | None = None) -> DataFrame:
    """(qid, position, session): each question's search in its own haystack, sessions (qid, id, session, body)."""
    config, streams = config or RecallConfig(), []
    corpus = sessions.select(F.col("qid").alias("space"), "id", "body")
    if config.mode != Mode.VECTOR:
        words = expanded_text(questions, synonyms) if config.synonyms and synonyms is not None else questions
        streams.append(bm25.top(spaced_scores(corpus, words), config.per_stream))
    if config.mode != Mode.BM25:
        own = corpus.select(F.col("space").alias("qid"), "id", quantize_i8(embed(F.col("body"), provider)).alias("v"))
        asked = questions.select("qid", quantize_i8(embed(F.col("text"), provider)).alias("q"))
        streams.append(bm25.top(own.join(asked, "qid").select("qid", "id", dot_i8(F.col("v"), F.col("q")).cast("long").alias("score")), config.per_stream))
    fused = fusion.fuse(streams, config.rrf_k).join(sessions.select("qid", "id", "session"), ["qid", "id"])
    return fusion.diversify(fused, "session", config.cap, limit).select("qid", "position", "session")


def int8_paths(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 20, pool: int = 200, cap: int = 2) -> DataFrame:
    """(qid, position, path) by the 8-bit index alone: the best ``pool`` chunks, then the path prefix, then at most ``cap`` a file."""
    best = bm25.top(vector.scores(vectors, queries, pool), pool)
    hit = best.join(chunks.select("id", "path"), "id").join(queries.select("qid", "path_prefix"), "qid")
    return _paths(hit.filter(_in_prefix()), cap, limit)


def int8_hybrid_paths(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, index: bm25.Index, limit: int = 20, per_stream: int = 50, rrf_k: int = 60, path_boost: float = 0.02, cap: int = 2) -> DataFrame:
    """(qid, position, path): BM25 within the prefix and the 8-bit index over all, fused, boosted by path, then the prefix."""
    asked = queries.select("qid", "path_prefix")
    inside = bm25.scores_from(index, queries).join(asked, "qid").join(chunks.select("id", "path"), "id").filter(_in_prefix()).select("qid", "id", "score")
    fused = fusion.fuse([bm25.top(inside, per_stream), bm25.top(vector.scores(vectors, queries, per_stream), per_stream)], rrf_k)
    fused = fused.join(chunks.select("id", "path"), "id").join(queries.select("qid", "path_prefix", path_tokens(F.col("text")).alias("ptoks")), "qid")
    return _paths(fusion.boost(fused, segment_matches(F.col("path"), F.col("ptoks")), path_boost).filter(_in_prefix()), cap, limit)


def _in_prefix() -> Column:
    return F.col("path_prefix").isNull() | F.col("path").startswith(F.col("path_prefix"))


def _paths(scored: DataFrame, cap: int, limit: int) -> DataFrame:
    """Paths in the order of their chunks, each at most ``cap`` times."""
    order = [F.desc("score"), F.asc("id")]
    kept = scored.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "path").orderBy(*order))).filter(F.col("nth") <= cap)
    return kept.select("qid", "path", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long").alias("position")).filter(F.col("position") <= limit)


# --- what is counted in them -----------------------------------------------------------------
def gold_ranks(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, gold_total, gold_ranks) of a ranking (qid, position, session) and gold (qid, session)."""
    total = gold.distinct().groupBy("qid").agg(F.count("*").cast("int").alias("gold_total"))
    hits = ranking.join(gold.distinct(), ["qid", "session"]).groupBy("qid").agg(F.array_sort(F.collect_list(F.col("position").cast("int"))).alias("gold_ranks"))
    return total.join(hits, "qid", "left").withColumn("gold_ranks", F.coalesce("gold_ranks", F.array().cast("array<int>")))


def first_hits(ranking: DataFrame, expected: DataFrame) -> DataFrame:
    """(qid, rank): the first position of a ranking (qid, position, path) whose path contains one of the expected strings (qid, expect array); null if none does."""
    found = ranking.join(expected.select("qid", "expect"), "qid").filter(F.exists("expect", lambda e: F.col("path").contains(e)))
    return expected.select("qid").join(found.groupBy("qid").agg(F.min("position").alias("rank")), "qid", "left")


def mode_stats(records: DataFrame) -> DataFrame:
    """(bucket, mode, n, hit_5, hit_10, hit_20, mrr, latency_ms) of records (bucket, mode, rank, latency_ms), by bucket and overall. A null rank is a miss."""
    rate = lambda k: F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), 6).alias(f"hit_{k}")
    found = [F.count("*").alias("n"), *map(rate, (5, 10, 20)), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("latency_ms"), 6).alias("latency_ms")]
    return records.groupBy("bucket", "mode").agg(*found).unionByName(records.groupBy("mode").agg(*found).withColumn("bucket", F.lit("overall")))


def synthetic_queries(names: DataFrame, column: str = "qualified", least: int = 4) -> DataFrame:
    """(query, id): the part of a name before its first comma, trimmed, of at least ``least`` characters, each once with the smallest id."""
    first = F.trim(F.split(column, ",")[0])
    return names.select("id", first.alias("query")).filter(F.length("query") >= least).groupBy("query").agg(F.min("id").alias("id"))


def verify_sha(spark: SparkSession, path: str, sha256: str) -> int:
    """The size in bytes of a file whose SHA-256 is as given; an error if it isn't."""
    row = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("sha")).first()
    if row is None or row["sha"] != sha256.lower():
        raise ValueError(f"{path} is not the file that was expected")
    return row["length"]


# --- runs ------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Run:
    summary: DataFrame
    by_type: DataFrame
    records: DataFrame


def run_questions(questions: DataFrame, provider: Provider, config: RecallConfig | None = None, limit: int = 20, synonyms: DataFrame | None = None) -> Run:
    """A question set in one plan: all questions are searched at once, each in its own haystack."""
    ids = questions.select("question_id", F.xxhash64("question_id").alias("qid"), F.col("question").alias("text"), "question_type")
    own = question_sessions(questions).join(ids.select("question_id", "qid"), "question_id")
    sessions = own.select("qid", F.col("nth").cast("long").alias("id"), "session", "is_gold", session_body(F.col("turns")).alias("body"))
    ranking = session_ranking(sessions, ids.select("qid", "text"), provider, config, limit, synonyms)
    gold = questions.join(ids.select("question_id", "qid"), "question_id").select("qid", F.explode("answer_session_ids").alias("session"))
    records = ids.select("qid", "question_id", "question_type").join(gold_ranks(ranking, gold), "qid")
    return Run(metrics.evaluate(records), metrics.evaluate(records, ["question_type"]), records)


def run_bank(chunks: DataFrame, vectors: DataFrame, bank: DataFrame, provider: Provider, index: bm25.Index, modes: tuple[str, ...] = MODES, limit: int = 20, synthetic: int = 0) -> tuple[DataFrame, DataFrame]:
    """(statistics by bucket and mode, first hits) of a query bank (qid, query, expect, path_prefix) and of names in the index.

    Synthetic queries are names of chunks that are expected to find their own file.
    """
    asked = bank.select("qid", F.col("query").alias("text"), "expect", "path_prefix", F.lit("curated").alias("bucket"))
    if synthetic:
        names = synthetic_queries(chunks.filter(~F.col("qualified").contains("part-"))).orderBy(F.xxhash64("query")).limit(synthetic)
        own = names.join(chunks.select("id", "path"), "id").select((-1 - F.col("id")).alias("qid"), F.col("query").alias("text"), F.array("path").alias("expect"), F.lit(None).cast("string").alias("path_prefix"), F.lit("synthetic").alias("bucket"))
        asked = asked.unionByName(own)
    asked = asked.withColumn("q8", quantize_i8(embed(F.col("text"), provider)))
    if asked.isEmpty():
        raise ValueError("the bank has no query")
    records = None
    for mode in modes:
        if mode == "int8":
            ranking = int8_paths(chunks, vectors, asked, limit)
        elif mode == "int8_hybrid":
            ranking = int8_hybrid_paths(chunks, vectors, asked, index, limit)
        else:
            ranking = None
            # a bank has few different prefixes
            for (prefix,) in asked.select("path_prefix").distinct().collect():
                own = asked.filter(F.col("path_prefix").eqNullSafe(F.lit(prefix)))
                found = recall_code(chunks, vectors, own, CodeRecallConfig(mode=Mode(mode), path_prefix=prefix), limit, index=index).select("qid", "path", "position")
                ranking = found if ranking is None else ranking.unionByName(found)
        one = first_hits(ranking, asked).join(asked.select("qid", "bucket"), "qid").withColumn("mode", F.lit(mode))
        records = one if records is None else records.unionByName(one)
    return mode_stats(records.withColumn("latency_ms", F.lit(None).cast("double"))), records


def write_code_report(stats: DataFrame, folder: str) -> None:
    """The statistics as Markdown and as indented JSON; they have a row for each bucket and mode."""
    rows = stats.orderBy("bucket", "mode")
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "code-report.md").write_text("# Code retrieval\n\n" + markdown_table(rows))
    Path(folder, "code-report.json").write_text(json.dumps([r.asDict() for r in rows.collect()], indent=2) + "\n")
