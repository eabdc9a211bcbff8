"""Recall end to end: lexical and vector streams, fusion, diversification, hydration, for a table of queries at once."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.stemmer import stems
from heliograph.functions.text import code_tokens, first_line, path_tokens, query_tokens, segment_matches
from heliograph.operators import bm25, fusion, vector
from heliograph.operators.paths import with_stale


class Mode(Enum):
    HYBRID = "hybrid"
    BM25 = "bm25"
    VECTOR = "vector"


@dataclass(frozen=True)
class RecallConfig:
    mode: Mode = Mode.HYBRID
    rrf_k: int = 60
    per_stream: int = 50
    cap: int | None = 3
    synonyms: bool = True


@dataclass(frozen=True)
class CodeRecallConfig:
    mode: Mode = Mode.HYBRID
    rrf_k: int = 60
    per_stream: int = 50
    path_boost: float = 0.02
    cap: int | None = 2
    language: str | None = None
    path_prefix: str | None = None
    stem: bool = True


#: Rows of results that are sent to all executors at most; larger ones are joined by the engine's own choice.
SENT = 200_000


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """The table, marked to be sent around if it has at most so many ``rows`` and these are few."""
    return F.broadcast(df) if rows <= SENT else df


def expand(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(qid, tokens): each query's tokens, then its synonyms' expansions that aren't among them in whatever case.

    Tokens keep their order and repeats; expansions are sorted, each once.
    """
    tokens = queries.select("qid", query_tokens(F.col("text")).alias("own"))
    found = tokens.select("qid", F.explode(F.array_distinct("own")).alias("term")).join(synonyms, "term").groupBy("qid").agg(F.array_sort(F.collect_set("expansion")).alias("more"))
    both = tokens.join(found, "qid", "left")
    once = F.aggregate(F.coalesce("more", F.array().cast("array<string>")), F.array().cast("array<string>"), lambda s, x: F.when(F.exists(s, lambda y: F.lower(y) == F.lower(x)), s).otherwise(F.concat(s, F.array(x))))
    new = F.filter(once, lambda x: ~F.exists("own", lambda t: F.lower(t) == F.lower(x)))
    return both.select("qid", F.concat("own", new).alias("tokens"))


def expanded_text(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """The word bag that is searched for; a query without tokens stays as it is."""
    bags = expand(queries, synonyms).select("qid", F.array_join("tokens", " ").alias("bag"))
    return queries.join(bags, "qid").select("qid", F.when(F.col("bag") == "", F.col("text")).otherwise(F.col("bag")).alias("text"))


def recall(corpus: DataFrame, vectors: DataFrame | None, queries: DataFrame, synonyms: DataFrame | None = None, config: RecallConfig | None = None, limit: int = 10, index: bm25.Index | None = None) -> DataFrame:
    """(qid, position, id, grp, score) and the corpus's other columns.

    corpus (id, grp, body, ...), vectors (id, emb_q8), queries (qid, text, q8). With an index of
    the corpus only the queries' terms are read, without one its texts are. Rows are hydrated after the cut, so only
    what is returned is read wide. Blank queries and a limit of 0 give nothing.
    """
    config = config or RecallConfig()
    queries = queries.filter(F.trim("text") != "")
    if limit <= 0:
        return corpus.limit(0).select(F.lit(0).cast("long").alias("qid"), F.lit(0).cast("long").alias("position"), "id", "grp", F.lit(0.0).alias("score"), *[c for c in corpus.columns if c not in ("id", "grp")])
    streams = []
    if config.mode != Mode.VECTOR:
        words = expanded_text(queries, synonyms) if config.synonyms and synonyms is not None else queries
        streams.append(bm25.top(bm25.scores(corpus, words) if index is None else bm25.scores_from(index, words), config.per_stream))
    if config.mode != Mode.BM25 and vectors is not None:
        known = vectors.join(corpus.select("id"), "id", "left_semi")
        streams.append(bm25.top(vector.scores(known, queries, config.per_stream), config.per_stream))
    if not streams:
        raise ValueError("vectors are needed in this mode")
    fused = fusion.fuse(streams, config.rrf_k)
    # a query has at most so many hits in each stream, and ``limit`` results
    n = queries.count()
    grouped = corpus.select("id", "grp").join(_sent(fused, n * config.per_stream * len(streams)), "id")
    best = fusion.diversify(grouped, "grp", config.cap, limit)
    return corpus.join(_sent(best.drop("grp"), n * limit), "id").select("qid", "position", "id", "grp", "score", *[c for c in corpus.columns if c not in ("id", "grp")])


def code_scores(chunks: DataFrame, queries: DataFrame, stem: bool = True) -> DataFrame:
    """Per-field BM25 over body, qualified name and path, with identifiers taken apart and, if wished, stemmed."""
    analyze = (lambda c: stems(code_tokens(c))) if stem else code_tokens
    return bm25.scores(chunks.withColumn("path_text", F.col("path")), queries, analyze, ("body", "qualified", "path_text"))


def recall_code(
    chunks: DataFrame, vectors: DataFrame | None, queries: DataFrame, config: CodeRecallConfig | None = None, limit: int = 10, listing: DataFrame | None = None, files: DataFrame | None = None, index: bm25.Index | None = None
) -> DataFrame:
    """(qid, position, id, path, score, ...) of chunks (id, path, language, qualified, body, ...).

    Language and path filters come before the ranking; with an index of all chunks they choose
    what is ranked, and frequencies are those of all. With a listing of the disk and the stored
    files (path, mtime_us, size) a flag ``stale`` is added: unknown, missing or changed files.
    """
    config = config or CodeRecallConfig()
    queries = queries.filter(F.trim("text") != "")
    if config.language:
        chunks = chunks.filter(F.col("language") == config.language)
    if config.path_prefix:
        chunks = chunks.filter(F.col("path").startswith(config.path_prefix))
    streams = []
    if config.mode != Mode.VECTOR:
        known = chunks if config.language or config.path_prefix else None
        streams.append(bm25.top(code_scores(chunks, queries, config.stem) if index is None else bm25.scores_from(index, queries, known), config.per_stream))
    if config.mode != Mode.BM25 and vectors is not None:
        streams.append(bm25.top(vector.scores(vectors.join(chunks.select("id"), "id", "left_semi"), queries, config.per_stream), config.per_stream))
    n = queries.count()
    fused = chunks.select("id", "path").join(_sent(fusion.fuse(streams, config.rrf_k), n * config.per_stream * len(streams)), "id").join(_sent(queries.select("qid", path_tokens(F.col("text")).alias("ptoks")), n), "qid")
    fused = fusion.boost(fused, segment_matches(F.col("path"), F.col("ptoks")), config.path_boost).drop("ptoks")
    best = fusion.diversify(fused, "path", config.cap, limit)
    out = chunks.join(_sent(best.drop("path"), n * limit), "id")
    if listing is not None and files is not None:
        out = with_stale(out, files, listing)
    return out


HEADER = "## Recalled context\n"


def context(results: DataFrame, budget: int) -> DataFrame:
    """(qid, text): Markdown lines in order, as many as fit the budget of tokens; the header always."""
    line = F.format_string("- **[%s]** _%s_: %s\n", "kind", "grp", first_line(F.col("body")))
    kept = fusion.within_budget(results.select("qid", "position", line.alias("line")), HEADER, budget)
    lines = kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "").alias("lines"))
    return results.select("qid").distinct().join(lines, "qid", "left").select("qid", F.concat(F.lit(HEADER), F.coalesce("lines", F.lit(""))).alias("text"))
