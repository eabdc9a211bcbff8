"""BM25 over a corpus (id, grp, body) for a whole table of queries (qid, text) in one plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.text import default_tokens
from heliograph.sources.scratch import written

K1, B = 1.2, 0.75
#: Scores are rounded before ranking, so that ranks don't depend on the order of floating-point sums.
DIGITS = 9


#: Rows (query, term) of a query set that are sent to all executors at most.
TERMS = 50_000
#: Folders of terms by hash: a query reads only those of its terms.
BUCKETS = 64


class Index(NamedTuple):
    """Stored postings (field, term, id, dl, tf, bucket), sizes (field, n, avgdl) and what makes a text's terms."""

    terms: DataFrame
    sizes: DataFrame
    analyze: Callable[[Column], Column]


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _tokens(corpus: DataFrame, analyze: Callable[[Column], Column], fields: tuple[str, ...]) -> DataFrame:
    """(id, field, tokens): null and empty fields have none."""
    parts = None
    for f in fields:
        one = corpus.select("id", F.lit(f).alias("field"), analyze(F.coalesce(F.col(f), F.lit(""))).alias("tokens"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def lengths(corpus: DataFrame, analyze: Callable[[Column], Column] = default_tokens, fields: tuple[str, ...] = ("body",)) -> DataFrame:
    """(id, field, dl)"""
    return _tokens(corpus, analyze, fields).select("id", "field", F.size("tokens").alias("dl"))


def postings(corpus: DataFrame, analyze: Callable[[Column], Column] = default_tokens, fields: tuple[str, ...] = ("body",)) -> DataFrame:
    """(field, term, id, dl, tf): the inverted index. Term counts are combined before the shuffle, as a document's tokens are in one task."""
    return _tokens(corpus, analyze, fields).select("id", "field", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("field", "term", "id", "dl").agg(F.count("*").alias("tf"))


def in_buckets(posted: DataFrame) -> DataFrame:
    """Postings in the order of the stored index: ranges of terms, so that a frequent term is split among tasks."""
    order = ["bucket", "term", "field", "id"]
    return posted.withColumn("bucket", bucket(F.col("term"))).repartitionByRange("bucket", "term", "id").sortWithinPartitions(*order)


def build(corpus: DataFrame, analyze: Callable[[Column], Column] = default_tokens, fields: tuple[str, ...] = ("body",)) -> Index:
    """An index of a corpus in scratch storage, for as long as the application runs."""
    sizes = lengths(corpus, analyze, fields).groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(written(in_buckets(postings(corpus, analyze, fields)), "terms", ("bucket",)), written(sizes, "sizes"), analyze)


def query_terms(queries: DataFrame, analyze: Callable[[Column], Column] = default_tokens) -> DataFrame:
    """(qid, term, qtf)"""
    return queries.select("qid", F.explode(analyze(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def scores(corpus: DataFrame, queries: DataFrame, analyze: Callable[[Column], Column] = default_tokens, fields: tuple[str, ...] = ("body",)) -> DataFrame:
    """(qid, id, score): per field BM25, summed over fields.

    The corpus is read once for the sizes and once for the terms. Only the queries' terms pass
    the first join, whose other side is the query set; so what is shuffled is what they match.
    """
    return scores_of(corpus, query_terms(queries, analyze), analyze, fields)


def scores_of(corpus: DataFrame, terms: DataFrame, analyze: Callable[[Column], Column] = default_tokens, fields: tuple[str, ...] = ("body",)) -> DataFrame:
    """``scores`` by the queries' terms (qid, term, qtf), which the caller can have sent around."""
    parts = _tokens(corpus, analyze, fields)
    sizes = parts.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    # outer: else Spark would test the tokens' number first, and make them twice; the join drops the nulls
    tf = parts.select("id", "field", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).join(terms.select("term").distinct(), "term").groupBy("field", "term", "id", "dl").agg(F.count("*").alias("tf"))
    return _scored(tf, sizes, terms)


def scores_from(index: Index, queries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(qid, id, score) like ``scores``, from a stored index: only the folders of the queries' terms are read.

    With ``known`` (id) only those documents are ranked; frequencies stay those of the whole index.
    """
    terms = query_terms(queries, index.analyze)
    # few terms are made once, and sent around as they are; more stay a table like any other
    got = terms.limit(TERMS + 1).toArrow()
    if got.num_rows <= TERMS:
        terms = F.broadcast(queries.sparkSession.createDataFrame(got, terms.schema))
    asked = terms.select("term").distinct().withColumn("bucket", bucket(F.col("term")))
    tf = index.terms.join(asked, ["bucket", "term"]).select("field", "term", "id", "dl", "tf")
    return _scored(tf, index.sizes, terms, known)


def _scored(tf: DataFrame, sizes: DataFrame, terms: DataFrame, known: DataFrame | None = None) -> DataFrame:
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # a row for each field
    weighted = df.join(F.broadcast(sizes), "field").select("field", "term", weight.alias("idf"), "avgdl").join(terms, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    if known is not None:
        tf = tf.join(known.select("id"), "id", "left_semi")
    return tf.join(weighted, ["field", "term"]).groupBy("qid", "id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def top(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best of each query with their ranks from 1; ties by id. Groups are cut before and after the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.desc(by), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def phrase_ids(corpus: DataFrame, phrase: list[str], analyze: Callable[[Column], Column] = default_tokens) -> DataFrame:
    """Ids of documents in which the tokens follow each other."""
    tokens = analyze(F.col("body"))
    n = len(phrase)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - n + 1, F.lit(1))), lambda i: F.slice("t", i, F.lit(n)))
    return corpus.select("id", tokens.alias("t")).filter(F.exists(windows, lambda w: w == F.array(*map(F.lit, phrase)))).select("id")
