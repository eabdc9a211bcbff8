"""A lenient query syntax: words, "phrases", +must, -must not, AND/OR/NOT, field:word.

A word that the analyzer takes apart is a phrase. Parsing is on the driver (queries are short);
the parsed query runs as a semi join with what its clauses allow around the BM25 of its positive words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.text import default_tokens
from heliograph.operators import bm25

PART = re.compile(r"""(?P<sign>[+-])?(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"?|(?P<word>[^\s"]+))""")


@dataclass(frozen=True)
class Clause:
    text: str
    occur: str = "should"  # should, must, not
    field: str | None = None
    phrase: bool = False


def parse(text: str, fields: tuple[str, ...] = ("body",)) -> list[Clause]:
    """Clauses in order. AND binds its two neighbours as must; NOT negates the next clause; what can't be read is skipped."""
    out: list[Clause] = []
    negate = both = False
    for m in PART.finditer(text):
        word, sign, field = m["word"], m["sign"], m["field"]
        if word in ("AND", "OR", "NOT") and not sign and not field:
            negate = negate or word == "NOT"
            if word == "AND":
                both = True
                if out and out[-1].occur == "should":
                    out[-1] = Clause(out[-1].text, "must", out[-1].field, out[-1].phrase)
            continue
        body = m["phrase"] if word is None else word
        if field and field not in fields:
            body, field = f"{field} {body}", None
        if not body.strip():
            continue
        occur = "not" if sign == "-" or negate else "must" if sign == "+" or both else "should"
        out.append(Clause(body, occur, field, word is None))
        negate = both = False
    return out


def _tokens_of(spark: SparkSession, texts: list[str], analyze: Callable[[Column], Column]) -> list[list[str]]:
    """The analyzer's tokens of each text, made once on the driver."""
    row = spark.range(1).select(*[analyze(F.lit(t)).alias(str(k)) for k, t in enumerate(texts)]).first()
    return [list(x or []) for x in row]


def _follow(own: Column, tokens: list[str]) -> Column:
    """Whether the tokens are next to each other in a text's tokens."""
    if len(tokens) < 2:
        return F.array_contains(own, tokens[0]) if tokens else F.lit(False)
    n, words = len(tokens), F.array(*map(F.lit, tokens))
    at = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(at, lambda i: (F.element_at(own, i) == tokens[0]) & (F.slice(own, i, F.lit(n)) == words))


def _matching(corpus: DataFrame, clauses: list[Clause], tokens: list[list[str]], fields: tuple[str, ...], analyze: Callable[[Column], Column]) -> DataFrame:
    """Ids of documents with every must, no not and, if there is nothing else, any should.

    A document's tokens are the variable of a lambda, so they are made once: an expression inside
    a lambda would be evaluated anew at every place of the text.
    """
    used = list(dict.fromkeys([*fields, *(c.field for c in clauses if c.field)]))
    own = F.struct(*[analyze(F.coalesce(F.col(f), F.lit(""))).alias(str(k)) for k, f in enumerate(used)])

    def ok(t: Column) -> Column:
        has = [(c.occur, reduce(or_, [_follow(t[str(used.index(f))], own_) for f in ([c.field] if c.field else fields)])) for c, own_ in zip(clauses, tokens, strict=True)]
        either = [x for occur, x in has if occur == "should"]
        must = [x for occur, x in has if occur == "must"] or ([reduce(or_, either)] if either else [])
        return reduce(and_, [*must, *(~x for occur, x in has if occur == "not")])

    return corpus.filter(F.exists(F.array(own), ok)).select("id")


def search(corpus: DataFrame, text: str, limit: int = 50, fields: tuple[str, ...] = ("body",), analyze: Callable[[Column], Column] = default_tokens, qid: int = 0) -> DataFrame:
    """(qid, id, score, rank) of one parsed query."""
    clauses = parse(text, fields)
    spark = corpus.sparkSession
    positive = [c for c in clauses if c.occur != "not"]
    if not positive:
        return spark.createDataFrame([], "qid long, id long, score double, rank long")
    scored, groups = None, list(dict.fromkeys(c.field for c in positive))
    made = _tokens_of(spark, [*(" ".join(c.text for c in positive if c.field == field) for field in groups), *(c.text for c in clauses)], analyze)
    for field, words in zip(groups, made, strict=False):
        count = Counter(words)
        terms = F.broadcast(spark.createDataFrame(pa.table({"qid": pa.array([qid] * len(count), pa.int64()), "term": pa.array(count, pa.string()), "qtf": pa.array(count.values(), pa.int64())})))
        own = bm25.scores_of(corpus, terms, analyze, (field,) if field else fields)
        scored = own if scored is None else scored.unionByName(own)
    scored = scored.groupBy("qid", "id").agg(F.round(F.sum("score"), bm25.DIGITS).alias("score"))
    scored = scored.join(_matching(corpus, clauses, made[len(groups) :], fields, analyze), "id", "left_semi")
    return bm25.top(scored.select("qid", "id", "score"), limit)
