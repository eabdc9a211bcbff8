"""Repeated passages are exact, whatever part of them other documents quote."""

import random
from collections import defaultdict

import pytest

from heliograph.llm import repeats
from tests.llm.test_duplicates import passages, repeated


def quotes():
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    docs = []
    for _ in range(40):
        for n, part in ((50, 40), (55, 45), (60, 49), (60, 45), (70, 40)):
            whole = fresh(n)
            lo = rng.choice([0, n - part, rng.randint(0, n - part)])
            for w in (whole, whole[lo : lo + part], whole):
                docs.append(" ".join([*fresh(rng.randint(5, 60)), *w, *fresh(rng.randint(5, 60))]))
    return docs


@pytest.mark.parametrize("make", [quotes, passages])
def test_passages_are_exact(spark, make):
    docs = make()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = defaultdict(set)
    for r in repeats.repeated_passages(df.repartition(5)).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert got == repeated(docs, repeats.MIN_WORDS)
