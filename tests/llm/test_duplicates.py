"""Near duplicates, repeated passages, decontamination, licences: against brute force on small fixtures."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.llm import decontam, graphs, licenses, neardup, repeats
from heliograph.llm.common import Shelf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    docs, base = [], words_of(rng, 120)
    for i in range(60):
        docs.append(" ".join(words_of(rng, rng.randint(3, 150))))
    for i in range(80):  # a group of near copies that drifts away from its first text
        w = list(base)
        for _ in range(rng.choice([0, 1, 3, 6, 10])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        docs.append(" ".join(w))
    w = words_of(rng, 100)
    for i in range(30):  # a chain: each is like its neighbours only
        w = list(w)
        for j in range(4):
            w[(i * 4 + j) % 100] = f"c{i}-{j}"
        docs.append(" ".join(w))
    docs += ["", None, "one", "one", "two words", "Two WORDS", "a b c", "É b", "é b", "x " * 3000]
    docs += [docs[5], docs[5], docs[70]]
    rng.shuffle(docs)
    return docs


def shingles(text, k):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(docs, k):
    sets = [shingles(t, k) for t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(docs))]


@pytest.mark.parametrize("k, rounds, sketches, sets", [(2, 2, (512, 1 << 18), (64, 1 << 18)), (5, 1, (16, 1 << 18), (8, 1 << 18)), (2, 3, (8, 500), (64, 500))])
def test_near_duplicates(spark, monkeypatch, k, rounds, sketches, sets):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "SKETCH_BLOCK", sketches)
    monkeypatch.setattr(neardup, "SET_BLOCK", sets)
    docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumns({"n": F.lit(1), "rep": F.lit("x"), "kept": F.lit(None).cast("string")})
    got = sorted(tuple(r) for r in neardup.near_duplicates(df, words=k).collect())
    assert got == brute_components(docs, k)


def test_near_duplicates_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, words=2).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (None, 3, 1, False)], key=str)
    assert neardup.near_duplicates(df.limit(0), words=2).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(df, percent=50)
    kept = neardup.stage(spark, df.withColumn("lang", F.lit("en")), "").collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 3, None] and kept[0].asDict().keys() == {"doc_id", "text", "lang"}


def test_overlaps(monkeypatch):
    monkeypatch.setattr(neardup, "SLICE", 7)
    rng = random.Random(3)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40)))) for _ in range(20)]
    left, right = np.array([0, 3, 5, 7]), np.array([1, 2, 3, 9, 19])
    assert neardup._overlaps(sets, left, right).tolist() == [[len(set(sets[i]) & set(sets[j])) for j in right] for i in left]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = graphs.components(spark.createDataFrame(edges, "u long, v long"), Shelf(spark, "t"))
    loops = {u for u, v in edges if u == v}
    assert {(r["node"], r["root"]) for r in got.collect() if r["node"] not in loops} == {(i, find(i)) for e in edges for i in e if e[0] != e[1] and i not in loops}
    assert graphs.components(spark.createDataFrame([], "u long, v long"), Shelf(spark, "t")).count() == 0


def repeated(docs, n):
    seen, out = {}, defaultdict(set)
    for i, t in enumerate(docs):
        w, mine = WORD.findall(t or ""), []
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in seen:
                out[i].update(range(k, k + n))
            mine.append(g)
        for g in mine:
            seen.setdefault(g, i)
    return out


def passages(seed=2):
    rng = random.Random(seed)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(n) for n in (49, 50, 51, 80, 300)]
    docs = []
    for i in range(60):
        w = fresh(rng.randint(0, 120))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(shared)
        docs.append(" ".join(w))
    docs += ["same " * 400, "x " + "same " * 300, "a b " * 200, "y a b " + "a b " * 100, "", None, "short", docs[0], docs[0]]
    return docs


def test_repeated_passages(spark):
    docs = passages()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumns({"doc": F.lit(0), "h": F.lit("x")})
    rows = repeats.repeated_passages(df.repartition(7)).collect()
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        a, b = (WORD.findall(docs[r[c]]) for c in ("doc_id", "of_doc_id"))
        assert r["of_doc_id"] < r["doc_id"] and r["n_words"] >= repeats.MIN_WORDS
        assert a[r["start_word"] : r["start_word"] + repeats.MIN_WORDS] == b[r["of_start_word"] : r["of_start_word"] + repeats.MIN_WORDS]
        assert not any(" ".join(a[r["start_word"] : r["start_word"] + repeats.MIN_WORDS]) in " ".join(WORD.findall(t or "")) for t in docs[: r["of_doc_id"]])
    assert got == repeated(docs, repeats.MIN_WORDS)
    assert repeats.repeated_passages(df.limit(0)).count() == 0


def test_neighbours_across_partitions_and_batches(spark, monkeypatch):
    from heliograph.llm import common

    monkeypatch.setattr(common, "BATCH_ROWS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    docs = [" ".join(f"k{j}" for j in range(60))] * 40 + ["z " + " ".join(f"k{j}" for j in range(60))] * 5
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    rows = repeats.repeated_passages(df).collect()
    assert {r["of_doc_id"] for r in rows} == {0, 40}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert sorted({r["doc_id"] for r in rows}) == list(range(1, 45)) and all(r["n_words"] >= 60 for r in rows)


def test_cut_keeps_the_first(spark):
    docs = passages()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumns({"n_chars": F.length("text").cast("long"), "cut__": F.lit(1), "spans": F.lit("x"), "Whose": F.lit(2)})
    out = {r["doc_id"]: r for r in repeats.stage(spark, df, "").collect()}
    assert out[0]["text"] == docs[0] and len(docs) - 1 not in out
    left = [out[i]["text"] if i in out else "" for i in range(len(docs))]
    # what remains is at the ends of passages and where a cut has put two pieces together
    total = lambda texts: sum(map(len, repeated(texts, 50).values()))
    assert total(left) < 0.05 * total(docs)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.values())


def leaky():
    rng = random.Random(5)
    stop = ["the", "of", "and", "to", "in"]
    sentence = lambda n: [rng.choice(stop) if rng.random() < 0.35 else f"t{rng.randrange(4000)}" for _ in range(n)]
    items = [sentence(rng.randint(15, 55)) for _ in range(40)]
    docs, true = [], set()
    for i in range(300):
        w = sentence(rng.randint(20, 500))
        if i % 3 == 0:
            j = rng.randrange(len(items))
            x = list(items[j])
            kind = (i // 3) % 3
            if kind == 1:  # one word in eight left out
                x = [v for k, v in enumerate(x) if k % 8 != 3]
            if kind == 2:  # one in seven replaced
                x = [f"q{k}" if k % 7 == 2 else v for k, v in enumerate(x)]
            at = rng.randint(0, len(w))
            w[at:at] = x
            true.add((i, j))
        docs.append(" ".join(w).upper() if i % 6 == 0 else " ".join(w))
    return items, docs, true


def test_decontamination(spark):
    items, docs, true = leaky()
    df = spark.createDataFrame(list(enumerate(docs)) + [(900, None), (901, "")], "doc_id long, text string").withColumns({"item_id": F.lit(0), "cosine": F.lit("x")})
    bench = spark.createDataFrame([(j, " ".join(x) + ".") for j, x in enumerate(items)] + [(None, "x y z"), (99, None), (98, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()}
    assert got == true
    assert decontam.contaminated(df, bench.limit(0)).count() == 0
    assert decontam.contaminated(df.limit(0), bench).count() == 0


def test_lcs_against_the_table():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(np.array(a), np.array(b)) == t[-1][-1]


def test_license_scan(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "p/LICENSE", mit),
        (2, "p/a/x.txt", "some text\nand more"),
        (3, "p/a/b/y.txt", "words of a text " * 20 + f"\n{gpl}"),
        (4, "p/a/COPYING", f"notes\nmore notes that are no licence and rather long\n{gpl}"),
        (5, "p/a/b/z.txt", "nothing here"),
        (6, "q/z.txt", "a license to speak freely about the many things that were never meant to be a header of any file at all"),
        (7, "q/e.txt", ""),
        (8, None, None),
        (9, "top.txt", "Licensed under CC BY-NC 4.0."),
        (10, "r/s.txt", "plain"),
        (11, "p/c.txt", "SPDX-License-Identifier: Apache-2.0\n" + "code " * 20),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"license": F.lit(1), "dir": F.lit("x")})
    got = {r["doc_id"]: (r["license"], r["how"], r["from_path"]) for r in licenses.scan(df).collect()}
    assert got[1] == ("MIT", "file", "p/LICENSE") and got[11][:2] == ("Apache-2.0", "header")
    assert got[2] == ("GPL-3.0", "inherited", "p/a/COPYING") == got[5] and got[3][:2] == ("GPL-3.0", "header")
    assert got[6] == got[7] == ("CC-BY-NC-4.0", "inherited", "top.txt") and got[9][:2] == ("CC-BY-NC-4.0", "file")
    assert got[10] == ("CC-BY-NC-4.0", "inherited", "top.txt") and got[8] == (None, None, None)
    assert licenses.scan(df.limit(0)).count() == 0
