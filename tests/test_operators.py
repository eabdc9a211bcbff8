import pytest
from pyspark.sql import functions as F

from heliograph.operators import bm25, chunker, dedup, dml, fusion, metrics, vector


def ranked(spark, ids):
    return spark.createDataFrame([(0, i, r) for r, i in enumerate(ids, 1)], "qid long, id long, rank long")


def order(df):
    return [r["id"] for r in df.orderBy(F.desc("score"), "id").collect()]


def test_fusion(spark):
    assert order(fusion.fuse([ranked(spark, [2, 1]), ranked(spark, [1, 3])]))[0] == 1
    assert order(fusion.fuse([ranked(spark, []), ranked(spark, [])])) == []
    assert order(fusion.fuse([ranked(spark, [3, 1, 2]), ranked(spark, [])])) == [3, 1, 2]


@pytest.mark.parametrize("groups, cap, limit, want", [("AAAAABB", 3, 10, "AAABBAA"), ("AAAAAAAAAA", 3, 2, "AA"), ("AAA", 2, 3, "AAA"), ("AAB", 0, 3, "AAB"), ("AAB", None, 2, "AA")])
def test_diversify(spark, groups, cap, limit, want):
    rows = [(0, i, g, 1.0 - i / 100) for i, g in enumerate(groups)]
    out = fusion.diversify(spark.createDataFrame(rows, "qid long, id long, g string, score double"), "g", cap, limit)
    assert "".join(r["g"] for r in out.orderBy("position").collect()) == want


def test_capped_has_no_backfill(spark):
    rows = spark.createDataFrame([(0, i, "A", 1.0) for i in range(5)], "qid long, id long, g string, score double")
    assert fusion.capped(rows, "g", 2, 10).count() == 2


def test_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([(0, 1, "aaaa"), (0, 2, "b" * 30), (0, 3, "c")], "qid long, position long, line string")
    assert [r["position"] for r in fusion.within_budget(rows, "head", 3).collect()] == [1]


def test_dedup(spark):
    times = [0, 200, 301, 500, 602, 603]
    rows = [(i, "s1", t) for i, t in enumerate(times)] + [(90, "s2", 200), (91, "s2", 200), (92, None, 1), (93, None, 2)]
    out = dedup.dedup_window(spark.createDataFrame(rows, "id long, session string, ts long"), ["session"], "ts", "id")
    fresh = {r["id"] for r in out.filter("fresh").collect()}
    assert {times[i] for i in fresh if i < 90} == {0, 301, 602}
    assert fresh & {90, 91, 92, 93} == {90, 92} and out.count() == len(rows)


def test_bm25_against_a_loop(spark):
    from math import log

    docs = {1: "alpha beta beta", 2: "beta gamma", 3: "delta", 4: ""}
    corpus = spark.createDataFrame(list(docs.items()), "id long, body string")
    got = {r["id"]: r["score"] for r in bm25.scores(corpus, spark.createDataFrame([(0, "beta alpha")], "qid long, text string")).collect()}
    toks = {i: t.split() for i, t in docs.items()}
    avg = sum(map(len, toks.values())) / 4
    want = {}
    for i, ts in toks.items():
        for q in ("beta", "alpha"):
            tf, df = ts.count(q), sum(q in x for x in toks.values())
            if tf:
                want[i] = want.get(i, 0) + log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
    assert got == pytest.approx(want)
    assert {r["id"] for r in bm25.phrase_ids(corpus, ["beta", "beta"]).collect()} == {1}


def test_vector_scores_take_the_best_chunk(spark):
    v = spark.createDataFrame([(1, [1, 2]), (1, [3, 4]), (2, [0, 1])], "id long, emb_q8 array<tinyint>")
    q = spark.createDataFrame([(7, [1, 1])], "qid long, q8 array<tinyint>")
    assert {(r["id"], r["score"]) for r in vector.scores(v, q, 2).collect()} == {(1, 7), (2, 1)}


@pytest.mark.parametrize("ranks, gold, column, want", [([3], 1, "r_at_5", 1), ([6], 1, "r_at_5", 0), ([], 1, "r_at_5", 0), ([1, 4], 2, "mrr", 1), ([1, 3, 9], 3, "p_at_5", 0.4), ([1, 2], 2, "ndcg_at_10", 1)])
def test_metrics(spark, ranks, gold, column, want):
    assert metrics.evaluate(spark.createDataFrame([(gold, ranks)], "gold_total int, gold_ranks array<int>")).first()[column] == pytest.approx(want)


def test_metrics_of_nothing(spark):
    row = metrics.evaluate(spark.createDataFrame([], "gold_total int, gold_ranks array<int>")).first()
    assert row["n"] == 0 and row["mrr"] == 0


def test_summary_percentiles(spark):
    values = [5, 1, 4, 2, 3, 3]
    out = metrics.summary(spark.createDataFrame([("a", float(v)) for v in values], "g string, v double"), ["g"], "v").first()
    s = sorted(values)
    assert (out["p50"], out["p95"], out["max"], out["share"]) == (s[3], s[5], 5, 1)


def test_dense_ids_follow_the_largest(spark):
    existing = spark.createDataFrame([(5,), (9,)], "id long")
    out = dml.with_ids(existing, spark.range(100).select(F.col("id").alias("k")), ["k"])
    assert sorted((r["k"], r["id"]) for r in out.collect()) == [(k, k + 10) for k in range(100)]


def test_synonyms_are_removed_both_ways(spark):
    s = dml.add_synonym(spark.createDataFrame([("x", "y")], "term string, expansion string"), "a", "b")
    assert s.count() == 3
    assert dml.remove_synonym(s, "b", "a").count() == 1 and dml.remove_synonym(s, "x").count() == 2


def test_chunker():
    fields = "\n".join(f"    field_{i}: u64," for i in range(40))
    lines = "\n".join(f"    let x{i} = {i};" for i in range(40))
    names = [c["qualified"] for c in chunker.chunk_source(f"struct Foo {{\n{fields}\n}}\n\nfn add() {{\n{lines}\n}}\n", "rust")]
    assert names == ["Foo", "add"]
    assert len(chunker.chunk_source("use a;\nuse b;\nuse c;\n", "rust")) <= 1
    joined = ",".join(c["qualified"] for c in chunker.chunk_source("class User:\n    x = 1\n\ndef greet():\n    return 1\n", "python"))
    assert "User" in joined and "greet" in joined
    big = chunker.chunk_source("fn big() {\n" + "\n".join(f"    call({i});" for i in range(400)) + "\n}", "rust")
    assert all(len(c["body"].encode()) <= 1500 and c["qualified"].startswith("big#part-") for c in big)
    assert "\n".join(c["body"] for c in big).count("call(") == 400
    assert chunker.chunk_source("just text", "rust")[0]["kind"] == "file"
    pieces = chunker.token_cap({"body": "a b c\n" + "x " * 30, "line_start": 5, "line_end": 6, "qualified": "q", "kind": "k"}, lambda t: len(t.split()), 8)
    assert all(len(p["body"].split()) <= 8 for p in pieces) and pieces[0]["line_start"] == 5


def test_chunks_on_a_table(spark):
    files = spark.createDataFrame([("a.py", "python", "def f():\n    return 1\n"), ("b.py", "python", None), ("c.py", "python", "")], "path string, language string, source string")
    assert [(r["path"], r["qualified"]) for r in chunker.chunks(files).collect()] == [("a.py", "f")]


def test_call_sizes_as_in_the_sql_beyond_16_chunks(spark, tmp_path):
    import duckdb

    from heliograph.plans.catalog import ORACLE_SQL, QUERIES

    keys = [(k,) for k, n in enumerate([1, 4, 5, 9, 16, 17, 40, 200]) for _ in range(n)]
    spark.createDataFrame(keys, "l_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = QUERIES["call_sizes"](spark, str(tmp_path)).select("bucket", "calls", "chunks", "call_share", "chunk_share")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE_SQL["call_sizes"]).fetchall())
