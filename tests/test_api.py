import json

import pytest

from heliograph import api
from heliograph.plans.syntax import Clause, parse, search
from heliograph.sources.embed import HashingProvider
from heliograph.sources.readers import Config


def test_parse():
    assert parse('alpha "beta gamma" +must -not body:x') == [Clause("alpha"), Clause("beta gamma", phrase=True), Clause("must", "must"), Clause("not", "not"), Clause("x", field="body")]
    assert [c.occur for c in parse("a AND b")] == ["must", "must"] and [c.occur for c in parse("a NOT b")] == ["should", "not"]
    assert parse("other:x")[0].text == "other x" and parse("") == [] and parse('"') == []


def test_search(spark):
    rows = [(1, "red green blue", "t"), (2, "green red", "u"), (3, "blue", "red"), (4, None, None)]
    corpus = spark.createDataFrame(rows, "id long, body string, title string")
    go = lambda q, **k: {r["id"] for r in search(corpus, q, **k).collect()}
    assert go("red") == {1, 2} and go('"red green"') == {1} and go("red -blue") == {2}
    assert go("+red +blue") == {1} and go("red AND blue") == {1} and go("red-green") == {1}
    both = ("body", "title")
    assert go("red", fields=both) == {1, 2, 3} and go("title:red", fields=both) == {3} and go("-red") == set()


def test_scope():
    roots = ["/a", "/a/b"]
    assert api.root_of("/a/b/c", roots) == "/a/b" and api.root_of("/ab", roots) is None
    assert api.resolve_scope("all", None, None, roots) == (None, [])
    assert api.resolve_scope("current", None, "/a/x", roots) == ("/a/", [])
    assert api.resolve_scope("current", None, "/z", roots)[0] == api.NOWHERE
    assert api.resolve_scope(None, "/z", None, roots)[1] and api.resolve_scope(None, "/a/b", None, roots)[0] == "/a/b"
    assert api.query_param("a=1&q=x+y%21&b", "q") == "x y!" and api.query_param("a&q=1", "q") is None


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    src = root / "src"
    src.mkdir()
    (src / "a.py").write_text("def running_total(xs):\n    return sum(xs)\n")
    (src / "b.rs").write_text("fn parse_url() {\n    let x = 1;\n}\n")
    e = api.Engine(spark, f"file://{root}/store", HashingProvider(32), Config(roots=(str(src),)))
    assert e.index(f"file://{src}") == 2 and e.index(f"file://{src}") == 0
    (src / "b.rs").unlink()
    (src / "a.py").write_text("def running_total(xs):\n    return sum(xs) + 0\n")
    assert e.index(f"file://{src}") == 1
    return e, str(src)


def test_code_index(engine):
    e, src = engine
    best, warnings = e.code_search("running total", scope="current", cwd=src)
    rows = best.collect()
    assert not warnings and [r["qualified"] for r in rows] == ["running_total"] and "+ 0" in rows[0]["body"]
    assert e.code_search("parse url")[0].filter("qualified = 'parse_url'").count() == 0


def test_capture_and_recall(spark, engine):
    e, _ = engine
    rows = [("s1", "user_prompt", "deploy to kubernetes with token=abcdefghijklmnop1234", 100), ("s1", "user_prompt", "deploy to kubernetes with token=abcdefghijklmnop1234", 200), ("s2", "odd", "é" * 1500, 300)]
    assert e.capture(spark.createDataFrame(rows, "session string, kind string, body string, ts long")) == 2
    obs = {r["session"]: r for r in e.store.read("obs").collect()}
    assert "[REDACTED]" in obs["s1"]["body"] and obs["s2"]["kind"] == "other"
    assert e.store.read("vec_chunks").filter(f"obs_id = {obs['s2']['id']}").count() == 2
    assert "kubernetes" in e.context("k8s deploy") and e.context(" ") == ""
    assert e.status()["obs"] == 2
    ask = lambda **x: json.loads(e.rpc(json.dumps({"id": 1, **x})))
    out = ask(method="tools/call", params={"name": "memory_recall", "arguments": {"query": "k8s"}})
    assert "kubernetes" in out["result"]["content"][0]["text"] and not out["result"]["isError"]
    assert len(ask(method="tools/list")["result"]["tools"]) == 3 and ask(method="ping")["result"] == {}
    assert ask(method="x")["error"]["code"] == -32601 and ask(method="tools/call", params={"name": "x"})["error"]["code"] == -32602
    assert e.synonyms("remove", "k8s")["removed"] == 2
    assert e.evict(now=250 + 90 * 86_400) == 1


def test_a_phrase_is_looked_up_in_tokens_that_are_made_once(spark):
    import time

    from heliograph.operators import bm25
    from heliograph.plans.syntax import search

    long = "beta alpha " * 20_000
    corpus = spark.createDataFrame([(1, long + "alpha gamma"), (2, long), (3, "alpha gamma delta"), (4, None)], "id long, body string")
    began = time.perf_counter()
    assert {r["id"] for r in search(corpus, '+"alpha gamma" -delta').collect()} == {1}
    assert {r["id"] for r in search(corpus, '"alpha gamma" "gamma delta"').collect()} == {1, 3}
    assert {r["id"] for r in search(corpus, "alpha -beta").collect()} == {3}
    assert time.perf_counter() - began < 60
    want = bm25.scores(corpus, spark.createDataFrame([(0, "alpha gamma gamma")], "qid long, text string")).filter("id = 3").first()["score"]
    assert search(corpus, "alpha gamma +gamma").filter("id = 3").first()["score"] == want
