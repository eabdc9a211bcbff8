"""Evaluation, status, HTTP, command line, watching and the store's log."""

import json
import threading
import time
import urllib.request

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from heliograph import __main__ as cli
from heliograph import evaluate, sweeps
from heliograph.api import Engine
from heliograph.functions import text as T
from heliograph.functions.vectors import from_bytes, legacy_i8, to_bytes
from heliograph.operators import bm25, dml, metrics, paths
from heliograph.plans.recall import Mode, RecallConfig
from heliograph.server import App, serve
from heliograph.sources.embed import HashingProvider, embed_table
from heliograph.sources.readers import Config, bodies_from_files, expand_roots, file_events, file_stats, git_branch, load_bank, markdown_table, read_questions, read_sources, walk
from heliograph.sources.store import Store
from heliograph.status import JsonLog, Status

EVENT = "session string, kind string, body string, ts long"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store", HashingProvider(16), Config(roots=(str(tmp_path / "src"),)))


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    (src / "deep/node_modules").mkdir(parents=True)
    (src / "out").mkdir()
    (src / "a.py").write_text("def alpha():\n    return 1\n")
    (src / "deep/b.py").write_text("def beta():\n    return alpha()\n")
    (src / "deep/skip.py").write_text("x = 1\n")
    (src / "deep/node_modules/c.py").write_text("x = 1\n")
    (src / "out/gen.py").write_text("x = 1\n")
    (src / ".gitignore").write_text("# made\nout/\n*.log\n")
    (src / "deep/.gitignore").write_text("skip.*\n!keep.py\n")
    (src / "x.log").write_text("no")
    return src


def test_ids_stay_the_same_however_often_they_are_read(spark):
    n = 1_000_000
    rows = spark.range(n).select((F.col("id") * 7919 % 1013).alias("a"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("b"), F.col("id").alias("k"))
    uneven = rows.repartition(3, "a").unionByName(spark.range(5).select((F.col("id") - 9).alias("a"), F.lit(0).cast("long").alias("b"), (F.col("id") + n).alias("k")))
    made = dml.with_ids(spark.range(0), uneven, ["a", "b"])
    got = made.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first()
    assert tuple(got) == (n + 5, n + 5, 1, n + 5)
    again = made.select("k", F.col("id").alias("one")).join(made.select("k", F.col("id").alias("two")), "k")
    assert again.filter("one <> two").count() == 0
    order = made.select("a", "b", "id").withColumn("prev", F.lag(F.struct("a", "b")).over(Window.orderBy("id")))
    assert order.filter(F.struct("a", "b") < F.col("prev")).count() == 0


def test_the_index_follows_the_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", dim=2)
    rows = lambda *x: spark.createDataFrame([(f"k{t}", t, "s", None, "note", b, None, None, None) for t, b in x], "row_key string, ts long, session string, branch string, kind string, body string, ref_path string, ref_line_start int, ref_line_end int")
    store.insert_obs(rows((1, "cats and dogs"), (2, "birds and birds"), (3, "dogs")))
    store.insert_obs(rows((4, "cats cats"), (5, "nothing here")))
    asked = spark.createDataFrame([(0, "cats dogs"), (1, "birds")], "qid long, text string")
    same = lambda: sorted(map(tuple, bm25.scores_from(store.index(), asked).collect())) == sorted(map(tuple, bm25.scores(store.read("obs"), asked).collect()))
    assert same() and bm25.scores_from(store.index(), asked).count() == 4
    assert store.evict_older_than(2) == 1 and same()
    before = store._state()["tables"]["obs"]
    store.insert_obs(rows((6, "more dogs")))
    # an insert adds a segment and leaves the others as they are
    assert store._state()["tables"]["obs"][: len(before)] == before and same()
    plan = bm25.scores_from(store.index(), asked)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_many_segments_are_put_together(spark, tmp_path, monkeypatch):
    from heliograph.sources import store as module

    monkeypatch.setattr(module, "SEGMENTS", 3)
    monkeypatch.setattr(module, "GONE", 1)
    store = Store.temporary(spark, 2)
    put = lambda k: store.cache_put(spark.createDataFrame([(k, [1.0], 1)], "key string, emb array<float>, created_ts long"))
    for k in "abcdef":
        put(k)
    put("a")
    assert sorted(r["key"] for r in store.read("embed_cache").collect()) == list("abcdef")
    assert len(store._state()["tables"]["embed_cache"]) <= 4 and len(store._commits()) <= 3
    for i in range(3):
        store.change().remove("embed_cache", spark.createDataFrame([("abc"[i],)], "key string"), "key").commit()
    assert sorted(r["key"] for r in store.read("embed_cache").collect()) == list("def")
    late = store.change().append("meta", spark.createDataFrame([("x", "y")], "key string, value string"))
    store.set_meta("z", "1")
    with pytest.raises(RuntimeError):
        late.commit()
    copy = Store(spark, store.snapshot("a tag"), 2, read_only=True)
    assert copy.counts()["embed_cache"] == 3 and copy.by_ids("obs", []).count() == 0


def test_capture_remembers_earlier_calls(spark, engine):
    event = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    assert engine.capture(event(("s", "tool_use", "hello there", 100), ("s", "tool_use", "hello there", 110))) == 1
    assert engine.capture(event(("s", "tool_use", "hello there", 110))) == 0
    assert engine.capture(event(("s", "tool_use", "hello there", 400), ("s2", "tool_use", "hello there", 400), ("s", "odd kind", "hello there", 400))) == 2
    assert engine.capture(event(("s", "tool_use", "hello there", 401))) == 1
    assert engine.capture(event(("s", "tool_use", "x", 1)).limit(0)) == 0
    assert [r["id"] for r in engine.store.read("obs").orderBy("id").collect()] == [1, 2, 3, 4]
    assert engine.store.by_ids("obs", [3, 9, 1]).select("id").collect() == [(3,), (1,)]


def test_capture_as_a_stream(spark, engine, tmp_path):
    rows = [("s", "note", f"text {i % 3}", 1000 + i * 100) for i in range(12)]
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], EVENT).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(EVENT).json(f"file://{tmp_path}/in")
        engine.capture_stream(stream, f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["body"], r["ts"]) for r in engine.store.read("obs").collect()) == sorted((f"text {i % 3}", 1000 + i * 100) for i in range(12) if (i // 3) % 2 == 0)


def test_the_streaming_state_expires(spark, tmp_path):
    from heliograph.streaming import capture

    schema, rows = "event_id long, session string, kind string, ts long", lambda *x: spark.createDataFrame(list(x), "event_id long, session string, kind string, ts long")
    steps = [rows((1, "a", "k", 1000), (2, "a", "k", 1200), (3, "b", "k", 1000)), rows((4, "c", "k", 9000)), rows((5, "c", "k", 9900)), rows((6, "a", "k", 10000))]
    sizes = []
    with capture.rocksdb(spark):
        for k, step in enumerate(steps):
            step.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
            q = capture.dedup_stream(stream, ["session", "kind"], schema).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
            sizes.append(max((s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]), default=0))
            last = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]][-1]
    got = sorted(r["event_id"] for r in spark.read.schema(schema).parquet(f"file://{tmp_path}/out").collect())
    assert got == [1, 3, 4, 5, 6]
    assert last < sum(1 for _ in "abc") * 4  # the old keys' times and timers are gone


def test_watching(spark, engine, tree, tmp_path):
    events = f"file://{tmp_path}/events"
    schema = "ts timestamp, path string, kind string"
    spark.createDataFrame([], schema).write.mode("append").json(events)
    go = lambda: engine.watch(spark.readStream.schema(schema).json(events), f"file://{tmp_path}/w").trigger(availableNow=True).start().awaitTermination()
    before = file_stats(spark, f"file://{tree}").filter(F.col("path").endswith(".py")).collect()
    before = spark.createDataFrame(before, "path string, mtime_us long, size long")
    file_events(before.limit(0), before, 100).write.mode("append").json(events)
    go()
    names = lambda: sorted(r["path"].rsplit("/", 1)[1] for r in engine.store.read("files").collect())
    assert names() == ["a.py", "b.py", "gen.py", "skip.py"] and "c.py" not in str(engine.status()["churn"])
    (tree / "a.py").unlink()
    (tree / "deep/b.py").write_text("def gamma():\n    return 2  # changed\n")
    after = file_stats(spark, f"file://{tree}").filter(F.col("path").endswith(".py"))
    changes = file_events(before, after, 200)
    assert sorted((r["path"].rsplit("/", 1)[1], r["kind"]) for r in changes.collect()) == [("a.py", "remove"), ("b.py", "modify")]
    changes.write.mode("append").json(events)
    go()
    assert names() == ["b.py", "gen.py", "skip.py"]
    assert "gamma" in engine.code_lines(*engine.code_search("gamma"))
    (tree / "deep/b.py").write_text("def delta():\n    return 3\n")
    stale, _ = engine.code_search("gamma", listing=file_stats(spark, f"file://{tree}"))
    assert engine.stale_events(stale, events) >= 1
    go()
    assert "delta" in engine.code_lines(*engine.code_search("delta"))


def test_walk_and_roots(spark, tree, tmp_path, monkeypatch):
    found = sorted(p.removeprefix(f"{tree}/") for p in walk(str(tree)))
    assert found == [".gitignore", "a.py", "deep/.gitignore", "deep/b.py"]
    assert sorted(r["path"].rsplit("/", 1)[1] for r in read_sources(spark, str(tree), ignore=True).collect()) == ["a.py", "b.py"]
    monkeypatch.setenv("HOME", str(tmp_path))
    assert expand_roots(["~/src", "~/none", str(tree)]) == [str(tree)]
    assert git_branch(str(tree)) is None
    (tree / ".git").mkdir()
    (tree / ".git/HEAD").write_text("ref: refs/heads/feature/x\n")
    assert git_branch(str(tree / "deep")) == "feature/x"
    chunks = spark.createDataFrame([(f"{tree}/a.py", 2, 2, "old"), ("/none", 1, 1, "old")], "path string, line_start int, line_end int, body string")
    assert sorted(r["body"] for r in bodies_from_files(chunks, read_sources(spark, f"file://{tree}")).collect()) == ["", "    return 1"]


def test_status_and_log(tmp_path):
    now = [1000.0]
    log = JsonLog(str(tmp_path / "log/x.jsonl"), 200)
    s = Status(600, log, lambda: now[0])
    for i in range(12):
        s.failed(f"/p{i}", "bad")
    s.count("indexed", 3, "/r")
    with pytest.raises(ValueError):
        s.count("other")
    assert [e["path"] for e in s.snapshot()["errors"]] == [f"/p{i}" for i in range(4, 12)]
    assert s.heartbeat() == {"failed": 12, "indexed": 3} and s.heartbeat() == {}
    for i in range(5_005):
        s.changed(f"/f{i % 25}", "modify", "/r")
    churn = s.churn()
    assert churn["events"] == 5_000 and len(churn["by_path"]) == 20 and churn["per_min"] == 500
    now[0] += 601
    assert s.churn()["events"] == 0
    assert (tmp_path / "log/x.jsonl.1").exists() and all(json.loads(x) for x in (tmp_path / "log/x.jsonl").read_text().splitlines())


def test_http(spark, engine):
    app = App(engine)
    assert app("GET", "/health")[0] == 200 and app("GET", "/nope")[0] == 404 and app("POST", "/capture", b"{")[0] == 400
    put = json.dumps({"session": "s1", "kind": "note", "body": "kubernetes pods", "ts": 5}).encode()
    assert json.loads(app("POST", "/capture", put)[2]) == {"stored": True}
    assert json.loads(app("POST", "/capture", put)[2]) == {"stored": False, "reason": "duplicate"}
    assert json.loads(app("POST", "/recall", b'{"query": "k8s"}')[2])[0]["body"] == "kubernetes pods"
    assert "kubernetes" in app("GET", "/context?query=k8s+pods&budget=100")[2] and app("GET", "/context?budget=x")[0] == 400
    assert app("POST", "/syn", b'{"op": "add", "term": "p", "expansion": "pods"}')[0] == 200 and app("POST", "/syn", b'{"op": "no", "term": "p"}')[0] == 400
    assert {"term": "p", "expansion": "pods"} in json.loads(app("GET", "/syn")[2])
    assert json.loads(app("POST", "/code/search", b'{"query": "x"}')[2])["results"] == []
    server = serve(engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/status") as r:
        assert json.loads(r.read())["obs"] == 1
    server.shutdown()
    server.server_close()


def test_command_line(spark, tree, tmp_path):
    import io

    (tmp_path / "c.toml").write_text(f'roots = ["{tree}"]\n')
    base, lines = ["--store", f"file://{tmp_path}/s", "--config", str(tmp_path / "c.toml")], []

    def go(*args, stdin=""):
        lines.clear()
        return cli.run(cli.parser().parse_args([*base, *args]), spark, io.StringIO(stdin), lines.append)

    assert go("capture", "stop", stdin='{"session_id": "s", "last_assistant_message": " done with kubernetes "}') == 0 and lines == ["stored 1"]
    assert go("capture", "post-tool-use", stdin='{"session_id": "s", "tool_name": "Read", "tool_input": {"file_path": "/p"}}') == 0 and lines == ["stored 1"]
    go("remember", "a thing to keep")
    go("recall", "k8s")
    assert "done with kubernetes" in lines[0]
    go("index")
    assert go("reindex") == 2 and go("reindex", "--confirm") == 0 and "files" in lines[-1]
    go("syn", "list")
    assert len(lines) == 52
    go("mcp", stdin='{"jsonrpc": "2.0", "id": 1, "method": "ping"}\n')
    assert json.loads(lines[0])["result"] == {}
    go("status")
    assert json.loads(lines[0])["obs"] == 3
    (tmp_path / "bank.toml").write_text('[[query]]\nquery = "alpha"\nexpect = ["a.py"]\ncategory = "symbol"\n[[query]]\nquery = "beta"\nexpect = ["b.py"]\npath_prefix = "/none"\n')
    go("eval", str(tmp_path / "bank.toml"), "--synthetic", "2", "--report", str(tmp_path / "report"))
    rows = {(r["bucket"], r["mode"]): r for r in map(json.loads, lines[0].splitlines())}
    assert rows["curated", "bm25"]["hit_5"] == 0.5 and rows["synthetic", "hybrid"]["n"] == 2 and ("overall", "int8_hybrid") in rows
    assert "| bucket |" in (tmp_path / "report/code-report.md").read_text()
    for what in ("code-index", "tokens", "embed"):
        go("bench", what, "--sizes", "8")
        assert json.loads(lines[0])


def test_question_sets(spark, tmp_path):
    turn = lambda t: [{"role": "user", "content": t}]
    questions = [
        {"question_id": "q1", "question": "where is the kubernetes pod", "question_type": "a", "haystack_sessions": [turn("the kubernetes pod is here"), turn("weather")], "haystack_session_ids": ["x", "y"], "answer_session_ids": ["x"]},
        {"question_id": "q2", "question": "zebra stripes", "question_type": "b", "haystack_sessions": [turn("nothing of it"), turn("cooking")], "haystack_session_ids": ["u", "v"], "answer_session_ids": ["w"]},
    ]
    (tmp_path / "q.json").write_text(json.dumps(questions))
    done = evaluate.run_questions(read_questions(spark, f"file://{tmp_path}/q.json"), HashingProvider(32), RecallConfig(mode=Mode.BM25))
    assert {r["question_type"]: r["r_at_5"] for r in done.by_type.collect()} == {"a": 1.0, "b": 0.0}
    assert done.summary.first()["mrr"] == 0.5 and done.records.count() == 2
    import hashlib

    sha = hashlib.sha256((tmp_path / "q.json").read_bytes()).hexdigest()
    assert evaluate.verify_sha(spark, f"file://{tmp_path}/q.json", sha) == (tmp_path / "q.json").stat().st_size
    with pytest.raises(ValueError):
        evaluate.verify_sha(spark, f"file://{tmp_path}/q.json", "0" * 64)


def test_small_functions(spark):
    df = spark.createDataFrame([([0.5, -0.25, 2.0], "Modify(Data)", "a b/ü*~", "/m/Model-X.Q8.gguf")], "v array<float>, k string, t string, p string")
    row = df.select(from_bytes(to_bytes(F.col("v"))).alias("v"), legacy_i8(F.col("v")).alias("q"), T.coarse_kind(F.col("k")).alias("k"), T.percent_encode(F.col("t")).alias("t"), T.model_tag(F.col("p")).alias("p"), T.file_safe(F.col("t")).alias("s")).first()
    assert (row["v"], row["q"], row["k"], row["t"], row["p"], row["s"]) == ([0.5, -0.25, 2.0], [64, -32, None], "modify", "a%20b%2F%C3%BC%2A~", "model-x.q8", "a_b____")
    with pytest.raises(Exception, match="32-bit"):
        df.select(from_bytes(F.lit(b"abc"))).collect()
    assert markdown_table(spark.range(5), 2).endswith("3 more rows\n") and markdown_table(spark.range(2)).count("\n") == 4
    e = spark.createDataFrame([(i, i) for i in range(20)], "ts long, n int")
    assert [r["n"] for r in metrics.last_errors(e, 3).collect()] == [19, 18, 17]
    roots = spark.createDataFrame([("/a/foo",), ("/a",)], "root string")
    rows = spark.createDataFrame([("/a/foobar/x",), ("/a/foo/x",), ("/b",), (None,)], "path string")
    assert {r["path"]: r["root"] for r in paths.longest_root(rows, roots, default="other").collect()} == {"/a/foobar/x": "/a", "/a/foo/x": "/a/foo", "/b": "other", None: "other"}
    counted = sweeps.token_counts(spark.createDataFrame([("p", "q", "a b c"), ("p", "r", "a")], "path string, qualified string, body string"), HashingProvider(4))
    assert sweeps.token_summary(counted, 2).first()["over_cap"] == 1
    busy = embed_table(spark.createDataFrame([("a",), (None,), ("b c",)], "t string"), HashingProvider(4), "t", "v", 2)
    assert busy.filter(F.size("v") == 4).count() == 3


def test_bank_without_queries(spark, tmp_path):
    (tmp_path / "b.toml").write_text("x = 1\n")
    bank = load_bank(spark, str(tmp_path / "b.toml"))
    with pytest.raises(ValueError):
        evaluate.run_bank(spark.createDataFrame([], "id long, path string, qualified string, language string, body string"), spark.createDataFrame([], "id long, emb_q8 array<tinyint>"), bank, HashingProvider(4), None)
    assert time.time() > 0
