import json

import pytest
from pyspark.sql import functions as F

from heliograph.operators.dedup import dedup_window
from heliograph.plans.recall import CodeRecallConfig, Mode, RecallConfig, context, recall, recall_code
from heliograph.sources.embed import HashingProvider, embed
from heliograph.sources.readers import changed, load_bank, load_config, question_sessions, read_questions, read_sources, write_report
from heliograph.sources.store import ModelMismatch, Store
from heliograph.streaming import capture


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", dim=2)


def test_observations(spark, store):
    rows = spark.createDataFrame([("a", 100, "s1", None, "note", "one", None, None, None), ("b", 1000, "s2", None, "note", "two", None, None, None)], "row_key string, ts long, session string, branch string, kind string, body string, ref_path string, ref_line_start int, ref_line_end int")
    chunks = spark.createDataFrame([("a", 0, [1, 2]), ("a", 1, [2, 1]), ("b", 0, [3, 3])], "row_key string, chunk_idx int, emb_q8 array<tinyint>")
    store.insert_obs(rows, chunks)
    assert [r["id"] for r in store.read("obs").orderBy("id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        store.insert_obs(rows, chunks.withColumn("emb_q8", F.array(F.lit(1).cast("tinyint"))))
    assert store.evict_older_than(500) == 1
    assert store.read("obs").count() == 1 and store.read("vec_chunks").count() == 1


def test_synonyms_are_seeded_once(spark, store, tmp_path):
    n = store.read("synonyms").count()
    assert n == 52 and store.remove_synonym("kubernetes") == 4
    assert Store(spark, f"file://{tmp_path}/store", dim=2).read("synonyms").count() == n - 4


def test_model_guard(spark, store):
    store.guard_model("m1")
    store.guard_model("m2")
    store.write("vec_code", spark.createDataFrame([(1, [1, 2])], "id long, emb_q8 array<tinyint>"))
    with pytest.raises(ModelMismatch):
        store.guard_model("m1")
    with pytest.raises(PermissionError):
        Store(spark, store.root, 2, read_only=True).set_meta("a", "b")


def test_code_is_replaced(spark, store):
    files = lambda *p: spark.createDataFrame([(x, "/r", "rust", 1, 2, None) for x in p], "path string, repo_root string, language string, mtime_ns long, size_bytes long, git_rev string")
    chunks = lambda *rows: spark.createDataFrame([(p, "rust", 1, 2, "fn", q, b) for p, q, b in rows], "path string, language string, line_start int, line_end int, kind string, qualified string, body string")
    store.upsert_code(files("a.rs", "b.rs"), chunks(("a.rs", "f", "cats"), ("b.rs", "g", "birds")))
    store.upsert_code(files("a.rs"), chunks(("a.rs", "f", "dogs")))
    assert {r["body"] for r in store.read("code_chunks").collect()} == {"dogs", "birds"}
    store.delete_code(files("b.rs"))
    assert store.read("files").count() == 1
    store.snapshot("x y")
    store.wipe_code_index()
    assert store.read("code_chunks").count() == 0


def test_cache_and_sessions(spark, store):
    store.cache_put(spark.createDataFrame([("k", [1.0], 1)], "key string, emb array<float>, created_ts long"))
    hit, miss = store.cache_split(spark.createDataFrame([("k",), ("z",)], "key string"))
    assert (hit.count(), miss.first()["key"]) == (1, "z")
    rows = "id string, started_ts long, branch string, cwd string"
    store.upsert_sessions(spark.createDataFrame([("s", 1, "main", None)], rows))
    store.upsert_sessions(spark.createDataFrame([("s", 9, None, "/x")], rows))
    row = store.read("sessions").first()
    assert (row["started_ts"], row["branch"], row["cwd"]) == (1, "main", "/x")


def corpus(spark, rows):
    return spark.createDataFrame(rows, "id long, grp string, kind string, body string")


def ask(spark, text):
    return spark.createDataFrame([(0, text, [1])], "qid long, text string, q8 array<tinyint>")


def test_recall(spark, store):
    docs = corpus(spark, [(1, "s1", "note", "learned about kubernetes pod scheduling today"), (2, "s1", "note", "the weather is nice today")])
    syn = store.read("synonyms")
    bm = RecallConfig(mode=Mode.BM25)
    assert recall(docs, None, ask(spark, "k8s scheduling"), syn, bm).orderBy("position").first()["id"] == 1
    assert recall(docs, None, ask(spark, "k8s"), syn, RecallConfig(mode=Mode.BM25, synonyms=False)).count() == 0
    assert recall(docs, None, ask(spark, "k8s"), syn, bm, limit=0).count() == 0
    assert recall(docs.limit(0), None, ask(spark, "k8s"), syn, bm).count() == 0
    assert recall(docs, None, ask(spark, "  "), syn, bm).count() == 0
    out = context(recall(docs, None, ask(spark, "k8s weather"), syn, bm), 500).first()["text"]
    assert out.startswith("## ") and out.count("\n- ") + out.count("- **") >= 2


def test_session_cap(spark):
    docs = corpus(spark, [(i, "s1", "n", f"alpha doc number {i}") for i in range(5)] + [(9, "s2", "n", "alpha distinct"), (10, "s2", "n", "alpha distinct two")])
    out = recall(docs, None, ask(spark, "alpha"), None, RecallConfig(mode=Mode.BM25), limit=5).collect()
    assert sum(r["grp"] == "s1" for r in out) <= 3


def test_code_recall(spark):
    chunks = spark.createDataFrame([(1, "src/a.rs", "rust", "alpha", "running fast"), (2, "tests/b.rs", "rust", "alpha", "other"), (3, "src/b.ts", "typescript", "alpha", "x")], "id long, path string, language string, qualified string, body string")
    go = lambda text, **k: [r["id"] for r in recall_code(chunks, None, ask(spark, text), CodeRecallConfig(mode=Mode.BM25, **k)).orderBy("position").collect()]
    assert go("alpha", path_prefix="src/", language="rust") == [1]
    assert go("alpha", language="typescript") == [3]
    assert go("run") == [1] and go("run", stem=False) == []
    files = spark.createDataFrame([("src/a.rs", 1, 2), ("tests/b.rs", 1, 2)], "path string, mtime_us long, size long")
    disk = spark.createDataFrame([("src/a.rs", 1, 2), ("tests/b.rs", 1, 3)], "path string, mtime_us long, size long")
    stale = {r["id"]: r["stale"] for r in recall_code(chunks, None, ask(spark, "alpha"), CodeRecallConfig(mode=Mode.BM25), listing=disk, files=files).collect()}
    assert stale == {1: False, 2: True, 3: True}


def test_embedding(spark):
    p = HashingProvider(16)
    row = spark.createDataFrame([("hello world",), (None,)], "t string").select(embed(F.col("t"), p).alias("e")).collect()
    assert sum(x * x for x in row[0]["e"]) == pytest.approx(1, abs=1e-5) and set(row[1]["e"]) == {0.0}


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.md").write_text("no")
    (tmp_path / "node_modules/c.js").write_text("no")
    got = read_sources(spark, f"file://{tmp_path}")
    assert [r["path"].rsplit("/", 1)[1] for r in got.collect()] == ["a.py"]
    assert changed(got, got).count() == 0 and changed(got, got.limit(0)).count() == 1


def test_questions_bank_config_report(spark, tmp_path):
    q = {"question_id": "q", "question": "?", "question_type": "t", "haystack_sessions": [[{"role": "user", "content": "a"}], []], "haystack_session_ids": ["s1", "s2"], "answer_session_ids": ["s2"]}
    (tmp_path / "q.json").write_text(json.dumps([q]))
    rows = question_sessions(read_questions(spark, f"file://{tmp_path}/q.json")).orderBy("nth").collect()
    assert [(r["session"], r["is_gold"]) for r in rows] == [("s1", False), ("s2", True)]
    (tmp_path / "bank.toml").write_text('[[query]]\nquery = "a"\nexpect = ["x"]\ncategory = "symbol"\n')
    assert load_bank(spark, str(tmp_path / "bank.toml")).first()["expect"] == ["x"]
    (tmp_path / "c.toml").write_text('roots = ["/a"]\nttl_days = 3\n')
    c = load_config(str(tmp_path / "c.toml"), {"HELIOGRAPH_TTL_DAYS": "5"})
    assert (c.roots, c.ttl_days) == (("/a",), 5)
    write_report(spark.range(2), str(tmp_path / "report"))
    assert "| id |" in (tmp_path / "report/report.md").read_text()


def test_hooks(spark):
    rows = [("user-prompt-submit", '{"prompt": "  hi "}'), ("stop", '{"last_assistant_message": "done"}'), ("subagent-stop", '{"content": "sub"}'), ("stop", '{"last_assistant_message": " "}')]
    out = capture.route(spark.createDataFrame(rows, "hook string, payload string")).collect()
    assert [(r["kind"], r["body"]) for r in out] == [("user_prompt", "hi"), ("assistant_message", "done"), ("subagent_message", "sub")]
    with pytest.raises(Exception, match="unknown hook"):
        capture.route(spark.createDataFrame([("nope", '{"prompt": "x"}')], "hook string, payload string")).collect()


def test_tool_references(spark):
    rows = [("Read", '{"file_path": "p", "offset": 10, "limit": 200}', "{}"), ("Write", '{"file_path": "p", "content": "a\\nb\\nc"}', "{}"), ("Bash", '{"command": "ls"}', '{"exit_code": 0}'), ("Bash", '{"command": "ls"}', '{"is_error": true, "exit_code": 2}'), ("Other", "{}", "{}")]
    out = capture.tool_reference(spark.createDataFrame(rows, "tool_name string, tool_input string, tool_response string")).collect()
    assert [r["body"] for r in out] == ["Read(p:10-209)", "Write(p, 3 lines)", "Bash($ ls, exit=0)", "Bash($ ls, exit=2)"]
    assert out[3]["kind"] == "tool_failure"


def test_streamed_dedup_equals_batch(spark):
    rows = [(i, f"s{i % 3}", "k", 1000 + (i * 37) % 2000) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, session string, kind string, ts long")
    batch = {r["event_id"] for r in dedup_window(events, ["session", "kind"], "ts", "event_id").filter("fresh").collect()}
    assert {r["event_id"] for r in capture.replay(events).collect()} == batch


def test_same_first_500_bytes_are_one(spark):
    rows = [("s", "k", "x" * 500 + "a", 100), ("s", "k", "x" * 500 + "b", 110)]
    out = capture.cleaned(spark.createDataFrame(rows, "session string, kind string, body string, ts long"))
    assert out.select("hash").distinct().count() == 1
