"""One object for a store: capture, recall, code search, context, synonyms, status; and its JSON-RPC face."""

from __future__ import annotations

import json
import time
from dataclasses import replace
from pathlib import Path, PurePosixPath
from urllib.parse import unquote_plus

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import text as T
from heliograph.functions.vectors import quantize_i8
from heliograph.operators.chunker import chunks
from heliograph.operators.dedup import WINDOW_S, dedup_window
from heliograph.plans.recall import CodeRecallConfig, RecallConfig, context, recall, recall_code
from heliograph.plans.syntax import search
from heliograph.sources.embed import HashingProvider, Provider, embed
from heliograph.sources.readers import Config, changed, expand_roots, git_branch, read_files, read_sources
from heliograph.sources.scratch import written
from heliograph.sources.store import CODE_FIELDS, CODE_INDEX, OBS_INDEX, Store, code_terms
from heliograph.status import CHANGES, Status
from heliograph.streaming.capture import cleaned

NOWHERE = "\0nowhere"


def query_param(query: str, name: str) -> str | None:
    """A url query's first value of a name, decoded; reading stops at a pair without =."""
    for pair in query.split("&"):
        key, eq, value = pair.partition("=")
        if not eq:
            return None
        if unquote_plus(key) == name:
            return unquote_plus(value, errors="replace")
    return None


def within(path: str, root: str) -> bool:
    return PurePosixPath(root) in (PurePosixPath(path), *PurePosixPath(path).parents)


def root_of(path: str, roots: list[str]) -> str | None:
    """The longest root that holds the path, by components."""
    return max((r for r in roots if within(path, r)), key=lambda r: len(PurePosixPath(r).parts), default=None)


def resolve_scope(scope: str | None, path: str | None, cwd: str | None, roots: list[str]) -> tuple[str | None, list[str]]:
    """A path prefix (None: no filter) and warnings. A prefix ends at a component."""
    if path is not None:
        if root_of(path, roots) is None:
            return NOWHERE, [f"{path} is outside the indexed roots"]
        return path.rstrip("/"), []
    if scope == "all":
        return None, []
    root = root_of(cwd, roots) if cwd else None
    return (root.rstrip("/") + "/", []) if root else (NOWHERE, ["the working directory is outside the indexed roots"])


class Engine:
    def __init__(self, spark: SparkSession, root: str, provider: Provider | None = None, config: Config | None = None, status: Status | None = None) -> None:
        self.spark, self.provider, self.config = spark, provider or HashingProvider(), config or Config()
        self.store = Store(spark, root, self.provider.dim)
        self.store.guard_model(self.provider.tag)
        self.state, self.cached = status or Status(self.config.churn_window_s), {}

    def _vectors(self, df: DataFrame, text: str, name: str) -> DataFrame:
        return df.withColumn(name, quantize_i8(embed(F.col(text), self.provider)))

    def _query(self, text: str) -> DataFrame:
        return self._vectors(self.spark.createDataFrame([(0, text)], "qid long, text string"), "text", "q8")

    def capture(self, events: DataFrame) -> int:
        """Stores observations (session, kind, body, ts, and branch, ref_path, ref_line_start, ref_line_end where there): redacted, cut, without duplicates of the last five minutes. The number stored."""
        for c, kind in (("branch", "string"), ("ref_path", "string"), ("ref_line_start", "int"), ("ref_line_end", "int")):
            if c not in events.columns:
                events = events.withColumn(c, F.lit(None).cast(kind))
        marked = written(cleaned(events).withColumn("row_key", F.concat_ws(":", "hash", F.col("ts").cast("string"))), "events")
        span = marked.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
        if span["a"] is None:
            return 0
        # what was accepted in the window before counts too, whichever call it came with
        have = self.store.read("obs").filter(F.col("ts").between(span["a"] - WINDOW_S, span["b"]))
        have = have.select(T.dedup_hash(F.col("session"), F.col("kind"), F.col("body")).alias("hash"), "ts").join(marked.select("hash").distinct(), "hash", "left_semi")
        both = marked.withColumn("order__", F.lit(1)).unionByName(have.withColumn("order__", F.lit(0)), allowMissingColumns=True)
        fresh = written(dedup_window(both, ["hash"], "ts", "order__").filter("fresh and order__ = 1").drop("order__", "fresh").dropDuplicates(["row_key"]), "fresh")
        pieces = fresh.select("row_key", F.posexplode(T.byte_windows(F.col("body"))).alias("chunk_idx", "piece"))
        n = fresh.count()
        if n:
            self.store.insert_obs(fresh, self._vectors(pieces, "piece", "emb_q8").drop("piece"), ("ts", "row_key"))
        return n

    def capture_stream(self, stream: DataFrame, checkpoint: str):
        """A writer that captures each micro-batch; a batch that is delivered again finds its own rows and stores nothing."""
        return stream.writeStream.foreachBatch(lambda df, _: self.capture(df) and None).option("checkpointLocation", checkpoint)

    def recall(self, text: str, limit: int = 10, config: RecallConfig | None = None) -> DataFrame:
        obs = self.store.read("obs").withColumnRenamed("session", "grp")
        vectors = self.vectors("vec_chunks").select(F.col("obs_id").alias("id"), "emb_q8")
        return recall(obs, vectors, self._query(text), self.store.read("synonyms"), config, limit, self.store.index(OBS_INDEX))

    def context(self, text: str, budget: int = 1000) -> str:
        row = context(self.recall(text, 20), budget).first() if text.strip() else None
        return row["text"] if row else ""

    def now(self) -> int:
        return int(time.time())

    def roots(self) -> list[str]:
        return expand_roots(self.config.roots)

    def index(self, root: str) -> int:
        """Brings the code index up to date with a tree; only new and changed files are read into chunks. Their number."""
        self.state.enter("indexing")
        try:
            n = self._index(root)
        except Exception as e:
            self.state.failed(root, e)
            raise
        finally:
            self.state.enter("idle")
        self.state.count("indexed", n, root)
        return n

    def delete(self, paths: DataFrame) -> None:
        self.store.delete_code(paths)

    def reindex(self, paths: DataFrame) -> int:
        """Reads files again, whether they have changed or not; those that are gone or not supported leave the index. Their number."""
        found = [r["path"] for r in paths.select("path").distinct().toLocalIterator()]
        there = [p for p in found if Path(p).is_file()]
        self.delete(paths)
        if not there:
            return 0
        files = read_files(self.spark, there, self.config)
        return self._store_files(files, None)

    def watch(self, stream: DataFrame, checkpoint: str):
        """A writer that keeps the index up to date with file events (ts timestamp, path, kind).

        Excluded paths are not even counted. Start it before a first ``index``: what happens
        meanwhile is handled after it, and handling a file twice does no harm.
        """
        kept = stream.filter(~T.excluded(F.col("path"), list(self.config.excludes))).withColumn("kind", T.coarse_kind(F.col("kind")))

        def handle(df: DataFrame, _: int) -> None:
            latest = written(df.groupBy("path").agg(F.max_by("kind", "ts").alias("kind"), F.count("*").alias("n")), "changed")
            rows = latest.limit(CHANGES).collect()
            for r in rows:
                self.state.changed(r["path"], r["kind"], root_of(r["path"], list(self.config.roots)) or "other")
            if not rows:
                return
            self.delete(latest.filter("kind = 'remove'").select("path"))
            self.reindex(latest.filter("kind in ('create', 'modify')").select("path"))
            self.state.heartbeat()

        return kept.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)

    def stale_events(self, best: DataFrame, folder: str) -> int:
        """Writes the stale paths of a code search as file events into a folder that a watched stream reads. Their number."""
        stale = written(best.filter("stale").select(F.current_timestamp().alias("ts"), "path", F.lit("modify").alias("kind")).dropDuplicates(["path"]), "stale")
        n = stale.count()
        if n:
            stale.write.mode("append").json(folder)
        return n

    def _index(self, root: str) -> int:
        listing = read_sources(self.spark, root, self.config)
        stored = self.store.read("files").select("path", F.expr("mtime_ns div 1000").alias("mtime_us"), F.col("size_bytes").alias("size"))
        fresh = changed(listing, stored).persist()
        try:
            n = fresh.count()
            gone = stored.filter(F.col("path").startswith(root.removeprefix("file://").rstrip("/") + "/")).join(listing.select("path"), "path", "left_anti").select("path")
            self.store.delete_code(gone)
            if n:
                self._store_files(fresh, root)
            return n
        finally:
            fresh.unpersist()

    def _store_files(self, fresh: DataFrame, root: str | None) -> int:
        """Chunks, vectors and terms of read files, in one commit. Their number."""
        files = written(fresh, "files")
        made = written(self._vectors(chunks(files, self.provider.count_tokens, self.provider.max_tokens), "body", "emb_q8"), "chunks")
        rows = files.select("path", F.lit(root).alias("repo_root"), "language", (F.col("mtime_us") * 1000).alias("mtime_ns"), F.col("size").alias("size_bytes"), F.lit(git_branch(root) if root else None).cast("string").alias("git_rev"))
        self.store.upsert_code(rows, made.drop("chunk", "emb_q8"), made.select("path", "line_start", "qualified", "emb_q8"))
        return rows.count()

    def code_search(
        self, text: str, limit: int = 10, config: CodeRecallConfig | None = None, scope: str = "all", path: str | None = None, cwd: str | None = None, listing: DataFrame | None = None
    ) -> tuple[DataFrame, list[str]]:
        """Results and warnings. With a listing of the disk (``file_stats``) each result says whether its file is stale."""
        prefix, warnings = resolve_scope(scope, path, cwd, list(self.config.roots))
        config = config or CodeRecallConfig()
        files = None if listing is None else self.store.read("files").select("path", F.expr("mtime_ns div 1000").alias("mtime_us"), F.col("size_bytes").alias("size"))
        found = recall_code(self.store.read("code_chunks"), self.vectors("vec_code"), self._query(text), replace(config, path_prefix=prefix or config.path_prefix), limit, listing, files, self.store.index(CODE_INDEX))
        return found, warnings

    def search(self, text: str, limit: int = 10, code: bool = False) -> DataFrame:
        """One query in the query syntax (phrases, +, -, AND, OR, NOT, fields): (qid, id, score, rank)."""
        corpus = self.store.read("code_chunks").withColumn("path_text", F.col("path")) if code else self.store.read("obs")
        return search(corpus, text, limit, CODE_FIELDS if code else ("body",), code_terms if code else T.default_tokens)

    def vectors(self, name: str) -> DataFrame:
        """A table of vectors; from memory once ``cache_vectors`` was called, and as long as the store hasn't changed."""
        n = self.store._state()["n"]
        if name in self.cached and self.cached[name][0] != n:
            self.cached.pop(name)[1].unpersist()
            self.cache_vectors(name)
        return self.cached[name][1] if name in self.cached else self.store.read(name)

    def cache_vectors(self, *names: str) -> None:
        """Keeps vectors in memory, on disk where they don't fit. Calling it again changes nothing."""
        for name in names or ("vec_chunks", "vec_code"):
            if name not in self.cached:
                self.cached[name] = (self.store._state()["n"], self.store.read(name).persist(StorageLevel.MEMORY_AND_DISK))

    def synonyms(self, op: str, term: str, expansion: str | None = None) -> dict:
        if op == "add" and expansion:
            self.store.add_synonym(term, expansion)
            return {"ok": True}
        if op == "remove":
            return {"removed": self.store.remove_synonym(term, expansion)}
        raise ValueError(f"unknown operation {op}")

    def evict(self, now: int | None = None) -> int:
        return self.store.evict_older_than((now or int(time.time())) - self.config.ttl_days * 86_400)

    def status(self) -> dict:
        """Model, rows of the tables, and what this process has done."""
        return {"model": self.provider.tag, **self.store.counts(), **self.state.snapshot()}

    # Markdown and JSON-RPC
    @staticmethod
    def recall_lines(best: DataFrame) -> str:
        line = F.format_string("- [%s | %s | rrf %.3f] %s", "kind", F.substring("grp", 1, 8), "score", T.one_line(F.col("body")))
        return "\n".join(r[0] for r in best.orderBy("position").select(line).collect()) or "No results."

    @staticmethod
    def code_lines(best: DataFrame, warnings: list[str]) -> str:
        line = F.format_string("─── %s:%d-%d %s (rrf %.3f) ───\n%s", "path", "line_start", "line_end", F.coalesce("qualified", F.lit("")), "score", "body")
        return "\n".join([*(f"⚠ {w}" for w in warnings), *(r[0] for r in best.orderBy("position").select(line).collect())]) or "No results."

    def rpc(self, request: str) -> str:
        """initialize, ping, tools/list, tools/call of session_recall, memory_recall (the same) and code_recall."""
        call = json.loads(request)
        method, params = call.get("method"), call.get("params") or {}
        answer = lambda **x: json.dumps({"jsonrpc": "2.0", "id": call.get("id"), **x}, ensure_ascii=False)
        tools = ["session_recall", "code_recall", "memory_recall"]
        if method == "initialize":
            return answer(result={"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "heliograph", "version": "0.1.0"}})
        if method == "ping":
            return answer(result={})
        if method == "tools/list":
            return answer(result={"tools": [{"name": t, "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]}} for t in tools]})
        if method != "tools/call":
            return answer(error={"code": -32601, "message": f"method not found: {method}"})
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in tools or not isinstance(given.get("query"), str):
            return answer(error={"code": -32602, "message": "an unknown tool, or no query"})
        try:
            if name == "code_recall":
                text = self.code_lines(*self.code_search(given["query"], int(given.get("limit", 10)), scope=given.get("scope", "all"), path=given.get("path"), cwd=given.get("cwd")))
            else:
                text = self.recall_lines(self.recall(given["query"], int(given.get("limit", 10))))
            return answer(result={"content": [{"type": "text", "text": text}], "isError": False})
        except Exception as e:  # a tool's failure is an answer of this protocol
            return answer(result={"content": [{"type": "text", "text": str(e)[:500]}], "isError": True})
