"""The store: fixed schemas in Parquet segments under a log of commits, a stored inverted index, and a guard on the embedding model."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.functions.stemmer import stems
from heliograph.functions.text import code_tokens, default_tokens
from heliograph.functions.vectors import legacy_i8
from heliograph.operators import bm25, dml
from heliograph.sources.scratch import shared_root, written

#: Segments of a table, and deletions among them, from which on it is written anew.
SEGMENTS, GONE = 64, 8
OBS_INDEX, CODE_INDEX = "obs", "code"
CODE_FIELDS = ("body", "qualified", "path_text")


def code_terms(c):
    return stems(code_tokens(c))


#: The tables' names and columns; the index's own are last.
SCHEMAS = {
    "obs": "id long, ts long, session string, branch string, kind string, body string, ref_path string, ref_line_start int, ref_line_end int",
    "sessions": "id string, started_ts long, ended_ts long, branch string, cwd string, summary string",
    "vec_chunks": "obs_id long, chunk_idx int, emb_q8 array<tinyint>",
    "synonyms": "term string, expansion string",
    "meta": "key string, value string",
    "files": "path string, repo_root string, language string, mtime_ns long, size_bytes long, git_rev string",
    "code_chunks": "id long, path string, language string, line_start int, line_end int, kind string, qualified string, body string",
    "vec_code": "id long, emb_q8 array<tinyint>",
    "embed_cache": "key string, emb array<float>, created_ts long",
    "index_sizes": "index string, field string, n long, words long",
    **{f"terms_{i}": "field string, term string, id long, dl int, tf long, bucket int" for i in (OBS_INDEX, CODE_INDEX)},
    **{f"lengths_{i}": "id long, field string, dl int" for i in (OBS_INDEX, CODE_INDEX)},
}

#: Pairs that are put in once, in both directions.
SYNONYM_PAIRS = [
    ("k8s", "kubernetes"),
    ("kube", "kubernetes"),
    ("db", "database"),
    ("repo", "repository"),
    ("ci", "continuous integration"),
    ("cd", "continuous deployment"),
    ("pr", "pull request"),
    ("env", "environment"),
    ("api", "endpoint"),
    ("ui", "interface"),
    ("auth", "authentication"),
    ("authz", "authorization"),
    ("fe", "frontend"),
    ("be", "backend"),
    ("ts", "typescript"),
    ("js", "javascript"),
    ("rs", "rust"),
    ("py", "python"),
    ("config", "configuration"),
    ("docs", "documentation"),
    ("e2e", "end to end"),
    ("oom", "out of memory"),
    ("perf", "performance"),
    ("dev", "development"),
    ("prod", "production"),
    ("stg", "staging"),
]


class ModelMismatch(RuntimeError):
    pass


class Change:
    """What one commit does to some tables: rows that go by a key, rows that come, or a new content."""

    def __init__(self, store: Store) -> None:
        self.store, self.state = store, store._state()
        self.tables: dict[str, list[dict]] = {t: list(v) for t, v in self.state["tables"].items()}

    def _add(self, name: str, df: DataFrame, **marks: str) -> None:
        path = f"{name}/{self.state['n'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        writer = df.write
        if "bucket" in df.columns:
            writer = writer.partitionBy("bucket")
        writer.parquet(f"{self.store.root}/{path}")
        self.tables.setdefault(name, []).append({"path": path, **marks})

    def append(self, name: str, df: DataFrame) -> Change:
        self._add(name, self.store.typed(name, df))
        return self

    def remove(self, name: str, keys: DataFrame, key: str) -> Change:
        """All rows so far with one of the keys go; no other row is written again."""
        if self.tables.get(name):
            self._add(name, keys.select(key).distinct(), gone=key)
        return self

    def replace(self, name: str, df: DataFrame) -> Change:
        fresh = self.store.typed(name, df)
        self.tables[name] = []
        self._add(name, fresh)
        return self

    def clear(self, name: str) -> Change:
        self.tables[name] = []
        return self

    def commit(self) -> None:
        """All tables at once. Tables of many segments are written anew on this occasion."""
        for name, found in list(self.tables.items()):
            if len(found) > SEGMENTS or sum("gone" in x for x in found) > GONE:
                self.replace(name, self.store._content(name, found))
        self.store._commit({"n": self.state["n"] + 1, "tables": self.tables}, self.state)


class Store:
    """Tables under ``root``: Parquet segments, and a log of commits that says which ones make up each table.

    Inserts and deletes add segments and rewrite nothing; a reader sees the last complete commit.
    There is one writer at a time: a commit on top of a state that is no longer the last one fails.
    """

    def __init__(self, spark: SparkSession, root: str, dim: int = 384, read_only: bool = False) -> None:
        self.spark, self.root, self.dim, self.read_only = spark, root.rstrip("/"), dim, read_only
        if not read_only:
            self.seed_synonyms_once()

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _commits(self) -> list[str]:
        fs, p = self._fs(f"{self.root}/_commits")
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.endswith(".json")) if fs.exists(p) else []

    def _state(self, name: str | None = None) -> dict:
        if name is None:
            found = self._commits()
            if not found:
                return {"n": 0, "tables": {}}
            name = found[-1]
        fs, p = self._fs(f"{self.root}/_commits/{name}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, state: dict, before: dict) -> None:
        if self.read_only:
            raise PermissionError("the store was opened for reading")
        fs, to = self._fs(f"{self.root}/_commits/{state['n']:08d}.json")
        fs, part = self._fs(f"{self.root}/_commits/{state['n']:08d}-{uuid.uuid4().hex[:8]}.tmp")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if fs.exists(to) or not fs.rename(part, to):
            fs.delete(part, False)
            raise RuntimeError("another writer has changed the store")
        # segments of neither this commit nor the one before go; readers may still be at that
        used = {x["path"] for s in (state, before) for found in s["tables"].values() for x in found}
        for old in self._commits()[:-2]:
            for found in self._state(old)["tables"].values():
                for x in found:
                    if x["path"] not in used:
                        gone_fs, p = self._fs(f"{self.root}/{x['path']}")
                        gone_fs.delete(p, True)
            gone_fs, p = self._fs(f"{self.root}/_commits/{old}")
            gone_fs.delete(p, False)

    def typed(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(SCHEMAS[name]).fields])

    def _content(self, name: str, found: list[dict]) -> DataFrame:
        out, paths = None, []

        def flush(out: DataFrame | None) -> DataFrame | None:
            if not paths:
                return out
            reader = self.spark.read.schema(SCHEMAS[name])
            # a table in folders is read segment by segment: several roots have no common base
            for df in [reader.parquet(p) for p in paths] if name.startswith("terms_") else [reader.parquet(*paths)]:
                out = df if out is None else out.unionByName(df)
            paths.clear()
            return out

        for x in found:
            if "gone" not in x:
                paths.append(f"{self.root}/{x['path']}")
                continue
            out = flush(out)
            if out is not None:
                kind = dict(self.spark.createDataFrame([], SCHEMAS[name]).dtypes)[x["gone"]]
                out = dml.delete_keys(out, self.spark.read.schema(f"{x['gone']} {kind}").parquet(f"{self.root}/{x['path']}"), x["gone"]).select(*out.columns)
        out = flush(out)
        return self.spark.createDataFrame([], SCHEMAS[name]) if out is None else out

    def read(self, name: str) -> DataFrame:
        return self._content(name, self._state()["tables"].get(name, []))

    def change(self) -> Change:
        if self.read_only:
            raise PermissionError("the store was opened for reading")
        return Change(self)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """A new content of one table."""
        self.change().replace(name, df).commit()
        return self.read(name)

    @classmethod
    def temporary(cls, spark: SparkSession, dim: int = 384) -> Store:
        """A store in scratch storage, which goes with the application."""
        return cls(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex[:12]}", dim)

    def file_meta(self, path: str):
        """The row of one file, or None."""
        return self.read("files").filter(F.col("path") == path).first()

    def by_ids(self, name: str, ids: list[int]) -> DataFrame:
        """Rows in the order of the ids; unknown ids are left out, repeated ones repeat."""
        asked = self.spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "nth__ int, id long")
        found = self.read(name).filter(F.col("id").isin(sorted(set(ids)))) if ids else self.read(name).limit(0)
        return found.join(asked, "id").orderBy("nth__").select(*found.columns)

    def counts(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in ("obs", "code_chunks", "files", "synonyms", "embed_cache")}

    def import_vectors(self, rows: DataFrame) -> None:
        """Old code vectors (id, emb array<float>) as 8-bit ones, appended."""
        self.change().append("vec_code", rows.select("id", legacy_i8(F.col("emb")).alias("emb_q8"))).commit()

    def views(self) -> None:
        for name in SCHEMAS:
            self.read(name).createOrReplaceTempView(name)

    # meta
    def meta(self, key: str) -> str | None:
        row = self.read("meta").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def set_meta(self, key: str, value: str) -> None:
        self.write("meta", dml.replace_by_key(self.read("meta"), self.spark.createDataFrame([(key, value)], SCHEMAS["meta"]), "key"))

    def guard_model(self, tag: str) -> None:
        """Vectors of different models can't be compared: refuses a new tag once there are vectors."""
        was = self.meta("embed_model_tag")
        if was is not None and was != tag and not (self.read("vec_code").isEmpty() and self.read("vec_chunks").isEmpty()):
            raise ModelMismatch(f"vectors were made by {was}, not {tag}: index anew")
        if was != tag:
            self.set_meta("embed_model_tag", tag)

    # synonyms
    def seed_synonyms_once(self) -> None:
        if self.meta("synonyms_seeded") is None:
            both = [*SYNONYM_PAIRS, *((b, a) for a, b in SYNONYM_PAIRS)]
            self.write("synonyms", self.read("synonyms").unionByName(self.spark.createDataFrame(both, SCHEMAS["synonyms"])).dropDuplicates())
            self.set_meta("synonyms_seeded", "1")

    def add_synonym(self, a: str, b: str) -> None:
        self.write("synonyms", dml.add_synonym(self.read("synonyms"), a, b))

    def remove_synonym(self, term: str, expansion: str | None = None) -> int:
        before = self.read("synonyms")
        kept = dml.remove_synonym(before, term, expansion)
        gone = before.count() - kept.count()
        self.write("synonyms", kept)
        return gone

    # observations
    def insert_obs(self, rows: DataFrame, chunks: DataFrame | None = None, order: tuple[str, ...] = ("ts", "body")) -> DataFrame:
        """Appends observations with dense ids, and their terms to the index. ``chunks`` (row_key, chunk_idx, emb_q8) go by the rows' row_key."""
        keyed = dml.with_ids(self.read("obs"), rows, list(order))
        change = self.change()
        if chunks is not None:
            bad = chunks.filter(F.size("emb_q8") != self.dim)
            if not bad.isEmpty():
                raise ValueError(f"a vector doesn't have {self.dim} dimensions")
            if not keyed.join(chunks, "row_key", "left_anti").isEmpty():
                raise ValueError("an observation has no chunk")
            change.append("vec_chunks", chunks.join(keyed.select("row_key", F.col("id").alias("obs_id")), "row_key"))
        change.append("obs", keyed)
        self._index(change, OBS_INDEX, keyed.select("id", "body"), default_tokens, ("body",))
        change.commit()
        return self.read("obs")

    def evict_older_than(self, cutoff: int) -> int:
        gone = self.read("obs").filter(F.col("ts") < cutoff).select("id")
        n = gone.count()
        if n:
            change = self.change().remove("vec_chunks", gone.withColumnRenamed("id", "obs_id"), "obs_id").remove("obs", gone, "id")
            self._unindex(change, OBS_INDEX, gone)
            change.commit()
        return n

    def upsert_sessions(self, fresh: DataFrame) -> DataFrame:
        old = self.read("sessions").join(fresh.select("id").distinct(), "id", "left_semi")
        merged = written(dml.upsert_sessions(old, fresh).join(old.select("id", "ended_ts", "summary"), "id", "left"), "sessions")
        self.change().remove("sessions", fresh, "id").append("sessions", merged).commit()
        return self.read("sessions")

    # code
    def upsert_code(self, files: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None) -> None:
        """Replaces files, their chunks, terms and vectors. ``vectors`` (path, line_start, qualified, emb_q8) go by the chunk's place."""
        keyed = dml.with_ids(self.read("code_chunks"), chunks, ["path", "line_start", "qualified"])
        change = self._without(files)
        if vectors is not None:
            change.append("vec_code", keyed.join(vectors, ["path", "line_start", "qualified"]).select("id", "emb_q8"))
        change.append("code_chunks", keyed).append("files", files)
        self._index(change, CODE_INDEX, keyed.withColumn("path_text", F.col("path")), code_terms, CODE_FIELDS)
        change.commit()

    def _without(self, paths: DataFrame) -> Change:
        stale = written(self.read("code_chunks").join(paths.select("path").distinct(), "path", "left_semi").select("id"), "stale")
        change = self.change().remove("vec_code", stale, "id").remove("code_chunks", paths, "path").remove("files", paths, "path")
        self._unindex(change, CODE_INDEX, stale)
        return change

    def delete_code(self, paths: DataFrame) -> None:
        self._without(paths).commit()

    def wipe_code_index(self) -> None:
        """Files, code chunks and all vectors go; the observations' texts and terms stay."""
        change = self.change()
        for name in ("files", "code_chunks", "vec_code", "vec_chunks", f"terms_{CODE_INDEX}", f"lengths_{CODE_INDEX}"):
            change.clear(name)
        change.append("index_sizes", self.read("index_sizes").filter(F.col("index") == CODE_INDEX).select("index", "field", (-F.col("n")).alias("n"), (-F.col("words")).alias("words")))
        change.commit()

    # the inverted index: postings in buckets of terms, a document's lengths, and sizes that are summed up over their rows
    def _index(self, change: Change, index: str, rows: DataFrame, analyze, fields: tuple[str, ...]) -> None:
        change.append(f"terms_{index}", bm25.in_buckets(bm25.postings(rows, analyze, fields)))
        lengths = written(bm25.lengths(rows, analyze, fields), "lengths")
        change.append(f"lengths_{index}", lengths)
        change.append("index_sizes", lengths.groupBy("field").agg(F.count("*").alias("n"), F.sum("dl").alias("words")).withColumn("index", F.lit(index)))

    def _unindex(self, change: Change, index: str, gone: DataFrame) -> None:
        lost = self.read(f"lengths_{index}").join(gone.select("id").distinct(), "id", "left_semi").groupBy("field").agg((-F.count("*")).alias("n"), (-F.sum("dl")).alias("words"))
        change.append("index_sizes", lost.withColumn("index", F.lit(index)))
        change.remove(f"terms_{index}", gone, "id").remove(f"lengths_{index}", gone, "id")

    def index(self, name: str = OBS_INDEX) -> bm25.Index:
        """The stored postings and sizes: ``obs``, by words, or ``code``, by stems of identifiers' parts."""
        sizes = self.read("index_sizes").filter(F.col("index") == name).groupBy("field").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))
        return bm25.Index(self.read(f"terms_{name}"), sizes, code_terms if name == CODE_INDEX else default_tokens)

    # embedding cache
    def cache_split(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Hits (with emb) and misses of (key, ...)."""
        return dml.cache_split(wanted, self.read("embed_cache"))

    def cache_put(self, rows: DataFrame) -> None:
        """Appends what isn't there; of rows with the same key the oldest."""
        first = rows.groupBy("key").agg(F.min(F.struct("created_ts", "emb")).alias("r")).select("key", "r.emb", "r.created_ts")
        self.change().append("embed_cache", first.join(self.read("embed_cache").select("key"), "key", "left_anti")).commit()

    def snapshot(self, tag: str) -> str:
        """A copy of all tables beside the store, named by the tag; it can be opened as a store."""
        to = f"{self.root}-{re.sub('[^A-Za-z0-9.-]', '_', tag)}"
        copy = Store(self.spark, to, self.dim, read_only=True)
        copy.read_only = False
        change = copy.change()
        for name, found in self._state()["tables"].items():
            change.replace(name, self._content(name, found))
        change.commit()
        return to
