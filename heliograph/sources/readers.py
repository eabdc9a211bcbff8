"""Readers and writers beside the store: source trees, hook events, question sets, query banks, reports."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.text import excluded, language_of, slice_lines

#: Parts of paths that are left out.
EXCLUDES = ["/target/", "/node_modules/", "/.git/", "/dist/", "/build/", "/.next/", "/.cache/", "/__pycache__/", "/.venv/", "/venv/"]
MAX_FILE_BYTES = 1 << 20

#: The columns of hook payloads and question sets, as their producers name them.
HOOK = "session_id string, cwd string, prompt string, last_assistant_message string, content string, tool_name string, tool_input string, tool_response string"
QUESTIONS = "question_id string, question string, question_type string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_session_ids array<string>, answer_session_ids array<string>"


@dataclass(frozen=True)
class Config:
    roots: tuple[str, ...] = ()
    excludes: tuple[str, ...] = tuple(EXCLUDES)
    languages: tuple[str, ...] = ()
    max_file_bytes: int = MAX_FILE_BYTES
    debounce_ms: int = 250
    churn_window_s: int = 600
    ttl_days: int = 90
    extra: dict = field(default_factory=dict)


def load_config(path: str | None = None, env: dict | None = None) -> Config:
    """Environment (HELIOGRAPH_ROOTS, ...) over the file over the defaults. A file that can't be parsed is an error."""
    out = Config()
    if path and Path(path).exists():
        values = tomllib.loads(Path(path).read_text())
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in Config.__dataclass_fields__}
        out = replace(out, **known, extra={k: v for k, v in values.items() if k not in known})
    for k, v in (env or {}).items():
        name = k.removeprefix("HELIOGRAPH_").lower()
        if k.startswith("HELIOGRAPH_") and name in Config.__dataclass_fields__:
            was = getattr(out, name)
            out = replace(out, **{name: tuple(x for x in v.split(":") if x) if isinstance(was, tuple) else int(v)})
    return out


def expand_roots(roots: list[str] | tuple[str, ...]) -> list[str]:
    """Folders that exist, with ~ for the home folder, each once."""
    found = (str(Path(r).expanduser()) for r in roots)
    return list(dict.fromkeys(r for r in found if Path(r).is_dir()))


def git_branch(folder: str) -> str | None:
    """The branch that a folder's working tree is on; None outside one or where no branch is checked out."""
    for place in (Path(folder).absolute(), *Path(folder).absolute().parents):
        git = place / ".git"
        if git.is_file():  # a linked working tree names its own folder
            git = place / git.read_text().removeprefix("gitdir:").strip()
        if (git / "HEAD").is_file():
            head = (git / "HEAD").read_text().strip()
            return head.removeprefix("ref: refs/heads/") if head.startswith("ref: refs/heads/") else None
    return None


def _rule(line: str) -> tuple[bool, bool, re.Pattern] | None:
    """A line of an ignore file: (takes back, folders only, pattern of relative paths)."""
    text = line.rstrip("\n").rstrip()
    if not text or text.startswith("#"):
        return None
    back, text = text.startswith("!"), text.removeprefix("!")
    only, text = text.endswith("/"), text.rstrip("/")
    anchored, text = "/" in text, text.lstrip("/")
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("**", i):
            out, i = out + ".*", i + 2
        elif text[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[" and "]" in text[i + 2 :]:
            end = text.index("]", i + 2)
            out, i = out + "[" + text[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(text[i]), i + 1
    return back, only, re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z")


def walk(root: str, config: Config | None = None, ignore_files: tuple[str, ...] = (".gitignore", ".ignore")) -> Iterator[str]:
    """Paths of a tree's files, without those that ignore files on the way or the excludes leave out.

    Folders that are left out are not entered; links are not followed.
    """
    config = config or Config()

    def visit(folder: str, rules: list) -> Iterator[str]:
        own = list(rules)
        for name in ignore_files:
            path = Path(folder, name)
            if path.is_file():
                own += [(folder, *r) for r in map(_rule, path.read_text(errors="replace").splitlines()) if r]
        with os.scandir(folder) as found:
            entries = sorted(found, key=lambda e: e.name)
        for e in entries:
            is_dir = e.is_dir(follow_symlinks=False)
            if e.is_symlink() or any(x in (e.path + "/" if is_dir else e.path) for x in config.excludes):
                continue
            out = False
            for base, back, only, pattern in own:
                if (is_dir or not only) and pattern.match(os.path.relpath(e.path, base)):
                    out = not back
            if out or (is_dir and e.name == ".git"):
                continue
            if is_dir:
                yield from visit(e.path, own)
            elif e.is_file(follow_symlinks=False):
                yield e.path

    yield from visit(str(root).rstrip("/") or "/", [])


def read_sources(spark: SparkSession, root: str, config: Config | None = None, ignore: bool = False) -> DataFrame:
    """(path, language, mtime_us, size, source) of a tree's supported files, read on the executors.

    With ``ignore`` the driver walks the tree, which it must see, and only what ignore files
    leave is listed; without, the tree is listed by the engine, and links and ignore files don't matter.
    """
    if ignore:
        return read_files(spark, list(walk(root.removeprefix("file://"), config)), config)
    return _sources(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), config or Config())


def read_files(spark: SparkSession, paths: list[str], config: Config | None = None) -> DataFrame:
    """Like ``read_sources``, of these files."""
    if not paths:
        return spark.createDataFrame([], "path string, language string, mtime_us long, size long, source string")
    return _sources(spark.read.format("binaryFile").load([Path(p).absolute().as_uri() for p in paths]), config or Config())


def _sources(files: DataFrame, config: Config) -> DataFrame:
    language = language_of(F.col("path"))
    kept = files.filter(~excluded(F.col("path"), list(config.excludes)) & (F.col("length") <= config.max_file_bytes) & language.isNotNull())
    if config.languages:
        kept = kept.filter(language.isin(list(config.languages)))
    return kept.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), language.alias("language"), F.unix_micros("modificationTime").alias("mtime_us"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("source"))


def file_stats(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime_us, size) of all files of a tree; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.unix_micros("modificationTime").alias("mtime_us"), F.col("length").alias("size"))


def file_events(before: DataFrame, after: DataFrame, ts: int) -> DataFrame:
    """(ts, path, kind) of what has changed between two listings (path, mtime_us, size): create, modify or remove."""
    b, a = before.select("path", F.struct("mtime_us", "size").alias("was")), after.select("path", F.struct("mtime_us", "size").alias("now"))
    kind = F.when(F.col("was").isNull(), "create").when(F.col("now").isNull(), "remove").when(F.col("was") != F.col("now"), "modify")
    return b.join(a, "path", "full_outer").select(F.timestamp_seconds(F.lit(ts)).alias("ts"), "path", kind.alias("kind")).filter("kind is not null")


def bodies_from_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks (path, line_start, line_end, ...) with the lines that the files (path, source) have now; an empty body where a file is gone."""
    have = files.select("path", "source")
    out = chunks.drop("body").join(have, "path", "left")
    return out.withColumn("body", F.coalesce(slice_lines(F.col("source"), F.col("line_start"), F.col("line_end")), F.lit(""))).drop("source")


def changed(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files whose time or size differ from what is stored (path, mtime_us, size), and new ones."""
    known = files.select("path", F.col("mtime_us").alias("m__"), F.col("size").alias("s__"))
    return listing.join(known, "path", "left").filter(~(F.col("mtime_us").eqNullSafe(F.col("m__")) & F.col("size").eqNullSafe(F.col("s__")))).drop("m__", "s__")


def read_hooks(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema("hook string, ts long, payload string").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set; fails on questions whose sessions and ids don't pair up."""
    out = spark.read.schema(QUESTIONS).option("multiLine", "true").json(path)
    return out.filter(F.assert_true(F.size("haystack_sessions") == F.size("haystack_session_ids"), F.lit("sessions and ids differ in number")).isNull())


def question_sessions(questions: DataFrame) -> DataFrame:
    """(question_id, session, nth, turns, is_gold)"""
    pairs = F.arrays_zip(F.col("haystack_session_ids").alias("session"), F.col("haystack_sessions").alias("turns"))
    out = questions.select("question_id", "answer_session_ids", F.posexplode(pairs).alias("nth", "p"))
    return out.select("question_id", F.col("p.session").alias("session"), "nth", F.col("p.turns").alias("turns"), F.array_contains("answer_session_ids", F.col("p.session")).alias("is_gold"))


def load_bank(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, expect, category, path_prefix) from a TOML query bank with [[query]] entries."""
    rows = next((v for v in tomllib.loads(Path(path).read_text()).values() if isinstance(v, list)), [])
    return spark.createDataFrame([(i, r["query"], list(r["expect"]), r.get("category", ""), r.get("path_prefix")) for i, r in enumerate(rows)], "qid long, query string, expect array<string>, category string, path_prefix string")


def sample_chunks(chunks: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n random chunks with a name of 6 characters or more that aren't parts of a larger one. A limited sort: each task keeps its n best."""
    return chunks.filter((F.length("qualified") >= 6) & ~F.col("qualified").contains("#part-")).withColumn("at__", F.rand(seed)).orderBy("at__").limit(n).drop("at__")


def markdown_table(df: DataFrame, limit: int | None = None) -> str:
    """All rows (reports are short), or the first ``limit`` and how many more there are."""
    rows = (df if limit is None else df.limit(limit)).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    out = "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)]) + "\n"
    more = 0 if limit is None or len(rows) < limit else df.count() - limit
    return out + (f"\n{more} more rows\n" if more else "")


def write_report(df: DataFrame, folder: str) -> None:
    """JSON lines and CSV from the executors, Markdown from the driver."""
    df.write.mode("overwrite").json(f"{folder}/report.json")
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("append").option("header", "true").csv(f"{folder}/summary.csv")
    Path(folder, "report.md").write_text(markdown_table(df))
