"""The capture path: hook events to observations, in batch and as a stream; file events to index updates.

Event time is the rows' ``ts``. The streaming dedup keeps the last accepted time of each (session,
kind, body) and drops it by a timer once the watermark is a window past it; rows behind the watermark are
dropped by the engine.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from heliograph.functions import text as T
from heliograph.operators.dedup import WINDOW_S
from heliograph.sources.readers import git_branch
from heliograph.sources.scratch import setting, shared_root

#: Hooks, the fields their text is in, and the kinds they make.
HOOKS = {"user-prompt-submit": (["prompt"], "user_prompt"), "stop": (["last_assistant_message"], "assistant_message"), "session-end": (["last_assistant_message"], "assistant_message"), "subagent-stop": (["last_assistant_message", "content"], "subagent_message")}


def route(events: DataFrame) -> DataFrame:
    """(.., kind, body) of prose hooks with a text; blank ones go, an unknown hook is an error."""
    body, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for hook, (fields, k) in HOOKS.items():
        at = F.col("hook") == hook
        body = F.when(at, F.coalesce(*[F.get_json_object("payload", f"$.{f}") for f in fields])).otherwise(body)
        kind = F.when(at, k).otherwise(kind)
    checked = F.when(F.col("hook").isin([*HOOKS, "post-tool-use", "session-start"]), kind).otherwise(F.raise_error(F.concat(F.lit("unknown hook: "), F.col("hook"))))
    return events.withColumn("kind", checked).withColumn("body", F.trim(body)).filter(F.col("kind").isNotNull() & (F.col("body") != ""))


def tool_reference(events: DataFrame) -> DataFrame:
    """(.., kind, body): a line for each use of a tool that is referred to; others go."""
    given = lambda f: F.get_json_object("tool_input", f"$.{f}")
    answer = lambda f: F.get_json_object("tool_response", f"$.{f}")
    path, offset, limit = given("file_path"), given("offset").cast("long"), given("limit").cast("long")
    lines = F.size(F.split(given("content"), "\n"))
    read = F.when(offset.isNotNull() & limit.isNotNull(), F.format_string("Read(%s:%d-%d)", path, offset, offset + limit - 1)).otherwise(F.format_string("Read(%s)", path))
    code = F.when(answer("interrupted").isNotNull(), F.when(answer("interrupted") == "true", "interrupted").otherwise("0")).otherwise(F.coalesce(answer("exit_code"), F.lit("0")))
    name = F.col("tool_name")
    body = (
        F.when(name == "Read", read)
        .when(name == "Edit", F.format_string("Edit(%s)", path))
        .when(name == "Write", F.format_string("Write(%s, %d lines)", path, lines))
        .when(name == "Bash", F.format_string("Bash($ %s, exit=%s)", T.truncate_mark(given("command"), 200), code))
        .when(name == "WebFetch", F.format_string("WebFetch(%s)", given("url")))
        .when(name == "Task", F.format_string("Task(%s: %s)", given("subagent_type"), T.truncate_mark(given("prompt"), 200)))
    )
    kind = F.when(answer("is_error") == "true", "tool_failure").otherwise("tool_use")
    return events.withColumn("body", body).withColumn("kind", kind).filter("body is not null")


def cleaned(events: DataFrame) -> DataFrame:
    """Redacted, then cut to 4096 bytes, of a known kind; with the hash by which duplicates are known."""
    out = events.withColumn("body", T.truncate_body(T.redact(F.col("body")))).withColumn("kind", T.normal_kind(F.col("kind")))
    return out.withColumn("hash", T.dedup_hash(F.col("session"), F.col("kind"), F.col("body")))


class LastAccepted(StatefulProcessor):
    """Keeps the time of a key's last accepted row; rows within the window of it are dropped.

    A micro-batch's rows of a key are put in order by their times, so that is what is held of them at
    once; a row before the last accepted time can't be fresh.
    """

    def __init__(self, columns: list[str], window: int = WINDOW_S) -> None:
        self.columns, self.window = columns, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([r[self.columns] for r in rows]).sort_values(["ts", self.columns[0]])
        before = last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for t in pdf["ts"]:
            fresh = last is None or t - last > self.window
            keep.append(fresh)
            last = int(t) if fresh else last
        if last != before:
            self.last.update((last,))
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(last))
        if any(keep):
            yield pdf[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def _ends(self, ts: int) -> int:
        """In milliseconds, the first moment at which a row is fresh again."""
        return (int(ts) + self.window + 1) * 1000

    def close(self) -> None:
        pass


def dedup_stream(stream: DataFrame, keys: list[str], schema: str, window: int = WINDOW_S, lateness: str = "300 seconds") -> DataFrame:
    """Fresh rows of a stream with ``ts`` in seconds. The first column of the schema orders rows of one second."""
    names = [f.split()[0] for f in schema.split(", ")]
    timed = stream.select(*names, F.timestamp_seconds("ts").alias("event_time")).withWatermark("event_time", lateness)
    return timed.groupBy(*keys).transformWithStateInPandas(LastAccepted(names, window), schema, "Append", "EventTime")


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for streams that are started within."""
    key, value = STATE_STORE
    before = setting(spark, key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def replay(events: DataFrame) -> DataFrame:
    """A bounded table through the streaming dedup, in one available-now run; state in RocksDB."""
    spark = events.sparkSession
    root = f"{shared_root(spark)}/replay-{uuid.uuid4().hex[:12]}"
    events.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    out = dedup_stream(stream, ["session", "kind"], "event_id long, session string, kind string, ts long")
    with rocksdb(spark):
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def hook_rows(spark: SparkSession, hook: str, payload: dict, ts: int) -> DataFrame:
    """One hook's JSON as observations (session, kind, body, ts, branch): its text, or a line for a tool's use."""
    given = lambda f: None if payload.get(f) is None else payload[f] if isinstance(payload[f], str) else json.dumps(payload[f])
    row = (hook, ts, json.dumps(payload), payload.get("session_id") or "", payload.get("tool_name"), given("tool_input"), given("tool_response"), git_branch(payload["cwd"]) if payload.get("cwd") else None)
    event = spark.createDataFrame([row], "hook string, ts long, payload string, session string, tool_name string, tool_input string, tool_response string, branch string")
    made = tool_reference(event) if hook == "post-tool-use" else route(event)
    return made.select("session", "kind", "body", "ts", "branch")


def debounced(stream: DataFrame, delay: str = "250 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """(path, kind): one row for each burst of a path's events, the last kind."""
    return stream.withWatermark("ts", lateness).groupBy("path", F.session_window("ts", delay)).agg(F.max_by("kind", "ts").alias("kind")).select("path", "kind")


def churn_stream(stream: DataFrame, window: str = "600 seconds", slide: str = "60 seconds", lateness: str = "60 seconds") -> DataFrame:
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", window, slide), "root").agg(F.count("*").alias("n"))


def heartbeat(stream: DataFrame, lateness: str = "60 seconds") -> DataFrame:
    """Counts by outcome for each minute with any event."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", "60 seconds"), "outcome").agg(F.count("*").alias("n"))


def reindex_batches(stream: DataFrame, reindex, delete, checkpoint: str):
    """Each micro-batch's paths once: removed ones to ``delete``, the others to ``reindex``."""

    def handle(df: DataFrame, _: int) -> None:
        latest = df.groupBy("path").agg(F.max_by("kind", "ts").alias("kind"))
        delete(latest.filter("kind = 'remove'").select("path"))
        reindex(latest.filter("kind <> 'remove'").select("path"))

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
