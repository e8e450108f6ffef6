"""Stateful behaviour as Structured Streaming, with batch forms that give the same rows on the whole history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.functions.text import query_hash
from palimpsest.params import DEFAULT, Params


def session_dedup(messages: DataFrame) -> DataFrame:
    """Each session's first message of each text (session_key, ts, seq, text)."""
    held = messages.withColumn("qhash", query_hash(F.col("text")))
    first = W.partitionBy("session_key", "qhash").orderBy("ts", "seq")
    return held.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def session_dedup_stream(messages: DataFrame, within: str = "1 day") -> DataFrame:
    """The same on a stream; state is kept for `within` of event time."""
    held = messages.withColumn("qhash", query_hash(F.col("text"))).withWatermark("ts", within)
    return held.dropDuplicatesWithinWatermark(["session_key", "qhash"])


def rapid_repeats(messages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """messages with is_repeat: the same first 50 characters in the session within ten seconds of the time before."""
    w = W.partitionBy("session_key", F.substring("text", 1, 50)).orderBy("ts", "seq")
    gap = F.col("ts").cast("double") - F.lag("ts").over(w).cast("double")
    return messages.withColumn("is_repeat", F.coalesce(gap <= p.repeat_seconds, F.lit(False)))


def windowed_stats(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and value sums by window and event; with `late` as a watermarked stream."""
    held = events.withWatermark("ts", late) if late else events
    return held.groupBy(F.window("ts", width).alias("w"), "event").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event", "n", "total")


def sessions(events: DataFrame, p: Params = DEFAULT, late: str | None = None) -> DataFrame:
    """Runs of a session's events that no pause of the inactivity limit breaks."""
    held = events.withWatermark("ts", late) if late else events
    gap = f"{p.inactivity_seconds} seconds"
    return held.groupBy(F.session_window("ts", gap).alias("w"), "session_key").agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("session_key", F.col("w.start").alias("start"), "last", "n")


def log_stats(events: DataFrame) -> DataFrame:
    """One row an event: total, share of all, sum and mean of value."""
    per = events.groupBy("event").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"))
    return per.crossJoin(F.broadcast(events.agg(F.count("*").alias("all")))).withColumn("ratio", F.round(F.col("n") / F.col("all"), 3)).drop("all")


def since(events: DataFrame, hours: float, p: Params = DEFAULT) -> DataFrame:
    """Events of the last hours before now; those without a time pass."""
    return events.filter(F.col("ts").isNull() | (F.col("ts").cast("double") >= F.lit(p.now).cast("timestamp").cast("double") - hours * 3600))


STATE = "task string, parts array<string>, from_iso string"
OUT = "agent_id string, action string, task string, parts array<string>, from_iso string"


def state_step(state: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
    """One message (status, task, summary, iso) on an agent's state (task, parts, from_iso): the new state, and what is ingested.

    Ongoing and stalled work merges: the first state of a summary wins. Completed work is ingested and clears the state; the next one starts
    where it ended.
    """
    status, task, summary, iso = row
    was = state or (None, (), None)
    parts = was[1] if summary is None or summary in was[1] else (*was[1], summary)
    now = (task or was[0], parts, was[2] or iso)
    if status == "completed":
        return (None, (), iso), now
    return now, None


def runtime_states(messages: DataFrame, forget_hours: float | None = None) -> DataFrame:
    """Ingested work of a stream of messages (agent_id, ts, status, task, summary): append mode, state by agent.

    With forget_hours (a query that then never is idle) an agent that is silent for so long is given up: what it had comes out as 'stalled' and its state goes, so that state does not grow with all
    agents ever seen.
    """
    limit = int((forget_hours or 0) * 3_600_000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        held = (held[0], tuple(held[1] or ()), held[2]) if held else None
        out = []
        if state.hasTimedOut:
            if held and held[1]:
                out.append((key[0], "stalled", held[0], list(held[1]), held[2]))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "summary"])
            for status, task, summary, ts in zip(rows["status"], rows["task"], rows["summary"], rows["ts"], strict=True):
                held, done = state_step(held, (status, task, summary, ts.isoformat()))
                if done:
                    out.append((key[0], "ingest", done[0], list(done[1]), done[2]))
            state.update((held[0], list(held[1]), held[2]))
            if limit:
                state.setTimeoutDuration(limit)
        yield pd.DataFrame(out, columns=["agent_id", "action", "task", "parts", "from_iso"])

    return messages.groupBy("agent_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if limit else GroupStateTimeout.NoTimeout)


def incremental_index(memories: DataFrame, path: str, checkpoint: str):
    """A stream of records (pid, summary) into the documents of a lexical index: each micro-batch appends the tokens of its records, no old text is cut again.

    `bm25.Index.of(spark.read.parquet(path))` is the index at any time; a record that comes again has its newest row by `batch`.
    """
    from palimpsest.functions.text import tokens

    def batch(df: DataFrame, number: int) -> None:
        docs = df.dropDuplicates(["pid"]).select("pid", tokens(F.coalesce("summary", F.lit("")), cjk=True).alias("t")).withColumns({"dl": F.size("t"), "batch": F.lit(number)})
        docs.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return memories.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def index_documents(spark, path: str) -> DataFrame:
    """pid, dl, t of an incremental index: the newest row of each record."""
    held = spark.read.parquet(path)
    return held.withColumn("_n", F.row_number().over(W.partitionBy("pid").orderBy(F.desc("batch")))).filter("_n = 1").select("pid", "dl", "t")


def daily_batch(spark, folder: str, write: Callable[[DataFrame, object], object], checkpoint: str, now=None):
    """Ingests all four-layer JSON files below a folder that no earlier run has seen, then stops (a daily job)."""
    from datetime import datetime

    from palimpsest.sources.files import four_layers

    raw = spark.readStream.format("text").option("wholetext", True).load(folder)
    docs = raw.select(F.md5(F.col("value").cast("binary")).alias("bundle_id"), "value")

    def batch(df: DataFrame, number: int) -> None:
        write(four_layers(df), now or datetime.now())

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recall_stream(messages: DataFrame, recall: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Every micro-batch of queries through a recall plan into an idempotent sink (batch number given)."""

    def batch(df: DataFrame, number: int) -> None:
        sink(recall(df), number)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
