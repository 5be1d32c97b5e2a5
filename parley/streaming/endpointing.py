"""Endpointing and turn state on streams. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(stream: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Points of a key less than ``gap`` apart as one session. In append mode a session comes out once the watermark has passed its end."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("closes"), "n", "total")


def closed_sessions(rows: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The batch twin: sessions that the watermark of all rows has passed."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp"))
    mark = timed.agg((F.max(at) - F.expr(f"INTERVAL {late}")).alias("mark"))
    every = timed.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return every.crossJoin(F.broadcast(mark)).where(F.col("w.end") <= F.col("mark")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("closes"), "n", "total")  # mark: one row


def turn_states(stream: DataFrame) -> DataFrame:
    """user_id, n_taken, n_seen, state after each batch of events: listening, answering or yielded.

    A purchase takes the floor, a click while answering yields it, a view after that listens again. State is a
    key's state alone, so it grows with the keys and not with the events.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, taken, seen = state.get if state.exists else ("listening", 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            seen += 1
            if kind == "purchase":
                taken += now != "answering"
                now = "answering"
            elif kind == "click" and now == "answering":
                now = "yielded"
            elif kind == "view" and now == "yielded":
                now = "listening"
        state.update((now, taken, seen))
        yield pd.DataFrame({"user_id": [key[0]], "n_taken": [taken], "n_seen": [seen], "state": [now]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n_taken bigint, n_seen bigint, state string", "state string, taken bigint, seen bigint", "update", "NoTimeout")


def settled_words(stream: DataFrame, commit: str = "2 seconds", at: str = "ts", grain: str = "1 second") -> DataFrame:
    """Words once they are older than the commit window, each once: event_id, event_type and ``at``.

    A word is held back, as state of its own grain of time, until the watermark (the latest time less ``commit``) has
    passed the end of that grain; append mode never takes back what it gave. The state is what came in within the window.
    """
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, commit)
    return timed.groupBy(F.window(at, grain).alias("w"), "event_id", "event_type").agg(F.min(at).alias(at)).select("event_id", "event_type", at)


def settled_of(rows: DataFrame, commit: str = "2 seconds", at: str = "ts", grain: str = "1 second") -> DataFrame:
    """The batch twin: all rows, with settled, which is false for those that the watermark of all rows still holds back."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp"))
    mark = timed.agg((F.max(at) - F.expr(f"INTERVAL {commit}")).alias("mark"))
    return timed.withColumn("w", F.window(at, grain)).crossJoin(F.broadcast(mark)).select("event_id", "event_type", at, (F.col("w.end") <= F.col("mark")).alias("settled"))  # mark: one row


def flushed(settled: DataFrame, rows: DataFrame, at: str = "ts") -> DataFrame:
    """What the end of a stream gives: the words it has settled, and then those still held back, which no later word can settle."""
    every = rows.select("event_id", "event_type", F.col(at).cast("timestamp").alias(at))
    rest = every.join(settled.select("event_id"), "event_id", "left_anti")
    return settled.withColumn("phase", F.lit("settled")).unionByName(rest.withColumn("phase", F.lit("flush")))
