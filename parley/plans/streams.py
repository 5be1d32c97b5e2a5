"""Queries that run a stream over the event table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import endpointing, runs
from .registry import query


@query("stream_endpointing", """
WITH s AS (SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 30 MINUTE AS closes, count(*) AS n, sum(value) AS total FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, run)
SELECT user_id, epoch_us(first)::BIGINT AS first_us, n, round(total, 6) AS total FROM s WHERE closes <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_endpointing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the event stream that its watermark has closed."""
    out = runs.run_to_table(endpointing.sessions(runs.file_stream(spark, sf_dir, "events")))
    return out.select("user_id", F.unix_micros("first").alias("first_us"), "n", F.round("total", 6).alias("total"))


@query("stream_fsm", """
WITH RECURSIVE x AS (SELECT user_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, 'listening' AS state, 0::BIGINT AS taken FROM x GROUP BY user_id
  UNION ALL SELECT f.user_id, x.i, CASE WHEN kind = 'purchase' THEN 'answering' WHEN kind = 'click' AND state = 'answering' THEN 'yielded' WHEN kind = 'view' AND state = 'yielded' THEN 'listening' ELSE state END, taken + (kind = 'purchase' AND state <> 'answering')::BIGINT FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1)
SELECT user_id, max(taken) AS n_taken, max(i) AS n_seen, arg_max(state, i) AS state FROM f GROUP BY user_id""")
def stream_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's state after all events. A fold over rows in their order."""
    return runs.run_latest(endpointing.turn_states(runs.file_stream(spark, sf_dir, "events")), ["user_id"])


#: A commit window wide enough to hold some of the table's events back.
COMMIT = "6 hours"


@query("stream_settled_words", """
SELECT event_type, count(*) AS n, max(event_id) AS last FROM events WHERE time_bucket(INTERVAL 1 SECOND, ts) + INTERVAL 1 SECOND <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events) GROUP BY event_type""")
def stream_settled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that the stream has settled: those younger than the commit window are still held back."""
    out = runs.run_to_table(endpointing.settled_words(runs.file_stream(spark, sf_dir, "events"), COMMIT))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("stream_flush", """
SELECT CASE WHEN time_bucket(INTERVAL 1 SECOND, ts) + INTERVAL 1 SECOND <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events) THEN 'settled' ELSE 'flush' END AS phase, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a stream that has ended: the settled ones, then the flush of the rest."""
    out = runs.run_to_table(endpointing.settled_words(runs.file_stream(spark, sf_dir, "events"), COMMIT))
    rows = endpointing.flushed(out, spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.groupBy("phase", "event_type").agg(F.count("*").alias("n"))
