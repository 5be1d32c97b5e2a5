"""Queries of folds and greedy choices. What SQL can't express is held against loops in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import folds, selection
from .conversations import conversations, ws
from .dialogues import SENT
from .registry import query, table
from .scores import scored


@query("speech_packing", f"""
WITH RECURSIVE s AS (SELECT conv_id, turn, {SENT.format(c="text")} AS s FROM conversations WHERE role = 'assistant'),
f AS (SELECT conv_id, turn, s, 1 AS i, 0 AS chunk, s[1] AS now, len({ws("s[1]")}) AS n FROM s WHERE len(s) > 0
  UNION ALL SELECT conv_id, turn, s, i + 1, CASE WHEN n + len({ws("s[i + 1]")}) <= 30 THEN chunk ELSE chunk + 1 END, CASE WHEN n + len({ws("s[i + 1]")}) <= 30 THEN now || ' ' || s[i + 1] ELSE s[i + 1] END, CASE WHEN n + len({ws("s[i + 1]")}) <= 30 THEN n + len({ws("s[i + 1]")}) ELSE len({ws("s[i + 1]")}) END FROM f WHERE i < len(s))
SELECT conv_id, turn, chunk::BIGINT AS chunk, arg_max(now, i) AS text FROM f GROUP BY conv_id, turn, chunk""")
def speech_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in chunks of whole sentences, 30 words at most."""
    rows = conversations(spark, sf_dir).where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.posexplode(folds.speech_chunks(F.col("text"))).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("bigint"))


@query("batch_packing", f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, len({ws("text")})::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, turn, i, 0 AS batch, 1 AS n, size AS s FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN f.n + 1 > 4 OR f.s + t.size > 120 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n + 1 > 4 OR f.s + t.size > 120 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n + 1 > 4 OR f.s + t.size > 120 THEN t.size ELSE f.s + t.size END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT conv_id, turn, batch::BIGINT AS batch FROM f""")
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in batches of four, or fewer where they have over 120 words together."""
    rows = conversations(spark, sf_dir).select("conv_id", "turn", F.size(text.ws_words(F.col("text"))).cast("bigint").alias("size"))
    return folds.batches(rows, ["conv_id"], "turn", "size", 4, 120)


@query("slot_filling", """
WITH RECURSIVE x AS (SELECT user_id, event_id::VARCHAR AS d, event_id % 13 = 0 AS wrong, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, 0::BIGINT AS i, '' AS digits, 0::BIGINT AS errors FROM x GROUP BY user_id
  UNION ALL SELECT f.user_id, x.i, CASE WHEN x.wrong THEN '' WHEN length(f.digits) >= 11 THEN f.digits ELSE substr(f.digits || x.d, 1, 11) END, f.errors + x.wrong::BIGINT FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1),
l AS (SELECT user_id, arg_max(digits, i) AS digits, max(errors) AS errors FROM f GROUP BY user_id)
SELECT user_id, digits, errors, CASE WHEN length(digits) = 11 THEN 'complete' WHEN errors > 0 THEN 'error' ELSE 'open' END AS state FROM l""")
def slot_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits that each user's purchases spell, until eleven."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 13 == 0, " x").otherwise("")).alias("said"))
    return folds.slots(rows, ["user_id"], "event_id", "said")


@query("greedy_coverage")
def greedy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight conversations that cover the roles and kinds of turns evenly. The number is the feature."""
    n = F.size(text.ws_words(F.col("text")))
    kinds = {"n_system": F.col("role") == "system", "n_short": n <= 10, "n_long": n > 60, "n_asked": text.terminal_mark(F.col("text")) == "?"}
    profile = conversations(spark, sf_dir).groupBy("conv_id").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    picked = selection.covering(profile, "conv_id", list(kinds), 8)
    return spark.createDataFrame([(i, k, g) for i, (k, g) in enumerate(picked)], "place bigint, conv_id bigint, gain double")


@query("greedy_thresholds")
def greedy_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that raise macro F1, adopted one tag after another."""
    rows = scored(spark, sf_dir).select("gold", "p")
    got = selection.adopted(rows, list(range(7)), {t: 0.2 for t in range(7)}, least=0.0)
    return spark.createDataFrame([(t, v, f) for t, v, f in got], "tag bigint, threshold double, f1 double")
