"""Queries over the event stream: sessions, intervals, as-of joins, histograms and roll-ups. Time is in seconds since the first midnight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals, scoring
from .registry import query, table

SEC = "epoch_us(ts)::BIGINT / 1000000.0::DOUBLE"
EV = f"ev AS (SELECT event_id, user_id, event_type, value, props, {SEC} AS t FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", (us / 1000000.0).alias("t"))


@query("keep_last_by_key", f"""
SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def keep_last_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each key. As an aggregate, so each task sends one row a key."""
    rows = events(spark, sf_dir)
    last = rows.groupBy("user_id").agg(F.max(F.struct("t", "event_id", "event_type", "value")).alias("x"))
    return last.select("user_id", "x.event_id", "x.event_type", F.round("x.value", 6).alias("value"))


@query("partial_replace_union", """
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT event_type, value FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT event_type, value * 2 AS value FROM events WHERE event_type IN ('click', 'view') AND event_id % 2 = 0) GROUP BY event_type""")
def partial_replace_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two types replaced by a new run of them, all others kept."""
    rows = events(spark, sf_dir)
    again = rows.where(F.col("event_type").isin("click", "view") & (F.col("event_id") % 2 == 0)).withColumn("value", F.col("value") * 2)
    kept = rows.join(spark.createDataFrame([("click",), ("view",)], "event_type string").hint("broadcast"), "event_type", "left_anti")
    return kept.unionByName(again.select(*kept.columns)).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


SPANS = f"""{EV}, spans AS (SELECT *, t AS s, t + 60 + (event_id % 7) * 600 AS e FROM ev)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("s", F.col("t")).withColumn("e", F.col("t") + 60 + (F.col("event_id") % 7) * 600)


@query("silence_gaps_long", f"""WITH {SPANS}
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE gap >= 3600) AS n_long, round(max(gap), 3) AS longest FROM (SELECT user_id, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) - e AS gap FROM spans) GROUP BY user_id""")
def silence_gaps_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.gaps(spans(spark, sf_dir), ["user_id"], "s", "e", "event_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("gap") >= 3600).alias("n_long"), F.round(F.max("gap"), 3).alias("longest"))


MERGED = f"""{SPANS}, marked AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 300 THEN 1 ELSE 0 END AS c FROM spans),
merged AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM marked) GROUP BY user_id, run)"""


@query("merge_close_intervals", f"WITH {MERGED} SELECT user_id, round(s, 3) AS s, round(e, 3) AS e, n FROM merged")
def merge_close_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_close(spans(spark, sf_dir), ["user_id"], "s", "e", 300).select("user_id", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"), "n")


@query("gap_sessions", f"""WITH {EV}
SELECT user_id, session::BIGINT AS session, round(min(t), 3) AS first, round(max(t), 3) AS last, count(*) AS n FROM
(SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 1800 THEN 0 ELSE 1 END AS c FROM ev)) GROUP BY user_id, session""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.sessions(events(spark, sf_dir), ["user_id"], "t", "event_id", 1800)
    return rows.select("user_id", "session", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), "n")


@query("range_overlap_seconds", f"""WITH {SPANS}
SELECT a.user_id, count(*) AS n_pairs, round(sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))), 3) AS shared
FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type = 'view' AND b.event_type = 'click' GROUP BY a.user_id""")
def range_overlap_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    views = rows.where("event_type = 'view'").select("user_id", "s", "e")
    clicks = rows.where("event_type = 'click'").select("user_id", F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = intervals.overlapping(views, clicks, ["user_id"], 3600.0)
    return pairs.groupBy("user_id").agg(F.count("*").alias("n_pairs"), F.round(F.sum("shared"), 3).alias("shared"))


@query("asof_nearest_event", f"""WITH {EV}
SELECT p.event_id, arg_max(v.event_id, v.t) AS view_id, round(max(v.t), 3) AS view_t FROM (SELECT * FROM ev WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.t <= p.t AND v.t >= p.t - 86400 GROUP BY p.event_id""")
def asof_nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase's latest view of the same user, a day back at most."""
    rows = events(spark, sf_dir)
    buys = rows.where("event_type = 'purchase'").select("user_id", "event_id", "t")
    views = rows.where("event_type = 'view'").select("user_id", F.col("t").alias("view_t"), F.col("event_id").alias("view_id"))
    found = intervals.last_before(buys, views, ["user_id"], "t", "event_id", "view_t", "view_id")
    near = F.col("view_t") >= F.col("t") - 86400
    return found.select("event_id", F.when(near, F.col("view_id")).alias("view_id"), F.when(near, F.round("view_t", 3)).alias("view_t"))


@query("first_event_after", f"""WITH {EV}
SELECT p.event_id, round(min(v.t) - p.t, 3) AS wait FROM (SELECT * FROM ev WHERE event_type = 'view') p LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') v ON p.user_id = v.user_id AND v.t >= p.t GROUP BY p.event_id, p.t""")
def first_event_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long after each view the user's next purchase comes."""
    rows = events(spark, sf_dir).withColumn("buy", F.when(F.col("event_type") == "purchase", F.col("t")))
    after = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("next", F.min("buy").over(after)).where("event_type = 'view'").select("event_id", F.round(F.col("next") - F.col("t"), 3).alias("wait"))


@query("interleave_history_asof", f"""WITH {EV}
SELECT event_id, string_agg(h, ',' ORDER BY r DESC) AS history FROM (SELECT a.event_id, b.event_type AS h, row_number() OVER (PARTITION BY a.event_id ORDER BY b.t DESC, b.event_id DESC) AS r FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.t < a.t WHERE a.event_type = 'purchase') WHERE r <= 6 GROUP BY event_id""")
def interleave_history_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of the six events before each purchase, in order."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(-6, -1)
    rows = events(spark, sf_dir).withColumn("h", F.collect_list("event_type").over(w))
    return rows.where("event_type = 'purchase'").where(F.size("h") > 0).select("event_id", F.array_join("h", ",").alias("history"))


@query("backchannel_jsd", """
WITH bins AS (SELECT user_id % 8 AS grp, floor(value / 5)::BIGINT AS bin, count(*) FILTER (WHERE event_type = 'view') AS a, count(*) FILTER (WHERE event_type = 'click') AS b FROM events GROUP BY ALL),
p AS (SELECT grp, bin, (a + 1e-9) / sum(a + 1e-9) OVER (PARTITION BY grp) AS p, (b + 1e-9) / sum(b + 1e-9) OVER (PARTITION BY grp) AS q FROM bins)
SELECT grp, count(*) AS n_bins, round(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2, 6) AS jsd FROM p GROUP BY grp""")
def backchannel_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart the values of two event types lie, by group of users."""
    bins = events(spark, sf_dir).groupBy((F.col("user_id") % 8).alias("grp"), F.floor(F.col("value") / 5).alias("bin")).agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    w = Window.partitionBy("grp")
    share = lambda c: (F.col(c) + 1e-9) / F.sum(F.col(c) + 1e-9).over(w)
    rows = bins.withColumn("p", share("a")).withColumn("q", share("b"))
    return rows.groupBy("grp").agg(F.count("*").alias("n_bins"), F.round(F.sum(scoring.jensen_shannon(F.col("p"), F.col("q"))), 6).alias("jsd"))


@query("rollup_counts", """
SELECT coalesce(event_type, 'TOTAL') AS event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value > 50) AS n_high, round(max(value), 6) AS most FROM events GROUP BY ROLLUP (event_type)""")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).rollup("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 50).alias("n_high"), F.round(F.max("value"), 6).alias("most"))
    return rows.withColumn("event_type", F.coalesce("event_type", F.lit("TOTAL")))


@query("trimmed_mean_rate", """
SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS spread,
  round(CASE WHEN count(*) >= 5 THEN (sum(value) - min(value) - max(value)) / (count(*) - 2) ELSE avg(value) END, 6) AS trimmed, round(0.5 * avg(value) + 0.5 * 50, 6) AS blended FROM events GROUP BY user_id""")
def trimmed_mean_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means without the least and the largest value, from five values on, and half drawn to an anchor."""
    n, v = F.count("value"), F.col("value")
    trimmed = F.when(n >= 5, (F.sum(v) - F.min(v) - F.max(v)) / (n - 2)).otherwise(F.avg(v))
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.stddev_pop(v), 6).alias("spread"), F.round(trimmed, 6).alias("trimmed"), F.round(0.5 * F.avg(v) + 25, 6).alias("blended"))


@query("cross_group_delta_pivot", """
SELECT event_type, round(a, 6) AS a, round(b, 6) AS b, printf('%+.3f', (b - a) * CASE WHEN event_type IN ('error', 'logout') THEN -1 ELSE 1 END) AS delta FROM
(SELECT event_type, avg(value) FILTER (WHERE user_id % 2 = 0) AS a, avg(value) FILTER (WHERE user_id % 2 = 1) AS b FROM events GROUP BY event_type)""")
def cross_group_delta_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side, the difference turned so that more is better."""
    side = events(spark, sf_dir).withColumn("side", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    wide = side.groupBy("event_type").pivot("side", ["a", "b"]).agg(F.avg("value"))
    turn = F.when(F.col("event_type").isin("error", "logout"), -1).otherwise(1)
    return wide.select("event_type", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.format_string("%+.3f", (F.col("b") - F.col("a")) * turn).alias("delta"))


@query("tag_share", """
SELECT grp, event_type, n, round(n / sum(n) OVER (PARTITION BY grp), 6) AS share, rank() OVER (PARTITION BY grp ORDER BY n DESC, event_type)::BIGINT AS place FROM (SELECT user_id % 4 AS grp, event_type, count(*) AS n FROM events GROUP BY ALL)""")
def tag_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = events(spark, sf_dir).groupBy((F.col("user_id") % 4).alias("grp"), "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("grp")), 6)).withColumn("place", F.rank().over(Window.partitionBy("grp").orderBy(F.desc("n"), "event_type")).cast("bigint"))


@query("time_remap_piecewise", f"""WITH {MERGED},
plan AS (SELECT *, sum((e - s) * 1.25) OVER w - (e - s) * 1.25 + (s - first_value(s) OVER w) - (sum(e - s) OVER w - (e - s)) AS to_s FROM merged WINDOW w AS (PARTITION BY user_id ORDER BY s))
SELECT v.event_id, round(p.to_s + (v.t - p.s) * 1.25, 3) AS mapped FROM ev v JOIN plan p ON v.user_id = p.user_id AND v.t >= p.s AND v.t < p.e WHERE v.event_type = 'click'""")
def time_remap_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved to a timeline whose spans last a quarter longer and whose gaps are kept, linearly within each span."""
    merged = intervals.merge_close(spans(spark, sf_dir), ["user_id"], "s", "e", 300)
    w = Window.partitionBy("user_id").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("e") - F.col("s")
    plan = merged.withColumn("to_s", F.sum(size * 1.25).over(w) - size * 1.25 + (F.col("s") - F.first("s").over(w)) - (F.sum(size).over(w) - size))
    points = events(spark, sf_dir).where("event_type = 'click'").select("user_id", "event_id", "t")
    at = intervals.last_before(points, plan.withColumn("x", F.struct("e", "to_s")), ["user_id"], "t", "event_id", "s", "x")
    return at.where(F.col("t") < F.col("x.e")).select("event_id", F.round(F.col("x.to_s") + (F.col("t") - F.col("s")) * 1.25, 3).alias("mapped"))


@query("structure_gate", f"""WITH {MERGED},
facts AS (SELECT user_id, sum(e - s) / (max(e) - min(s)) AS filled, avg((gap >= 3600)::INT) FILTER (WHERE gap IS NOT NULL) AS long_gaps FROM (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) - e AS gap FROM merged) GROUP BY user_id)
SELECT user_id, round(filled, 6) AS filled, round(long_gaps, 6) AS long_gaps, CASE WHEN abs(filled - 0.3) <= 0.2 AND coalesce(abs(long_gaps - 0.9), 1) <= 0.2 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM facts""")
def structure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of time filled and of long gaps, held against what is expected with a tolerance."""
    merged = intervals.gaps(intervals.merge_close(spans(spark, sf_dir), ["user_id"], "s", "e", 300), ["user_id"], "s", "e", "e")
    facts = merged.groupBy("user_id").agg((F.sum(F.col("e") - F.col("s")) / (F.max("e") - F.min("s"))).alias("filled"), F.avg((F.col("gap") >= 3600).cast("int")).alias("long_gaps"))
    good = (F.abs(F.col("filled") - 0.3) <= 0.2) & (F.coalesce(F.abs(F.col("long_gaps") - 0.9), F.lit(1.0)) <= 0.2)
    return facts.select("user_id", F.round("filled", 6).alias("filled"), F.round("long_gaps", 6).alias("long_gaps"), F.when(good, "PASS").otherwise("FAIL").alias("verdict"))


@query("completeness_gated_rate", """
SELECT g.grp, count(e.event_id) AS n, CASE WHEN count(e.event_id) >= g.expected THEN round(avg((e.value > 50)::INT), 6) END AS rate
FROM (SELECT unnest(range(0, 6))::BIGINT AS grp, unnest([1, 100, 10, 100000000, 1, 1]) AS expected) g LEFT JOIN (SELECT *, user_id % 5 AS grp FROM events) e ON e.grp = g.grp GROUP BY g.grp, g.expected""")
def completeness_gated_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate by group, given only where the group has as many rows as expected."""
    sizes = spark.createDataFrame(list(enumerate([1, 100, 10, 100000000, 1, 1])), "grp bigint, expected bigint")
    got = events(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("grp")).agg(F.count("*").alias("n"), F.avg((F.col("value") > 50).cast("int")).alias("rate"))
    n = F.coalesce("n", F.lit(0))
    return sizes.join(got, "grp", "left").select("grp", n.alias("n"), F.when(n >= F.col("expected"), F.round("rate", 6)).alias("rate"))


@query("energy_run_barge_in", f"""WITH {EV},
loud AS (SELECT *, value >= 40 AS loud, sum((value < 40)::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS quiet FROM ev)
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, quiet ORDER BY t, event_id) AS r FROM loud WHERE loud) WHERE r % 3 = 0""")
def energy_run_barge_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires on every third loud event in a row, and starts again."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, sf_dir).withColumn("quiet", F.sum((F.col("value") < 40).cast("int")).over(w)).where("value >= 40")
    run = Window.partitionBy("user_id", "quiet").orderBy("t", "event_id")
    return rows.withColumn("r", F.row_number().over(run)).where("r % 3 = 0").select("user_id", "event_id")


@query("playback_gate_anti_join", f"""WITH {EV}
SELECT event_type, count(*) AS n FROM ev a WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM ev p WHERE p.event_type = 'purchase' AND p.user_id = a.user_id AND a.t >= p.t AND a.t < p.t + 36000.6) GROUP BY event_type""")
def playback_gate_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events but those in the ten hours (and a tail) after a purchase of the same user."""
    rows = events(spark, sf_dir)
    buys = rows.where("event_type = 'purchase'").select("user_id", F.col("t").alias("s"), F.lit(1).alias("one"))
    seen = intervals.last_before(rows.where("event_type != 'purchase'"), buys, ["user_id"], "t", "event_id", "s", "one")
    return seen.where(F.col("s").isNull() | (F.col("t") >= F.col("s") + 36000.6)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("accumulate_until_marker", f"""WITH {EV}
SELECT user_id, run, count(*) AS n, round(sum(value), 4) AS total, bool_or(event_type = 'purchase') AS closed FROM
(SELECT *, (sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) - (event_type = 'purchase')::INT)::BIGINT AS run FROM ev) GROUP BY user_id, run""")
def accumulate_until_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events gathered until one of the marking type, which ends the turn."""
    mark = (F.col("event_type") == "purchase").cast("int")
    run = F.sum(mark).over(Window.partitionBy("user_id").orderBy("t", "event_id")) - mark
    return events(spark, sf_dir).withColumn("run", run.cast("bigint")).groupBy("user_id", "run").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.bool_or(F.col("event_type") == "purchase").alias("closed"))


@query("interval_clip_accounting", f"""WITH {SPANS}, ends AS (SELECT max(t) - 3600 AS stop FROM ev)
SELECT event_type, count(*) FILTER (WHERE s < stop) AS placed, count(*) FILTER (WHERE s < stop AND e > stop) AS clipped, count(*) FILTER (WHERE s >= stop) AS beyond, round(sum(greatest(0, least(e, stop) - s)), 3) AS kept FROM spans, ends GROUP BY event_type""")
def interval_clip_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the intervals lies before the end of the recording."""
    rows = spans(spark, sf_dir)
    stop = rows.agg((F.max("t") - 3600).alias("stop"))
    s, e, end = F.col("s"), F.col("e"), F.col("stop")
    return rows.crossJoin(F.broadcast(stop)).groupBy("event_type").agg(  # one row
        F.count_if(s < end).alias("placed"), F.count_if((s < end) & (e > end)).alias("clipped"), F.count_if(s >= end).alias("beyond"), F.round(F.sum(F.greatest(F.lit(0.0), F.least(e, end) - s)), 3).alias("kept"))


@query("latest_sequence_wins", f"""WITH {EV}, numbered AS (SELECT *, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS seq FROM ev)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE seq < before) AS n_stale FROM (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM numbered) GROUP BY user_id""")
def latest_sequence_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose sequence number a later one has overtaken are stale."""
    rows = events(spark, sf_dir).withColumn("seq", F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)))
    before = F.max("seq").over(Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("seq") < F.col("before")).alias("n_stale"))


@query("silence_ticks", f"""WITH {EV}, gaps AS (SELECT user_id, event_id, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - t AS gap FROM ev)
SELECT event_id, least(12, floor((coalesce(gap, 1e9) - 0.6) / 1800))::BIGINT AS ticks FROM gaps WHERE coalesce(gap, 1e9) >= 1800.6""")
def silence_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ticks of silence follow an event before the next, twelve at most."""
    gap = F.coalesce(F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")) - F.col("t"), F.lit(1e9))
    rows = events(spark, sf_dir).withColumn("gap", gap).where("gap >= 1800.6")
    return rows.select("event_id", F.least(F.lit(12), F.floor((F.col("gap") - 0.6) / 1800)).cast("bigint").alias("ticks"))
