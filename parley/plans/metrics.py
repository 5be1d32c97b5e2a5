"""Turn-taking metrics over users' pieces and the speech of scripted policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, timing
from ..operators import pieces as P
from ..operators import simulator
from .conversations import PIECES, USER, conversations, draw, seconds, user_pieces
from .registry import query

CHAT, LEN = draw("'chat'", "conv_id", "turn", "piece"), draw("'len'", "conv_id", "turn", "piece")
#: Scenarios (a user's turn each) and the segments that two policies speak in them: one after turn ends only, one after some pieces.
SPEECH = f"""{USER},
scen AS (SELECT conv_id, turn, count(*) AS n_pieces, min(t_end) AS pause, max(t_end) AS done FROM users GROUP BY conv_id, turn),
seg AS (SELECT conv_id, turn, 'patient' AS policy, t_end + 0.2 AS s, t_end + 0.2 + 8 / 3.25 AS e, 8 AS words FROM users WHERE ends_turn
  UNION ALL SELECT conv_id, turn, 'chatty', t_end + 0.3, t_end + 0.3 + {seconds(f"({LEN} % 6 + 1)")}, {LEN} % 6 + 1 FROM users WHERE {CHAT} % 4 = 0),
pol AS (SELECT 'patient' AS policy UNION ALL SELECT 'chatty'),
tor AS (SELECT p.policy, s.*, count(g.s) FILTER (WHERE g.s >= s.pause - 1e-9) AS n_late, min(g.s) FILTER (WHERE g.s >= s.pause - 1e-9) AS s_late, max(g.e) FILTER (WHERE g.s >= s.pause - 1e-9) AS e_late, sum(g.words) FILTER (WHERE g.s >= s.pause - 1e-9) AS w_late,
  count(g.s) FILTER (WHERE g.s >= s.done - 1e-9) AS n_done, min(g.s) FILTER (WHERE g.s >= s.done - 1e-9) AS s_done, max(g.e) FILTER (WHERE g.s >= s.done - 1e-9) AS e_done, sum(g.words) FILTER (WHERE g.s >= s.done - 1e-9) AS w_done,
  coalesce(bool_or(g.e - g.s > 3 OR g.words > 3), false) AS loud, count(g.s) FILTER (WHERE g.e - g.s <= 3 AND g.words <= 3) AS n_back
  FROM scen s CROSS JOIN pol p LEFT JOIN seg g ON g.conv_id = s.conv_id AND g.turn = s.turn AND g.policy = p.policy GROUP BY ALL)"""


def sql_tor(x: str) -> str:
    return f"(CASE WHEN n_{x} = 0 THEN 0 WHEN e_{x} - s_{x} < 1.0 THEN (w_{x} > 3)::INT ELSE 1 END)"


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each policy and user's turn: when it pauses and ends, and what the policy says from there on."""
    users = user_pieces(spark, sf_dir)
    key = [F.col("conv_id"), F.col("turn"), F.col("piece")]
    said = P.replies(users, F.col("ends_turn"), F.lit(8), F.lit(0.2)).withColumn("policy", F.lit("patient")).unionByName(
        P.replies(users, hashing.draw(F.lit("chat"), *key) % 4 == 0, hashing.draw(F.lit("len"), *key) % 6 + 1, F.lit(0.3)).withColumn("policy", F.lit("chatty")))
    scen = users.groupBy("conv_id", "turn").agg(F.count("*").alias("n_pieces"), F.min("t_end").alias("pause"), F.max("t_end").alias("done"))
    both = scen.withColumn("policy", F.explode(F.array(F.lit("patient"), F.lit("chatty"))))
    late, done = F.col("start") >= F.col("pause") - 1e-9, F.col("start") >= F.col("done") - 1e-9
    cut = []
    for name, c in (("late", late), ("done", done)):
        cut += [F.count_if(c).alias(f"n_{name}"), F.min(F.when(c, F.col("start"))).alias(f"s_{name}"), F.max(F.when(c, F.col("end"))).alias(f"e_{name}"), F.sum(F.when(c, F.col("words"))).alias(f"w_{name}")]
    span = F.col("end") - F.col("start")
    return both.join(said.drop("piece"), ["policy", "conv_id", "turn"], "left").groupBy("policy", "conv_id", "turn", "n_pieces", "pause", "done").agg(
        *cut, F.coalesce(F.bool_or((span > 3) | (F.col("words") > 3)), F.lit(False)).alias("loud"), F.count_if((span <= 3) & (F.col("words") <= 3)).alias("n_back"))


def tor(x: str):
    return timing.takeover(F.col(f"n_{x}"), F.col(f"s_{x}"), F.col(f"e_{x}"), F.col(f"w_{x}"))


@query("pause_tor", f"WITH {SPEECH} SELECT policy, count(*) AS n, round(avg({sql_tor('late')}), 6) AS tor, round(stddev_samp({sql_tor('late')}) / sqrt(count(*)), 6) AS sem FROM tor WHERE n_pieces > 1 GROUP BY policy")
def pause_tor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a policy takes the floor once the user has paused."""
    rows = scenarios(spark, sf_dir).where("n_pieces > 1").withColumn("tor", tor("late"))
    return rows.groupBy("policy").agg(F.count("*").alias("n"), F.round(F.avg("tor"), 6).alias("tor"), F.round(timing.sem(F.col("tor")), 6).alias("sem"))


@query("smooth_tor", f"WITH {SPEECH} SELECT policy, count(*) AS n, round(avg({sql_tor('done')}), 6) AS tor, round(avg(CASE WHEN {sql_tor('done')} = 1 THEN greatest(0, s_done - done) END), 6) AS latency FROM tor GROUP BY policy")
def smooth_tor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a policy answers after the turn's end, and how late where it does."""
    rows = scenarios(spark, sf_dir).withColumn("tor", tor("done"))
    late = F.when(F.col("tor") == 1, F.greatest(F.lit(0.0), F.col("s_done") - F.col("done")))
    return rows.groupBy("policy").agg(F.count("*").alias("n"), F.round(F.avg("tor"), 6).alias("tor"), F.round(F.avg(late), 6).alias("latency"))


@query("backchannel_tor_freq", f"WITH {SPEECH} SELECT policy, count(*) AS n, round(avg(loud::INT), 6) AS tor, round(avg(n_back / done), 6) AS freq, round(avg((n_back = 0)::INT), 6) AS silent FROM tor GROUP BY policy")
def backchannel_tor_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a policy speaks at length while it should give signs only, and how many signs a second it gives."""
    return scenarios(spark, sf_dir).groupBy("policy").agg(F.count("*").alias("n"), F.round(F.avg(F.col("loud").cast("int")), 6).alias("tor"), F.round(F.avg(F.col("n_back") / F.col("done")), 6).alias("freq"), F.round(F.avg((F.col("n_back") == 0).cast("int")), 6).alias("silent"))


BARGE = draw("'stop'", "conv_id", "turn") + " % 5"


@query("interruption_tor", f"""WITH {SPEECH}, i AS (SELECT *, CASE WHEN {BARGE} = 0 THEN NULL ELSE done END AS over FROM tor)
SELECT policy, count(*) AS n, round(avg(CASE WHEN over IS NULL THEN 0 ELSE {sql_tor('done')} END), 6) AS tor, round(avg(nullif(CASE WHEN over IS NOT NULL AND {sql_tor('done')} = 1 THEN s_done - over ELSE 0 END, 0)), 6) AS latency FROM i GROUP BY policy""")
def interruption_tor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a policy answers an interruption; those that were never scored count as not answered, latencies of zero don't count."""
    over = F.when(hashing.draw(F.lit("stop"), F.col("conv_id"), F.col("turn")) % 5 != 0, F.col("done"))
    rows = scenarios(spark, sf_dir).withColumn("over", over).withColumn("tor", F.when(F.col("over").isNull(), 0).otherwise(tor("done")))
    late = F.when(F.col("tor") == 1, F.col("s_done") - F.col("over")).otherwise(F.lit(0.0))
    return rows.groupBy("policy").agg(F.count("*").alias("n"), F.round(F.avg("tor"), 6).alias("tor"), F.round(F.avg(F.nullif(late, F.lit(0.0))), 6).alias("latency"))


def ata(pause_a, pause_b, smooth, interruption):
    """Averaged turn-taking accuracy: pauses count by what wasn't taken; under half of the smooth turns it is 0; a missing interruption rate counts as 0."""
    whole = ((1 - pause_a) + (1 - pause_b) + smooth + F.coalesce(interruption, F.lit(0.0))) / 4
    return F.when(smooth < 0.5, F.lit(0.0)).otherwise(whole)


@query("ata_wide_row", f"""WITH {SPEECH}, w AS (SELECT policy, avg({sql_tor('late')}) FILTER (WHERE conv_id % 2 = 0 AND n_pieces > 1) AS pause_a, avg({sql_tor('late')}) FILTER (WHERE conv_id % 2 = 1 AND n_pieces > 1) AS pause_b, avg({sql_tor('done')}) AS smooth, avg({sql_tor('done')}) FILTER (WHERE {BARGE} <> 0) AS interruption FROM tor GROUP BY policy)
SELECT policy, round(pause_a, 6) AS pause_a, round(pause_b, 6) AS pause_b, round(smooth, 6) AS smooth, round(interruption, 6) AS interruption, round(CASE WHEN smooth < 0.5 THEN 0 ELSE (1 - pause_a + 1 - pause_b + smooth + coalesce(interruption, 0)) / 4 END, 6) AS ata FROM w""")
def ata_wide_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenarios(spark, sf_dir).withColumn("late", tor("late")).withColumn("smooth", tor("done"))
    paused = F.col("n_pieces") > 1
    wide = rows.groupBy("policy").agg(
        F.avg(F.when(paused & (F.col("conv_id") % 2 == 0), F.col("late"))).alias("pause_a"), F.avg(F.when(paused & (F.col("conv_id") % 2 == 1), F.col("late"))).alias("pause_b"), F.avg("smooth").alias("smooth"),
        F.avg(F.when(hashing.draw(F.lit("stop"), F.col("conv_id"), F.col("turn")) % 5 != 0, F.col("smooth"))).alias("interruption"))
    return wide.withColumn("ata", ata(*[F.col(c) for c in ("pause_a", "pause_b", "smooth", "interruption")])).select("policy", *[F.round(c, 6).alias(c) for c in ("pause_a", "pause_b", "smooth", "interruption", "ata")])


@query("official_vs_port_backchannel", f"""WITH {SPEECH}, ranked AS (SELECT *, row_number() OVER (PARTITION BY policy, conv_id, turn ORDER BY s DESC) AS r FROM seg)
SELECT policy, count(*) AS n, round(avg("any"::INT), 6) AS any_rule, round(avg(last_::INT), 6) AS last_rule, count(*) FILTER (WHERE "any" <> last_) AS differ
FROM (SELECT policy, conv_id, turn, bool_or(e - s > 3 OR words > 3) AS "any", bool_or(r = 1 AND (e - s >= 1 OR words > 3)) AS last_ FROM ranked GROUP BY ALL) GROUP BY policy""")
def official_vs_port_backchannel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules for a sign that was too long: any segment over 3 s or 3 words; or the last segment alone, from 1 s on."""
    users = user_pieces(spark, sf_dir)
    key = [F.col("conv_id"), F.col("turn"), F.col("piece")]
    seg = P.replies(users, F.col("ends_turn"), F.lit(8), F.lit(0.2)).withColumn("policy", F.lit("patient")).unionByName(
        P.replies(users, hashing.draw(F.lit("chat"), *key) % 4 == 0, hashing.draw(F.lit("len"), *key) % 6 + 1, F.lit(0.3)).withColumn("policy", F.lit("chatty")))
    span = F.col("end") - F.col("start")
    each = seg.groupBy("policy", "conv_id", "turn").agg(F.bool_or((span > 3) | (F.col("words") > 3)).alias("any"), F.max_by((span >= 1) | (F.col("words") > 3), "start").alias("last"))
    return each.groupBy("policy").agg(F.count("*").alias("n"), F.round(F.avg(F.col("any").cast("int")), 6).alias("any_rule"), F.round(F.avg(F.col("last").cast("int")), 6).alias("last_rule"), F.count_if(F.col("any") != F.col("last")).alias("differ"))


@query("decision_accuracy", f"""WITH {PIECES}, d AS (SELECT *, {draw("'tag'", "conv_id", "turn", "piece")} % 4 = 0 OR (ends_turn AND piece > 2) AS fin, n_words = 1 AS quiet FROM pieces WHERE role = 'user'),
c AS (SELECT count(*) FILTER (WHERE fin AND ends_turn) AS tp, count(*) FILTER (WHERE fin AND NOT ends_turn) AS fp, count(*) FILTER (WHERE NOT fin AND ends_turn) AS fn, count(*) FILTER (WHERE NOT fin AND NOT ends_turn) AS tn, avg((NOT fin)::INT) FILTER (WHERE quiet AND NOT ends_turn) AS kept, conv_id % 3 AS grp FROM d GROUP BY grp)
SELECT grp, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(kept, 6) AS pause_kept FROM c""")
def decision_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions to take the floor held against turn ends; short pieces within a turn apart."""
    rows = P.pieces(conversations(spark, sf_dir)).where("role = 'user'")
    fin = (hashing.draw(F.lit("tag"), F.col("conv_id"), F.col("turn"), F.col("piece")) % 4 == 0) | (F.col("ends_turn") & (F.col("piece") > 2))
    rows = rows.withColumn("fin", fin).withColumn("grp", F.col("conv_id") % 3)
    f, e = F.col("fin"), F.col("ends_turn")
    c = rows.groupBy("grp").agg(F.count_if(f & e).alias("tp"), F.count_if(f & ~e).alias("fp"), F.count_if(~f & e).alias("fn"), F.count_if(~f & ~e).alias("tn"), F.avg(F.when((F.col("n_words") == 1) & ~e, (~f).cast("int"))).alias("kept"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select("grp", "tp", "fp", "fn", "tn", F.round((F.col("tp") + F.col("tn")) / n, 6).alias("accuracy"), F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"), F.round("kept", 6).alias("pause_kept"))


@query("invitation_rates", f"""WITH {PIECES}, d AS (SELECT *, {draw("'tag'", "conv_id", "turn", "piece")} % 3 = 0 AS takes FROM pieces WHERE role = 'user')
SELECT conv_id % 4 AS grp, count(DISTINCT conv_id || ':' || turn) AS n_scenarios, round(avg(takes::INT) FILTER (WHERE ends_turn), 6) AS at_end, round(avg(takes::INT) FILTER (WHERE NOT ends_turn), 6) AS within, round(count(*) FILTER (WHERE takes) / count(DISTINCT conv_id || ':' || turn), 6) AS invites FROM d GROUP BY grp""")
def invitation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = hashing.draw(F.lit("tag"), F.col("conv_id"), F.col("turn"), F.col("piece")) % 3 == 0
    each = P.pieces(conversations(spark, sf_dir)).where("role = 'user'").withColumn("takes", takes).groupBy("conv_id", "turn").agg(  # a scenario is its turn, so no distinct count is needed
        F.count_if("takes").alias("taken"), F.count_if(F.col("takes") & F.col("ends_turn")).alias("end_taken"), F.count_if("ends_turn").alias("ends"), F.count("*").alias("n"))
    s = lambda c: F.sum(c)
    return each.groupBy((F.col("conv_id") % 4).alias("grp")).agg(
        F.count("*").alias("n_scenarios"), F.round(F.try_divide(s("end_taken"), s("ends")), 6).alias("at_end"),
        F.round(F.try_divide(s("taken") - s("end_taken"), s("n") - s("ends")), 6).alias("within"), F.round(s("taken") / F.count("*"), 6).alias("invites"))


SPACED = f"""{USER}, laid AS (SELECT conv_id, turn, piece, ends_turn, turn * 6.0::DOUBLE + t_start AS t_start, turn * 6.0::DOUBLE + t_end AS t_end FROM users),
ordered AS (SELECT *, lead(t_start) OVER (PARTITION BY conv_id ORDER BY t_start, turn, piece) AS after FROM laid)"""


@query("simulator_grouped_map", f"""WITH {SPACED}
SELECT conv_id, turn, round(t_end + 0.2, 6) AS start, round(least(t_end + 0.2 + 20 / 3.25, coalesce(after, 1e9)), 6) AS "end", coalesce(after < t_end + 0.2 + 20 / 3.25, false) AS stopped
FROM ordered WHERE ends_turn AND coalesce(after, 1e9) > t_end + 0.2""")
def simulator_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simulator with a policy that answers at turn ends; its SQL is the closed form."""
    laid = user_pieces(spark, sf_dir).withColumn("t_start", F.col("turn") * 6.0 + F.col("t_start")).withColumn("t_end", F.col("turn") * 6.0 + F.col("t_end"))
    out = simulator.simulate(laid, simulator.after_turn)
    return out.select("conv_id", "turn", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "stopped")
