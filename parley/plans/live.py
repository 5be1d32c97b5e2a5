"""Evaluations of recorded speech, and the rules that a live session follows, over batches that stand for its stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import pieces as P
from .conversations import PIECES, USER, conversations, draw, user_pieces, ws
from .events import EV, events
from .metrics import BARGE, SPEECH
from .registry import query, table

#: A span that takes the floor by its length alone, in seconds; else it needs more words than these.
SPAN, WORDS = 1.0, 3


def segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scenarios (a user's turn each) and what two policies say in them."""
    users = user_pieces(spark, sf_dir)
    key = [F.col("conv_id"), F.col("turn"), F.col("piece")]
    said = P.replies(users, F.col("ends_turn"), F.lit(8), F.lit(0.2)).withColumn("policy", F.lit("patient")).unionByName(
        P.replies(users, hashing.draw(F.lit("chat"), *key) % 4 == 0, hashing.draw(F.lit("len"), *key) % 6 + 1, F.lit(0.3)).withColumn("policy", F.lit("chatty")))
    scen = users.groupBy("conv_id", "turn").agg(F.count("*").alias("n_pieces"), F.max("t_end").alias("done"))
    return scen.withColumn("policy", F.explode(F.array(F.lit("patient"), F.lit("chatty")))), said


@query("official_evaluators", f"""WITH {SPEECH}, c AS (SELECT p.policy, s.conv_id, s.turn, s.n_pieces, s.done, count(g.s) AS n, min(g.s) AS first, max(g.e) AS last, coalesce(sum(g.words), 0) AS words FROM scen s CROSS JOIN pol p LEFT JOIN seg g ON g.conv_id = s.conv_id AND g.turn = s.turn AND g.policy = p.policy GROUP BY ALL),
o AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN last - first < {SPAN} AND words <= {WORDS} THEN 0 ELSE 1 END AS tor, greatest(0, first - done) AS late FROM c),
t AS (SELECT *, unnest(list_filter([CASE WHEN n_pieces > 1 THEN 'pause' END, 'smooth', CASE WHEN {BARGE} <> 0 THEN 'interruption' END], lambda x: x IS NOT NULL)) AS task FROM o)
SELECT policy, task, count(*) AS n, round(avg(tor), 6) AS tor, round(avg(late) FILTER (WHERE tor = 1 AND task <> 'pause'), 6) AS latency FROM t GROUP BY policy, task""")
def official_evaluators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published evaluators of pauses, smooth turns and interruptions: all that was said in a recording counts, and an answer before the turn's end has no latency."""
    scen, said = segments(spark, sf_dir)
    c = scen.join(said, ["policy", "conv_id", "turn"], "left").groupBy("policy", "conv_id", "turn", "n_pieces", "done").agg(F.count("start").alias("n"), F.min("start").alias("first"), F.max("end").alias("last"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    tor = F.when((F.col("n") == 0) | ((F.col("last") - F.col("first") < SPAN) & (F.col("words") <= WORDS)), 0).otherwise(1)
    tasks = F.array_compact(F.array(F.when(F.col("n_pieces") > 1, "pause"), F.lit("smooth"), F.when(hashing.draw(F.lit("stop"), F.col("conv_id"), F.col("turn")) % 5 != 0, "interruption")))
    rows = c.select("policy", F.explode(tasks).alias("task"), tor.alias("tor"), F.greatest(F.lit(0.0), F.col("first") - F.col("done")).alias("late"))
    return rows.groupBy("policy", "task").agg(F.count("*").alias("n"), F.round(F.avg("tor"), 6).alias("tor"), F.round(F.avg(F.when((F.col("tor") == 1) & (F.col("task") != "pause"), F.col("late"))), 6).alias("latency"))


#: Rates of finished runs: two kinds of pauses, smooth turns, interruptions, backchannels; null where a task wasn't run.
RUNS = [(1, 0.1, 0.2, 0.9, 0.95, 0.3), (2, 1.0, 1.0, 0.4, 1.0, 0.0), (3, 0.0, 0.0, 0.5, None, None), (4, None, 0.1, 0.8, 0.9, 0.2), (5, 0.25, 0.5, 1.0, 0.75, 0.1)]
RUNS_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) for x in r) + ")" for r in RUNS) + ") r(run, pause_a, pause_b, smooth, interruption, backchannel)"


def ata_forms(pause_a: Column, pause_b: Column, smooth: Column, interruption: Column, backchannel: Column) -> dict[str, Column]:
    """Averaged turn-taking accuracy as audio runs report it (the smooth rate itself under a half), as published (five terms), and raw. A missing rate leaves a form null."""
    four = 1 - pause_a + 1 - pause_b + smooth + interruption
    return {"audio": F.when(four.isNotNull(), F.when(smooth < 0.5, smooth).otherwise(four / 4)), "paper": F.round((four + 1 - backchannel) / 5, 3), "raw": four / 4}


@query("ata_forms", f"""
SELECT run::BIGINT AS run, round(CASE WHEN four IS NOT NULL THEN CASE WHEN smooth < 0.5 THEN smooth ELSE four / 4 END END, 6) AS audio, round((four + 1 - backchannel) / 5, 3) AS paper, round(four / 4, 6) AS raw FROM (SELECT *, 1 - pause_a + 1 - pause_b + smooth + interruption AS four FROM {RUNS_SQL})""")
def ata_forms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(RUNS, "run bigint, pause_a double, pause_b double, smooth double, interruption double, backchannel double")
    forms = ata_forms(*[F.col(c) for c in ("pause_a", "pause_b", "smooth", "interruption", "backchannel")])
    return rows.select("run", F.round(forms["audio"], 6).alias("audio"), forms["paper"].alias("paper"), F.round(forms["raw"], 6).alias("raw"))


@query("audio_rollup", f"""WITH {SPEECH}, c AS (SELECT p.policy, s.conv_id, s.turn, s.done, g.s, least(g.e, s.done + 1.5) AS e, g.e AS natural_e, g.words FROM scen s CROSS JOIN pol p LEFT JOIN seg g ON g.conv_id = s.conv_id AND g.turn = s.turn AND g.policy = p.policy),
r AS (SELECT policy, conv_id, turn, done, coalesce(bool_or(e > s), false) AS spoke, coalesce(bool_or(e > s AND s < done), false) AS within, coalesce(bool_or(e > s AND (e - s >= {SPAN} OR words > {WORDS})), false) AS formal, min(s) FILTER (WHERE e > s) AS first, coalesce(sum(greatest(0, natural_e - greatest(e, s))), 0) AS clipped FROM c GROUP BY ALL)
SELECT policy, count(*) AS n, round(avg(spoke::INT), 4) AS spoke_rate, round(avg(within::INT), 4) AS within_rate, round(avg((spoke AND NOT within)::INT), 4) AS late_only_rate, round(coalesce(sum(first) FILTER (WHERE spoke), 0) / greatest(1, count(*) FILTER (WHERE spoke)), 3) AS first_speech, round(avg(formal::INT), 4) AS formal_rate, round(sum(clipped), 3) AS clipped_seconds, round(max(first), 6) AS latest_start FROM r GROUP BY policy""")
def audio_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings rolled up by what was heard: speech ends with the recording, 1.5 s after the user's turn; what began later is silent."""
    scen, said = segments(spark, sf_dir)
    cut = scen.join(said, ["policy", "conv_id", "turn"], "left").withColumn("natural", F.col("end")).withColumn("end", F.least("end", F.col("done") + 1.5))
    heard, span = F.col("end") > F.col("start"), F.col("end") - F.col("start")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    r = cut.groupBy("policy", "conv_id", "turn", "done").agg(
        some(heard).alias("spoke"), some(heard & (F.col("start") < F.col("done"))).alias("within"), some(heard & ((span >= SPAN) | (F.col("words") > WORDS))).alias("formal"), F.min(F.when(heard, F.col("start"))).alias("first"),
        F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("natural") - F.greatest("end", "start"))), F.lit(0.0)).alias("clipped"),
    )
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    return r.groupBy("policy").agg(
        F.count("*").alias("n"), rate(F.col("spoke")).alias("spoke_rate"), rate(F.col("within")).alias("within_rate"), rate(F.col("spoke") & ~F.col("within")).alias("late_only_rate"),
        F.round(F.coalesce(F.sum(F.when(F.col("spoke"), F.col("first"))), F.lit(0.0)) / F.greatest(F.lit(1), F.count_if("spoke")), 3).alias("first_speech"), rate(F.col("formal")).alias("formal_rate"), F.round(F.sum("clipped"), 3).alias("clipped_seconds"), F.round(F.max("first"), 6).alias("latest_start"),
    )


#: Limits of the read-out of a prompt candidate (fixed values).
LEAST_RECALL, MOST_ODD, MOST_EMPTY, LEAST_PRECISION = 0.05, 0.02, 0.5, 0.5


def verdict(errors: Column, recall: Column, odd: Column, empty: Column, precision: Column) -> Column:
    """The first fault that a candidate shows, in order of gravity."""
    return F.when(errors > 0, "BROKEN").when(F.coalesce(recall, F.lit(0.0)) <= LEAST_RECALL, "NO-TAGS").when(F.coalesce(odd, F.lit(0.0)) > MOST_ODD, "DEGENERATE").when(F.coalesce(empty, F.lit(1.0)) > MOST_EMPTY, "NO-SPEECH").when(precision < LEAST_PRECISION, "OVER-EAGER").otherwise("OK")


@query("prompt_verdicts", f"""WITH {PIECES}, d AS (SELECT conv_id % 20 AS prompt, ends_turn, CASE conv_id % 20 % 6 WHEN 1 THEN false WHEN 2 THEN ends_turn WHEN 3 THEN ends_turn WHEN 4 THEN {draw("'tag'", "conv_id", "turn", "piece")} % 2 = 0 ELSE ends_turn AND piece % 7 <> 3 END AS fin FROM pieces WHERE role = 'user'),
m AS (SELECT prompt, count(*) AS n, count(*) FILTER (WHERE fin AND ends_turn) / nullif(count(*) FILTER (WHERE ends_turn), 0) AS recall, count(*) FILTER (WHERE fin AND ends_turn) / nullif(count(*) FILTER (WHERE fin), 0) AS precision FROM d GROUP BY prompt),
a AS (SELECT conv_id % 20 AS prompt, avg((conv_id % 20 % 6 = 2 AND turn % 8 = 1)::INT) AS odd, avg((conv_id % 20 % 6 = 3 AND turn % 4 = 1)::INT) AS empty, count(*) FILTER (WHERE conv_id = 0) AS errors, avg(len({ws("text")})) AS words FROM conversations WHERE role = 'assistant' GROUP BY prompt)
SELECT m.prompt, n, errors, round(recall, 6) AS recall, round(precision, 6) AS precision, round(odd, 6) AS odd, round(empty, 6) AS empty, round(words, 6) AS words, CASE WHEN errors > 0 THEN 'BROKEN' WHEN coalesce(recall, 0) <= {LEAST_RECALL} THEN 'NO-TAGS' WHEN coalesce(odd, 0) > {MOST_ODD} THEN 'DEGENERATE' WHEN coalesce(empty, 1) > {MOST_EMPTY} THEN 'NO-SPEECH' WHEN precision < {LEAST_PRECISION} THEN 'OVER-EAGER' ELSE 'OK' END AS verdict
FROM m LEFT JOIN a ON a.prompt = m.prompt""")
def prompt_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide row for each prompt candidate: its decisions, the quality of what it says, its errors, and the verdict."""
    pieces = P.pieces(conversations(spark, sf_dir)).where("role = 'user'").withColumn("prompt", F.col("conv_id") % 20)
    kind, end = F.col("prompt") % 6, F.col("ends_turn")
    coin = hashing.draw(F.lit("tag"), F.col("conv_id"), F.col("turn"), F.col("piece")) % 2 == 0
    fin = F.when(kind == 1, F.lit(False)).when(kind.isin(2, 3), end).when(kind == 4, coin).otherwise(end & (F.col("piece") % 7 != 3))
    decided = pieces.withColumn("fin", fin).groupBy("prompt").agg(F.count("*").alias("n"), F.try_divide(F.count_if(F.col("fin") & end), F.count_if(end)).alias("recall"), F.try_divide(F.count_if(F.col("fin") & end), F.count_if("fin")).alias("precision"))
    said = conversations(spark, sf_dir).where("role = 'assistant'").withColumn("prompt", F.col("conv_id") % 20)
    share = lambda c: F.avg(c.cast("int"))
    content = said.groupBy("prompt").agg(share((kind == 2) & (F.col("turn") % 8 == 1)).alias("odd"), share((kind == 3) & (F.col("turn") % 4 == 1)).alias("empty"), F.count_if(F.col("conv_id") == 0).alias("errors"), F.avg(F.size(text.ws_words(F.col("text")))).alias("words"))
    wide = decided.join(content, "prompt", "left")
    told = verdict(F.col("errors"), F.col("recall"), F.col("odd"), F.col("empty"), F.col("precision"))
    return wide.select("prompt", "n", "errors", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "odd", "empty", "words")], told.alias("verdict"))


#: Echo floor: how much of it stays, how fast it falls while idle, its multiple that is loud, the least level, frames in a row.
KEEP, FALL, TIMES, LEVEL, FRAMES = 0.95, 0.99, 1.5, 30.0, 2


def echo_floor(frames: DataFrame, by: str, order: list[str], level: str, playing: str) -> DataFrame:
    """n_fired and floor of each key after its frames: the floor follows the level while the system plays and falls while it is idle; frames over the larger of LEVEL and TIMES the floor count, FRAMES in a row fire once and start anew."""
    gathered = frames.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(level).alias("level"), F.col(playing).alias("playing")))).alias("x"))
    start = F.struct(F.lit(0.0).alias("floor"), F.lit(0).alias("run"), F.lit(0).cast("bigint").alias("fired"))

    def step(a: Column, x: Column) -> Column:
        floor = F.when(x["playing"], KEEP * a["floor"] + (1 - KEEP) * x["level"]).otherwise(FALL * a["floor"])
        loud = x["playing"] & (x["level"] > F.greatest(F.lit(LEVEL), TIMES * floor))
        run = F.when(loud, a["run"] + 1).otherwise(0)
        return F.struct(floor.alias("floor"), F.when(run >= FRAMES, 0).otherwise(run).alias("run"), (a["fired"] + (run >= FRAMES).cast("bigint")).alias("fired"))

    return gathered.select(by, F.aggregate("x", start, step).alias("s")).select(by, F.col("s.fired").alias("n_fired"), F.col("s.floor").alias("floor"))


@query("echo_floor_barge_in", f"""WITH RECURSIVE {EV}, f AS (SELECT user_id, value, event_type <> 'view' AS playing, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev),
walk AS (SELECT user_id, 0::BIGINT AS i, 0.0::DOUBLE AS floor, 0 AS run, 0::BIGINT AS fired FROM (SELECT DISTINCT user_id FROM f) UNION ALL
  SELECT user_id, i, floor, CASE WHEN run >= {FRAMES} THEN 0 ELSE run END, fired + (run >= {FRAMES})::BIGINT FROM (SELECT user_id, i, floor, fired, CASE WHEN playing AND value > greatest({LEVEL}, {TIMES} * floor) THEN run + 1 ELSE 0 END AS run
    FROM (SELECT w.user_id, f.i, f.playing, f.value, w.fired, w.run, CASE WHEN f.playing THEN {KEEP} * w.floor + {1 - KEEP} * f.value ELSE {FALL} * w.floor END AS floor FROM walk w JOIN f ON f.user_id = w.user_id AND f.i = w.i + 1)))
SELECT user_id, arg_max(fired, i) AS n_fired, round(arg_max(floor, i), 6) AS floor FROM walk GROUP BY user_id""")
def echo_floor_barge_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("playing", F.col("event_type") != "view")
    return echo_floor(rows, "user_id", ["t", "event_id"], "value", "playing").select("user_id", "n_fired", F.round("floor", 6).alias("floor"))


#: Seconds between partial transcripts, and the longest utterance that is kept.
INTERVAL, LONGEST = 0.75, 25.0


@query("partial_triggers", f"""WITH RECURSIVE {USER}, f AS (SELECT conv_id, turn, 0 AS n, 0.0::DOUBLE AS at_ FROM users GROUP BY conv_id, turn UNION ALL
  SELECT f.conv_id, f.turn, f.n + 1, min(u.t_end) FROM f JOIN users u ON u.conv_id = f.conv_id AND u.turn = f.turn AND u.t_end - f.at_ >= {INTERVAL} - 1e-9 GROUP BY f.conv_id, f.turn, f.n)
SELECT conv_id, turn, max(n)::BIGINT AS n_partials, round(max(at_), 6) AS last FROM f GROUP BY conv_id, turn""")
def partial_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many partial transcripts an utterance asks for: one whenever INTERVAL has passed since the last as words come in."""
    gathered = user_pieces(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("t_end")).alias("x"))
    start = F.struct(F.lit(0.0).alias("last"), F.lit(0).cast("bigint").alias("n"))

    def step(a: Column, x: Column) -> Column:
        due = x - a["last"] >= INTERVAL - 1e-9
        return F.struct(F.when(due, x).otherwise(a["last"]).alias("last"), (a["n"] + due.cast("bigint")).alias("n"))

    return gathered.select("conv_id", "turn", F.aggregate("x", start, step).alias("s")).select("conv_id", "turn", F.col("s.n").alias("n_partials"), F.round("s.last", 6).alias("last"))


@query("utterance_trim", f"""WITH {USER}, z AS (SELECT *, max(t_end) OVER (PARTITION BY conv_id, turn) AS done FROM users)
SELECT conv_id, turn, count(*) AS n, count(*) FILTER (WHERE t_start >= done - {LONGEST} - 1e-9) AS n_kept, round(max(done), 6) AS seconds FROM z GROUP BY conv_id, turn""")
def utterance_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces within the last LONGEST seconds of an utterance: older ones go, whole."""
    own = user_pieces(spark, sf_dir).withColumn("done", F.max("t_end").over(Window.partitionBy("conv_id", "turn")))
    return own.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.count_if(F.col("t_start") >= F.col("done") - LONGEST - 1e-9).alias("n_kept"), F.round(F.max("done"), 6).alias("seconds"))


REVISED = draw("'revise'", "conv_id", "turn", "piece") + " % 5 - 2"


@query("revisions_never_retract", f"""WITH {PIECES}, h AS (SELECT conv_id, turn, piece, greatest(0, sum(n_words) OVER (PARTITION BY conv_id, turn ORDER BY piece) + {REVISED})::BIGINT AS heard FROM pieces WHERE role = 'user'),
d AS (SELECT *, coalesce(max(heard) OVER (PARTITION BY conv_id, turn ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given FROM h)
SELECT conv_id, turn, piece, heard, given, greatest(0, heard - given) AS n_new FROM d""")
def revisions_never_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revised transcripts deliver by place: words already given stay given, a shorter revision gives nothing."""
    order = Window.partitionBy("conv_id", "turn").orderBy("piece")
    shift = hashing.draw(F.lit("revise"), F.col("conv_id"), F.col("turn"), F.col("piece")) % 5 - 2
    heard = F.greatest(F.lit(0), F.sum("n_words").over(order) + shift).cast("bigint")
    rows = P.pieces(conversations(spark, sf_dir)).where("role = 'user'").select("conv_id", "turn", "piece", heard.alias("heard"))
    given = F.coalesce(F.max("heard").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("given", given).withColumn("n_new", F.greatest(F.lit(0), F.col("heard") - F.col("given")))


#: Events that a queue holds; seconds of a watchdog's tick and its ticks.
QUEUE, WATCH, TICKS = 5, 0.24, 2


@query("bounded_queue", f"""WITH {EV}, q AS (SELECT *, floor(t / 43200)::BIGINT AS slot FROM ev)
SELECT user_id, slot, least({QUEUE}, count(*)) AS n_kept, greatest(0, count(*) - {QUEUE}) AS n_dropped, min(event_id) FILTER (WHERE r <= {QUEUE}) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY t DESC, event_id DESC) AS r FROM q) GROUP BY user_id, slot""")
def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue that drops its oldest when it is full: what is left of half a day's events, and how many were dropped."""
    rows = events(spark, sf_dir).withColumn("slot", F.floor(F.col("t") / 43200).cast("bigint"))
    r = F.row_number().over(Window.partitionBy("user_id", "slot").orderBy(F.desc("t"), F.desc("event_id")))
    each = rows.withColumn("r", r).groupBy("user_id", "slot")
    return each.agg(F.least(F.lit(QUEUE), F.count("*")).alias("n_kept"), F.greatest(F.lit(0), F.count("*") - QUEUE).alias("n_dropped"), F.min(F.when(F.col("r") <= QUEUE, F.col("event_id"))).alias("oldest"))


@query("deferred_final_watchdog", f"""WITH {USER}, f AS (SELECT conv_id, turn, piece, t_end, lead(t_start + ({draw("'gap'", "conv_id", "turn", "piece")} % 4) * 0.2) OVER (PARTITION BY conv_id, turn ORDER BY piece) - t_end AS wait FROM users)
SELECT conv_id, turn, piece, CASE WHEN wait < {WATCH * TICKS} THEN 'joined' ELSE 'forced' END AS how, least({TICKS}, floor(coalesce(wait, 1e9) / {WATCH} + 1e-9))::BIGINT AS ticks FROM f""")
def deferred_final_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A final that is held back waits some ticks for more words: these join it, or it is forced out after the last tick."""
    own = user_pieces(spark, sf_dir)
    begins = F.col("t_start") + hashing.draw(F.lit("gap"), F.col("conv_id"), F.col("turn"), F.col("piece")) % 4 * 0.2
    wait = F.lead(begins).over(P.turn_order()) - F.col("t_end")
    rows = own.withColumn("wait", wait)
    return rows.select("conv_id", "turn", "piece", F.when(F.col("wait") < WATCH * TICKS, "joined").otherwise("forced").alias("how"), F.least(F.lit(TICKS), F.floor(F.coalesce("wait", F.lit(1e9)) / WATCH + 1e-9)).cast("bigint").alias("ticks"))


@query("busy_reactions", f"""WITH {USER}, said AS (SELECT conv_id, turn, t_end + 0.1 AS s, t_end + 0.1 + 12 / 3.25 AS e FROM users WHERE {draw("'chat'", "conv_id", "turn", "piece")} % 4 = 0)
SELECT kind, count(*) AS n, round(sum(heard), 6) AS heard_seconds FROM (SELECT u.conv_id, u.turn, u.piece, CASE WHEN max(a.s) IS NULL THEN 'free' WHEN u.n_words <= 2 THEN 'backchannel' ELSE 'barge_in' END AS kind, coalesce(u.t_end - max(a.s), 0) AS heard
  FROM users u LEFT JOIN said a ON a.conv_id = u.conv_id AND a.turn = u.turn AND a.s <= u.t_end AND u.t_end < a.e GROUP BY u.conv_id, u.turn, u.piece, u.n_words, u.t_end) GROUP BY kind""")
def busy_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes in while the system speaks: up to two words are a sign, more stop it, after as many seconds as were heard."""
    own = user_pieces(spark, sf_dir)
    speaks = hashing.draw(F.lit("chat"), F.col("conv_id"), F.col("turn"), F.col("piece")) % 4 == 0
    said = P.replies(own, speaks, F.lit(12), F.lit(0.1)).groupBy("conv_id", "turn").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = own.join(said, ["conv_id", "turn"], "left")
    began = F.array_max(F.transform(F.filter("spans", lambda x: (x["start"] <= F.col("t_end")) & (F.col("t_end") < x["end"])), lambda x: x["start"]))
    rows = rows.withColumn("began", began)
    kind = F.when(F.col("began").isNull(), "free").when(F.col("n_words") <= 2, "backchannel").otherwise("barge_in")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce(F.col("t_end") - F.col("began"), F.lit(0.0))), 6).alias("heard_seconds"))


@query("words_in_spans", f"""WITH {USER}, spans AS (SELECT conv_id, turn, piece, t_start AS s, t_start + (t_end - t_start) * 0.7 AS e FROM users), w AS (SELECT conv_id, turn, piece, unnest(range(n_words)) AS k, n_words, t_start, t_end FROM users),
m AS (SELECT conv_id, turn, piece, t_start + (t_end - t_start) * (k + 0.5) / n_words AS mid FROM w)
SELECT s.conv_id, s.turn, s.piece, count(m.mid) AS n FROM spans s LEFT JOIN m ON m.conv_id = s.conv_id AND m.turn = s.turn AND m.mid >= s.s AND m.mid < s.e GROUP BY ALL""")
def words_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose middle lies in a span of speech."""
    own = user_pieces(spark, sf_dir)
    spans = own.select("conv_id", "turn", "piece", F.col("t_start").alias("s"), (F.col("t_start") + (F.col("t_end") - F.col("t_start")) * 0.7).alias("e"))
    k = F.explode(F.sequence(F.lit(0), (F.col("n_words") - 1).cast("int")))
    words = own.select("conv_id", "turn", "t_start", "t_end", "n_words", k.alias("k")).select("conv_id", "turn", (F.col("t_start") + (F.col("t_end") - F.col("t_start")) * (F.col("k") + 0.5) / F.col("n_words")).alias("mid"))
    met = spans.join(words, ["conv_id", "turn"]).where((F.col("mid") >= F.col("s")) & (F.col("mid") < F.col("e"))).groupBy("conv_id", "turn", "piece").agg(F.count("*").alias("n"))
    return spans.select("conv_id", "turn", "piece").join(met, ["conv_id", "turn", "piece"], "left").select("conv_id", "turn", "piece", F.coalesce("n", F.lit(0)).alias("n"))


CHANGED = f"CASE WHEN {draw(chr(39) + 'edit' + chr(39), 'conv_id', 'turn')} % 5 = 0 THEN text || ' edited' ELSE text END"


@query("cache_if_source_equal", f"""WITH now_ AS (SELECT conv_id, turn, text FROM conversations), cache AS (SELECT conv_id, turn, {CHANGED} AS source, 'done: ' || text AS done FROM conversations WHERE turn % 3 <> 1)
SELECT n.conv_id, n.turn, c.done IS NOT NULL AS known, md5(coalesce(c.done, n.text)) AS result FROM now_ n LEFT JOIN cache c ON c.conv_id = n.conv_id AND c.turn = n.turn AND c.source = n.text""")
def cache_if_source_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was done before is taken over by segment number only while its source text is still the same."""
    rows = conversations(spark, sf_dir)
    cache = rows.where("turn % 3 != 1").select("conv_id", "turn", F.expr(CHANGED.replace("('0x' || substr(", "conv(substr(").replace(", 1, 8))::BIGINT", ", 1, 8), 16, 10)")).alias("source"), F.concat(F.lit("done: "), "text").alias("done"))
    met = rows.join(cache, ["conv_id", "turn"], "left").withColumn("done", F.when(F.col("source") == F.col("text"), F.col("done")))
    return met.select("conv_id", "turn", F.col("done").isNotNull().alias("known"), F.md5(F.coalesce("done", "text")).alias("result"))


@query("front_truncation", f"""WITH t AS (SELECT conv_id, turn, len({ws("text")}) AS n FROM conversations), c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS before, sum(n) OVER (PARTITION BY conv_id) AS total FROM t)
SELECT conv_id, max(total)::BIGINT AS n_words, count(*) FILTER (WHERE before >= greatest(0, total - 256)) AS n_kept, coalesce(sum(n) FILTER (WHERE before >= greatest(0, total - 256)), 0)::BIGINT AS words_kept, min(turn) FILTER (WHERE before >= greatest(0, total - 256)) AS first_turn FROM c GROUP BY conv_id""")
def front_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation cut to 256 words from the front, whole turns only: it begins with the first turn that starts at or after the cut."""
    rows = conversations(spark, sf_dir).select("conv_id", "turn", F.size(text.ws_words(F.col("text"))).alias("n"))
    by = Window.partitionBy("conv_id")
    rows = rows.withColumn("before", F.sum("n").over(by.orderBy("turn")) - F.col("n")).withColumn("total", F.sum("n").over(by))
    kept = F.col("before") >= F.greatest(F.lit(0), F.col("total") - 256)
    return rows.groupBy("conv_id").agg(F.max("total").alias("n_words"), F.count_if(kept).alias("n_kept"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("words_kept"), F.min(F.when(kept, F.col("turn"))).alias("first_turn"))


@query("class_quota_sample", f"""WITH s AS (SELECT d.doc_id, d.lang, l.toxic FROM documents d JOIN labels l USING (doc_id)), q AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY {draw("'class'", "doc_id")}, doc_id) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM s),
k AS (SELECT * FROM q WHERE r <= CASE WHEN toxic = 1 THEN 60 ELSE greatest(1, n // 10) END)
SELECT doc_id, lang, toxic FROM (SELECT *, row_number() OVER (ORDER BY {draw("'all'", "doc_id")}, doc_id) AS place FROM k) WHERE place <= 100""")
def class_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample by class quotas (60 toxic ones, a tenth of the others), then at most 100 of all in the order of a hash: quota and cap are the feature."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    size = rows.groupBy("toxic").agg(F.count("*").alias("n"))  # a row a class
    h = hashing.draw(F.lit("class"), F.col("doc_id"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("toxic").orderBy(h, "doc_id"))).join(F.broadcast(size), "toxic")
    kept = ranked.where(F.col("r") <= F.when(F.col("toxic") == 1, 60).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") / 10))))
    return kept.orderBy(hashing.draw(F.lit("all"), F.col("doc_id")), "doc_id").limit(100).select("doc_id", "lang", "toxic")
