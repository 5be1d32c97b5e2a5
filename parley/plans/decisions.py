"""Decision rows of dialogues with their hard negatives, and rows of recorded traces labelled by annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import pieces as P
from .conversations import PIECES, USER, conversations, draw, user_pieces, ws
from .registry import query

#: Shares of pieces or turns that a family is drawn for (fixed values).
SHARES = {
    "finalized_mid_turn": 0.5, "partial_punctuation_negative": 0.55, "sentence_final_mid_turn": 0.35, "premature_final_partial": 0.9, "vad_final_pause": 0.1, "vad_tail": 0.5, "pause_mid_turn": 0.18, "system_backchannel": 0.012,
    "silence_after_final": 0.65, "interrupt": 0.28, "backchannel_during_system": 0.5, "silence_after_system": 0.45,
}
#: The least words of an answer that is interrupted, and a listener's sign.
LEAST_ANSWER, SIGN = 6, "uhum"
WAIT, TAKE, STOP, THINK, BACK, SAY = "user_is_speaking", "user_finish_speaking", "user_interruption", "user_is_thinking", "user_backchannel", "system_backchannel"
NONE = "no_tag"


def _drawn(family: str, *key: str) -> str:
    return f"{draw(chr(39) + family + chr(39), *key)} < {int(SHARES[family] * 2**32)}"


_PIECE, _TURN = ("conv_id", "turn", "piece"), ("conv_id", "turn")
_ROW = "SELECT '{f}' AS family, {label} AS label, {t} AS text, {kind} AS kind, {ends} AS ends, {busy} AS busy FROM {of} WHERE {where}"


def _family(f: str, label: str, t: str, kind: str, ends: str, of: str, where: str, busy: str = "false") -> str:
    return _ROW.format(f=f, label=label, t=t, kind=f"'{kind}'", ends=ends, busy=busy, of=of, where=where)


FAMILIES_SQL = f"""WITH {PIECES}, np AS (SELECT conv_id, turn, count(*) AS c, string_agg(text, ' ' ORDER BY piece) AS whole FROM pieces GROUP BY conv_id, turn),
t AS (SELECT c.conv_id, c.turn, c.role, len({ws("c.text")}) AS n, np.c, np.whole, lead(role) OVER w AS next_role, lead(np.c) OVER w AS next_c FROM conversations c LEFT JOIN np ON np.conv_id = c.conv_id AND np.turn = c.turn WINDOW w AS (PARTITION BY c.conv_id ORDER BY c.turn)),
i AS (SELECT *, role = 'assistant' AND coalesce(next_role, '') = 'user' AND coalesce(next_c, 0) >= 2 AND n >= {LEAST_ANSWER} AND {_drawn("interrupt", *_TURN)} AS cut FROM t),
u AS (SELECT * FROM (SELECT *, coalesce(lag(cut) OVER w, false) AS pending, lead(cut) OVER w AS cut_next FROM i WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant' AND c > 0),
p AS (SELECT q.*, u.pending AND q.piece = 0 AS busy, regexp_matches(q.text, '[.!?…]$') AS closed, regexp_replace(q.text, '[.?!…,;:\\s]+$', '') AS bare, u.c FROM pieces q JOIN u ON u.conv_id = q.conv_id AND u.turn = q.turn),
rows AS ({" UNION ALL ".join([
    f"SELECT 'main' AS family, CASE WHEN busy THEN '{STOP}' WHEN ends_turn THEN '{TAKE}' ELSE '{WAIT}' END AS label, text, CASE WHEN ends_turn THEN 'final' ELSE 'partial' END AS kind, ends_turn AS ends, busy FROM p",
    _family("finalized_mid_turn", f"'{WAIT}'", "text", "final", "false", "p", f"NOT ends_turn AND NOT busy AND {_drawn('finalized_mid_turn', *_PIECE)}"),
    _family("partial_punctuation_negative", f"'{WAIT}'", "bare || '.'", "partial", "false", "p", f"NOT ends_turn AND NOT busy AND NOT closed AND bare <> '' AND {_drawn('partial_punctuation_negative', *_PIECE)}"),
    _family("sentence_final_mid_turn", f"'{WAIT}'", "text", "partial", "false", "p", f"NOT ends_turn AND NOT busy AND closed AND {_drawn('sentence_final_mid_turn', *_PIECE)}"),
    _family("premature_final_partial", f"'{WAIT}'", "text", "partial", "false", "p", f"ends_turn AND {_drawn('premature_final_partial', *_PIECE)}", "busy"),
    _family("final_without_punctuation", f"'{TAKE}'", "bare", "final", "true", "p", "ends_turn AND bare <> text", "busy"),
    _family("vad_final_pause", f"'{WAIT}'", f"CASE WHEN {_drawn('vad_tail', *_PIECE)} THEN '' ELSE text END", "final", "true", "p", f"NOT ends_turn AND NOT busy AND {_drawn('vad_final_pause', *_PIECE)}"),
    _family("vad_final_pause_silence", f"'{WAIT}'", "''", "silence", "false", "p", f"NOT ends_turn AND NOT busy AND {_drawn('vad_final_pause', *_PIECE)}"),
    _family("pause_mid_turn", f"'{WAIT}'", "''", "silence", "false", "p", f"NOT ends_turn AND (busy OR NOT {_drawn('vad_final_pause', *_PIECE)}) AND {_drawn('pause_mid_turn', *_PIECE)}"),
    _family("system_backchannel", f"'{SAY}'", "text", "partial", "false", "p", f"NOT ends_turn AND {_drawn('system_backchannel', *_PIECE)}", "busy"),
    _family("barge_in_final", f"'{STOP}'", "whole", "final", "true", "u", "pending", "true"),
    _family("empty_final", f"'{TAKE}'", "''", "final", "true", "u", "true"),
    _family("silence_after_final", f"'{TAKE}'", "''", "silence", "false", "u", _drawn("silence_after_final", *_TURN)),
    _family("silence_during_system", f"'{NONE}'", "''", "silence", "false", f"(SELECT *, unnest(range(1 + {draw(chr(39) + 'quiet' + chr(39), *_TURN)} % 2)) FROM u)", "cut_next", "true"),
    _family("backchannel_during_system", f"'{BACK}'", f"'{SIGN}'", "final", "closes", "(SELECT *, unnest([false, true]) AS closes FROM u)", f"cut_next AND {_drawn('backchannel_during_system', *_TURN)}", "true"),
    _family("silence_after_system", f"'{THINK}'", "''", "silence", "false", "u", f"NOT cut_next AND {_drawn('silence_after_system', *_TURN)}"),
])})
SELECT family, label, kind, ends, busy, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM rows GROUP BY ALL"""


def decision_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, family, label, text, kind, ends, busy: what a listener should decide at each event of a dialogue.

    Every answered user turn gives the events that it has, and for each family of hard negatives events of the same words
    in another shape. An answer may be interrupted by the turn that follows it, which then begins while the system
    speaks. All families come from one pass: a turn is cut in its own row, and what applies is exploded.
    """
    key = [F.col("conv_id"), F.col("turn")]
    order = Window.partitionBy("conv_id").orderBy("turn")
    own = turns.select("conv_id", "turn", "role", F.size(text.ws_words(F.col("text"))).alias("n"), P.cut_pieces(text.ws_words(F.col("text")), key).alias("p"))
    own = own.withColumn("c", F.coalesce(F.size("p"), F.lit(0))).withColumn("next_role", F.lead("role").over(order)).withColumn("next_c", F.lead("c").over(order))
    drawn = lambda family, *more: hashing.chance(SHARES[family], F.lit(family), *key, *more)
    cut = (F.col("role") == "assistant") & (F.coalesce("next_role", F.lit("")) == "user") & (F.coalesce("next_c", F.lit(0)) >= 2) & (F.col("n") >= LEAST_ANSWER) & drawn("interrupt")
    own = own.withColumn("cut", cut).withColumn("pending", F.coalesce(F.lag("cut").over(order), F.lit(False))).withColumn("cut_next", F.lead("cut").over(order))
    users = own.where("role = 'user' AND next_role = 'assistant' AND c > 0")

    def row(family: str, label: Column | str, t: Column, kind: Column | str, ends: Column, busy: Column, when: Column) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.when(when, F.struct(F.lit(family).alias("family"), lit(label).alias("label"), t.alias("text"), lit(kind).alias("kind"), ends.alias("ends"), busy.alias("busy")))

    no, yes, empty = F.lit(False), F.lit(True), F.lit("")
    t, end, piece = F.col("text"), F.col("ends_turn"), F.col("piece")
    each = users.select("conv_id", "turn", "pending", F.inline("p")).withColumn("busy", F.col("pending") & (piece == 0)).withColumn("bare", text.strip_terminal(t))
    busy, bare, closed = F.col("busy"), F.col("bare"), t.rlike("[.!?…]$")
    open_ = ~end & ~busy
    vad = drawn("vad_final_pause", piece)
    of_pieces = [
        row("main", F.when(busy, STOP).when(end, TAKE).otherwise(WAIT), t, F.when(end, "final").otherwise("partial"), end, busy, yes),
        row("finalized_mid_turn", WAIT, t, "final", no, no, open_ & drawn("finalized_mid_turn", piece)),
        row("partial_punctuation_negative", WAIT, text.add_punctuation(t), "partial", no, no, open_ & ~closed & (bare != "") & drawn("partial_punctuation_negative", piece)),
        row("sentence_final_mid_turn", WAIT, t, "partial", no, no, open_ & closed & drawn("sentence_final_mid_turn", piece)),
        row("premature_final_partial", WAIT, t, "partial", no, busy, end & drawn("premature_final_partial", piece)),
        row("final_without_punctuation", TAKE, bare, "final", yes, busy, end & (bare != t)),
        row("vad_final_pause", WAIT, F.when(drawn("vad_tail", piece), empty).otherwise(t), "final", yes, no, open_ & vad),
        row("vad_final_pause_silence", WAIT, empty, "silence", no, no, open_ & vad),
        row("pause_mid_turn", WAIT, empty, "silence", no, no, ~end & (busy | ~vad) & drawn("pause_mid_turn", piece)),
        row("system_backchannel", SAY, t, "partial", no, busy, ~end & drawn("system_backchannel", piece)),
    ]
    whole, cut_next, twice = F.array_join(F.transform("p", lambda x: x["text"]), " "), F.col("cut_next"), hashing.draw(F.lit("quiet"), *key) % 2 == 1
    sign = cut_next & drawn("backchannel_during_system")
    of_turns = [
        row("barge_in_final", STOP, whole, "final", yes, yes, F.col("pending")), row("empty_final", TAKE, empty, "final", yes, no, yes), row("silence_after_final", TAKE, empty, "silence", no, no, drawn("silence_after_final")),
        row("silence_during_system", NONE, empty, "silence", no, yes, cut_next), row("silence_during_system", NONE, empty, "silence", no, yes, cut_next & twice),
        *[row("backchannel_during_system", BACK, F.lit(SIGN), "final", x, yes, sign) for x in (no, yes)], row("silence_after_system", THINK, empty, "silence", no, no, ~cut_next & drawn("silence_after_system")),
    ]
    made = lambda df, rows: df.select("conv_id", "turn", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("conv_id", "turn", "r.*")
    return made(each, of_pieces).unionByName(made(users, of_turns))


@query("decision_families", FAMILIES_SQL)
def decision_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each family has, by label and shape."""
    return decision_rows(conversations(spark, sf_dir)).groupBy("family", "label", "kind", "ends", "busy").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


#: Subsets of recorded traces, in the order in which conversations are dealt to them here.
SUBSETS = ["candor_pause_handling", "synthetic_pause_handling", "icc_backchannel", "candor_turn_taking", "synthetic_user_interruption"]
#: Silences after a turn's end that still say finish, seconds between ticks, and how far from its annotation a target may lie.
POST_FINISH, TICK, BEFORE, AFTER = 2, 0.5, 0.5, 0.4
TRACE = f"""{USER}, sized AS (SELECT *, turn * 6.0::DOUBLE + t_end AS tm, turn * 6.0::DOUBLE + t_start AS began FROM users),
events AS (SELECT conv_id, turn, piece AS part, tm, CASE WHEN ends_turn THEN 'final' ELSE 'partial' END AS kind, ends_turn AS ends, text FROM sized UNION ALL SELECT conv_id, turn, 1000000 + k, tm + k * {TICK}, 'silence', false, '' FROM sized, (SELECT unnest([1, 2, 3]) AS k) WHERE ends_turn),
seq AS (SELECT *, ['{"', '".join(SUBSETS)}'][conv_id % 5 + 1] AS subset, row_number() OVER (PARTITION BY conv_id ORDER BY tm, turn, part) - 1 AS i FROM events),
said AS (SELECT conv_id, tm + 0.2 AS s, tm + 0.2 + 8 / 3.25 AS e FROM sized WHERE ends_turn),
marks AS (SELECT conv_id, max(tm) FILTER (WHERE ends_turn AND turn = 0) + 0.3 AS first_end, min(began) FILTER (WHERE turn = 2) AS second_start, max(tm) FILTER (WHERE turn = 2) AS second_end FROM sized GROUP BY conv_id)"""


def traces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recorded traces made of conversations: events (users' pieces and ticks of silence on one clock), spans of speech, and annotations."""
    own = user_pieces(spark, sf_dir).withColumn("at", F.col("turn") * 6.0 + F.col("t_end")).withColumn("began", F.col("turn") * 6.0 + F.col("t_start"))
    kind = F.when(F.col("ends_turn"), "final").otherwise("partial")
    ticks = F.when(F.col("ends_turn"), F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    events = own.withColumn("k", F.explode(ticks)).select(
        "conv_id", "turn", F.when(F.col("k") == 0, F.col("piece")).otherwise(1000000 + F.col("k")).alias("part"), (F.col("at") + F.col("k") * TICK).alias("at"),
        F.when(F.col("k") == 0, kind).otherwise("silence").alias("kind"), (F.col("ends_turn") & (F.col("k") == 0)).alias("ends"), F.when(F.col("k") == 0, F.col("text")).otherwise("").alias("text"),
    )
    subset = F.element_at(F.array(*[F.lit(s) for s in SUBSETS]), (F.col("conv_id") % 5 + 1).cast("int"))
    events = events.withColumn("subset", subset).withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "turn", "part")) - 1)
    said = own.where("ends_turn").select("conv_id", (F.col("at") + 0.2).alias("s"), (F.col("at") + 0.2 + 8 / 3.25).alias("e"))
    marks = own.groupBy("conv_id").agg((F.max(F.when(F.col("ends_turn") & (F.col("turn") == 0), F.col("at"))) + 0.3).alias("first_end"), F.min(F.when(F.col("turn") == 2, F.col("began"))).alias("second_start"), F.max(F.when(F.col("turn") == 2, F.col("at"))).alias("second_end"))
    return events, said, marks


def trace_labels(events: DataFrame, said: DataFrame, marks: DataFrame) -> DataFrame:
    """conv_id, i, subset, kind, label of each event of a trace, by the rules of its subset.

    ``events``: conv_id, i (order), at, kind, ends, text, subset; ``said``: spans of the system's speech, which count for
    interruptions only; ``marks``: first_end (the annotated end of a turn), second_start and second_end (of an
    interruption). Targets are the finals nearest to the annotations; the first two silences after a target that
    finishes a turn say finish again.
    """
    smooth, cut = F.col("subset") == SUBSETS[3], F.col("subset") == SUBSETS[4]
    whole = Window.partitionBy("conv_id")
    rows = events.join(marks, "conv_id", "left")
    final = (F.col("kind") == "final") & F.col("ends")
    worded = final & (F.trim("text") != "")
    rows = rows.withColumn("final", F.when(F.max(worded).over(whole), worded).otherwise(final))

    def near(when: Column) -> Column:
        good = F.col("final") & (F.col("at") >= when - BEFORE)
        best = F.min(F.when(good, F.struct(F.abs(F.col("at") - when).alias("d"), "i"))).over(whole)["i"]
        return F.when(when.isNotNull(), F.coalesce(best, F.max(F.when(F.col("final"), F.col("i"))).over(whole)))

    def last(when: Column) -> Column:
        return F.max(F.when(F.col("final") & (F.col("at") <= when + AFTER), F.struct("at", (-F.col("i")).alias("back")))).over(whole)["back"] * -1

    rows = rows.withColumn("target", F.when(smooth, near(F.col("first_end")))).withColumn("post", F.when(cut, near(F.col("second_end")))).withColumn("context", F.when(cut, last(F.col("second_start"))))
    rows = rows.withColumn("hit", F.coalesce((smooth & (F.col("i") == F.col("target"))) | (cut & ((F.col("i") == F.col("post")) | ((F.col("i") == F.col("context")) & (F.col("context") != F.coalesce("post", F.lit(-1)))))), F.lit(False)))
    # The system speaks at an event if one of its spans holds it: spans of a conversation are few and lie in order.
    spans = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    rows = rows.join(spans, "conv_id", "left").withColumn("busy", cut & F.coalesce(F.exists("spans", lambda x: (x["s"] <= F.col("at")) & (F.col("at") < x["e"])), F.lit(False)))
    quiet, order = F.col("kind") == "silence", Window.partitionBy("conv_id").orderBy("i")
    rows = rows.withColumn("island", F.sum((~quiet).cast("int")).over(order))
    island = Window.partitionBy("conv_id", "island")
    rows = rows.withColumn("closed", F.max(~quiet & F.col("hit") & ~F.col("busy")).over(island))
    rows = rows.withColumn("nth", F.sum((quiet & ~F.col("busy")).cast("int")).over(island.orderBy("i")))
    busy, sign = F.col("busy"), F.lower(F.regexp_replace(F.trim("text"), "[.!?…]+$", "")) == SIGN
    while_busy = F.when(sign, BACK).otherwise(STOP)
    silent = F.when(F.col("closed"), F.when(~busy & (F.col("nth") <= POST_FINISH), TAKE).when(busy, NONE).otherwise(THINK)).when(busy, NONE).otherwise(WAIT)
    spoken = F.when(F.col("hit"), F.when(busy, while_busy).otherwise(TAKE)).when(busy, while_busy).otherwise(WAIT)
    listening = F.when(quiet & busy, NONE).when(~quiet & busy & sign, BACK).otherwise(WAIT)
    label = F.when(smooth | cut, F.when(quiet, silent).otherwise(spoken)).otherwise(listening)
    return rows.select("conv_id", "i", "subset", "kind", label.alias("label"))


@query("trace_labels", f"""WITH {TRACE}, f AS (SELECT s.*, m.first_end, m.second_start, m.second_end, kind = 'final' AND ends AS fin FROM seq s LEFT JOIN marks m ON m.conv_id = s.conv_id),
smooth AS (SELECT conv_id, coalesce(arg_min(i, abs(tm - first_end)) FILTER (WHERE fin AND tm >= first_end - {BEFORE}), max(i) FILTER (WHERE fin)) AS target FROM f WHERE subset = '{SUBSETS[3]}' AND first_end IS NOT NULL GROUP BY conv_id),
cut AS (SELECT conv_id, CASE WHEN max(second_end) IS NOT NULL THEN coalesce(arg_min(i, abs(tm - second_end)) FILTER (WHERE fin AND tm >= second_end - {BEFORE}), max(i) FILTER (WHERE fin)) END AS post, arg_max(i, tm) FILTER (WHERE fin AND tm <= second_start + {AFTER}) AS context FROM f WHERE subset = '{SUBSETS[4]}' GROUP BY conv_id),
h AS (SELECT f.*, coalesce(f.i = smooth.target, false) OR coalesce(f.i = cut.post, false) OR coalesce(f.i = cut.context AND cut.context <> coalesce(cut.post, -1), false) AS hit, f.subset = '{SUBSETS[4]}' AND EXISTS (SELECT 1 FROM said a WHERE a.conv_id = f.conv_id AND a.s <= f.tm AND f.tm < a.e) AS busy
  FROM f LEFT JOIN smooth ON smooth.conv_id = f.conv_id LEFT JOIN cut ON cut.conv_id = f.conv_id),
n AS (SELECT *, sum((kind <> 'silence')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS island FROM h),
k AS (SELECT *, bool_or(kind <> 'silence' AND hit AND NOT busy) OVER (PARTITION BY conv_id, island) AS closed, sum((kind = 'silence' AND NOT busy)::INT) OVER (PARTITION BY conv_id, island ORDER BY i) AS nth FROM n)
SELECT conv_id, i, subset, kind, CASE WHEN subset NOT IN ('{SUBSETS[3]}', '{SUBSETS[4]}') THEN '{WAIT}' WHEN kind = 'silence' AND closed AND NOT busy AND nth <= {POST_FINISH} THEN '{TAKE}' WHEN kind = 'silence' AND busy THEN '{NONE}' WHEN kind = 'silence' AND closed THEN '{THINK}' WHEN kind = 'silence' THEN '{WAIT}'
  WHEN busy THEN '{STOP}' WHEN hit THEN '{TAKE}' ELSE '{WAIT}' END AS label FROM k""")
def trace_labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all events of the traces."""
    return trace_labels(*traces(spark, sf_dir))


@query("replay_order", f"""WITH {USER}, e AS (SELECT conv_id, turn, 'speech_start' AS kind, min(t_start) AS tm, 0 AS first, -1 AS part FROM users GROUP BY conv_id, turn UNION ALL SELECT conv_id, turn, 'text', t_end, 1, piece FROM users UNION ALL SELECT conv_id, turn, 'speech_end', max(t_end), 2, 0 FROM users GROUP BY conv_id, turn)
SELECT conv_id, turn, kind, part, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(tm, 6), first, part) AS nth FROM e""")
def replay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded turn's events in the order of a replay: by time, and at one time starts, then texts, then ends."""
    own = user_pieces(spark, sf_dir)
    of_turn = own.groupBy("conv_id", "turn").agg(F.min("t_start").alias("a"), F.max("t_end").alias("b"))
    event = lambda kind, at, first, part: F.struct(F.lit(kind).alias("kind"), at.alias("at"), F.lit(first).alias("first"), F.lit(part).cast("bigint").alias("part"))
    edges = of_turn.select("conv_id", "turn", F.inline(F.array(event("speech_start", F.col("a"), 0, -1), event("speech_end", F.col("b"), 2, 0))))
    texts = own.select("conv_id", "turn", F.lit("text").alias("kind"), F.col("t_end").alias("at"), F.lit(1).alias("first"), F.col("piece").alias("part"))
    order = Window.partitionBy("conv_id", "turn").orderBy(F.round("at", 6), "first", "part")
    return edges.unionByName(texts).select("conv_id", "turn", "kind", "part", F.row_number().over(order).cast("bigint").alias("nth"))
