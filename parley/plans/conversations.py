"""Queries over conversations: turns, pieces, clocks and training records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, text, timing
from ..operators import pieces as P
from .registry import query, table

WS = "list_filter(string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"
SECONDS = "CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.35, {n} / 3.25) END"


def ws(c: str) -> str:
    return WS.format(c=c)


def seconds(n: str) -> str:
    return SECONDS.format(n=n)


def draw(*key: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(key) + "), 1, 8))::BIGINT"


PIECES = f"""
words AS (SELECT conv_id, turn, role, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT conv_id, turn, role, {ws("text")} AS w FROM conversations)),
cuts AS (SELECT *, CASE WHEN pos = 0 OR {draw("'cut'", "conv_id", "turn", "pos")} < {int(0.45 * 2**32)} THEN 1 ELSE 0 END AS c FROM words),
runs AS (SELECT *, sum(c) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM cuts),
parts AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, turn, run ORDER BY pos) - 1) // 7 AS part FROM runs),
joined AS (SELECT conv_id, turn, role, run, part, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n_words FROM parts GROUP BY ALL),
pieces AS (SELECT conv_id, turn, role, row_number() OVER w - 1 AS piece, text, n_words, lead(run) OVER w IS NULL AS ends_turn FROM joined WINDOW w AS (PARTITION BY conv_id, turn ORDER BY run, part))"""
USER = f"""{PIECES},
users AS (SELECT *, t_end - sec AS t_start FROM (SELECT *, sum(sec) OVER (PARTITION BY conv_id, turn ORDER BY piece) AS t_end FROM (SELECT *, {seconds("n_words")} AS sec FROM pieces WHERE role = 'user')))"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def user_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' pieces on a clock that starts with each turn."""
    return P.clocked(P.pieces(conversations(spark, sf_dir)).where("role = 'user'"), ["conv_id", "turn"], ["piece"])


@query("turn_takeover_by_role", f"""
SELECT role, count(*) AS n, round(avg(tor), 6) AS takeover_rate, round(CASE WHEN count(*) > 1 THEN stddev_samp(tor) / sqrt(count(*)) END, 6) AS sem, round(max(t_end), 6) AS longest
FROM (SELECT role, t_end, CASE WHEN n = 0 THEN 0 WHEN sec < 1.0 THEN (n > 3)::INT ELSE 1 END::BIGINT AS tor
      FROM (SELECT *, sum(sec) OVER (PARTITION BY conv_id ORDER BY turn) AS t_end FROM (SELECT *, {seconds("n")} AS sec FROM (SELECT conv_id, turn, role, len(regexp_extract_all(text, '\\p{{L}}+'))::BIGINT AS n FROM conversations))))
GROUP BY role""")
def turn_takeover_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(text.alpha_words(F.col("text"))).cast("bigint")
    turns = P.clocked(conversations(spark, sf_dir).select("conv_id", "turn", "role", n.alias("n_words")), ["conv_id"], ["turn"])
    said = F.when(F.col("n_words") > 0, 1).otherwise(0)
    tor = timing.takeover(said, F.lit(0.0), timing.speech_seconds(F.col("n_words")), F.col("n_words"))
    rows = turns.withColumn("tor", tor)
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("tor"), 6).alias("takeover_rate"), F.round(timing.sem(F.col("tor")), 6).alias("sem"), F.round(F.max("t_end"), 6).alias("longest"))


@query("content_hash_manifest", """
SELECT role, count(*) AS n, sha256(sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(h, 17, 15))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(h, 33, 15))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(h, 49, 15))::BIGINT)::VARCHAR) AS digest
FROM (SELECT role, sha256(conv_id || '|' || turn || '|' || role || '|' || text) AS h FROM conversations) GROUP BY role""")
def content_hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each role's rows in any order: rows' hashes are summed, so no task gathers them."""
    row = F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text"), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 16 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return conversations(spark, sf_dir).select("role", row.alias("h")).groupBy("role").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", *[part(i) for i in range(4)]), 256).alias("digest"))


@query("role_alternation_violations", """
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = before) AS n_same, arg_max(role, turn) AS last_role, (count(*) >= 4 AND count(*) FILTER (WHERE role = before) = 0) AS valid
FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role <> 'system') GROUP BY conv_id""")
def role_alternation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir).where("role != 'system'").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    same = F.count_if(F.col("role") == F.col("before"))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), same.alias("n_same"), F.max_by("role", "turn").alias("last_role"), ((F.count("*") >= 4) & (same == 0)).alias("valid"))


@query("dialogue_validity", f"""
SELECT t.conv_id, n_turns, longest, most_repeated, ends_with_assistant, (n_turns >= 2 AND shortest >= 1 AND longest <= 180 AND most_repeated < 3 AND ends_with_assistant) AS valid
FROM (SELECT conv_id, count(*) AS n_turns, max(n) AS longest, min(n) AS shortest, arg_max(role, turn) = 'assistant' AS ends_with_assistant FROM (SELECT *, len({ws("text")})::BIGINT AS n FROM conversations) GROUP BY conv_id) t
JOIN (SELECT conv_id, max(n) AS most_repeated FROM (SELECT conv_id, lower(text), count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id) r USING (conv_id)""")
def dialogue_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = conversations(spark, sf_dir).withColumn("n", F.size(text.ws_words(F.col("text"))).cast("bigint"))
    same = Window.partitionBy("conv_id", F.lower("text"))
    each = lines.withColumn("times", F.count("*").over(same)).groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.max("n").alias("longest"), F.min("n").alias("shortest"), F.max("times").alias("most_repeated"), (F.max_by("role", "turn") == "assistant").alias("ends_with_assistant"))
    valid = (F.col("n_turns") >= 2) & (F.col("shortest") >= 1) & (F.col("longest") <= 180) & (F.col("most_repeated") < 3) & F.col("ends_with_assistant")
    return each.withColumn("valid", valid).drop("shortest")


@query("next_role_label", """
SELECT role, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY role), 6) AS share
FROM (SELECT role, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), 'end') AS label FROM conversations) GROUP BY role, label""")
def next_role_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.coalesce(F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("end"))
    n = conversations(spark, sf_dir).select("role", label.alias("label")).groupBy("role", "label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("role")), 6))


@query("merge_same_role_turns", """
SELECT conv_id, run::BIGINT AS run, side, min(turn) AS first, max(turn) AS last, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS text
FROM (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY conv_id ORDER BY turn) = side THEN 0 ELSE 1 END AS c
      FROM (SELECT *, CASE role WHEN 'assistant' THEN 'out' ELSE 'in' END AS side FROM conversations))) GROUP BY conv_id, run, side""")
def merge_same_role_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = conversations(spark, sf_dir).withColumn("side", F.when(F.col("role") == "assistant", "out").otherwise("in"))
    return P.merge_runs(sides, ["conv_id"], "turn", "side", "text")


@query("terminal_punctuation_stats", """
SELECT role, mark, count(*) AS n, round(avg(length(bare)), 6) AS mean_bare FROM
(SELECT role, regexp_extract(regexp_replace(text, '[\\s"''”’»)\\]]+$', ''), '([.!?…])$', 1) AS mark, regexp_replace(text, '[.?!…,;:\\s]+$', '') AS bare FROM conversations) GROUP BY role, mark""")
def terminal_punctuation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("role", text.terminal_mark(F.col("text")).alias("mark"), F.length(text.strip_terminal(F.col("text"))).alias("bare"))
    return rows.groupBy("role", "mark").agg(F.count("*").alias("n"), F.round(F.avg("bare"), 6).alias("mean_bare"))


@query("word_chunker_pieces", f"WITH {PIECES} SELECT conv_id, turn, piece, text, n_words, ends_turn FROM pieces")
def word_chunker_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pieces(conversations(spark, sf_dir)).drop("role")


@query("piece_length_dist", f"WITH {PIECES} SELECT n_words, count(*) AS n, count(*) FILTER (WHERE ends_turn) AS n_final FROM pieces GROUP BY n_words")
def piece_length_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pieces(conversations(spark, sf_dir)).groupBy("n_words").agg(F.count("*").alias("n"), F.count_if("ends_turn").alias("n_final"))


@query("chunk_lossless_check", f"""WITH {PIECES},
back AS (SELECT conv_id, turn, string_agg(text, ' ' ORDER BY piece) AS t FROM pieces GROUP BY conv_id, turn)
SELECT c.role, count(*) AS n_turns, count(*) FILTER (WHERE array_to_string({ws("c.text")}, ' ') <> coalesce(b.t, '')) AS n_lost FROM conversations c LEFT JOIN back b USING (conv_id, turn) GROUP BY c.role""")
def chunk_lossless_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir)
    back = P.pieces(turns).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("x")).select("conv_id", "turn", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("t"))
    lost = F.array_join(text.ws_words(F.col("text")), " ") != F.coalesce("t", F.lit(""))
    return turns.join(back, ["conv_id", "turn"], "left").groupBy("role").agg(F.count("*").alias("n_turns"), F.count_if(lost).alias("n_lost"))


TAGGED = "'<|' || role || '|> ' || text || CASE WHEN turn % 3 = 0 THEN ' <|pause|>  go on' ELSE ' <|end|>' END"


@query("token_strip_split", f"""
SELECT conv_id, turn, array_to_string(regexp_extract_all(t, '(<\\|[^|>]+\\|>)', 1), ' ') AS tokens, trim(regexp_replace(regexp_replace(t, '(<\\|[^|>]+\\|>)', ' ', 'g'), '\\s+', ' ', 'g')) AS bare, regexp_extract(t, '^\\s*(<\\|[^|>]+\\|>)', 1) AS leading
FROM (SELECT conv_id, turn, {TAGGED} AS t FROM conversations)""")
def token_strip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("<|"), "role", F.lit("|> "), "text", F.when(F.col("turn") % 3 == 0, " <|pause|>  go on").otherwise(" <|end|>"))
    rows = conversations(spark, sf_dir).select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", F.array_join(text.tokens(F.col("t")), " ").alias("tokens"), text.without_tokens(F.col("t")).alias("bare"), text.leading_token(F.col("t")).alias("leading"))


@query("running_clock", f"""
SELECT conv_id, turn, n_words, round(t_end - sec, 6) AS t_start, round(t_end, 6) AS t_end, sec <= 3.0 AND n_words <= 3 AS backchannel, sec >= 1.0 OR n_words > 3 AS formal
FROM (SELECT *, sum(sec) OVER (PARTITION BY conv_id ORDER BY turn) AS t_end FROM (SELECT *, {seconds("n_words")} AS sec FROM (SELECT conv_id, turn, len({ws("text")})::BIGINT AS n_words FROM conversations)))""")
def running_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.clocked(conversations(spark, sf_dir).select("conv_id", "turn", F.size(text.ws_words(F.col("text"))).cast("bigint").alias("n_words")), ["conv_id"], ["turn"])
    sec = timing.speech_seconds(F.col("n_words"))
    return rows.select("conv_id", "turn", "n_words", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), timing.is_backchannel(sec, F.col("n_words")).alias("backchannel"), timing.is_formal(sec, F.col("n_words")).alias("formal"))


STATE = f"""{PIECES},
flat AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, piece) AS i FROM pieces),
look AS (SELECT *, max(CASE WHEN role = 'user' THEN i END) OVER w AS last_user, max(CASE WHEN role = 'assistant' THEN i END) OVER w AS last_out,
  arg_max(ends_turn, CASE WHEN role = 'user' THEN i END) OVER w AS closed FROM flat WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
states AS (SELECT *, CASE WHEN last_user IS NULL THEN 'none' WHEN NOT closed THEN 'in_turn' WHEN last_out > last_user THEN 'answered' ELSE 'awaiting_answer' END AS state FROM look)"""


@query("turn_state_machine", f"WITH {STATE} SELECT role, state, ends_turn, count(*) AS n FROM states GROUP BY ALL")
def turn_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's turn as the six pieces before show it."""
    flat = P.pieces(conversations(spark, sf_dir)).withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "piece")))
    w = Window.partitionBy("conv_id").orderBy("i").rowsBetween(-6, -1)
    user = F.when(F.col("role") == "user", F.col("i"))
    rows = flat.withColumn("last_user", F.max(user).over(w)).withColumn("last_out", F.max(F.when(F.col("role") == "assistant", F.col("i"))).over(w)).withColumn("closed", F.max(F.when(F.col("role") == "user", F.struct("i", "ends_turn"))).over(w)["ends_turn"])
    state = F.when(F.col("last_user").isNull(), "none").when(~F.col("closed"), "in_turn").when(F.col("last_out") > F.col("last_user"), "answered").otherwise("awaiting_answer")
    return rows.withColumn("state", state).groupBy("role", "state", "ends_turn").agg(F.count("*").alias("n"))


FINISH = draw("'tag'", "conv_id", "turn", "piece") + " % 4 = 0"


def finish_tag():
    return hashing.draw(F.lit("tag"), F.col("conv_id"), F.col("turn"), F.col("piece")) % 4 == 0


@query("first_finish_per_utterance", f"""WITH {PIECES},
utt AS (SELECT conv_id, turn, min(CASE WHEN fin THEN piece END) AS fired, max(piece) AS last FROM (SELECT *, {FINISH} AS fin FROM pieces WHERE role = 'user') GROUP BY conv_id, turn)
SELECT CASE WHEN grouping(conv_mod) = 1 THEN 'total' ELSE conv_mod::VARCHAR END AS subset, count(*) AS n, count(*) FILTER (WHERE fired < last) AS premature, count(*) FILTER (WHERE fired = last) AS closed_end, count(*) FILTER (WHERE fired IS NULL) AS no_finish
FROM (SELECT *, conv_id % 4 AS conv_mod FROM utt) GROUP BY ROLLUP (conv_mod)""")
def first_finish_per_utterance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.pieces(conversations(spark, sf_dir)).where("role = 'user'")
    utt = rows.groupBy("conv_id", "turn").agg(F.min(F.when(finish_tag(), F.col("piece"))).alias("fired"), F.max("piece").alias("last")).withColumn("conv_mod", F.col("conv_id") % 4)
    sub = F.when(F.grouping("conv_mod") == 1, "total").otherwise(F.col("conv_mod").cast("string"))
    return utt.rollup("conv_mod").agg(sub.alias("subset"), F.count("*").alias("n"), F.count_if(F.col("fired") < F.col("last")).alias("premature"), F.count_if(F.col("fired") == F.col("last")).alias("closed_end"), F.count_if(F.col("fired").isNull()).alias("no_finish")).drop("conv_mod")


SPLIT = "list_reduce(list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(h, i::INT, 1)) - 1), lambda a, d: (a * 16 + d) % 10)"


@query("hash_split", f"""
SELECT CASE r WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n, min(conv_id) AS least FROM
(SELECT conv_id, {SPLIT} AS r FROM (SELECT DISTINCT conv_id, sha1('en:conv:' || conv_id) AS h FROM conversations)) GROUP BY split""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = conversations(spark, sf_dir).select("conv_id").distinct()
    split = hashing.bucket_name(hashing.digest_split(F.concat(F.lit("en:conv:"), F.col("conv_id").cast("string"))))
    return ids.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))


@query("shift_label_weights", f"""
SELECT conv_id, count(*) AS n_tokens, count(*) FILTER (WHERE weight > 0) AS n_supervised, round(sum(weight), 6) AS weight, arg_max(label, pos) AS last_label
FROM (SELECT conv_id, pos, nxt AS label, CASE WHEN nxt IS NULL THEN 0.0::DOUBLE WHEN nrole = 'assistant' THEN 1.0 WHEN pos < 4 THEN 0.0 ELSE 0.25 END AS weight
      FROM (SELECT conv_id, pos, lead(word) OVER w AS nxt, lead(role) OVER w AS nrole, back FROM (
        SELECT conv_id, role, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, pos DESC) AS back FROM (
          SELECT conv_id, turn, role, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT conv_id, turn, role, {ws("text")} AS w FROM conversations))) WHERE back <= 256 WINDOW w AS (PARTITION BY conv_id ORDER BY pos)))
GROUP BY conv_id""")
def shift_label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 256 words of a conversation, each labelled by the next one: full weight where the assistant speaks next, a quarter elsewhere, none at the front."""
    words = P.words(conversations(spark, sf_dir))
    order, back = Window.partitionBy("conv_id").orderBy("turn", "pos"), Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("pos"))
    flat = words.select("conv_id", "role", "word", (F.row_number().over(order) - 1).alias("at"), F.row_number().over(back).alias("back")).where("back <= 256")
    along = Window.partitionBy("conv_id").orderBy("at")
    rows = flat.withColumn("label", F.lead("word").over(along)).withColumn("next_role", F.lead("role").over(along))
    weight = F.when(F.col("label").isNull(), 0.0).when(F.col("next_role") == "assistant", 1.0).when(F.col("at") < 4, 0.0).otherwise(0.25)
    rows = rows.withColumn("weight", weight)
    known = F.when(F.col("label").isNotNull(), F.col("at"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("weight") > 0).alias("n_supervised"), F.round(F.sum("weight"), 6).alias("weight"), F.max_by("label", known).alias("last_label"))


@query("prefix_records", f"""
SELECT conv_id, turn, k, array_to_string(w[1:k], ' ') AS prefix, k = len(w) AS whole FROM (SELECT conv_id, turn, w, unnest(range(1, least(len(w), 5) + 1)) AS k FROM (SELECT conv_id, turn, {ws("text")} AS w FROM conversations WHERE role = 'user'))""")
def prefix_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", text.ws_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(5)))))
    return rows.select("conv_id", "turn", F.col("k").cast("bigint").alias("k"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("prefix"), (F.col("k") == F.size("w")).alias("whole"))


@query("template_render", f"""
SELECT conv_id, string_agg(upper(role[1:1]) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn) AS transcript, printf('%d turns, %+.3f words from 50 a turn', count(*), avg(n) - 50) AS note
FROM (SELECT *, len({ws("text")}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 8 GROUP BY conv_id""")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight turns of a conversation as a transcript, and a note on it."""
    last = conversations(spark, sf_dir).withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("back <= 8")
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("text"))
    return last.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript"),
        F.format_string("%d turns, %+.3f words from 50 a turn", F.count("*"), F.avg(F.size(text.ws_words(F.col("text")))) - 50).alias("note"))


@query("repeat_chunk_cut", f"""WITH {PIECES},
keyed AS (SELECT *, array_to_string({ws("lower(text)")}[1:2], ' ') AS k FROM pieces),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY piece) > 1 AS again FROM keyed),
cut AS (SELECT *, min(CASE WHEN again THEN piece END) OVER (PARTITION BY conv_id, turn) AS stop FROM seen)
SELECT conv_id, turn, count(*) AS n_pieces, count(*) FILTER (WHERE piece < coalesce(stop, 10) AND piece < 10) AS n_kept, bool_or(again) AS repeats FROM cut GROUP BY conv_id, turn""")
def repeat_chunk_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of a turn until one begins with two words that began an earlier one, ten at most."""
    key = F.array_join(F.slice(text.ws_words(F.lower("text")), 1, 2), " ")
    seen = P.pieces(conversations(spark, sf_dir)).withColumn("k", key).withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "turn", "k").orderBy("piece")) > 1)
    stop = F.min(F.when(F.col("again"), F.col("piece"))).over(Window.partitionBy("conv_id", "turn"))
    kept = (F.col("piece") < F.coalesce("stop", F.lit(10))) & (F.col("piece") < 10)
    return seen.withColumn("stop", stop).groupBy("conv_id", "turn").agg(F.count("*").alias("n_pieces"), F.count_if(kept).alias("n_kept"), F.bool_or("again").alias("repeats"))


MICRO = f"""{PIECES},
said AS (SELECT *, lag(hit, 1, false) OVER (PARTITION BY conv_id ORDER BY turn, piece) AS carried FROM (
  SELECT *, role = 'assistant' AND NOT ends_turn AND {draw("'barge'", "conv_id", "turn", "piece")} < {int(0.3 * 2**32)} AS hit, role = 'user' AND {draw("'pause'", "conv_id", "turn", "piece")} < {int(0.2 * 2**32)} AS pause FROM pieces))"""


@query("duplex_micro_turns", f"""WITH {MICRO}
SELECT conv_id, count(*) AS n_items, count(*) FILTER (WHERE tag = 'speak') AS n_speak, count(*) FILTER (WHERE tag = 'stop') AS n_stop, count(*) FILTER (WHERE tag = 'wait') AS n_wait, count(*) FILTER (WHERE tag = 'finish') AS n_finish, count(*) FILTER (WHERE tag = 'listen') AS n_listen
FROM (SELECT conv_id, CASE WHEN carried THEN 'stop' WHEN role = 'assistant' THEN 'speak' WHEN ends_turn THEN 'finish' WHEN pause THEN 'wait' ELSE 'listen' END AS tag FROM said) GROUP BY conv_id""")
def duplex_micro_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of both sides tagged; an interruption drawn on one piece stops the piece that follows."""
    key = [F.col("conv_id"), F.col("turn"), F.col("piece")]
    rows = P.pieces(conversations(spark, sf_dir)).withColumn("hit", (F.col("role") == "assistant") & ~F.col("ends_turn") & hashing.chance(0.3, F.lit("barge"), *key)).withColumn("pause", (F.col("role") == "user") & hashing.chance(0.2, F.lit("pause"), *key))
    rows = rows.withColumn("carried", F.lag("hit", 1, False).over(Window.partitionBy("conv_id").orderBy("turn", "piece")))
    tag = F.when(F.col("carried"), "stop").when(F.col("role") == "assistant", "speak").when(F.col("ends_turn"), "finish").when(F.col("pause"), "wait").otherwise("listen")
    each = rows.select("conv_id", tag.alias("tag")).groupBy("conv_id")
    return each.agg(F.count("*").alias("n_items"), *[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("speak", "stop", "wait", "finish", "listen")])


@query("prefix_diff_partials", f"""WITH {PIECES},
grown AS (SELECT conv_id, turn, piece, string_agg(text, ' ') OVER (PARTITION BY conv_id, turn ORDER BY piece) AS partial FROM pieces WHERE role = 'user')
SELECT conv_id, turn, piece, length(partial) AS n, trim(substr(partial, length(coalesce(before, '')) + 1)) AS added, coalesce(starts_with(partial, before), true) AS grows
FROM (SELECT *, lag(partial) OVER (PARTITION BY conv_id, turn ORDER BY piece) AS before FROM grown)""")
def prefix_diff_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript as it grows, and what each version adds to the one before."""
    rows = P.pieces(conversations(spark, sf_dir)).where("role = 'user'")
    so_far = F.array_join(F.collect_list("text").over(P.turn_order().rowsBetween(Window.unboundedPreceding, 0)), " ")
    rows = rows.withColumn("partial", so_far).withColumn("before", F.lag("partial").over(P.turn_order()))
    added = F.trim(F.substring(F.col("partial"), F.length(F.coalesce("before", F.lit(""))) + 1, F.length("partial")))
    return rows.select("conv_id", "turn", "piece", F.length("partial").cast("bigint").alias("n"), added.alias("added"), F.coalesce(F.startswith("partial", "before"), F.lit(True)).alias("grows"))


@query("speech_queue_starts", f"""WITH timed AS (SELECT conv_id, turn, n, (turn * 4)::DOUBLE AS asked, {seconds("n")} AS sec FROM (SELECT conv_id, turn, len({ws("text")})::BIGINT AS n FROM conversations WHERE role = 'assistant')),
summed AS (SELECT *, sum(sec) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM timed),
ends AS (SELECT *, max(asked - (total - sec)) OVER (PARTITION BY conv_id ORDER BY turn) + total AS done FROM summed)
SELECT conv_id, turn, round(done - sec, 6) AS start, round(done, 6) AS "end", round(done - sec - asked, 6) AS waited FROM ends""")
def speech_queue_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When queued replies are heard: start = max(asked at, end of the one before). As a running maximum, so without a loop over rows."""
    rows = conversations(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", (F.col("turn") * 4.0).alias("at"), timing.speech_seconds(F.size(text.ws_words(F.col("text")))).alias("sec"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.sum("sec").over(w)).withColumn("done", F.max(F.col("at") - (F.col("total") - F.col("sec"))).over(w) + F.col("total"))
    return rows.select("conv_id", "turn", F.round(F.col("done") - F.col("sec"), 6).alias("start"), F.round("done", 6).alias("end"), F.round(F.col("done") - F.col("sec") - F.col("at"), 6).alias("waited"))
