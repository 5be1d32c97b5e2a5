"""Queries that make training and evaluation rows from dialogues, and parse short answers and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calls, hashing, text
from ..operators import catalogue, scoring
from ..operators import pieces as P
from .conversations import PIECES, conversations, draw, ws
from .registry import query
from .scores import LONG, SCORED, tag_rows

SENT = "list_filter(string_split(regexp_replace(trim({c}), '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query("sentence_chunker", f"""
WITH s AS (SELECT conv_id, turn, unnest(range(len(s))) AS pos, unnest(s) AS t FROM (SELECT conv_id, turn, {SENT.format(c="text")} AS s FROM conversations)), w AS (SELECT *, {ws("t")} AS w FROM s),
h AS (SELECT conv_id, turn, pos, 0 AS half, CASE WHEN len(w) > 20 THEN w[1:(len(w) + 1) // 2] ELSE w END AS part FROM w UNION ALL SELECT conv_id, turn, pos, 1, w[(len(w) + 1) // 2 + 1:] FROM w WHERE len(w) > 20)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos, half) - 1 AS piece, array_to_string(part, ' ') AS text, len(part)::BIGINT AS n_words FROM h""")
def sentence_chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece a sentence, two if it has over 20 words."""
    s = conversations(spark, sf_dir).select("conv_id", "turn", F.posexplode(text.sentences(F.col("text"))).alias("pos", "t")).withColumn("w", text.ws_words(F.col("t")))
    n = F.size("w")
    half = F.ceil(n / 2).cast("int")
    parts = F.when(n > 20, F.array(F.slice("w", F.lit(1), half), F.slice("w", half + 1, n))).otherwise(F.array("w"))
    rows = s.select("conv_id", "turn", "pos", F.posexplode(parts).alias("half", "part"))
    order = Window.partitionBy("conv_id", "turn").orderBy("pos", "half")
    return rows.select("conv_id", "turn", (F.row_number().over(order) - 1).cast("bigint").alias("piece"), F.array_join("part", " ").alias("text"), F.size("part").cast("bigint").alias("n_words"))


@query("scenario_tasks", f"""
WITH t AS (SELECT conv_id, turn, text, len({ws("text")})::BIGINT AS n, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role FROM conversations)
SELECT conv_id, turn, 'task-' || lpad(conv_id::VARCHAR, 7, '0') || '-' || turn AS sid, CASE WHEN n <= 3 THEN 'backchannel' WHEN turn % 4 = 0 THEN 'pause' WHEN turn % 4 = 2 THEN 'interruption' ELSE 'smooth' END AS task, answer IS NOT NULL AS answered FROM t WHERE role = 'user'""")
def scenario_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'user'")
    n = F.size(text.ws_words(F.col("text")))
    task = F.when(n <= 3, "backchannel").when(F.col("turn") % 4 == 0, "pause").when(F.col("turn") % 4 == 2, "interruption").otherwise("smooth")
    return rows.select("conv_id", "turn", F.format_string("task-%07d-%d", "conv_id", "turn").alias("sid"), task.alias("task"), F.col("answer").isNotNull().alias("answered"))


@query("padded_batches", f"""
WITH l AS (SELECT conv_id, turn, least(len({ws("text")}), 40) AS n, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 16 AS batch FROM conversations)
SELECT batch, count(*) AS n_rows, max(n)::BIGINT AS width, (max(n) * count(*) - sum(n))::BIGINT AS padding FROM l GROUP BY batch""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16 rows padded to their longest, rows cut to 40 words. Numbers over all rows come from counts by conversation, so no task sorts them all."""
    rows = conversations(spark, sf_dir).select("conv_id", "turn", F.least(F.size(text.ws_words(F.col("text"))), F.lit(40)).alias("n"))
    slot = (F.col("conv_id") / 1000).cast("bigint")
    counts = rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")  # one row a thousand conversations
    own = F.row_number().over(Window.partitionBy("slot").orderBy("conv_id", "turn")) - 1
    placed = rows.withColumn("slot", slot).withColumn("own", own).join(before, "slot").withColumn("batch", F.floor((F.col("before") + F.col("own")) / 16))
    width = F.max("n").cast("bigint")
    return placed.groupBy("batch").agg(F.count("*").alias("n_rows"), width.alias("width"), (width * F.count("*") - F.sum("n")).alias("padding"))


@query("chatml_render", """
SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id""")
def chatml_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return conversations(spark, sf_dir).groupBy("conv_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n<|im_start|>assistant\n")).alias("prompt"))


DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


@query("digits_as_words", f"""
SELECT event_id, trim(regexp_replace({"".join("replace(" for _ in DIGITS)}user_id::VARCHAR{"".join(f", '{i}', ' {w} ')" for i, w in enumerate(DIGITS))}, '\\s+', ' ', 'g')) AS said FROM events WHERE event_type = 'purchase'""")
def digits_as_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number as it is read out, digit by digit."""
    said = F.col("user_id").cast("string")
    for i, w in enumerate(DIGITS):
        said = F.replace(said, F.lit(str(i)), F.lit(f" {w} "))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
    return rows.select("event_id", text.squeeze(said).alias("said"))


ANSWERS = [(1, "1: pt\n2: en\n\n3 : unclear"), (2, "no list"), (3, "2. fr\n10: de"), (4, "1: a\n1: b")]
ANSWERS_SQL = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in ANSWERS).replace("\n", "' || chr(10) || '") + ") v(id, t)"


@query("numbered_answers", f"""
SELECT id::BIGINT AS id, regexp_extract(l, '^\\s*([0-9]+)\\s*[:.]\\s*(.+)$', 1)::BIGINT AS n, trim(regexp_extract(l, '^\\s*([0-9]+)\\s*[:.]\\s*(.+)$', 2)) AS answer FROM (SELECT id, unnest(string_split(t, chr(10))) AS l FROM {ANSWERS_SQL}) WHERE regexp_matches(l, '^\\s*[0-9]+\\s*[:.]\\s*.+$')""")
def numbered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a numbered list; other lines are no answers."""
    lines = spark.createDataFrame(ANSWERS, "id bigint, t string").select("id", F.explode(F.split("t", "\n")).alias("l"))
    line = r"^\s*([0-9]+)\s*[:.]\s*(.+)$"
    return lines.where(F.col("l").rlike(line)).select("id", F.regexp_extract("l", line, 1).cast("bigint").alias("n"), F.trim(F.regexp_extract("l", line, 2)).alias("answer"))


CALLS = [
    (1, '{"name": "book", "arguments": {"city": "Lisbon", "date": "2024-05-01"}}', '{"name": "book", "arguments": {"city": "lisbon", "date": "2024/05/01"}}'), (2, '```json\n{"name": "book", "arguments": {"city": "Porto"}}\n```', '{"name": "book", "arguments": {"city": "Lisbon"}}'),
    (3, "no call", '{"name": "book", "arguments": {}}'), (4, 'Sure. {"name": "find", "arguments": {"city": "x"}} }', '{"name": "book", "arguments": {}}'), (5, '{"a": 1} then {"name": "Book", "arguments": {"city": "New Lisbon", "n": 2}}', '{"name": "book", "arguments": {"city": "lisbon", "n": "2.0"}}'),
    (6, '<tool_call>{"name": "book", "arguments": {"city": "São Paulo"}}</tool_call> {"name": "other"}', '{"name": "book", "arguments": {"city": "sao  paulo", "zip": ""}}'), (7, '{"name": "book", "arguments": {"time": "15:00"}}', '{"name": "book", "arguments": {"time": "15h00"}}'), (8, '{"name": "book", "arguments": {"city": "a"', '{"name": "book", "arguments": {}}'),
    (9, '{bad {"name": "book"}} {"name": "book", "arguments": {"city": "b"}}', '{"name": "book", "arguments": {"city": "b"}}'), (10, '{"name": "book", "arguments": {}}', '{"name": "book", "arguments": {"city": "b"}}'),
]
CALLS_SQL = "(VALUES " + ", ".join(f"({i}, '{a}', '{w}')" for i, a, w in CALLS) + ") v(id, answer, want)"
_NORM = "lower(trim(regexp_replace(strip_accents({0}), '\\s+', ' ', 'g')))"
_VALUE = "CASE WHEN regexp_matches({0}, '\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}') OR regexp_matches({0}, '^\\d{{1,2}}\\s*[:h]') THEN regexp_replace({0}, '\\D', '', 'g') ELSE " + _NORM + " END"


@query("tool_call_match", f"""WITH RECURSIVE c AS (SELECT id, want, CASE WHEN contains(answer, '<tool_call>') THEN regexp_extract(answer, '(?s)<tool_call>(.*?)</tool_call>', 1) ELSE answer END AS t FROM {CALLS_SQL}),
f AS (SELECT id, t, 0 AS i, 0 AS depth, 0 AS first, NULL::VARCHAR AS found FROM c UNION ALL
  SELECT id, t, i + 1, CASE substr(t, i + 1, 1) WHEN '{{' THEN depth + 1 WHEN '}}' THEN greatest(depth - 1, 0) ELSE depth END, CASE WHEN substr(t, i + 1, 1) = '{{' AND depth = 0 THEN i + 1 ELSE first END, CASE WHEN substr(t, i + 1, 1) = '}}' AND depth = 1 THEN substr(t, first, i + 2 - first) END FROM f WHERE i < length(t)),
o AS (SELECT id, arg_min(found, i) AS call FROM f WHERE found IS NOT NULL AND json_valid(found) AND CASE WHEN json_valid(found) THEN coalesce(json_extract_string(found, '$.name'), '') <> '' END GROUP BY id),
w AS (SELECT c.id, c.want, o.call, unnest(json_keys(c.want, '$.arguments') || ['']) AS k FROM c LEFT JOIN o ON o.id = c.id),
v AS (SELECT id, want, call, k, CASE WHEN k <> '' THEN json_extract_string(want, '$.arguments.' || k) END AS b, CASE WHEN k <> '' THEN json_extract_string(call, '$.arguments.' || k) END AS a FROM w),
e AS (SELECT id, want, call, k = '' OR b = '' OR coalesce(CASE WHEN TRY_CAST(a AS DOUBLE) IS NOT NULL AND TRY_CAST(b AS DOUBLE) IS NOT NULL THEN TRY_CAST(a AS DOUBLE) = TRY_CAST(b AS DOUBLE) ELSE contains({_VALUE.format("a")}, {_VALUE.format("b")}) OR contains({_VALUE.format("b")}, {_VALUE.format("a")}) END, false) AS good FROM v)
SELECT id::BIGINT AS id, call, coalesce({_NORM.format("json_extract_string(call, '$.name')")} = {_NORM.format("json_extract_string(want, '$.name')")} AND bool_and(good), false) AS correct FROM e GROUP BY id, want, call""")
def tool_call_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call found in an answer, and whether it is the one that was expected."""
    rows = spark.createDataFrame(CALLS, "id bigint, answer string, want string").withColumn("call", calls.call(F.col("answer")))
    return rows.select("id", "call", calls.call_correct(F.col("call"), F.col("want"), []).alias("correct"))


GENERAL = [(1, "Lisboa", "lisboa", "exact_norm"), (2, "É  Lisboa.", "lisboa", "contains"), (3, "a, b; c", "", "count3"), (4, "um e dois", "", "count3"), (5, "x", "", "contains"), (6, "Sao Paulo", "São Paulo", "exact_norm"), (7, "- a\n- b\n- c", "", "count3"), (8, "", "y", "contains")]
GENERAL_SQL = "(VALUES " + ", ".join(f"({i}, '{t}', '{w}', '{m}')" for i, t, w, m in GENERAL) + ") v(id, t, want, mode)"


@query("answer_match", f"""
SELECT id::BIGINT AS id, CASE mode WHEN 'exact_norm' THEN {_NORM.format("t")} = {_NORM.format("want")} WHEN 'count3' THEN len(list_filter(regexp_split_to_array(t, '[,;\n•-]| e '), lambda x: trim(x) <> '')) = 3 ELSE want <> '' AND contains({_NORM.format("t")}, {_NORM.format("want")}) END AS correct FROM {GENERAL_SQL}""")
def answer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether answers are right, each by its own way of matching."""
    return spark.createDataFrame(GENERAL, "id bigint, t string, want string, mode string").select("id", calls.answer_correct(F.col("t"), F.col("want"), F.col("mode")).alias("correct"))


UPDATES = [
    (1, {"max_price": "900", "tags": "a,b"}, {"max_price": None, "climate": "warm"}), (2, {"min_price": "5000", "max_price": "900"}, {}), (3, {}, {"min_nights": "0", "max_nights": "99"}), (4, {"pace": "slow"}, {"pace": "fast", "tags": "x,x,y"}),
]


def _map(m: dict) -> str:
    show = lambda v: "NULL::VARCHAR" if v is None else f"'{v}'"
    return f"MAP([{', '.join(show(k) for k in m)}]::VARCHAR[], [{', '.join(show(v) for v in m.values())}]::VARCHAR[])"


UPDATES_SQL = "(VALUES " + ", ".join(f"({i}, {_map(a)}, {_map(b)})" for i, a, b in UPDATES) + ") v(id, base, new)"
_OF = "CASE WHEN list_contains(map_keys(new), '{0}') THEN new['{0}'] ELSE base['{0}'] END"
_BOUND = "CASE WHEN coalesce(TRY_CAST({0} AS DOUBLE), 0) <> 0 THEN least(greatest(TRY_CAST({0} AS DOUBLE), {1}), {2}) END"


@query("filter_update", f"""WITH u AS (SELECT id, {_OF.format("min_price")} AS lo, {_OF.format("max_price")} AS hi, {_OF.format("max_nights")} AS nights, {_OF.format("climate")} AS climate, {_OF.format("pace")} AS pace, coalesce({_OF.format("tags")}, '') AS tags FROM {UPDATES_SQL}),
n AS (SELECT *, {_BOUND.format("lo", 300, 12000)} AS low, {_BOUND.format("hi", 300, 12000)} AS high FROM u)
SELECT id::BIGINT AS id, CASE WHEN high IS NULL OR low <= high THEN low END AS min_price, high AS max_price, {_BOUND.format("nights", 1, 30)} AS max_nights, climate, pace,
  array_to_string(list_filter(list_transform(range(1, len(string_split(tags, ',')) + 1), lambda i: CASE WHEN list_position(string_split(tags, ','), string_split(tags, ',')[i]) = i THEN string_split(tags, ',')[i] END), lambda x: x <> '')[1:6], ',') AS tags FROM n""")
def filter_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter brought up to date: absent keys stay, nulls clear, numbers are held within bounds, a lower bound over the upper goes."""
    rows = spark.createDataFrame(UPDATES, "id bigint, base map<string,string>, new map<string,string>")
    f = rows.select("id", catalogue.merged_filter(F.col("base"), F.col("new")).alias("f"))
    num = lambda k, a, b: catalogue.bounded(F.try_element_at("f", F.lit(k)).try_cast("double"), a, b)
    low, high = num("min_price", 300, 12000), num("max_price", 300, 12000)
    tags = F.array_join(F.slice(F.array_distinct(F.filter(F.split(F.coalesce(F.try_element_at("f", F.lit("tags")), F.lit("")), ","), lambda t: t != "")), 1, 6), ",")
    return f.select("id", F.when(high.isNull() | (low <= high), low).alias("min_price"), high.alias("max_price"), num("max_nights", 1, 30).alias("max_nights"), F.try_element_at("f", F.lit("climate")).alias("climate"), F.try_element_at("f", F.lit("pace")).alias("pace"), tags.alias("tags"))


@query("word_timing", f"""
WITH w AS (SELECT conv_id, turn, unnest(range(len(w))) AS pos, unnest(w) AS word, len(w) AS n FROM (SELECT conv_id, turn, {ws("text")} AS w FROM conversations WHERE role = 'assistant')),
x AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS so_far, sum(length(word) + 1) OVER (PARTITION BY conv_id, turn) AS total FROM w)
SELECT conv_id, turn, pos, word, round((so_far - length(word) - 1) / total * n / 3.25, 6) AS start, round(so_far / total * n / 3.25, 6) AS "end" FROM x""")
def word_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each word of a span is heard, in proportion to its letters."""
    w = P.words(conversations(spark, sf_dir).where("role = 'assistant'"))
    span = Window.partitionBy("conv_id", "turn")
    weight = F.length("word") + 1
    so_far, total, seconds = F.sum(weight).over(span.orderBy("pos")), F.sum(weight).over(span), F.count("*").over(span) / 3.25
    return w.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "word", F.round((so_far - weight) / total * seconds, 6).alias("start"), F.round(so_far / total * seconds, 6).alias("end"))


@query("commit_words", f"""WITH {PIECES},
g AS (SELECT conv_id, turn, piece, sum(n_words) OVER (PARTITION BY conv_id, turn ORDER BY piece)::BIGINT AS heard, ends_turn FROM pieces WHERE role = 'user')
SELECT conv_id, turn, piece, heard, CASE WHEN ends_turn THEN heard ELSE coalesce(lag(heard, 2) OVER (PARTITION BY conv_id, turn ORDER BY piece), 0) END AS settled FROM g""")
def commit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words are settled: those that two versions before already had, all at the turn's end."""
    rows = P.pieces(conversations(spark, sf_dir)).where("role = 'user'").withColumn("heard", F.sum("n_words").over(P.turn_order()))
    settled = F.when(F.col("ends_turn"), F.col("heard")).otherwise(F.coalesce(F.lag("heard", 2).over(P.turn_order()), F.lit(0)))
    return rows.select("conv_id", "turn", "piece", "heard", settled.alias("settled"))


@query("content_quality", f"""
WITH t AS (SELECT conv_id, role, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM conversations)
SELECT role, count(*) AS n, round(avg((text = before)::INT) FILTER (WHERE before IS NOT NULL), 6) AS repeat_rate, round(avg((trim(text) = '')::INT), 6) AS empty_rate, round(avg(len({ws("text")})), 6) AS mean_words, round(avg(length(regexp_replace(text, '[^éèäöüñß]', '', 'g')) / greatest(length(text), 1)), 6) AS marked_ratio FROM t GROUP BY role""")
def content_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).withColumn("before", F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    marked = F.length(F.regexp_replace("text", "[^éèäöüñß]", "")) / F.greatest(F.length("text"), F.lit(1))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg((F.col("text") == F.col("before")).cast("int")), 6).alias("repeat_rate"), F.round(F.avg((F.trim("text") == "").cast("int")), 6).alias("empty_rate"), F.round(F.avg(F.size(text.ws_words(F.col("text")))), 6).alias("mean_words"), F.round(F.avg(marked), 6).alias("marked_ratio"))


@query("high_precision_threshold", f"""WITH {SCORED}, {LONG}, s AS (SELECT tag, k / 20 AS threshold, count(*) FILTER (WHERE floor(p * 20 + 1e-9) >= k AND gold = tag) AS tp, count(*) FILTER (WHERE floor(p * 20 + 1e-9) >= k AND gold <> tag) AS fp FROM long, (SELECT unnest(range(1, 20)) AS k) GROUP BY tag, k)
SELECT tag, round(min(threshold), 6) AS threshold FROM s WHERE tp / nullif(tp + fp, 0) >= 0.2 GROUP BY tag""")
def high_precision_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest threshold of each tag at which a fifth of what is found is right."""
    return scoring.sweep(tag_rows(spark, sf_dir), "p", "truth").where("precision >= 0.2").groupBy("tag").agg(F.round(F.min("threshold"), 6).alias("threshold"))


@query("filler_turns", """
SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(regexp_replace(text, '[^\\p{L}\\s]', '', 'g')), '^\\s*((the|of|and)\\s*)+$')) AS n_filler, count(*) FILTER (WHERE NOT regexp_matches(text, '[\\p{L}\\p{N}]')) AS n_wordless FROM conversations GROUP BY role""")
def filler_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of nothing but filler words, and those without any word."""
    bare = F.lower(F.regexp_replace("text", r"[^\p{L}\s]", ""))
    return conversations(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"), F.count_if(bare.rlike(r"^\s*((the|of|and)\s*)+$")).alias("n_filler"), F.count_if(~F.col("text").rlike(r"[\p{L}\p{N}]")).alias("n_wordless"))


@query("conversation_split", f"""
SELECT conv_id, r, CASE WHEN r <= n // 10 THEN 'test' WHEN r <= n // 10 + n // 10 THEN 'val' ELSE 'train' END AS split FROM (SELECT conv_id, row_number() OVER (ORDER BY {draw("'split'", "conv_id")}, conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations))""")
def conversation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the order of a hash, a tenth each for test and validation. Numbered by ranges of the hash, so no task sorts them all."""
    ids = conversations(spark, sf_dir).select("conv_id").distinct().withColumn("h", hashing.draw(F.lit("split"), F.col("conv_id"))).withColumn("slot", F.floor(F.col("h") / 2**24))
    counts = ids.groupBy("slot").agg(F.count("*").alias("c"))
    every = Window.orderBy("slot")  # 256 slots at most
    before = counts.select("slot", F.coalesce(F.sum("c").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    r = F.col("before") + F.row_number().over(Window.partitionBy("slot").orderBy("h", "conv_id"))
    tenth = F.floor(F.col("n") / 10)
    placed = ids.join(F.broadcast(before), "slot").withColumn("r", r)
    return placed.select("conv_id", "r", F.when(F.col("r") <= tenth, "test").when(F.col("r") <= 2 * tenth, "val").otherwise("train").alias("split"))
