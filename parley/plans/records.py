"""Rules over records: parsing, guards, projections, allow-lists, heuristics and clean-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import pieces as P
from .conversations import PIECES, conversations, draw, ws
from .registry import query, table


def values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") v({names})"


#: What lines of a written dialogue begin with, and who speaks them (fixed values); the least lines of a dialogue.
PREFIXES, LEAST_LINES = {"Usuário:": "user", "Usuario:": "user", "Assistente:": "assistant"}, 6


def parsed_lines(c: Column) -> Column:
    """The lines of a written dialogue as an array of role and content; null with under LEAST_LINES or where the roles don't alternate, a user first. Lines without a role are left out."""
    line = lambda x: F.coalesce(*[F.when(F.startswith(x, F.lit(p)), F.struct(F.lit(r).alias("role"), F.trim(F.substring(x, len(p) + 1, 1 << 30)).alias("content"))) for p, r in PREFIXES.items()])
    lines = F.array_compact(F.transform(F.split(c, "\n"), lambda x: line(F.trim(x))))
    good = F.forall(F.transform(lines, lambda x, i: x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    return F.when((F.size(lines) >= LEAST_LINES) & good, lines)


WRITTEN = "CASE role WHEN 'user' THEN 'Usuário: ' WHEN 'assistant' THEN 'Assistente: ' ELSE '' END || CASE WHEN turn = 2 AND conv_id % 7 = 0 THEN chr(10) || 'note' ELSE '' END || replace(text, chr(10), ' ')"


@query("dialogue_parse", f"""WITH d AS (SELECT conv_id, string_agg(CASE WHEN conv_id % 11 = 0 AND turn = 3 THEN '' ELSE {WRITTEN} END, chr(10) ORDER BY turn) AS t FROM (SELECT * FROM conversations UNION ALL SELECT conv_id, turn + 100, role, text FROM conversations) GROUP BY conv_id),
l AS (SELECT conv_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN starts_with(trim(x), 'Usuário:') THEN 'user' WHEN starts_with(trim(x), 'Assistente:') THEN 'assistant' END), lambda x: x IS NOT NULL) AS r FROM d)
SELECT conv_id, len(r) >= {LEAST_LINES} AND len(list_filter(range(len(r)), lambda i: r[i + 1] <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END)) = 0 AS valid, len(r)::BIGINT AS n_lines FROM l""")
def dialogue_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written dialogues read back: which are valid, of how many lines with a role."""
    own = conversations(spark, sf_dir)
    twice = own.unionByName(own.withColumn("turn", F.col("turn") + 100))
    shown = F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") == 3), "").otherwise(F.expr(WRITTEN))
    written = twice.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", shown.alias("x")))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda x: x["x"]), "\n").alias("t"))
    n = F.size(F.filter(F.split("t", "\n"), lambda x: F.trim(x).rlike("^(" + "|".join(PREFIXES) + ")"))).cast("bigint")
    return written.select("conv_id", parsed_lines(F.col("t")).isNotNull().alias("valid"), n.alias("n_lines"))


@query("message_scan", f"""
SELECT conv_id, count(*) AS n, sum(len({ws("text")}))::BIGINT AS n_words FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id HAVING count(*) >= 4""")
def message_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues of at least four messages that say something, by roles that count."""
    rows = conversations(spark, sf_dir).where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.size(text.ws_words(F.col("text")))).alias("n_words")).where("n >= 4")


TAILS = [(1, "tudo bem é é é"), (2, "olá. ő"), (3, "ok ok"), (4, "sim, ok"), (5, ", a capital é Brasília."), (6, "— bom dia"), (7, "fim. no"), (8, "é"), (9, ""), (10, "a a a a"), (11, "longo longo"), (12, "bom! é é"), (13, "...")]
EMOJI = [(20, "😀 😀"), (21, "😀!"), (22, "  "), (23, "★☀"), (24, "a")]


@query("reply_cleanup", f"""WITH w AS (SELECT id, t, string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ') AS w FROM {values(TAILS + EMOJI, "id, t")}),
r AS (SELECT *, CASE WHEN length(w[-1]) <= 2 THEN list_filter(range(1, len(w) + 1), lambda i: i = len(w) OR len(list_filter(w[i:], lambda x: x <> w[-1])) > 0 OR FALSE) ELSE range(1, len(w) + 1) END AS kept FROM w),
o AS (SELECT id, t, list_transform(kept, lambda i: w[i]) AS o FROM r)
SELECT id::BIGINT AS id, array_to_string(CASE WHEN len(o) >= 2 AND regexp_full_match(o[-1], '\\p{{L}}{{1,2}}') AND NOT regexp_full_match(o[-1], '[\\x00-\\x7F]*') AND NOT regexp_matches(o[-2], '[\\p{{L}}\\p{{N}}]$') THEN o[:-2] ELSE o END, ' ') AS tail,
  regexp_replace(t, '^[\\s,;:.…—–-]+', '') AS opening, regexp_full_match(regexp_replace(t, '\\s', '', 'g'), '\\p{{So}}*') AS emoji_only, CASE WHEN regexp_replace(t, '[.?!…,;:\\s]+$', '') = '' THEN '' ELSE regexp_replace(t, '[.?!…,;:\\s]+$', '') || '.' END AS closed FROM o""")
def reply_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies without degenerate ends or openings, closed by a full stop, and whether they are symbols alone."""
    t = F.col("t")
    return spark.createDataFrame(TAILS + EMOJI, "id bigint, t string").select("id", text.degenerate_tail(t).alias("tail"), text.continuation(t).alias("opening"), text.emoji_only(t).alias("emoji_only"), text.add_punctuation(t).alias("closed"))


#: Names that may be chosen for each model.
ALLOWED = [("a", "plain"), ("a", "tagged"), ("b", "plain")]
CHOICES = [(1, "a", "tagged"), (2, "a", None), (3, "b", "tagged"), (4, "c", "plain"), (5, "b", "plain")]


def resolved(rows: DataFrame, allowed: DataFrame, strict: bool = True) -> DataFrame:
    """``rows`` (model, candidate) with the name that stands: the candidate, or the model's first by name for null. One that isn't allowed is an error, or null if not ``strict``."""
    first = allowed.groupBy("model").agg(F.min("name").alias("first"), F.collect_set("name").alias("names"))  # a row a model
    met = rows.join(F.broadcast(first), "model", "left")
    name = F.coalesce("candidate", "first")
    good = F.coalesce(F.array_contains("names", name), F.lit(False))
    other = F.raise_error(F.concat(F.lit("not allowed: "), F.col("model"), F.lit(" "), F.coalesce("candidate", F.lit("")))).cast("string") if strict else F.lit(None).cast("string")
    return met.withColumn("name", F.when(good, name).otherwise(other)).drop("first", "names")


@query("config_resolution", f"""WITH a AS (SELECT * FROM {values(ALLOWED, "model, name")}), f AS (SELECT model, min(name) AS first FROM a GROUP BY model)
SELECT c.id::BIGINT AS id, a.name FROM {values(CHOICES, "id, model, candidate").replace(" v(", " c(")} LEFT JOIN f ON f.model = c.model LEFT JOIN a ON a.model = c.model AND a.name = coalesce(c.candidate, f.first)""")
def config_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named setting that each run gets; null where its candidate isn't allowed."""
    return resolved(spark.createDataFrame(CHOICES, "id bigint, model string, candidate string"), spark.createDataFrame(ALLOWED, "model string, name string"), False).select("id", "name")


@query("item_projection", """
SELECT conv_id, count(*) AS n_items, count(*) FILTER (WHERE trim(text) <> '') AS n_kept, sum(length(role || ':' || text)) FILTER (WHERE trim(text) <> '')::BIGINT AS n_chars FROM conversations GROUP BY conv_id""")
def item_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's items with role and text alone, blank ones dropped."""
    items = conversations(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("items"))
    kept = F.transform(F.filter("items", lambda x: F.trim(x["text"]) != ""), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    size = F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + F.length(F.concat_ws(":", x["role"], x["text"])))
    return items.select("conv_id", F.size("items").cast("bigint").alias("n_items"), F.size(kept).cast("bigint").alias("n_kept"), F.when(F.size(kept) > 0, size).alias("n_chars"))


def heuristic(kind: Column, ends: Column, busy: Column, sign: Column) -> Column:
    """The decision where no model is loaded."""
    return F.when(busy, F.when(sign, "user_backchannel").otherwise("user_interruption")).when(((kind == "final") & ends) | (kind == "silence"), "user_finish_speaking").when(kind == "partial", "user_is_speaking").otherwise("no_tag")


def guarded(tag: Column, busy: Column, sign: Column) -> Column:
    """A model's decision, but that a sign while the system speaks is no interruption."""
    return F.when((tag == "user_interruption") & busy & sign, "user_backchannel").otherwise(tag)


@query("heuristic_decision", f"""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'partial' WHEN 'click' THEN 'silence' WHEN 'purchase' THEN 'final' ELSE 'other' END AS kind, event_id % 2 = 0 AS ends, value > 60 AS busy, event_id % 3 = 0 AS sign, {draw("'tag'", "event_id")} % 2 = 0 AS cut FROM events),
d AS (SELECT *, CASE WHEN busy AND sign THEN 'user_backchannel' WHEN busy THEN 'user_interruption' WHEN (kind = 'final' AND ends) OR kind = 'silence' THEN 'user_finish_speaking' WHEN kind = 'partial' THEN 'user_is_speaking' ELSE 'no_tag' END AS tag, CASE WHEN cut AND NOT (busy AND sign) THEN 'user_interruption' WHEN cut THEN 'user_backchannel' ELSE 'no_tag' END AS model_tag FROM e)
SELECT tag, model_tag, count(*) AS n FROM d GROUP BY ALL""")
def heuristic_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by rule, and a model's after its guard."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "partial").when(F.col("event_type") == "click", "silence").when(F.col("event_type") == "purchase", "final").otherwise("other")
    ends, busy, sign = F.col("event_id") % 2 == 0, F.col("value") > 60, F.col("event_id") % 3 == 0
    said = F.when(hashing.draw(F.lit("tag"), F.col("event_id")) % 2 == 0, "user_interruption").otherwise("no_tag")
    return e.select(heuristic(kind, ends, busy, sign).alias("tag"), guarded(said, busy, sign).alias("model_tag")).groupBy("tag", "model_tag").agg(F.count("*").alias("n"))


TAGGED = [(1, "take:empty,wait,take:inaudible,no_tag", 3), (2, "wait", 4), (3, "", 2), (4, "a:b:c,d", 5), (5, "x,y", 0)]


@query("tag_cleanup", f"""
SELECT id::BIGINT AS id, array_to_string(list_transform(CASE WHEN t = '' THEN [] ELSE string_split(t, ',') END, lambda x: split_part(x, ':', 1))[1:n], ',') AS tags FROM {values(TAGGED, "id, t, n")}""")
def tag_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags without what stands behind their colon, as many as there are pieces."""
    each = F.filter(F.split("t", ","), lambda x: x != "")
    tags = F.slice(F.transform(each, lambda x: F.split_part(x, F.lit(":"), F.lit(1))), F.lit(1), F.col("n"))
    return spark.createDataFrame(TAGGED, "id bigint, t string, n int").select("id", F.array_join(tags, ",").alias("tags"))


ANNOTATED = [(1, '[{"timestamp": [1.5, 2.25], "text": "a"}, {"timestamp": [9, 10]}]'), (2, "[]"), (3, None), (4, "not json"), (5, '[{"text": "no time"}]'), (6, '[{"timestamp": [3.0, 4.0], "context": "c", "interrupt": "i"}]')]


@query("annotation_access", """
SELECT * FROM (VALUES (1::BIGINT, 1.5::DOUBLE, 2.25::DOUBLE, NULL, 2::BIGINT), (2, NULL, NULL, NULL, 0), (3, NULL, NULL, NULL, 0), (4, NULL, NULL, NULL, 0), (5, NULL, NULL, NULL, 1), (6, 3.0, 4.0, 'i', 1)) v(id, first, last, interrupt, n)""")
def annotation_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first annotated span and what interrupts; a missing or malformed document is an empty list."""
    rows = spark.createDataFrame(ANNOTATED, "id bigint, t string").withColumn("a", annotations(F.col("t")))
    first = F.get("a", F.lit(0))
    return rows.select("id", F.get(first["timestamp"], F.lit(0)).alias("first"), F.get(first["timestamp"], F.lit(1)).alias("last"), first["interrupt"].alias("interrupt"), F.size("a").cast("bigint").alias("n"))


def annotations(c: Column) -> Column:
    """An annotation document as a list; empty if it is missing or malformed."""
    kind = "array<struct<timestamp:array<double>,text:string,context:string,interrupt:string>>"
    return F.coalesce(F.filter(F.from_json(c, kind), lambda x: x.isNotNull()), F.array().cast(kind))


def without_errors(rows: DataFrame, error: str = "error") -> DataFrame:
    """Rows that didn't fail: what metrics are computed over."""
    return rows.where(F.col(error).isNull())


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows``, which fail as soon as one of the columns is null in one of them."""
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])), ", ")
    return rows.where(F.when(missing == "", True).otherwise(F.raise_error(F.concat(F.lit("missing input: "), missing)).cast("boolean")))


@query("error_exclusion", """WITH r AS (SELECT event_type, value, CASE WHEN event_type = 'error' OR event_id % 17 = 0 THEN 'failed' END AS error FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM r WHERE error IS NULL GROUP BY event_type""")
def error_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric over rows that didn't fail, once its inputs are known to be there."""
    rows = table(spark, sf_dir, "events").withColumn("error", F.when((F.col("event_type") == "error") | (F.col("event_id") % 17 == 0), "failed"))
    return required(without_errors(rows), ["value"]).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("anchor_union", """
SELECT origin, kind, count(*) AS n, count(weight) AS n_weighted FROM (SELECT 'own' AS origin, role AS kind, 1.0 AS weight FROM conversations WHERE turn < 2 UNION ALL SELECT 'benchmark', 'anchor', NULL FROM benchmark) GROUP BY ALL""")
def anchor_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows and outside anchors as one table, columns that one side lacks with their defaults."""
    own = conversations(spark, sf_dir).where("turn < 2").select(F.lit("own").alias("origin"), F.col("role").alias("kind"), F.lit(1.0).alias("weight"))
    outside = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"))
    both = own.unionByName(outside, allowMissingColumns=True).withColumn("kind", F.coalesce("kind", F.lit("anchor")))
    return both.groupBy("origin", "kind").agg(F.count("*").alias("n"), F.count("weight").alias("n_weighted"))


@query("common_keys", """
SELECT count(*) AS n, min(conv_id) AS first, max(conv_id) AS last FROM (SELECT conv_id, turn FROM conversations WHERE conv_id % 2 = 0 INTERSECT SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0)""")
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that two runs have in common."""
    rows = conversations(spark, sf_dir).select("conv_id", "turn")
    return rows.where("conv_id % 2 = 0").intersect(rows.where("turn % 3 = 0")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))


@query("items_per_dialogue", f"""
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY {draw("'item'", "conv_id", "turn")}, turn) AS r FROM conversations) WHERE r <= 2""")
def items_per_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns of each dialogue, drawn by hash: the number is the feature."""
    order = Window.partitionBy("conv_id").orderBy(hashing.draw(F.lit("item"), F.col("conv_id"), F.col("turn")), "turn")
    return conversations(spark, sf_dir).withColumn("r", F.row_number().over(order)).where("r <= 2").select("conv_id", "turn")


#: Prompts that rows are generated for, and their openings.
PROMPTS = ["Explain {}", "What do you know of {}?", "Tell me about {} in short", "Compare {} with something else"]


@query("anchor_prompts", f"""
SELECT doc_id, replace([{", ".join("'" + p + "'" for p in PROMPTS)}][{draw("'prompt'", "doc_id")} % {len(PROMPTS)} + 1], '{{}}', {ws("text")}[1]) AS prompt FROM documents WHERE len({ws("text")}) > 0""")
def anchor_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each document: an opening drawn by hash, filled with the document's first word."""
    which = (hashing.draw(F.lit("prompt"), F.col("doc_id")) % len(PROMPTS) + 1).cast("int")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(text.ws_words(F.col("text")), F.lit(0)).alias("w")).where(F.col("w").isNotNull())
    return rows.select("doc_id", F.replace(F.element_at(F.array(*[F.lit(p) for p in PROMPTS]), which), F.lit("{}"), F.col("w")).alias("prompt"))


def good_reply(c: Column) -> Column:
    """A reply that may stand: 2 to 60 words, no character six times in a row."""
    n = F.size(text.ws_words(c))
    return n.between(2, 60) & ~text.repeated_run(c)


@query("rewrite_with_fallback", f"""WITH a AS (SELECT conv_id, turn, text AS source, CASE {draw("'try'", "conv_id", "turn", "1")} % 3 WHEN 0 THEN 'ok' WHEN 1 THEN '' ELSE text END AS one, CASE {draw("'try'", "conv_id", "turn", "2")} % 2 WHEN 0 THEN 'a short reply' ELSE 'x' END AS two FROM conversations WHERE role = 'assistant'),
g AS (SELECT *, len({ws("one")}) BETWEEN 2 AND 60 AND NOT regexp_matches(one, '{"|".join("(" + c + "){6}" for c in "abcdefghijklmnopqrstuvwxyz")}') AS good_one, len({ws("two")}) BETWEEN 2 AND 60 AS good_two FROM a)
SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE good_one) AS n_first, count(*) FILTER (WHERE NOT good_one AND good_two) AS n_second, count(*) FILTER (WHERE NOT good_one AND NOT good_two) AS n_fallback FROM g GROUP BY conv_id""")
def rewrite_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a teacher rewrites: the first attempt that may stand, a second one, else the source itself. The teacher here is a hash."""
    rows = conversations(spark, sf_dir).where("role = 'assistant'")
    key = [F.col("conv_id"), F.col("turn")]
    one, two = (hashing.draw(F.lit("try"), *key, F.lit(k)) for k in (1, 2))
    first = F.when(one % 3 == 0, "ok").when(one % 3 == 1, "").otherwise(F.col("text"))
    second = F.when(two % 2 == 0, "a short reply").otherwise("x")
    rows = rows.select("conv_id", good_reply(first).alias("a"), good_reply(second).alias("b"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if("a").alias("n_first"), F.count_if(~F.col("a") & F.col("b")).alias("n_second"), F.count_if(~F.col("a") & ~F.col("b")).alias("n_fallback"))


@query("scenario_generators", f"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents), t AS (SELECT doc_id, {ws("s[1]")} AS w, ['smooth_turn', 'pause_synthetic', 'pause_candor', 'backchannel', 'user_interruption'][doc_id % 5 + 1] AS task FROM s WHERE len(s) > 0),
n AS (SELECT *, len(w) AS n, {draw("'split'", "doc_id")} % 26 / 100.0::DOUBLE + 0.35 AS share, 1.2 + {draw("'pause'", "doc_id")} % 29 / 10.0::DOUBLE AS pause FROM t)
SELECT doc_id, task, CASE WHEN task LIKE 'pause%' THEN greatest(1, least(n - 1, round_even(n * share, 0)::BIGINT)) ELSE n END::BIGINT AS n_said, n::BIGINT AS n_words, task = 'smooth_turn' AS ends_turn, round(CASE WHEN task LIKE 'pause%' THEN pause ELSE 1.0 END, 2) AS silence FROM n WHERE n > 1""")
def scenario_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios of five tasks from documents' first sentences: pauses stop inside the sentence and stay silent, a smooth turn is said whole and ends."""
    tasks = F.array(*[F.lit(t) for t in ("smooth_turn", "pause_synthetic", "pause_candor", "backchannel", "user_interruption")])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(text.ws_words(F.get(text.sentences(F.col("text")), F.lit(0)))).alias("n"), F.element_at(tasks, (F.col("doc_id") % 5 + 1).cast("int")).alias("task")).where("n > 1")
    paused = F.col("task").startswith("pause")
    share = hashing.draw(F.lit("split"), F.col("doc_id")) % 26 / 100.0 + 0.35
    said = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.col("n") * share, 0).cast("bigint")))
    pause = 1.2 + hashing.draw(F.lit("pause"), F.col("doc_id")) % 29 / 10.0
    return rows.select("doc_id", "task", F.when(paused, said).otherwise(F.col("n")).cast("bigint").alias("n_said"), F.col("n").cast("bigint").alias("n_words"), (F.col("task") == "smooth_turn").alias("ends_turn"), F.round(F.when(paused, pause).otherwise(1.0), 2).alias("silence"))


#: What a record of each kind and label weighs in training; others weigh 1. The share of records that carry an instruction, and of finals with a silence after them.
LOSS = [("main", "user_finish_speaking", 2.0), ("main", "user_is_speaking", 0.5), ("silence", "user_is_thinking", 0.75), ("barge_in", "user_interruption", 3.0)]
INSTRUCTED, QUIET = 0.5, 0.3
LOSS_SQL = values(LOSS, "kind, label, weight").replace(" v(", " l(")


@query("policy_records", f"""WITH {PIECES}, p AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first_turn FROM pieces WHERE role = 'user'),
r AS (SELECT 'main' AS kind, CASE WHEN ends_turn THEN 'user_finish_speaking' ELSE 'user_is_speaking' END AS label, conv_id, turn, piece FROM p
  UNION ALL SELECT 'silence', 'user_is_thinking', conv_id, turn, piece FROM p WHERE ends_turn AND {draw("'quiet'", "conv_id", "turn", "piece")} < {int(QUIET * 2**32)}
  UNION ALL SELECT 'barge_in', 'user_interruption', conv_id, turn, piece FROM p WHERE piece = 0 AND turn > first_turn AND n_words > 2
  UNION ALL SELECT 'rule', 'follow_rule', conv_id, turn, piece FROM p WHERE regexp_matches(lower(text), '(^| )(que|the|und|los)( |$)'))
SELECT r.kind, r.label, count(*) AS n, round(sum(coalesce(weight, 1)::DOUBLE), 6) AS loss_weight, count(*) FILTER (WHERE {draw("'mix'", "r.kind", "conv_id", "turn", "piece")} < {int(INSTRUCTED * 2**32)}) AS n_instructed FROM r LEFT JOIN {LOSS_SQL} ON l.kind = r.kind AND l.label = r.label GROUP BY ALL""")
def policy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records for a policy's training: the main walk, silences, interruptions and rules, each with the loss weight of its kind and label and, for some, an instruction."""
    rows = P.pieces(conversations(spark, sf_dir)).where("role = 'user'")
    rows = rows.withColumn("first_turn", F.min("turn").over(Window.partitionBy("conv_id")))
    end, key = F.col("ends_turn"), [F.col("conv_id"), F.col("turn"), F.col("piece")]
    one = lambda kind, label, when: F.when(when, F.struct(F.lit(kind).alias("kind"), label.alias("label")))
    made = F.array_compact(F.array(
        one("main", F.when(end, "user_finish_speaking").otherwise("user_is_speaking"), F.lit(True)), one("silence", F.lit("user_is_thinking"), end & hashing.chance(QUIET, F.lit("quiet"), *key)),
        one("barge_in", F.lit("user_interruption"), (F.col("piece") == 0) & (F.col("turn") > F.col("first_turn")) & (F.col("n_words") > 2)), one("rule", F.lit("follow_rule"), F.lower("text").rlike("(^| )(que|the|und|los)( |$)")),
    ))
    records = rows.select(*key, F.explode(made).alias("r")).select("conv_id", "turn", "piece", "r.*")
    loss = F.broadcast(spark.createDataFrame(LOSS, "kind string, label string, weight double"))  # a row a kind and label
    told = records.withColumn("instructed", hashing.chance(INSTRUCTED, F.lit("mix"), F.col("kind"), *key)).join(loss, ["kind", "label"], "left")
    return told.groupBy("kind", "label").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("weight", F.lit(1.0))), 6).alias("loss_weight"), F.count_if("instructed").alias("n_instructed"))


@query("dialogue_gate", f"""WITH t AS (SELECT conv_id, turn, role, lower(text) AS low, len({ws("text")}) AS n, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM conversations),
s AS (SELECT conv_id, role, sum(len(list_filter(w, lambda x: length(x) > 2)))::BIGINT AS clear, count(*) AS lines FROM t GROUP BY conv_id, role), l AS (SELECT conv_id, max(c) AS most FROM (SELECT conv_id, low, count(*) AS c FROM t GROUP BY conv_id, low) GROUP BY conv_id)
SELECT t.conv_id, arg_max(t.role, t.turn) = 'assistant' AND min(t.n) >= 1 AND max(t.n) <= 180 AND any_value(l.most) < 3 AND any_value(b.ok) AS valid FROM t JOIN l USING (conv_id) JOIN (SELECT conv_id, count(*) FILTER (WHERE role IN ('user', 'assistant') AND clear >= 8) = 2 AS ok FROM s GROUP BY conv_id) b USING (conv_id) GROUP BY t.conv_id""")
def dialogue_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues that may be trained on: an assistant has the last word, lines have 1 to 180 words, none stands three times, and both sides say enough to be told by their language."""
    clear = F.size(F.filter(text.alpha_words(F.lower("text")), lambda x: F.length(x) > 2))
    rows = conversations(spark, sf_dir).select("conv_id", "turn", "role", F.lower("text").alias("low"), F.size(text.ws_words(F.col("text"))).alias("n"), clear.alias("clear"))
    lines = rows.groupBy("conv_id", "low").agg(F.count("*").alias("c"), F.max(F.struct("turn", "role")).alias("last"), F.min("n").alias("least"), F.max("n").alias("most"), *[F.sum(F.when(F.col("role") == r, F.col("clear")).otherwise(0)).alias(r) for r in ("user", "assistant")])
    whole = lines.groupBy("conv_id").agg(F.max("last").alias("last"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("c").alias("c"), F.sum("user").alias("user"), F.sum("assistant").alias("assistant"))
    return whole.select("conv_id", ((F.col("last.role") == "assistant") & (F.col("least") >= 1) & (F.col("most") <= 180) & (F.col("c") < 3) & (F.col("user") >= 8) & (F.col("assistant") >= 8)).alias("valid"))
