"""Queries over documents: normal forms, language, sampling, quality rules, and parsing of short answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import scoring
from .conversations import conversations, draw, ws
from .registry import query, table

NORM = "lower(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' ([.,!?;:])', '\\1', 'g'))"
#: Words that mark a language, and letters that do.
MARKERS = {"en": ["the", "of", "and", "to", "with"], "de": ["der", "die", "das", "und", "mit"], "fr": ["le", "la", "les", "des", "une"], "es": ["el", "los", "las", "que", "una"]}
LETTERS = {"de": "[äöüß]", "fr": "[èêçà]", "es": "[ñáíóú]"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("normalised_dedup", f"""
SELECT key, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, sha256({NORM.format(c="text")}) AS key FROM documents) GROUP BY key""")
def normalised_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each normal form. Grouped by digest, so no text is shuffled and copies are counted before the exchange."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(text.normalise(F.col("text")), 256).alias("key")).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("ambiguous_group_drop", """
SELECT source, count(*) AS n, count(*) FILTER (WHERE langs > 1) AS n_dropped FROM (SELECT d.source, k.langs FROM documents d JOIN (SELECT md5(text) AS h, count(DISTINCT source) AS langs FROM documents GROUP BY h) k ON md5(d.text) = k.h) GROUP BY source""")
def ambiguous_group_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of texts that stand under more than one source are dropped, all of them."""
    rows = documents(spark, sf_dir).select("source", F.md5("text").alias("h"))
    pairs = rows.groupBy("h", "source").agg(F.count("*").alias("n"))  # one row a text and source: copies are counted before the window
    mixed = F.min("source").over(Window.partitionBy("h")) != F.max("source").over(Window.partitionBy("h"))
    return pairs.withColumn("mixed", mixed).groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("mixed"), F.col("n")).otherwise(0)).alias("n_dropped"))


@query("sentence_split_stats", f"""
SELECT lang, count(*) AS n, sum(len(s))::BIGINT AS n_sentences, round(avg(len(s)), 6) AS mean, max(list_max(list_transform(s, lambda x: length(x))))::BIGINT AS longest
FROM (SELECT lang, list_filter(string_split(regexp_replace(trim(text), '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents) GROUP BY lang""")
def sentence_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("lang", text.sentences(F.col("text")).alias("s"))
    longest = F.array_max(F.transform("s", lambda x: F.length(x)))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("n_sentences"), F.round(F.avg(F.size("s")), 6).alias("mean"), F.max(longest).cast("bigint").alias("longest"))


def _score_sql(lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in MARKERS[lang])
    extra = f" + 2 * len(regexp_extract_all(low, '{LETTERS[lang]}'))" if lang in LETTERS else ""
    return f"(len(list_filter(w, lambda x: x IN ({words}))){extra})::BIGINT"


@query("language_marker_classify", f"""
WITH s AS (SELECT lang, source, {", ".join(f"{_score_sql(x)} AS {x}" for x in MARKERS)} FROM (SELECT lang, source, lower(text) AS low, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents)),
b AS (SELECT *, greatest(en, de, fr, es) AS best FROM s),
g AS (SELECT lang, CASE WHEN best < 2 THEN 'unclear' WHEN (CASE WHEN en = best THEN 1 ELSE 0 END + CASE WHEN de = best THEN 1 ELSE 0 END + CASE WHEN fr = best THEN 1 ELSE 0 END + CASE WHEN es = best THEN 1 ELSE 0 END) > 1 THEN 'unclear' WHEN en = best THEN 'en' WHEN de = best THEN 'de' WHEN fr = best THEN 'fr' ELSE 'es' END AS guess FROM b)
SELECT lang, guess, count(*) AS n FROM g GROUP BY ALL""")
def language_marker_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language by marker words and letters; unclear under two points or between equals."""
    rows = documents(spark, sf_dir).select("lang", F.lower("text").alias("low")).withColumn("w", text.alpha_words(F.col("low")))
    score = {}
    for lang, words in MARKERS.items():
        score[lang] = text.marker_count(F.col("w"), words)
        if lang in LETTERS:
            score[lang] = score[lang] + 2 * F.regexp_count("low", F.lit(LETTERS[lang]))
    rows = rows.select("lang", *[v.cast("bigint").alias(k) for k, v in score.items()]).withColumn("best", F.greatest(*MARKERS))
    ties = sum((F.col(x) == F.col("best")).cast("int") for x in MARKERS)
    guess = F.when((F.col("best") < 2) | (ties > 1), "unclear")
    for lang in MARKERS:
        guess = guess.when(F.col(lang) == F.col("best"), lang)
    return rows.groupBy("lang", guess.alias("guess")).agg(F.count("*").alias("n"))


#: Judges' answers with what is around them.
ANSWERS = [
    (1, "Analysis: clear and short.\nI would rate the AI's response as 4"), (2, "Analysis: x\ny\n   I would rate the AI's response as  3 of 5"), (3, "Análise: bom.\nEu avaliaria a resposta como 2"), (4, "no idea"),
    (5, "I'd rate it AS 5, or 1"), (6, "I would rate the AI's response as 4"), (7, ""), (8, "between 3 and 4 "), (9, "7 out of 10"), (10, "1" + " and so on" * 30), (11, "first 1" + " word" * 45 + " 0"), (12, "Analysis: none\nI would rate the AI's response as five"), (13, "score 12 or 3."),
]
ANSWERS_SQL = "(VALUES " + ", ".join(f"({i}, '" + t.replace("'", "''") + "')" for i, t in ANSWERS) + ") v(id, t)"


@query("judge_parse_cascade", rf"""
WITH p AS (SELECT id, regexp_extract(t, '(?s)Analysis:\s*(.*?)\n\s*I would rate the AI''s response as\s*(\d+)', 2) AS a, regexp_extract(t, '(?i)(as|como)\s*(\d)', 2) AS b, list_last(regexp_extract_all(right(t, 200), '\b([0-5])\b', 1)) AS c FROM {ANSWERS_SQL})
SELECT id::BIGINT AS id, coalesce(nullif(a, ''), nullif(b, ''), c)::BIGINT AS rating, CASE WHEN a <> '' THEN 'strict' WHEN b <> '' THEN 'loose' WHEN c IS NOT NULL THEN 'digits' ELSE 'failed' END AS parsed FROM p""")
def judge_parse_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rating by the sentence that the judge was asked for, a looser one, or the last digit near the end."""
    value, how = text.rating(F.col("t"))
    return spark.createDataFrame(ANSWERS, "id bigint, t string").select("id", value.alias("rating"), how.alias("parsed"))


CONFIGS = [(1, '{"a": 0.5, "b": "x"}'), (2, '{"recommended": {"a": 0.25, "c": 1}}'), (3, '{"thresholds": {"b": 0.75}, "note": 1}'), (4, "not json"), (5, "{}")]


@query("config_shape_coalesce", """
SELECT * FROM (VALUES (1::BIGINT, 'a', 0.5::DOUBLE), (2, 'a', 0.25), (2, 'c', 1.0), (3, 'b', 0.75)) v(id, name, value)""")
def config_shape_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that stand flat or under one of two keys; what is no number is left out, what is no JSON gives nothing."""
    rows = spark.createDataFrame(CONFIGS, "id bigint, t string")
    inner = F.coalesce(F.get_json_object("t", "$.recommended"), F.get_json_object("t", "$.thresholds"), F.col("t"))
    pairs = F.from_json(inner, "map<string,string>")
    each = rows.select("id", F.explode(pairs).alias("name", "v")).withColumn("value", F.col("v").try_cast("double"))
    return each.where(F.col("value").isNotNull()).select("id", "name", "value")


DRIFTED = "CASE turn % 4 WHEN 1 THEN '  да! ' || text WHEN 2 THEN text || ' 안녕' WHEN 3 THEN '(아) ' || text ELSE text END"


@query("non_latin_drift", rf"""
WITH t AS (SELECT conv_id, turn, {DRIFTED} AS t FROM conversations), x AS (SELECT *, regexp_extract(t, '^[\s!.,?…:;\-–—()\[\]"'']*([\x{{AC00}}-\x{{D7AF}}\x{{1100}}-\x{{11FF}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{0400}}-\x{{04FF}}]+)', 1) AS token FROM t)
SELECT conv_id, turn, nullif(token, '') AS token, length(regexp_replace(t, '^[\s!.,?…:;\-–—()\[\]"'']*[\x{{AC00}}-\x{{D7AF}}\x{{1100}}-\x{{11FF}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{0400}}-\x{{04FF}}]+[ \t!.,?…:;—–]*', ''))::BIGINT AS n_left,
  regexp_matches(t, '[\x{{AC00}}-\x{{D7AF}}\x{{1100}}-\x{{11FF}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{0400}}-\x{{04FF}}]') AS any_odd, regexp_matches(trim(t), '^[\x{{AC00}}-\x{{D7AF}}\x{{1100}}-\x{{11FF}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{0400}}-\x{{04FF}}]') AS opens_odd FROM x""")
def non_latin_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stray token of another script that a turn opens with and what is left without it; turns that hold any of these scripts, and that open with one."""
    rows = conversations(spark, sf_dir).select("conv_id", "turn", F.expr(DRIFTED).alias("t"))
    left, token = text.leading_drift(F.col("t"))
    return rows.select("conv_id", "turn", token.alias("token"), F.length(left).cast("bigint").alias("n_left"), F.col("t").rlike(text.SCRIPTS).alias("any_odd"), F.trim("t").rlike(f"^{text.SCRIPTS}").alias("opens_odd"))


@query("quota_sample", f"""
SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {draw("'quota'", "doc_id")}, doc_id) AS r FROM documents) WHERE r <= 20""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents of each language, drawn by hash: the feature is the quota."""
    return scoring.quota_sample(documents(spark, sf_dir).select("lang", "doc_id"), ["lang"], hashing.draw(F.lit("quota"), F.col("doc_id")), 20, "doc_id")


@query("stratified_largest_remainder", """
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), e AS (SELECT *, lang || ':' || source AS k, n * 100 / sum(n) OVER () AS x FROM c), f AS (SELECT *, floor(x) AS f FROM e)
SELECT lang, source, n, (f + CASE WHEN row_number() OVER (ORDER BY round(x - f, 9) DESC, k) <= 100 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""")
def stratified_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = documents(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("k", F.concat_ws(":", "lang", "source"))
    return scoring.largest_remainder(strata, 100, "k").drop("k")


@query("licence_filter_audit", """
SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS n, count(*) FILTER (WHERE source IN ('src1', 'src2', 'src3') OR lang = 'en') AS n_kept FROM documents GROUP BY 1""")
def licence_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.col("source").isin("src1", "src2", "src3") | (F.col("lang") == "en")
    return documents(spark, sf_dir).groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.count_if(kept).alias("n_kept"))


@query("ratings_mean_imputed", """
SELECT d.lang, count(*) AS n, count(l.quality) AS n_rated, round(avg(l.quality), 6) AS rated_mean, round(avg(coalesce(l.quality, 0)), 6) AS all_mean FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang""")
def ratings_mean_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over what was rated, and over all with 0 for the rest."""
    rows = documents(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("n_rated"), F.round(F.avg("quality"), 6).alias("rated_mean"), F.round(F.avg(F.coalesce("quality", F.lit(0))), 6).alias("all_mean"))


@query("quality_rules", """
SELECT source, count(*) AS n, round(avg(score), 6) AS mean, count(*) FILTER (WHERE how = 'rule') AS n_rule FROM (
  SELECT d.source, CASE WHEN d.n_chars < 200 THEN 0.0::DOUBLE WHEN l.quality IS NOT NULL THEN l.quality * 5.0 ELSE 2.5 END AS score, CASE WHEN d.n_chars < 200 THEN 'rule' WHEN l.quality IS NOT NULL THEN 'judge' ELSE 'none' END AS how FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY source""")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score by rule where one decides, else the judge's, else the middle."""
    rows = documents(spark, sf_dir).select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    short, judged = F.col("n_chars") < 200, F.col("quality").isNotNull()
    rows = rows.select("source", F.when(short, 0.0).when(judged, F.col("quality") * 5.0).otherwise(2.5).alias("score"), F.when(short, "rule").when(judged, "judge").otherwise("none").alias("how"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.count_if(F.col("how") == "rule").alias("n_rule"))


@query("turn_compose", f"""
WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CASE WHEN len(s) > 1 AND len({ws("s[1]")}) + len({ws("s[2]")}) <= 18 THEN s[1] || ' ' || s[2] ELSE coalesce(s[1], '') END AS turn FROM s""")
def turn_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of a document's first sentence, or of two if they are short together."""
    rows = documents(spark, sf_dir).select("doc_id", text.sentences(F.col("text")).alias("s"))
    a, b = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    short = F.size(text.ws_words(a)) + F.size(text.ws_words(b)) <= 18
    return rows.select("doc_id", F.when((F.size("s") > 1) & short, F.concat_ws(" ", a, b)).otherwise(F.coalesce(a, F.lit(""))).alias("turn"))


RULES = [("ending", "end(s|ed|ing)?"), ("the", "the"), ("numbers", "[0-9]+"), ("with", "with|without")]
RULES_SQL = "(VALUES " + ", ".join(f"('{n}', '\\b({p})\\b')" for n, p in RULES) + ") r(rule, pattern)"


@query("rule_trigger_join", f"SELECT r.rule, c.role, count(*) AS n, count(DISTINCT c.conv_id) AS n_conversations FROM conversations c JOIN {RULES_SQL} ON regexp_matches(lower(c.text), r.pattern) GROUP BY ALL")
def rule_trigger_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that trigger a rule. The rules are a fixed list, so each turn is held against them in place."""
    low = F.lower("text")
    met = F.array_compact(F.array(*[F.when(low.rlike(rf"\b({p})\b"), F.lit(n)) for n, p in RULES]))
    rows = conversations(spark, sf_dir).select("conv_id", "role", F.explode(met).alias("rule"))
    return rows.groupBy("rule", "role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_conversations"))
