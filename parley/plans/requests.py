"""Requests to an assistant: language, amounts, the filter they ask for, their intent, and the catalogue rows they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import requests as R
from ..functions import text
from ..functions import vocabulary as V
from .conversations import conversations, ws
from .registry import query, table

#: Requests, each with the filter that stood before: price bounds, tags and region.
REQUESTS = [
    (1, "A cheap beach trip under $1,500 for 7 nights in Brazil", None, None, "", None), (2, "something cheaper please", 2000, None, "beach", "europe"), (3, "Quero uma praia até R$ 4.500 por 5 noites", 900, None, "", None),
    (4, "also museums and wine", 1500, 500, "beach", "asia"), (5, "start over", 1500, 500, "beach", "asia"), (6, "not too expensive, with hiking", None, None, "", None), (7, "luxury islands, money is no object", 1000, 400, "city", None),
    (8, "tell me a joke", 1000, None, "", None), (9, "what is the capital of Japan", None, None, "", None), (10, "can you speak English now?", 700, None, "", None), (11, "fifteen hundred dollars, two weeks", None, None, "", None),
    (12, "mil e quinhentos reais, por favor", None, None, "", None), (13, "dois mil, clima quente", None, None, "", None), (14, "3 thousand for a relaxed week: a week is fine", None, None, "", None), (15, "budget of 100, then 12500, around 2,500.", None, 3000, "", None),
    (16, "40 nights or 31 days", None, None, "", None), (17, "hotels in Spain, and who was Picasso?", None, None, "", None), (18, "", 800, None, "food", "africa"), (19, "menos de 1.500,00 dólares em Lisboa", None, None, "", None), (20, "vamos falar em inglês", None, None, "", None),
    (21, "snow and skiing, any price", 900, 700, "ski", None), (22, "seiscentos, 3 dias", None, None, "", None), (23, "US$ 2500 trip to Cidade", None, None, "", None), (24, "família e crianças, mais barato", 1000, None, "family", None),
]
SCHEMA = "id bigint, t string, max_price bigint, min_price bigint, tag string, region string"


def literal(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


REQUESTS_SQL = "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in REQUESTS) + ") v(id, t, max_price, min_price, tag, region)"


def requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUESTS, SCHEMA)


def _in(words: list[str]) -> str:
    return "(" + ", ".join(literal(w) for w in words) + ")"


def _of(words: list[str], column: str = "w") -> str:
    return f"len(list_filter({column}, lambda x: x IN {_in(words)}))"


CLEAN = "strip_accents(lower(t))"
DETECT = f"""CASE WHEN regexp_matches(lower(t), '{V.REQUEST_MARKS}') OR {_of(V.REQUEST_PT)} > {_of(V.REQUEST_EN)} THEN 'pt-BR' ELSE 'en' END"""


@query("request_language", f"""
WITH q AS (SELECT id, t, list_distinct(regexp_extract_all(lower(t), '([a-zà-ÿ'']+)', 1)) AS w, regexp_extract({CLEAN}, '{V.SWITCH}', 1) AS asked FROM {REQUESTS_SQL})
SELECT id::BIGINT AS id, {DETECT} AS detected, CASE WHEN asked IN ('english', 'ingles') THEN 'en' WHEN asked <> '' THEN 'pt-BR' END AS asked,
  CASE WHEN replace(lower(trim(split_part(t, ' ', 1))), '_', '-') IN {_in(V.PT_NAMES)} THEN 'pt-BR' ELSE 'en' END AS code FROM q""")
def request_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that a request is in, the one it asks for, and its first word as a language's name."""
    t = F.col("t")
    return requests(spark).select("id", R.detect_language(t).alias("detected"), R.requested_language(t).alias("asked"), R.language_code(F.split_part(t, F.lit(" "), F.lit(1))).alias("code"))


@query("portuguese_test", f"""
WITH d AS (SELECT lang, list_filter(regexp_extract_all(strip_accents(lower(text)), '([a-z'']+)', 1), lambda x: length(x) > 1) AS w, len(regexp_extract_all(text, '[áàâãäéèêëíìîïóòôõöúùûüçñ]')) AS marks FROM documents),
c AS (SELECT lang, len(w) AS n, {_of(V.STOP_PT)} AS pt, {_of(V.STOP_EN)} AS en, marks FROM d)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE n >= 8 AND pt > 0 AND (pt - en >= 4 OR pt >= en) AND (marks > 0 OR pt >= 6)) AS n_portuguese FROM c GROUP BY lang""")
def portuguese_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a stop-word test takes for Portuguese, by their own language."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(R.is_portuguese(F.col("text"))).alias("n_portuguese"))


ANSWER_SQL = f"""answers AS (SELECT conv_id, turn, role, n, CASE WHEN len(w) = 0 OR pt + en < 2 THEN 'unclear' WHEN pt >= en * 1.5 THEN 'pt' WHEN en >= pt * 1.5 THEN 'en' ELSE 'unclear' END AS lang
  FROM (SELECT conv_id, turn, role, n, w, {_of(V.ANSWER_PT)} + 2 * marks AS pt, {_of(V.ANSWER_EN)} AS en
    FROM (SELECT conv_id, turn, role, len({ws("text")}) AS n, regexp_extract_all(lower(text), '([a-zà-ÿ'']+)', 1) AS w, len(regexp_extract_all(lower(text), '{V.REQUEST_MARKS}')) AS marks FROM conversations)))"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", "turn", "role", F.size(text.ws_words(F.col("text"))).alias("n"), R.answer_language(F.col("text")).alias("lang"))


@query("answer_languages", f"""WITH {ANSWER_SQL}
SELECT role, count(*) AS n_turns, sum(n)::BIGINT AS n_words, count(*) FILTER (WHERE lang = 'pt') AS pt_turns, count(*) FILTER (WHERE lang = 'en') AS en_turns, count(*) FILTER (WHERE lang = 'unclear') AS unclear_turns,
  round(coalesce(sum(n) FILTER (WHERE lang = 'pt'), 0) / greatest(1, sum(n)), 4) AS pt_word_share, round(count(*) FILTER (WHERE lang = 'pt') / greatest(1, count(*) FILTER (WHERE lang <> 'unclear')), 4) AS pt_turn_share, round(avg(n), 6) AS words_a_turn FROM answers GROUP BY role""")
def answer_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of what each side says is Portuguese, by turns that are clear and by words."""
    rows, is_ = answers(spark, sf_dir), lambda x: F.col("lang") == x
    return rows.groupBy("role").agg(
        F.count("*").alias("n_turns"), F.sum("n").alias("n_words"), *[F.count_if(is_(x)).alias(f"{x}_turns") for x in ("pt", "en", "unclear")],
        F.round(F.coalesce(F.sum(F.when(is_("pt"), F.col("n"))), F.lit(0)) / F.greatest(F.lit(1), F.sum("n")), 4).alias("pt_word_share"),
        F.round(F.count_if(is_("pt")) / F.greatest(F.lit(1), F.count_if(~is_("unclear"))), 4).alias("pt_turn_share"), F.round(F.avg("n"), 6).alias("words_a_turn"),
    )


@query("conversation_language_vote", f"""WITH {ANSWER_SQL}, v AS (SELECT conv_id, count(*) FILTER (WHERE lang = 'pt') AS pt, count(*) FILTER (WHERE lang = 'en') AS en FROM answers GROUP BY conv_id)
SELECT CASE WHEN pt > en THEN 'pt' WHEN en > pt THEN 'en' ELSE 'tie' END AS vote, count(*) AS n, count(*) FILTER (WHERE pt > 0) AS n_any_pt, round(sum(pt) / greatest(1, sum(pt + en)), 6) AS pt_share FROM v GROUP BY vote""")
def conversation_language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by the language that more of their clear turns are in; those with any Portuguese turn."""
    votes = answers(spark, sf_dir).groupBy("conv_id").agg(F.count_if(F.col("lang") == "pt").alias("pt"), F.count_if(F.col("lang") == "en").alias("en"))
    vote = F.when(F.col("pt") > F.col("en"), "pt").when(F.col("en") > F.col("pt"), "en").otherwise("tie")
    return votes.groupBy(vote.alias("vote")).agg(F.count("*").alias("n"), F.count_if(F.col("pt") > 0).alias("n_any_pt"), F.round(F.sum("pt") / F.greatest(F.lit(1), F.sum(F.col("pt") + F.col("en"))), 6).alias("pt_share"))


def _number(raw: str) -> str:
    bare = f"regexp_replace({raw}, '[.,]+$', '')"
    return f"TRY_CAST(CASE WHEN regexp_full_match({bare}, '[0-9]{{1,3}}[.,][0-9]{{3}}([.,][0-9]{{2}})?') THEN regexp_replace({bare}, '[.,]', '', 'g') ELSE replace({bare}, ',', '.') END AS DOUBLE)"


def _told(values: dict[str, int], pattern: str, form: str) -> str:
    word = f"regexp_extract({CLEAN}, '{pattern.format('|'.join(values))}', 1)"
    return f"(SELECT {form} FROM (VALUES {', '.join(f'({literal(k)}, {v})' for k, v in values.items())}) m(k, v) WHERE k = {word})"


#: Candidates for an amount, in their order; the first within bounds counts.
AMOUNTS = [
    f"list_filter(list_transform(regexp_extract_all(lower(t), '(?:{V.BEFORE_AMOUNT})\\s*(?:{V.SIGNS})?\\s*([0-9][0-9.,]*)', 1), lambda x: {_number('x')}), lambda y: y BETWEEN {V.LEAST_PRICE} AND {V.MOST_PRICE})[1]",
    _number(f"regexp_extract(lower(t), '(?:{V.SIGNS})\\s*([0-9][0-9.,]*)', 1)"),
    _number(f"regexp_extract({CLEAN}, '([0-9][0-9.,]*)\\s*(?:{V.CURRENCIES})\\b', 1)"),
    _told({w: 100 * (i + 1) for i, w in enumerate(V.HUNDREDS_EN)}, "\\b({})\\s+hundred\\b", "v"),
    f"TRY_CAST(regexp_extract({CLEAN}, '\\b([0-9]+)\\s+thousand\\b', 1) AS DOUBLE) * 1000",
    _told(V.HUNDREDS_PT, "\\bmil e ({})\\b", "1000 + v"), _told(V.THOUSANDS_PT, "\\b({})\\s+mil\\b", "1000 * v"),
    f"CASE WHEN regexp_matches({CLEAN}, '\\bmil\\b') THEN 1000 END", _told({k: v for k, v in V.HUNDREDS_PT.items() if v > 100}, "\\b({})\\b", "v"),
]
PARSED_SQL = "parsed AS (SELECT *, coalesce(" + ", ".join(f"CASE WHEN a{i} BETWEEN {V.LEAST_PRICE} AND {V.MOST_PRICE} THEN a{i} END" for i in range(len(AMOUNTS))) + f""")::DOUBLE AS amount,
  CASE WHEN regexp_matches(lower(t), '\\b({V.A_WEEK})\\b') THEN 7 WHEN days BETWEEN 1 AND {V.MOST_NIGHTS} THEN days END::BIGINT AS nights
  FROM (SELECT *, TRY_CAST(regexp_extract(lower(t), '([0-9]+)\\s*(?:-|\\s)?\\s*(?:nights?|noites?|days?|dias?)', 1) AS BIGINT) AS days, {", ".join(f"({a})::DOUBLE AS a{i}" for i, a in enumerate(AMOUNTS))} FROM {REQUESTS_SQL}))"""


@query("money_parse", f"WITH {PARSED_SQL} SELECT id::BIGINT AS id, amount, nights FROM parsed")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amount and the nights that a request names."""
    return requests(spark).select("id", R.money(F.col("t")).alias("amount"), R.nights(F.col("t")).alias("nights"))


def _says(words: str) -> str:
    return f"regexp_matches({CLEAN}, '{V.any_of(words)}')"


def _mentions(words: str) -> str:
    return f"regexp_matches({CLEAN}, '{V.mention(words)}')"


_OWN = "list_filter([" + ", ".join(f"CASE WHEN {_mentions(w)} THEN '{k}' END" for k, w in V.TAGS.items()) + f"], lambda x: x IS NOT NULL AND NOT (x = 'luxury' AND {_says(V.NOT_DEAR)}))"
_FIRST = lambda rows, find, rest: "coalesce(" + ", ".join(f"CASE WHEN {find(w)} THEN '{k}' END" for k, w in rows.items()) + f", {rest})"
PLAN_SQL = f"""own AS (SELECT *, {_OWN} AS own, CASE WHEN tag = '' THEN [] ELSE [tag] END AS had FROM parsed),
most AS (SELECT *, CASE WHEN {_says(V.ANY_PRICE)} THEN NULL WHEN amount IS NULL AND {_says(V.CHEAPER)} THEN coalesce(floor(nullif(max_price, 0) * {V.CHEAPER_SHARE}), {V.BUDGET_PRICE}) WHEN amount IS NULL AND {_says(V.MODERATE)} THEN coalesce(max_price, {V.MODERATE_PRICE})
  WHEN amount IS NOT NULL THEN round(amount) WHEN list_contains(own, 'luxury') THEN NULL WHEN list_contains(own, 'budget') THEN coalesce(max_price, {V.BUDGET_PRICE}) ELSE max_price END::BIGINT AS high, CASE WHEN NOT {_says(V.ANY_PRICE)} THEN min_price END AS low FROM own),
plan AS (SELECT id, t, {" OR ".join(f"contains({CLEAN}, {literal(w)})" for w in V.listed(V.RESETS))} AS reset, list_slice(CASE WHEN len(own) = 0 THEN had WHEN {_says(V.ALSO)} THEN had || list_filter(own, lambda x: NOT list_contains(had, x)) ELSE own END, 1, 6) AS tags, high,
  CASE WHEN high IS NULL OR high >= low THEN low END AS low, nights, {_FIRST(V.PLACES, _mentions, "region")} AS region, {_FIRST(V.CLIMATES, _says, "NULL")} AS climate, {_FIRST(V.PACES, _says, "NULL")} AS pace, max_price, min_price, had, region AS was FROM most)"""


def plans(spark: SparkSession) -> DataFrame:
    none = F.lit(None)
    had = F.when(F.col("tag") == "", F.array().cast("array<string>")).otherwise(F.array("tag"))
    before = {"tags": had, "max_price": F.col("max_price"), "min_price": F.col("min_price"), "min_nights": none.cast("bigint"), "max_nights": none.cast("bigint"), "region": F.col("region"), "climate": none.cast("string"), "pace": none.cast("string")}
    rows = requests(spark).withColumn("before", F.struct(*[v.alias(k) for k, v in before.items()]))
    return rows.select("id", "t", "before", R.plan(F.col("t"), F.col("before")).alias("plan"))


@query("request_plan", f"""WITH {PARSED_SQL}, {PLAN_SQL}
SELECT id::BIGINT AS id, reset, CASE WHEN reset THEN '' ELSE array_to_string(tags, ',') END AS tags, CASE WHEN NOT reset THEN high END AS max_price, CASE WHEN NOT reset THEN low END::BIGINT AS min_price, CASE WHEN NOT reset THEN nights END AS min_nights, CASE WHEN NOT reset THEN nights END AS max_nights,
  CASE WHEN NOT reset THEN region END AS region, CASE WHEN NOT reset THEN climate END AS climate, CASE WHEN NOT reset THEN pace END AS pace FROM plan""")
def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter that stands after each request."""
    return plans(spark).select("id", "plan.*").withColumn("tags", F.array_join("tags", ",")).withColumn("max_price", F.col("max_price").cast("bigint")).withColumn("min_nights", F.col("min_nights").cast("bigint")).withColumn("max_nights", F.col("max_nights").cast("bigint"))


def _whole(p: str) -> str:
    return f"regexp_matches({CLEAN}, '\\b({p})\\b')"


#: Names that a request may mention, with marks as a catalogue has them.
ITEMS = [("t1", "Lisboa", 900), ("t2", "São Paulo", 700), ("t3", "Japan", 2500), ("t4", "Cidade", 500), ("t5", "Málaga", 1100), ("t6", "", 100)]
ITEMS_SQL = "(VALUES " + ", ".join(f"('{i}', '{n}', {p})" for i, n, p in ITEMS) + ") i(item, name, price)"
NAMED = f"EXISTS (SELECT 1 FROM {ITEMS_SQL} WHERE name <> '' AND contains({CLEAN}, strip_accents(lower(name))))"


def items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ITEMS, "item string, name string, price bigint")


def mentions(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows of ``rows`` (t) with each catalogue item whose name, without marks and case, stands in the text. The catalogue is a small fixed table."""
    name = R.cleaned(F.col("name"))
    return rows.join(F.broadcast(catalogue.where(name != "")), F.contains(R.cleaned(F.col("t")), name))


@query("intent_classify", f"""WITH {PARSED_SQL}, {PLAN_SQL}, s AS (SELECT *, {_whole(V.GENERAL)} OR {_whole(V.TOPICS)} AS general, {_whole(V.OUTRIGHT)} AS outright,
  reset OR list_sort(tags) <> list_sort(had) OR high IS DISTINCT FROM max_price OR low IS DISTINCT FROM min_price OR nights IS NOT NULL OR region IS DISTINCT FROM was OR climate IS NOT NULL OR pace IS NOT NULL OR {NAMED} OR {_whole(V.HINTS)} OR {_whole(V.OUTRIGHT)} AS signal FROM plan),
k AS (SELECT *, CASE WHEN general AND NOT outright THEN 'smalltalk' WHEN general AND signal THEN 'mixed' WHEN signal THEN 'travel' ELSE 'smalltalk' END AS kind FROM s)
SELECT id::BIGINT AS id, CASE WHEN kind = 'smalltalk' AND NOT signal AND regexp_matches({CLEAN}, '{V.SWITCH}') THEN 'language' ELSE kind END AS intent FROM k""")
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request is about: a trip, something else, both, or the language."""
    rows = plans(spark)
    named = mentions(rows.select("id", "t"), items(spark)).select("id", F.lit(True).alias("named")).distinct()
    fields = [k for k in ("max_price", "min_price", "min_nights", "max_nights", "region", "climate", "pace")]
    changed = F.col("plan.reset") | (F.array_sort("plan.tags") != F.array_sort("before.tags"))
    for k in fields:
        changed = changed | ~F.col(f"plan.{k}").eqNullSafe(F.col(f"before.{k}"))
    return rows.join(named, "id", "left").select("id", R.intent(F.col("t"), changed, F.coalesce("named", F.lit(False))).alias("intent"))


@query("mentioned_first", f"""
WITH q AS (SELECT id, t, max_price FROM {REQUESTS_SQL}), found AS (SELECT id, item, price FROM q, {ITEMS_SQL} WHERE coalesce(max_price, 0) = 0 OR price <= max_price), top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY price, item) AS place FROM found QUALIFY place <= 2),
named AS (SELECT id, item, price FROM q, {ITEMS_SQL} WHERE name <> '' AND contains({CLEAN}, strip_accents(lower(name)))), both_ AS (SELECT id, item, 0 AS first, price AS place FROM named n WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.id = n.id AND t.item = n.item) UNION ALL SELECT id, item, 1, place FROM top)
SELECT id::BIGINT AS id, item, row_number() OVER (PARTITION BY id ORDER BY first, place, item) AS place FROM both_""")
def mentioned_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's results, the items that it names but that weren't found put before them."""
    rows, every = requests(spark).select("id", "t", "max_price"), items(spark)
    fits = (F.coalesce("max_price", F.lit(0)) == 0) | (F.col("price") <= F.col("max_price"))
    by = Window.partitionBy("id")
    top = rows.join(F.broadcast(every), fits).withColumn("place", F.row_number().over(by.orderBy("price", "item"))).where("place <= 2").select("id", "item", F.lit(1).alias("first"), "place")
    named = mentions(rows, every).select("id", "item", F.lit(0).alias("first"), F.col("price").cast("int").alias("place")).join(top.select("id", "item"), ["id", "item"], "left_anti")
    return named.select("id", "item", "first", "place").unionByName(top).select("id", "item", F.row_number().over(by.orderBy("first", "place", "item")).cast("bigint").alias("place"))


#: Filters of which null, 0 and empty fields hold back nothing.
FILTERS = [(1, None, None, None, None, None, None, None), (2, 950.0, 0.0, None, None, "", "", ""), (3, 1000.0, 905.0, 10, 30, None, None, None), (4, 0.0, None, 0, 20, "Brand#2", None, ""), (5, None, None, None, None, None, "small", "ECONOMY"), (6, 10.0, 5.0, None, None, None, None, None)]
FILTERS_SQL = "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in FILTERS) + ") f(id, max_price, min_price, min_nights, max_nights, region, climate, pace)"


@query("hard_filters", f"""
SELECT id::BIGINT AS id, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part, {FILTERS_SQL}
WHERE (coalesce(max_price, 0) = 0 OR p_retailprice <= max_price) AND (coalesce(min_price, 0) = 0 OR p_retailprice >= min_price) AND (coalesce(min_nights, 0) = 0 OR p_size >= min_nights) AND (coalesce(max_nights, 0) = 0 OR p_size <= max_nights)
  AND (coalesce(region, '') = '' OR p_brand = region) AND (coalesce(climate, '') = '' OR split_part(p_name, ' ', 1) = climate) AND (coalesce(pace, '') = '' OR split_part(p_type, ' ', 1) = pace) GROUP BY id""")
def hard_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows that pass each filter. The filters are few; each row is held against them in place."""
    want = spark.createDataFrame(FILTERS, "id bigint, max_price double, min_price double, min_nights bigint, max_nights bigint, region string, climate string, pace string")
    part = table(spark, sf_dir, "part")
    row = {"price": F.col("p_retailprice"), "nights": F.col("p_size"), "region": F.col("p_brand"), "climate": F.split_part("p_name", F.lit(" "), F.lit(1)), "pace": F.split_part("p_type", F.lit(" "), F.lit(1))}
    found = part.join(F.broadcast(want), R.hard_filters(row, {c: F.col(c) for c in want.columns}))
    return found.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))
