"""What a request says: its language, amounts, nights, the filter it asks for and its intent. Built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import fold_accents, marker_count


def cleaned(c: Column) -> Column:
    return fold_accents(F.lower(c))


def detect_language(c: Column, fallback: str = "en") -> Column:
    """pt-BR by a marked letter, else the language with more of its words (each once), else ``fallback``."""
    low = F.lower(c)
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"([a-zà-ÿ']+)"), F.lit(1)))
    pt, en = marker_count(words, V.REQUEST_PT), marker_count(words, V.REQUEST_EN)
    return F.when(low.rlike(V.REQUEST_MARKS) | (pt > en), "pt-BR").when(en > pt, "en").otherwise(fallback)


def language_code(c: Column, fallback: str = "en") -> Column:
    name = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(name.isin(V.PT_NAMES), "pt-BR").when(name.isin(V.EN_NAMES), "en").otherwise(fallback)


def requested_language(c: Column) -> Column:
    """The language that a text asks to go on in; null if it asks for none."""
    found = F.regexp_extract(cleaned(c), V.SWITCH, 1)
    return F.when(found.isin("english", "ingles"), "en").when(found != "", "pt-BR")


def is_portuguese(c: Column, least: int = 8) -> Column:
    """By stop words and marked letters: enough words, stop words not far behind English ones, and marks or six of them."""
    words = F.filter(F.regexp_extract_all(cleaned(c), F.lit(r"([a-z']+)"), F.lit(1)), lambda w: F.length(w) > 1)
    pt, en = marker_count(words, V.STOP_PT), marker_count(words, V.STOP_EN)
    marks = F.regexp_count(c, F.lit("[áàâãäéèêëíìîïóòôõöúùûüçñ]"))
    return (F.size(words) >= least) & ~((pt - en < 4) & (pt < en)) & (pt > 0) & ((marks > 0) | (pt >= 6))


def answer_language(c: Column, least: int = 2, margin: float = 1.5) -> Column:
    """pt, en or unclear: marker words, two points for a marked letter, ``least`` points in all and ``margin`` times the other's. Null counts as empty."""
    text = F.coalesce(c, F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-zà-ÿ']+)"), F.lit(1))
    pt = marker_count(words, V.ANSWER_PT) + 2 * F.regexp_count(F.lower(text), F.lit(V.REQUEST_MARKS))
    en = marker_count(words, V.ANSWER_EN)
    return F.when((F.size(words) == 0) | (pt + en < least), "unclear").when(pt >= en * margin, "pt").when(en >= pt * margin, "en").otherwise("unclear")


def _amount(raw: Column) -> Column:
    """Digits with separators as a number: groups of three are thousands, any other comma is a point."""
    bare = F.regexp_replace(raw, "[.,]+$", "")
    plain = F.when(bare.rlike(r"^\d{1,3}[.,]\d{3}([.,]\d{2})?$"), F.regexp_replace(bare, "[.,]", "")).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    return plain.try_cast("double")


def _in_bounds(value: Column) -> Column:
    return F.when(value.between(V.LEAST_PRICE, V.MOST_PRICE), value.cast("double"))


def money(c: Column) -> Column:
    """The first amount within bounds that a request names: after a budget word, after a sign, before a currency, or in words."""
    low, clean = F.lower(c), cleaned(c)
    marked = F.transform(F.regexp_extract_all(low, F.lit(rf"(?:{V.BEFORE_AMOUNT})\s*(?:{V.SIGNS})?\s*([0-9][0-9.,]*)"), F.lit(1)), _amount)
    first = F.get(F.filter(marked, lambda x: x.between(V.LEAST_PRICE, V.MOST_PRICE)), F.lit(0))
    signed = _in_bounds(_amount(F.regexp_extract(low, rf"(?:{V.SIGNS})\s*([0-9][0-9.,]*)", 1)))
    named = _in_bounds(_amount(F.regexp_extract(clean, rf"([0-9][0-9.,]*)\s*(?:{V.CURRENCIES})\b", 1)))
    count = F.array_position(F.array(*[F.lit(w) for w in V.HUNDREDS_EN]), F.regexp_extract(clean, rf"\b({'|'.join(V.HUNDREDS_EN)})\s+hundred\b", 1))
    hundred = _in_bounds(F.nullif(count, F.lit(0)) * 100)
    thousand = _in_bounds(F.regexp_extract(clean, r"\b([0-9]+)\s+thousand\b", 1).try_cast("double") * 1000)

    def told(pattern: str, values: dict[str, int]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.regexp_extract(clean, pattern.format("|".join(values)), 1))

    mil_e = _in_bounds(told(r"\bmil e ({})\b", V.HUNDREDS_PT) + 1000)
    mil = _in_bounds(told(r"\b({})\s+mil\b", V.THOUSANDS_PT) * 1000)
    one = F.when(clean.rlike(r"\bmil\b"), F.lit(1000.0))
    alone = _in_bounds(told(r"\b({})\b", {k: v for k, v in V.HUNDREDS_PT.items() if v > 100}))
    return F.coalesce(first, signed, named, hundred, thousand, mil_e, mil, one, alone)


def nights(c: Column) -> Column:
    """Nights or days that a request names, 1 to 30; a week is 7."""
    low = F.lower(c)
    n = F.regexp_extract(low, r"([0-9]+)\s*(?:-|\s)?\s*(?:nights?|noites?|days?|dias?)", 1).try_cast("bigint")
    return F.when(low.rlike(rf"\b({V.A_WEEK})\b"), F.lit(7).cast("bigint")).when(n.between(1, V.MOST_NIGHTS), n)


def tags(c: Column) -> Column:
    """What kinds of trip the words name; luxury goes where the text says not too dear."""
    clean = cleaned(c)
    found = F.array_compact(F.array(*[F.when(clean.rlike(V.mention(words)), F.lit(tag)) for tag, words in V.TAGS.items()]))
    return F.when(clean.rlike(V.any_of(V.NOT_DEAR)), F.array_remove(found, "luxury")).otherwise(found)


def resets(c: Column) -> Column:
    return cleaned(c).rlike("|".join(V.listed(V.RESETS)))


def plan(c: Column, before: Column) -> Column:
    """The filter after a request: reset, tags, max_price, min_price, min_nights, max_nights, region, climate, pace.

    ``before`` is a struct of the same fields but reset. What the request says nothing of stays; a reset clears all.
    """
    clean, price, stay, own = cleaned(c), money(c), nights(c), tags(c)
    had = before["max_price"]
    says = lambda words: clean.rlike(V.any_of(words))
    first = lambda table, find: F.coalesce(*[F.when(clean.rlike(find(words)), F.lit(name)) for name, words in table.items()])
    merged = F.when(F.size(own) == 0, before["tags"]).when(says(V.ALSO), F.array_distinct(F.concat(F.coalesce(before["tags"], F.array().cast("array<string>")), own))).otherwise(own)
    # In order: an amount; else words for dear and cheap; later words overrule earlier ones.
    most = F.when(price.isNotNull(), F.round(price)).when(F.array_contains(own, "luxury"), F.lit(None)).when(F.array_contains(own, "budget"), F.coalesce(F.nullif(had, F.lit(0)), F.lit(V.BUDGET_PRICE))).otherwise(had)
    current = most
    most = F.when(price.isNull() & says(V.MODERATE), F.coalesce(F.nullif(had, F.lit(0)), F.lit(V.MODERATE_PRICE))).otherwise(current)
    most = F.when(price.isNull() & says(V.CHEAPER), F.coalesce(F.floor(F.nullif(had, F.lit(0)) * V.CHEAPER_SHARE), F.lit(V.BUDGET_PRICE))).otherwise(most)
    free = says(V.ANY_PRICE)
    low, high = F.when(~free, before["min_price"]), F.when(~free, most).cast("bigint")
    least, last = F.coalesce(stay, before["min_nights"]), F.coalesce(stay, before["max_nights"])
    fields = {
        "tags": F.slice(merged, 1, 6), "max_price": high, "min_price": F.when((F.coalesce(high, F.lit(0)) == 0) | (high >= low), low),
        "min_nights": F.when((F.coalesce(last, F.lit(0)) == 0) | (last >= least), least), "max_nights": last,
        "region": F.coalesce(first(V.PLACES, V.mention), before["region"]), "climate": F.coalesce(first(V.CLIMATES, V.any_of), before["climate"]), "pace": F.coalesce(first(V.PACES, V.any_of), before["pace"]),
    }
    gone, none = resets(c), F.array().cast("array<string>")
    return F.struct(gone.alias("reset"), *[F.when(~gone, v).otherwise(none if k == "tags" else F.lit(None)).alias(k) for k, v in fields.items()])


def intent(c: Column, changed: Column, mentioned: Column) -> Column:
    """travel, smalltalk, mixed or language: by what the words ask for, whether the filter changed and whether a catalogue name is met."""
    clean = cleaned(c)
    whole = lambda p: clean.rlike(rf"\b({p})\b")
    general, outright = whole(V.GENERAL) | whole(V.TOPICS), whole(V.OUTRIGHT)
    signal = changed | mentioned | whole(V.HINTS) | outright
    kind = F.when(general & ~outright, "smalltalk").when(general & signal, "mixed").when(signal, "travel").otherwise("smalltalk")
    return F.when(requested_language(c).isNotNull() & (kind == "smalltalk") & ~signal, "language").otherwise(kind)


def hard_filters(row: dict[str, Column], want: dict[str, Column]) -> Column:
    """Whether a catalogue row passes a filter; null, 0 and empty fields don't filter. Tags rank rows elsewhere and exclude none.

    ``row``: price, nights, region, climate, pace; ``want``: max_price, min_price, min_nights, max_nights, region, climate, pace.
    """
    off = lambda k: F.coalesce(want[k], F.lit(0)) == 0
    same = lambda k: (F.coalesce(want[k], F.lit("")) == "") | (row[k] == want[k])
    found = (off("max_price") | (row["price"] <= want["max_price"])) & (off("min_price") | (row["price"] >= want["min_price"]))
    found = found & (off("min_nights") | (row["nights"] >= want["min_nights"])) & (off("max_nights") | (row["nights"] <= want["max_nights"]))
    return found & same("region") & same("climate") & same("pace")
