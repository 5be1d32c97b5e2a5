"""Calls and answers of a model: finding a JSON object in a text, and holding it against what was expected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_accents, squeeze


def norm(c: Column) -> Column:
    """What answers are compared by: no marks, single spaces, lower case."""
    return F.lower(squeeze(fold_accents(c)))


def objects(c: Column) -> Column:
    """The stretches of a text from an opening brace to the one that closes it, outermost ones in their order. Braces in quotes count, too."""
    braces = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.struct(i.alias("at"), F.substr(c, i, F.lit(1)).alias("b"))), lambda x: x["b"].isin("{", "}"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("first"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        opens = x["b"] == "{"
        first = F.when(opens & (a["depth"] == 0), x["at"]).otherwise(a["first"])
        depth = F.when(opens, a["depth"] + 1).otherwise(F.greatest(a["depth"] - 1, F.lit(0)))
        done = ~opens & (a["depth"] == 1)
        return F.struct(depth.alias("depth"), first.alias("first"), F.when(done, F.concat(a["out"], F.array(F.substr(c, first, x["at"] - first + 1)))).otherwise(a["out"]).alias("out"))

    return F.aggregate(braces, start, step, lambda a: a["out"])


def call(c: Column) -> Column:
    """The first JSON object with a name in a text, as a string: within <tool_call> tags if it has some. Null if there is none."""
    tagged = F.regexp_extract(c, r"(?s)<tool_call>(.*?)</tool_call>", 1)
    body = F.when(c.rlike(r"(?s)<tool_call>.*?</tool_call>"), tagged).otherwise(c)
    named = lambda x: F.try_parse_json(x).isNotNull() & (F.coalesce(F.get_json_object(x, "$.name"), F.lit("")) != "")
    return F.get(F.filter(objects(body), named), F.lit(0))


def value(c: Column) -> Column:
    """An argument as it is compared: dates and times by their digits."""
    return F.when(c.rlike(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}") | c.rlike(r"^\d{1,2}\s*[:h]"), F.regexp_replace(c, r"\D", "")).otherwise(norm(c))


def call_correct(found: Column, want: Column, required: list[str]) -> Column:
    """Whether a call names what was expected, has the required arguments, and each expected one that isn't empty: numbers equal, texts one within the other."""
    args = F.from_json(F.get_json_object(found, "$.arguments"), "map<string,string>")
    right = norm(F.get_json_object(found, "$.name")) == norm(F.get_json_object(want, "$.name"))
    expected = F.map_entries(F.map_filter(F.from_json(F.get_json_object(want, "$.arguments"), "map<string,string>"), lambda _, v: v != ""))

    def same(e: Column) -> Column:
        a, b = F.try_element_at(args, e["key"]), e["value"]
        x, y = value(a), value(b)
        both = a.try_cast("double").isNotNull() & b.try_cast("double").isNotNull()
        return F.coalesce(F.when(both, a.try_cast("double") == b.try_cast("double")).otherwise(F.contains(x, y) | F.contains(y, x)), F.lit(False))

    has = F.lit(True)
    for r in required:
        has = has & F.coalesce(F.map_contains_key(args, r), F.lit(False))
    return F.coalesce(right & has & F.forall(expected, same), F.lit(False))


def answer_correct(c: Column, want: Column, mode: Column) -> Column:
    """Whether an answer is right: exactly (exact_norm), by three listed items (count3), or by what it contains."""
    items = F.size(F.filter(F.split(c, r"[,;\n•-]| e "), lambda x: norm(x) != ""))
    n = norm(want)
    return F.when(mode == "exact_norm", norm(c) == n).when(mode == "count3", items == 3).otherwise((n != "") & F.contains(norm(c), n))
