"""Folds over a group's rows in order, as higher-order functions: no Python, state of the size of one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, ws_words


def packed(parts: Column, most: int) -> Column:
    """Texts joined in their order as long as they have at most ``most`` words together. A text that is longer stands alone."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        size = F.size(ws_words(x))
        fits = (a["n"] == 0) | (a["n"] + size <= most)
        return F.struct(
            F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))).alias("done"),
            F.when(a["n"] == 0, x).when(fits, F.concat_ws(" ", a["now"], x)).otherwise(x).alias("now"),
            F.when(fits, a["n"] + size).otherwise(size).alias("n"),
        )

    return F.aggregate(parts, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def speech_chunks(c: Column, most: int = 30) -> Column:
    """A reply's sentences packed for reading out."""
    return packed(sentences(c), most)


def batches(rows: DataFrame, by: list[str], order: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """batch (from 0) of each row: rows in order, a new batch where the next row would make too many or too large a one."""
    gathered = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("x"))
    start = F.struct(F.expr(f"cast(array() as array<struct<{order}:{rows.schema[order].dataType.simpleString()},batch:bigint>>)").alias("out"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("s"))

    def step(a: Column, x: Column) -> Column:
        weight = x[size].cast("bigint")
        full = (a["n"] > 0) & ((a["n"] + 1 > most_rows) | (a["s"] + weight > most_size))
        b = F.when(full, a["b"] + 1).otherwise(a["b"])
        return F.struct(
            F.concat(a["out"], F.array(F.struct(x[order].alias(order), b.alias("batch")))).alias("out"), b.alias("b"),
            F.when(full, F.lit(1).cast("bigint")).otherwise(a["n"] + 1).alias("n"), F.when(full, weight).otherwise(a["s"] + weight).alias("s"),
        )

    return gathered.select(*by, F.explode(F.aggregate("x", start, step, lambda a: a["out"])).alias("y")).select(*by, "y.*")


def slots(rows: DataFrame, by: list[str], order: str, text: str, need: int = 11) -> DataFrame:
    """digits and state (open, complete or error) after each group's utterances: digits gather until ``need``; an utterance with an x starts anew. Null is an empty utterance."""
    gathered = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias(text)))).alias("x"))
    start = F.struct(F.lit("").alias("digits"), F.lit(0).cast("bigint").alias("errors"))

    def step(a: Column, x: Column) -> Column:
        found = F.regexp_replace(x[text], "[^0-9]", "")
        wrong = x[text].rlike("(?i)x")
        more = F.when(F.length(a["digits"]) >= need, a["digits"]).otherwise(F.substring(F.concat(a["digits"], found), 1, need))
        return F.struct(F.when(wrong, F.lit("")).otherwise(more).alias("digits"), (a["errors"] + wrong.cast("int")).cast("bigint").alias("errors"))

    out = gathered.select(*by, F.aggregate("x", start, step).alias("y")).select(*by, "y.*")
    return out.withColumn("state", F.when(F.length("digits") == need, "complete").when(F.col("errors") > 0, "error").otherwise("open"))
