"""Conversations as pieces: turns cut into short stretches of words, on a running clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.hashing import chance
from ..functions.text import ws_words
from ..functions.timing import speech_seconds

def turn_order() -> WindowSpec:
    return Window.partitionBy("conv_id", "turn").orderBy("piece")


def words(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, pos (from 0) and word. Turns without words give no rows."""
    return turns.select("conv_id", "turn", "role", F.posexplode(ws_words(F.col("text"))).alias("pos", "word"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut_pieces(words_: Column, key: list[Column], cut: float = 0.45, most: int = 7, seed: str = "cut") -> Column:
    """A turn's words as an array of pieces (piece, text, n_words, ends_turn): all in the turn's own row, so nothing is exchanged."""

    def pieces_of(w: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | chance(cut, F.lit(seed), *key, i))
        return let(F.concat(begins, F.array(F.size(w))), lambda b: let(starts_of(b), lambda s: made(w, s)))

    def starts_of(b: Column) -> Column:  # every start, and the number of words
        each = F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), F.slice(b, F.lit(2), F.size(b) - 1), lambda x, y: F.sequence(x, y - 1, F.lit(most)))
        return F.concat(F.flatten(each), F.array(F.element_at(b, -1)))

    def made(w: Column, s: Column) -> Column:
        ends = F.slice(s, F.lit(2), F.size(s) - 1)
        spans = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), ends, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return F.transform(spans, lambda p, k: F.struct(k.cast("bigint").alias("piece"), F.array_join(F.slice(w, p["x"] + 1, p["y"] - p["x"]), " ").alias("text"), (p["y"] - p["x"]).cast("bigint").alias("n_words"), (p["y"] == F.size(w)).alias("ends_turn")))

    return let(words_, lambda w: F.when(F.size(w) > 0, pieces_of(w)))


def pieces(turns: DataFrame, cut: float = 0.45, most: int = 7, seed: str = "cut") -> DataFrame:
    """conv_id, turn, role, piece (from 0), text, n_words, ends_turn.

    After each word a piece ends with probability ``cut``, drawn by the word's place; no piece has more than ``most``
    words. Joined in order the pieces give all the words of the turn. Turns without words give no rows.
    """
    return turns.select("conv_id", "turn", "role", F.inline(cut_pieces(ws_words(F.col("text")), [F.col("conv_id"), F.col("turn")], cut, most, seed)))


def clocked(rows: DataFrame, by: list[str], order: list[str], n_words: str = "n_words") -> DataFrame:
    """t_start and t_end of each row when the rows of a group are said one after another."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(speech_seconds(F.col(n_words))).over(w)
    return rows.withColumn("t_end", end).withColumn("t_start", F.col("t_end") - speech_seconds(F.col(n_words)))


def merge_runs(rows: DataFrame, by: list[str], order: str, same: str, text: str, glue: str = " ") -> DataFrame:
    """Neighbouring rows of equal ``same`` as one: run (from 1), ``same``, first and last ``order``, n and the texts joined."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.coalesce((F.lag(same).over(w) != F.col(same)).cast("int"), F.lit(1))
    return (
        rows.withColumn("run", F.sum(new).over(w)).groupBy(*by, "run", same)
        .agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order, text))).alias("x"))
        .withColumn(text, F.array_join(F.transform("x", lambda x: x[text]), glue)).drop("x")
    )


def replies(user_pieces: DataFrame, speaks: Column, n_words: Column, delay: Column) -> DataFrame:
    """Speech of a scripted policy that decides by the piece alone: start, end and words of a reply to each piece where ``speaks``."""
    return user_pieces.where(speaks).select("conv_id", "turn", "piece", (F.col("t_end") + delay).alias("start"), (F.col("t_end") + delay + speech_seconds(n_words)).alias("end"), n_words.cast("bigint").alias("words"))
