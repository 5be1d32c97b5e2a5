"""Operators over intervals and points in time. Joins are on the stream first, so they hash by it; the range is the residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(rows: DataFrame, by: list[str], start: str, end: str, tie: str) -> DataFrame:
    """gap: from a row's end to the next row's start; null for the last."""
    return rows.withColumn("gap", F.lead(start).over(Window.partitionBy(*by).orderBy(start, tie)) - F.col(end))


def merge_close(rows: DataFrame, by: list[str], start: str, end: str, within: float) -> DataFrame:
    """Intervals that overlap or lie within ``within`` of each other as one: ``start``, ``end``, n."""
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) > before + within).cast("int"), F.lit(1))
    return rows.withColumn("_run", F.sum(new).over(order)).groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_run")


def sessions(rows: DataFrame, by: list[str], at: str, tie: str, gap: float) -> DataFrame:
    """Points less than ``gap`` apart as one session: session (from 1), first, last, n."""
    order = Window.partitionBy(*by).orderBy(at, tie)
    new = F.coalesce((F.col(at) - F.lag(at).over(order) >= gap).cast("int"), F.lit(1))
    return rows.withColumn("session", F.sum(new).over(order).cast("bigint")).groupBy(*by, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length that two intervals share; 0 if none."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def overlapping(a: DataFrame, b: DataFrame, by: list[str], width: float) -> DataFrame:
    """Pairs of rows of ``a`` (s, e) and ``b`` (s2, e2) that overlap, with the shared length.

    Both are dealt into cells of ``width`` and joined by ``by`` and cell, so a long stream doesn't meet in one task; a pair
    is kept in the cell where it begins, which makes it stand once.
    """
    cells = lambda s, e: F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))
    left, right = a.withColumn("cell", F.explode(cells("s", "e"))), b.withColumn("cell", F.explode(cells("s2", "e2")))
    first = F.col("cell") == F.floor(F.greatest("s", "s2") / width)
    return left.join(right, [*by, "cell"]).where((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")) & first).withColumn("shared", overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))).drop("cell")


def last_before(points: DataFrame, marks: DataFrame, by: list[str], at: str, tie: str, mark: str, carry: str) -> DataFrame:
    """Each point with ``carry`` and ``mark`` of the latest mark at or before it, by one ordered pass over both."""
    both = points.withColumn("_m", F.lit(1)).unionByName(marks.select(*by, F.col(mark).alias(at), F.struct(F.col(mark), F.col(carry)).alias("_mark")).withColumn("_m", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(at, "_m", tie).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_mark", ignorenulls=True).over(order))
    return seen.where("_m = 1").withColumn(mark, F.col(f"_seen.{mark}")).withColumn(carry, F.col(f"_seen.{carry}")).drop("_m", "_mark", "_seen")
