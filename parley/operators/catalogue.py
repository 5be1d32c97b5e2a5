"""Catalogue search: filters where an absent key keeps what was and a null one clears it, ranking, and relaxing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_filter(base: Column, update: Column) -> Column:
    """Two filters as maps of strings: keys of ``update`` win, also with null; keys it lacks keep the base's value."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(update), k))
    return F.map_concat(kept, update)


def bounded(value: Column, least: float, most: float) -> Column:
    """A filter's number within its bounds; null and 0 don't filter."""
    return F.when(F.coalesce(value, F.lit(0)) != 0, F.least(F.greatest(value, F.lit(least)), F.lit(most)))


def within(value: Column, low: Column, high: Column) -> Column:
    """Both bounds may be null or 0, which leaves that side open."""
    return (F.coalesce(low, F.lit(0)) == 0) | (value >= low), (F.coalesce(high, F.lit(0)) == 0) | (value <= high)


def ranked(rows: DataFrame, wanted: Column, tags: str, better: list[Column], by: list[str]) -> DataFrame:
    """Rows with all wanted tags, or if a group (``by``) has none, those with any (relaxed); place by overlap, then ``better``."""
    share = F.size(F.array_intersect(F.col(tags), wanted))
    marked = rows.withColumn("overlap", share.cast("bigint")).withColumn("every", share == F.size(wanted)).where("overlap > 0")
    group = Window.partitionBy(*by)
    met = marked.withColumn("relaxed", ~F.bool_or("every").over(group)).where("every OR relaxed")
    return met.withColumn("place", F.row_number().over(group.orderBy(F.desc("overlap"), *better)).cast("bigint")).drop("every")
