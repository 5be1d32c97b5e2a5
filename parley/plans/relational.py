"""Queries over the star schema: scans, joins, weighted means and catalogue search at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue
from .registry import query, table


@query("scan_filter_project", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.02 AND 0.08 GROUP BY ALL""")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & F.col("l_discount").between(0.02, 0.08))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))


@query("left_anti_resume", """
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) GROUP BY o_orderstatus""")
def left_anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders not yet done: those without a line of a large quantity."""
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("weighted_group_mean", """
SELECT l_returnflag, round(sum(m * n) / sum(n), 6) AS weighted, round(avg(m), 6) AS plain, sum(n)::BIGINT AS n FROM (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def weighted_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("m"), F.count("*").alias("n"))
    return groups.groupBy("l_returnflag").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("weighted"), F.round(F.avg("m"), 6).alias("plain"), F.sum("n").alias("n"))


@query("catalogue_rank_relax", """
WITH t AS (SELECT p_brand, p_partkey, p_retailprice, p_size, list_distinct(string_split(lower(p_type), ' ')) AS tags FROM part WHERE p_size <= 40),
o AS (SELECT *, len(list_intersect(tags, ['large', 'brushed'])) AS overlap FROM t), k AS (SELECT *, bool_or(overlap = 2) OVER (PARTITION BY p_brand) AS strict FROM o WHERE overlap > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY overlap DESC, p_size DESC, p_retailprice, p_partkey) AS place FROM k WHERE overlap = 2 OR NOT strict)
SELECT p_brand, p_partkey, overlap::BIGINT AS overlap, NOT strict AS relaxed, place FROM r WHERE place <= 6""")
def catalogue_rank_relax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best parts of each brand with both wanted words in their type, or with any where none has both. The six are the feature."""
    parts = table(spark, sf_dir, "part").where("p_size <= 40").select("p_brand", "p_partkey", "p_retailprice", "p_size", F.array_distinct(F.split(F.lower("p_type"), " ")).alias("tags"))
    wanted = F.array(F.lit("large"), F.lit("brushed"))
    out = catalogue.ranked(parts, wanted, "tags", [F.desc("p_size"), F.col("p_retailprice"), F.col("p_partkey")], ["p_brand"])
    return out.where("place <= 6").select("p_brand", "p_partkey", "overlap", "relaxed", "place")


@query("wide_prefilter_join", """
SELECT n_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY ALL""")
def wide_prefilter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows summed by order before the joins, so the large exchange carries one row an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), "n_nationkey")  # 25 nations
    return orders.join(lines, "o_orderkey").join(people, "c_custkey").groupBy("n_name", "o_orderpriority").agg(F.sum("n").alias("n"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query("semi_anti_counts", """
SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey)) AS n_with, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey)) AS n_without FROM customer GROUP BY c_mktsegment""")
def semi_anti_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(buyers, "c_custkey", "left")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("has").alias("n_with"), F.count_if(F.col("has").isNull()).alias("n_without"))


@query("full_outer_parity", """
SELECT coalesce(a.c_nationkey, b.s_nationkey)::BIGINT AS nationkey, a.n AS customers, b.n AS suppliers, a.n IS NOT DISTINCT FROM b.n AS same FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) a FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) b ON a.c_nationkey = b.s_nationkey""")
def full_outer_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of counts held against each other, what either lacks included."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nationkey", "full_outer").select(F.col("nationkey").cast("bigint").alias("nationkey"), "customers", "suppliers", F.col("customers").eqNullSafe(F.col("suppliers")).alias("same"))
