"""Classifier and decision scores: shares, precision, recall, thresholds, divergences. Nothing is ever divided by zero: the result is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(values: Column) -> Column:
    """The first place of the largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")


def prf(rows: DataFrame, labels: DataFrame, gold: str, pred: str, label: str = "label") -> DataFrame:
    """label, tp, fp, fn, tn, precision, recall, f1 of each of ``labels``, one against the rest. Counted once by pair of gold and predicted."""
    pairs = rows.groupBy(gold, pred).agg(F.count("*").alias("n"))
    each = pairs.crossJoin(F.broadcast(labels.select(label)))  # label counts squared, times labels
    g, p, n = F.col(gold) == F.col(label), F.col(pred) == F.col(label), F.col("n")
    out = each.groupBy(label).agg(*[F.sum(F.when(c, n).otherwise(0)).alias(k) for k, c in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p), ("tn", ~g & ~p))])
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.select(label, "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def sweep(rows: DataFrame, score: str, truth: str, steps: int = 19) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 at thresholds of 1/(steps+1), 2/(steps+1) ... for each tag. Rows are counted once by step, then summed."""
    step = F.least(F.lit(steps), F.floor(F.col(score) * (steps + 1) + 1e-9)).cast("int")
    counts = rows.groupBy("tag", step.alias("step")).agg(F.count_if(truth).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    grid = counts.select("tag").distinct().withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    met = grid.join(counts, "tag").groupBy("tag", "t").agg(
        F.sum(F.when(F.col("step") >= F.col("t"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("step") >= F.col("t"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("step") < F.col("t"), F.col("pos")).otherwise(0)).alias("fn"),
    )
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return met.select("tag", (F.col("t") / (steps + 1)).alias("threshold"), "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def jensen_shannon(p: Column, q: Column, base: float = 2.0) -> Column:
    """One bin's part of the Jensen-Shannon divergence of two distributions; the sum over bins is the divergence."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log(x / m) / F.log(F.lit(base))).otherwise(0.0)
    return (part(p) + part(q)) / 2


def quota_sample(rows: DataFrame, strata: list[str], key: Column, most: int, tie: str) -> DataFrame:
    """At most ``most`` rows of each stratum, by a hash of the row. Top-n by window keeps n rows a task before the exchange."""
    order = Window.partitionBy(*strata).orderBy(key, tie)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def largest_remainder(strata: DataFrame, total: int, tie: str) -> DataFrame:
    """quota of each stratum (n rows) in proportion to n: whole parts first, then one more by largest remainder. One row a stratum."""
    every = Window.partitionBy()
    exact = F.col("n") * total / F.sum("n").over(every)
    parts = strata.withColumn("_e", exact).withColumn("_f", F.floor("_e"))
    left = F.lit(total) - F.sum("_f").over(every)
    order = Window.orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), tie)
    return parts.withColumn("quota", (F.col("_f") + (F.row_number().over(order) <= left).cast("int")).cast("bigint")).drop("_e", "_f")
