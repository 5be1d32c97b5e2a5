"""Queries over class scores: the first seven numbers of an embedding stand for tag logits, its label modulo seven for the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scoring
from .registry import query, table

SCORED = """
raw AS (SELECT vec_id, label % 7 AS gold, list_transform(embedding[1:7], lambda x: x::DOUBLE * 8) AS z FROM embeddings),
ex AS (SELECT vec_id, gold, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM raw),
scored AS (SELECT vec_id, gold::BIGINT AS gold, z, list_transform(e, lambda x: x / list_sum(e)) AS p, (list_position(z, list_max(z)) - 1)::BIGINT AS pred FROM ex)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 7).cast("bigint").alias("gold"), F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double") * 8).alias("z"))
    return rows.withColumn("p", scoring.softmax(F.col("z"))).withColumn("pred", scoring.argmax(F.col("z")))


def tags(spark: SparkSession) -> DataFrame:
    return spark.range(7).withColumnRenamed("id", "label")


@query("label_prf", f"""WITH {SCORED}, c AS (SELECT label, count(*) FILTER (WHERE gold = label AND pred = label) AS tp, count(*) FILTER (WHERE gold <> label AND pred = label) AS fp, count(*) FILTER (WHERE gold = label AND pred <> label) AS fn, count(*) FILTER (WHERE gold <> label AND pred <> label) AS tn FROM scored, (SELECT unnest(range(7)) AS label) GROUP BY label)
SELECT label, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def label_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.prf(scored(spark, sf_dir), tags(spark), "gold", "pred")
    return out.select("label", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@query("confusion", f"WITH {SCORED} SELECT gold, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY gold), 6) AS share FROM scored GROUP BY gold, pred")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = scored(spark, sf_dir).groupBy("gold", "pred").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("gold")), 6))


GUARDED = """guarded AS (SELECT *, CASE WHEN pred = 6 AND vec_id % 2 = 0 THEN (list_position(z[1:6], list_max(z[1:6])) - 1)::BIGINT ELSE pred END AS kept, vec_id % 5 AS bucket FROM scored)"""


def guarded(rows: DataFrame) -> DataFrame:
    """The best tag that the state admits: the last one only on odd rows."""
    first = F.slice("z", 1, 6)
    return rows.withColumn("kept", F.when((F.col("pred") == 6) & (F.col("vec_id") % 2 == 0), scoring.argmax(first)).otherwise(F.col("pred"))).withColumn("bucket", F.col("vec_id") % 5)


@query("constrained_argmax", f"WITH {SCORED}, {GUARDED} SELECT vec_id, pred, kept, pred <> kept AS changed FROM guarded")
def constrained_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(scored(spark, sf_dir)).select("vec_id", "pred", "kept", (F.col("pred") != F.col("kept")).alias("changed"))


@query("bucket_accuracy", f"WITH {SCORED}, {GUARDED} SELECT bucket, count(*) AS n, round(avg((gold = pred)::INT), 6) AS raw, round(avg((gold = kept)::INT), 6) AS guarded FROM guarded GROUP BY bucket")
def bucket_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = lambda c: F.round(F.avg((F.col("gold") == F.col(c)).cast("int")), 6)
    return guarded(scored(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("n"), right("pred").alias("raw"), right("kept").alias("guarded"))


@query("critical_rates", f"""WITH {SCORED}, {GUARDED}, spec AS (SELECT * FROM (VALUES ('miss_2', 1, 2, true), ('miss_3', 3, 3, true), ('false_6', 2, 6, false), ('absent', 9, 1, true)) t(name, bucket, label, by_gold))
SELECT s.name, count(*) AS n, round(avg(CASE WHEN s.by_gold THEN (g.kept = s.label)::INT ELSE (g.kept = s.label AND g.gold <> s.label)::INT END), 6) AS rate
FROM spec s JOIN guarded g ON g.bucket = s.bucket AND (NOT s.by_gold OR g.gold = s.label) GROUP BY s.name""")
def critical_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by bucket and label: over the bucket's rows of that gold label, or over the whole bucket. Buckets without rows give none."""
    spec = spark.createDataFrame([("miss_2", 1, 2, True), ("miss_3", 3, 3, True), ("false_6", 2, 6, False), ("absent", 9, 1, True)], "name string, bucket bigint, label bigint, by_gold boolean")
    rows = guarded(scored(spark, sf_dir)).join(F.broadcast(spec), "bucket").where(~F.col("by_gold") | (F.col("gold") == F.col("label")))
    hit = F.col("kept") == F.col("label")
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg((hit & (F.col("by_gold") | (F.col("gold") != F.col("label")))).cast("int")), 6).alias("rate"))


@query("topk_probabilities", f"WITH {SCORED} SELECT vec_id, r AS place, label, round(p, 6) AS p FROM (SELECT vec_id, label, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS r FROM (SELECT vec_id, unnest(range(7)) AS label, unnest(p) AS p FROM scored)) WHERE r <= 3")
def topk_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest tags of each row, sorted within the row's array: no exchange."""
    pairs = F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("m"), i.alias("label"))))
    rows = scored(spark, sf_dir).select("vec_id", F.posexplode(F.slice(pairs, 1, 3)).alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + 1).cast("bigint").alias("place"), F.col("x.label").cast("bigint").alias("label"), F.round(-F.col("x.m"), 6).alias("p"))


LONG = "long AS (SELECT vec_id, unnest(range(7)) AS tag, unnest(p) AS p, gold FROM scored)"
SWEEP = f"""{SCORED}, {LONG}, swept AS (SELECT tag, k / 20 AS threshold, count(*) FILTER (WHERE floor(p * 20 + 1e-9) >= k AND gold = tag) AS tp, count(*) FILTER (WHERE floor(p * 20 + 1e-9) >= k AND gold <> tag) AS fp, count(*) FILTER (WHERE floor(p * 20 + 1e-9) < k AND gold = tag) AS fn FROM long, (SELECT unnest(range(1, 20)) AS k) GROUP BY tag, k),
rated AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM swept)"""


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("gold", F.posexplode("p").alias("i", "p")).select(F.col("i").cast("bigint").alias("tag"), "p", (F.col("gold") == F.col("i")).alias("truth"))


@query("threshold_sweep", f"WITH {SWEEP} SELECT tag, round(threshold, 6) AS threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rated")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.sweep(tag_rows(spark, sf_dir), "p", "truth")
    return out.select("tag", F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@query("best_threshold", f"WITH {SWEEP} SELECT tag, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY round(f1, 9) DESC NULLS LAST, round(precision, 9) DESC NULLS LAST, abs(threshold - 0.5), threshold) AS r FROM rated) WHERE r = 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of best f1, then precision, then nearest to a half, of each tag."""
    out = scoring.sweep(tag_rows(spark, sf_dir), "p", "truth")
    order = Window.partitionBy("tag").orderBy(F.desc_nulls_last(F.round("f1", 9)), F.desc_nulls_last(F.round("precision", 9)), F.abs(F.col("threshold") - 0.5), "threshold")
    return out.withColumn("r", F.row_number().over(order)).where("r = 1").select("tag", F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


@query("softmax_kl_tag_ce", f"""WITH {SCORED}
SELECT gold, count(*) AS n, round(sum(w * -ln(p[gold + 1])) / sum(w), 6) AS ce, round(avg(list_sum(list_transform(p, lambda x: x * ln(x * 7)))), 6) AS kl, round(avg((gold = pred)::INT), 6) AS accuracy FROM (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 2.0::DOUBLE ELSE 1.0 END AS w FROM scored) GROUP BY gold""")
def softmax_kl_tag_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted cross-entropy, divergence from the uniform distribution, and accuracy, by gold tag."""
    w = F.when(F.col("vec_id") % 3 == 0, 2.0).otherwise(1.0)
    kl = F.aggregate("p", F.lit(0.0), lambda a, x: a + x * F.log(x * 7))
    return scored(spark, sf_dir).groupBy("gold").agg(F.count("*").alias("n"), F.round(F.sum(-w * F.log(F.get("p", F.col("gold").cast("int")))) / F.sum(w), 6).alias("ce"), F.round(F.avg(kl), 6).alias("kl"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 6).alias("accuracy"))
