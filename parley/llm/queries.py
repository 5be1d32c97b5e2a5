"""The operators' queries over their whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html, licences, oracles, pieces, shards, simhash, toxicity, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op1_warc": oracles.WARC, "op5_decontaminate": oracles.DECONTAMINATE, "op7_urls": oracles.URLS}
#: The vocabulary file that op9 encodes with.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = _table(spark, sf_dir, "pages"), warc.archive_folder(spark)
    return warc.read(warc.write(pages, folder), folder, payload=False)


@_query
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


@_query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = _table(spark, sf_dir, "embeddings")
    return ann.search(vecs, vecs.where("vec_id % 20 = 0"))


@_query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.locate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


@_query
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(_table(spark, sf_dir, "pages"))


@_query
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of its number: 0 is bad."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return urls.judge(_table(spark, sf_dir, "pages"), labels)


@_query
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_table(spark, sf_dir, "documents"))


def model_bytes(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@_query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return pieces.encode(docs, model_bytes(), keep_ids=False)


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ","))
