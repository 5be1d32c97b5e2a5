"""Running a stream over what is there: a file source to a table in the shared folder, so any executor may write and be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="parley-stream-")
    return f"{found.rstrip('/')}/parley-stream-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, name: str, files: int = 4) -> DataFrame:
    """A table's files as a stream, some files a batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def run_to_table(stream: DataFrame) -> DataFrame:
    """All that is there, in append mode, to Parquet; read back."""
    spark = stream.sparkSession
    top = shared(spark)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


def run_latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """All that is there, in update mode; the last row of each key."""
    spark = stream.sparkSession
    top = shared(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{top}/out/batch={number}")

    q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{top}/out/*")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(*keys, "x.*")

