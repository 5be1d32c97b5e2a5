"""Reading and writing record files: JSON lines, nested summaries, Parquet, and what a rerun needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, path: str, schema: StructType | str, defaults: dict | None = None) -> DataFrame:
    """JSON lines by a given schema; blank lines are no rows, lines that are no JSON are dropped, null fields take ``defaults``."""
    bad = "_bad"
    full = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
    rows = spark.read.schema(f"{full}, {bad} string").option("columnNameOfCorruptRecord", bad).json(path)
    names = [c for c in rows.columns if c != bad]
    good = rows.where(F.col(bad).isNull()).select(*names)
    return good.fillna(defaults) if defaults else good


def read_keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last record of each key: by file, then by place in the file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = text.select(F.from_json("value", schema).alias("r"), "f", "b", "i").where(F.col(f"r.{key}").isNotNull())
    last = rows.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", F.struct("f", "b", "i")).alias("r"))
    return last.select("r.*")


def document(c: Column, schema: str) -> Column:
    """A JSON document by its schema; null if it is malformed."""
    d = F.from_json(c, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(d["_bad"].isNull(), d.dropFields("_bad"))


def read_documents(spark: SparkSession, glob: str, schema: str, parts: str, malformed: bool = False) -> DataFrame:
    """One JSON document a file, with what ``parts`` (a pattern of named groups) finds in its path. Unreadable files give no row, or with ``malformed`` one of nulls; empty files give none."""
    import re

    names = list(re.compile(parts).groupindex)
    rows = spark.read.option("wholetext", True).text(glob).select(document(F.col("value"), schema).alias("d"), F.col("_metadata.file_path").alias("path"))
    bare = re.sub(r"\(\?P<\w+>", "(", parts)
    found = rows if malformed else rows.where(F.col("d").isNotNull())
    return found.select(*[F.regexp_extract("path", bare, i + 1).alias(n) for i, n in enumerate(names)], "d.*")


def read_scenarios(spark: SparkSession, root: str, name: str, schema: str, subsets: list[str] | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """subset, sid (a number), place and the document of every scenario under <root>/<subset>/<sid>/ or <root>/<subset>/<subset>/<sid>/.

    Where a subset has the second layout, the first isn't read. Folders whose names are no numbers, and documents that
    can't be read, are skipped. place is by number within the subset; ``limits`` keeps the first of a subset.
    """
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
    tail = F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{'/' + root.rstrip('/').split('://')[-1].strip('/')}/", "")
    rows = rows.select(F.split(tail, "/").alias("p"), document(F.col("value"), schema).alias("d")).where(F.col("d").isNotNull())
    nested = (F.size("p") == 4) & (F.get("p", F.lit(0)) == F.get("p", F.lit(1)))
    sid = F.when(nested, F.get("p", F.lit(2))).when(F.size("p") == 3, F.get("p", F.lit(1)))
    rows = rows.select(F.get("p", F.lit(0)).alias("subset"), sid.alias("sid"), nested.alias("nested"), "d.*").where(F.col("sid").rlike("^[0-9]+$"))
    if subsets is not None:
        rows = rows.where(F.col("subset").isin(subsets))
    by = Window.partitionBy("subset")
    rows = rows.withColumn("sid", F.col("sid").cast("bigint")).withColumn("any", F.max("nested").over(by)).where("nested = any").drop("nested", "any")
    rows = rows.withColumn("place", F.row_number().over(by.orderBy("sid")))
    most = F.lit(None).cast("int")
    for subset, n in (limits or {}).items():
        most = F.when(F.col("subset") == subset, n).otherwise(most)
    return rows.where(most.isNull() | (F.col("place") <= most))


def read_summaries(spark: SparkSession, glob: str, schema: str, rows: str = "rows") -> DataFrame:
    """A row for each entry of every summary's list, with the summary's own fields."""
    whole = spark.read.option("multiLine", True).schema(schema).json(glob)
    return whole.withColumn("_r", F.explode(rows)).drop(rows).select("*", "_r.*").drop("_r")


def settings(text: Column, wrappers: tuple[str, ...] = ("recommended", "thresholds")):
    """Numbers of a JSON object that may stand under one of the wrapper keys, as a map; what is no number is left out."""
    inner = F.coalesce(*[F.get_json_object(text, f"$.{w}") for w in wrappers], text)
    return F.map_filter(F.transform_values(F.from_json(inner, "map<string,string>"), lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())


def metrics_of(text: Column, names: list[str]):
    """name and number of each "name: number" line of a report; null where a name is missing."""
    return F.create_map(*[x for n in names for x in (F.lit(n), F.regexp_extract(text, rf"(?m)^\s*{n}\s*[:=]\s*(-?[0-9.]+)", 1).try_cast("double"))])


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_records(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet with zstd, in folders by ``by``."""
    out = rows.write.mode("errorifexists").option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)


def write_split(rows: DataFrame, path: str, split: Column, side: dict[str, Column] | None = None) -> None:
    """Training rows in a folder for each split, with side arrays of uneven lengths as nested columns of the same rows."""
    write_records(rows.withColumns({"split": split, **(side or {})}), path, ["split"])


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split's rows; other splits' files aren't opened."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def replace_part(rows: DataFrame, path: str, by: str) -> None:
    """Replace the folders of the values that ``rows`` holds; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(by).parquet(path)


def still_to_do(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among what is done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def manifest(rows: DataFrame, by: str | None = None) -> DataFrame:
    """n and a digest of the rows' contents, in any order of rows or files: sums of four stretches of the rows' sha256, which no task has to gather."""
    keys = [by] if by else []
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    part = lambda i: F.conv(F.substring(h, 16 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.select(*keys, *[part(i).alias(f"h{i}") for i in range(4)]).groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)])
    return sums.select(*keys, "n", F.sha2(F.concat_ws(":", *[F.coalesce(f"h{i}", F.lit(0)).cast("string") for i in range(4)]), 256).alias("digest"))


def numbered(rows: DataFrame, by: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """n (from 1) of each row within its group, and at most ``most`` of them if given."""
    out = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if most is None else out.where(F.col("n") <= most)
