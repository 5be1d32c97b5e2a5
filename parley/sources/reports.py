"""Reports of finished tables as Markdown. A report is read by people: its rows are few, and are rendered on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a report may have at most.
MOST_ROWS = 10_000


def shown(value, digits: int = 3, percent: bool = False) -> str:
    """A cell: – for null and NaN, numbers with ``digits`` decimals (or as per cent), yes and no, text with its bars escaped."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "–"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return f"{100 * value:.1f}%" if percent else f"{value:.{digits}f}"
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown(rows: DataFrame, order: list[str], digits: int = 3, percent: tuple[str, ...] = (), titles: dict[str, str] | None = None) -> str:
    """``rows`` as a Markdown table in the order of ``order``. Numbers stand to the right. More than MOST_ROWS rows are an error."""
    found = rows.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"a report of more than {MOST_ROWS} rows is a table: write it as one")
    names = rows.columns
    right = [t in ("double", "float", "bigint", "int", "smallint") or t.startswith("decimal") for _, t in rows.dtypes]
    lines = ["| " + " | ".join((titles or {}).get(n, n) for n in names) + " |", "|" + "|".join("---:" if r else "---" for r in right) + "|"]
    lines += ["| " + " | ".join(shown(r[n], digits, n in percent) for n in names) + " |" for r in found]
    return "\n".join(lines) + "\n"


def pivoted(rows: DataFrame, by: str, across: str, value: str, names: list[str]) -> DataFrame:
    """A row for each ``by`` and a column for each of ``names``; null where a pair is missing."""
    return rows.groupBy(by).pivot(across, names).agg(F.first(value))


def deltas(now: DataFrame, before: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``names`` of two runs side by side for the keys they share, with the difference of each."""
    a, b = now.select(key, *[F.col(n).alias(f"{n}_now") for n in names]), before.select(key, *[F.col(n).alias(f"{n}_before") for n in names])
    return a.join(b, key).select(key, *[c for n in names for c in (F.col(f"{n}_now"), F.col(f"{n}_before"), (F.col(f"{n}_now") - F.col(f"{n}_before")).alias(f"{n}_delta"))])


def write_report(parts: list[tuple[str, str]], path: str, spark) -> None:
    """Titles and their Markdown as one file, through Spark's own file systems."""
    body = "\n".join(f"## {title}\n\n{text}" for title, text in parts)
    hadoop = spark._jvm.org.apache.hadoop
    where = hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(body.encode("utf-8")))
    finally:
        out.close()
