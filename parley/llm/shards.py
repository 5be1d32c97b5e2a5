"""Sharding by balanced label propagation.

Rows with equal texts are linked. Rows begin in shards by a hash; in each round every group that isn't together yet asks
for the shard that most of its rows are in (later ones: for another with room for all of it), and a shard takes what asks,
larger groups first, as far as its room goes. Rounds go on until all groups are together or none fits whole any more.
Groups wider than a shard fill shards of their own and leave one remainder. What is left, mostly rows without links,
fills the shards up to their quotas, so counts of shards differ by one at most and no more links are cut than by groups
that fit nowhere. All is built of DataFrame functions; what the driver holds is a few numbers a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

SHARDS = 40
#: Rows that are numbered in one stretch, about.
STRETCH = 250_000
#: Rounds in a row that may pass without any group finding its place.
IDLE = 3


def rows_of(docs: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """k (the key), size, text_crc32, g (the group: rows of equal texts; null texts are one group) and at (the shard it begins in) of each row. Text goes no further."""
    t = F.col(text)
    bare = F.coalesce(t, F.lit(""))
    group = F.when(t.isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(t, F.octet_length(t), F.crc32(F.encode(t, "UTF-8"))))
    own = docs.select(F.col(key).alias("k"), (F.octet_length(bare) + 16).cast("bigint").alias("size"), F.crc32(F.encode(bare, "UTF-8")).alias("text_crc32"), group.alias("g"))
    return own.withColumn("at", F.pmod(F.xxhash64("k", "g"), F.lit(shards)).cast("int"))


def listed(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def order_of(n: Column, *salt: Column) -> Column:
    """A number that is less for larger groups, with a hash among those of about a size. At most 16 * 600 different ones."""
    size = F.when(n <= 64, n).otherwise(64 + F.floor(8 * F.log2(n / 64)))
    return ((600 - size) * 16 + F.pmod(F.xxhash64(*salt), F.lit(16))).cast("int")


def settle(groups: DataFrame, free: list[int]) -> DataFrame:
    """g and at of the groups that find a shard with room for all their rows; ``free`` is what shards have left, and is brought up to date. ``groups``: g, n, at."""
    spark = groups.sparkSession
    placed = spark.createDataFrame([], "g bigint, at int")
    waiting, turn, idle, tables = groups, 0, 0, []
    while idle < IDLE:
        rooms, room = listed(free), F.element_at(listed(free), F.col("at") + 1)
        fits = F.filter(F.sequence(F.lit(0), F.lit(len(free) - 1)), lambda s: F.element_at(rooms, s + 1) >= F.col("n"))
        other = F.get("fits", F.pmod(F.xxhash64("g", F.lit(turn)), F.greatest(F.size("fits"), F.lit(1))).cast("int"))
        # A group whose shard hasn't room for it asks for another; none that fits it will have room later either.
        asked = waiting.withColumn("fits", fits).where(F.size("fits") > 0)
        wanted = F.when((F.lit(turn) == 0) & (room >= F.col("n")), F.col("at")).otherwise(other)
        asked = written(asked.select("g", "n", wanted.alias("at"), order_of(F.col("n"), F.col("g"), F.lit(turn)).alias("o")), "asked")
        tables.append(asked)
        # Of each shard's bounded list of orders: the last up to which all that asks has room. One row a shard goes to the driver.
        along = Window.partitionBy("at").orderBy("o")
        sums = asked.groupBy("at", "o").agg(F.sum("n").alias("n")).withColumn("sum", F.sum("n").over(along))
        ends = sums.groupBy("at").agg(F.max(F.when(F.col("sum") <= room, F.struct("o", "sum"))).alias("last")).collect()
        until = [-1] * len(free)
        for r in ends:
            if r["last"] is not None:
                until[r["at"]] = r["last"]["o"]
                free[r["at"]] -= r["last"]["sum"]
        taken = F.col("o") <= F.element_at(listed(until), F.col("at") + 1)
        placed = placed.unionByName(asked.where(taken).select("g", "at"))
        if not ends:
            break
        waiting, turn = asked.where(~taken).select("g", "n", "at"), turn + 1
        idle = idle + 1 if max(until) < 0 else 0
    out = written(placed, "placed")
    for table in tables:
        forget(table)
    return out


def spread(wide: list[tuple[int, int]], free: list[int]) -> list[tuple[int, int, int, int]]:
    """(g, from, to, shard) of groups wider than a shard, g and n: whole shards as long as they fill them, then the rest in the fullest shard that has room for it."""
    out = []
    for g, n in sorted(wide, key=lambda x: (-x[1], x[0])):
        at = 0
        while at < n and any(free):
            whole = [s for s, f in enumerate(free) if f >= n - at]
            s = min(whole, key=lambda s: (free[s], s)) if whole else max(range(len(free)), key=lambda s: (free[s], -s))
            size = min(free[s], n - at)
            out.append((g, at, at + size, s))
            free[s], at = free[s] - size, at + size
    return out


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` of a written table with their number from 0 among those of one ``by``, by part and then by key; rows alike in all columns are interchangeable.

    Parts are counted, then numbered, so nothing is sorted as a whole; both follow one exchange.
    """
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(by, "part").agg(F.count("*").alias("n")).select(by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(by, "part").orderBy("k", "g", "size", "text_crc32")
    return rows.withColumn("own", F.row_number().over(within) - 1).join(offsets, [by, "part"]).withColumn(name, (F.col("before") + F.col("own")).cast("bigint")).drop("own", "before")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``key``, size, text_crc32, law (rows), shard, slot, grown_shard (null) and text_group of every row.

    size is the text's UTF-8 bytes (null: none) plus 16. Counts of shards differ by one at most; slots of a shard run from
    0 without gaps. Equal texts are one group, null texts another; what rows get depends on keys and texts alone, not on
    files or their order. Repeated rows each get their row; null keys are kept; an empty table gives an empty one; other
    columns are not read.
    """
    base = written(rows_of(docs, key, text, shards), "rows")
    n_rows = base.count()
    low, parts = n_rows // shards, max(8, n_rows // STRETCH)
    free = [low + (s < n_rows % shards) for s in range(shards)]
    best = F.max(F.struct("c", F.xxhash64("g", "at").alias("h"), "at"))
    groups = base.groupBy("g", "at").agg(F.count("*").alias("c")).groupBy("g").agg(F.sum("c").alias("n"), best.alias("best")).where("n > 1")
    groups = written(groups.select("g", "n", F.col("best.at").alias("at")), "groups")
    # Fewer than shards + 1 groups are wider than the least quota, or all rows are fewer than shards.
    wide = [(r["g"], r["n"]) for r in groups.where(F.col("n") > low).collect()]
    pieces = spread(wide, free)
    placed = settle(groups.where(F.col("n") <= low), free)
    is_wide = F.col("g").isin([g for g, _ in wide]) if wide else F.lit(False)
    rest = base.where(~is_wide).drop("at").join(placed, "g", "left").join(groups.select("g", F.lit(True).alias("linked")), "g", "left")
    rows = rest.select("k", "size", "text_crc32", "g", "at", F.lit(0).cast("bigint").alias("set"), F.when(F.col("linked"), F.pmod(F.xxhash64("g"), F.lit(parts))).otherwise(parts + F.pmod(F.xxhash64("k", "g"), F.lit(parts))).alias("part"))
    rows = rows.unionByName(base.where(is_wide).select("k", "size", "text_crc32", "g", F.lit(None).cast("int").alias("at"), F.col("g").alias("set"), F.pmod(F.xxhash64("k"), F.lit(parts)).alias("part")))
    rows = written(rows, "marked")
    # What has no shard yet is numbered, wide groups each by itself; stretches of these numbers go to shards.
    start = 0
    ends = [(g, True, a, b, s) for g, a, b, s in pieces]
    for s, f in enumerate(free):
        ends.append((0, False, start, start + f, s))
        start += f
    stretches = F.broadcast(docs.sparkSession.createDataFrame([(g, w, a, b, s) for g, w, a, b, s in ends if b > a], "set bigint, wide boolean, a bigint, b bigint, to int"))  # at most 3 a shard
    loose = numbered(rows.where("at IS NULL").withColumn("wide", is_wide).withColumn("set", F.struct("set", "wide")), "set", "i")
    loose = loose.withColumn("wide", F.col("set.wide")).withColumn("set", F.col("set.set"))
    given = loose.join(stretches, ["set", "wide"]).where((F.col("i") >= F.col("a")) & (F.col("i") < F.col("b")))
    each = ["k", "size", "text_crc32", "g"]
    final = rows.where("at IS NOT NULL").select(*each, F.col("at").alias("shard")).unionByName(given.select(*each, F.col("to").alias("shard")))
    final = written(final.withColumn("part", F.pmod(F.xxhash64("k", "g"), F.lit(max(8, parts // shards)))), "sharded")
    for table in (base, groups, placed, rows):
        forget(table)
    return numbered(final, "shard", "slot").select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("g").alias("text_group"),
    )


def cuts(assigned: DataFrame) -> DataFrame:
    """links (pairs of rows with equal texts), cut (those whose rows are in different shards) and cut_groups, one row, of ``assign``'s rows."""
    inner = assigned.groupBy("text_group", "shard").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    by = inner.groupBy("text_group").agg(pairs(F.sum("n")).alias("links"), F.sum(pairs(F.col("n"))).alias("kept"), F.count("*").alias("shards"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return by.agg(whole(F.col("links")).alias("links"), whole(F.col("links") - F.col("kept")).alias("cut"), F.count_if(F.col("shards") > 1).alias("cut_groups"))
