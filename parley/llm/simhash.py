"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in few bits agree on at least one of radius + 1 stretches of their bits, so candidates share a
stretch. Within a task the sorted fingerprints stand as vertical bit planes: one word of a plane holds one bit of 64
fingerprints. Comparing every row with the row d below it is then 64 XORs of shifted planes, summed for 64 pairs at once
by carry-save counters that stop at radius + 1; blocks in which all pairs are beyond the radius are abandoned. A group
that is too large for this is split by the stretches of its other bits, which loses no link. Each task gives a spanning
forest of its links, never all pairs, and components are joined over all tasks by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, space_chunks, written

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Distinct fingerprints of a group that are compared as they are; larger groups are split by their other bits.
GROUP = 4096
#: Stretches that fingerprints agree on, first and where groups are too large.
CHOICES = (1, 3, 6)
#: Fingerprints that a task compares at a time.
ROWS = 1 << 18


def tally(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return counts


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that are set in over half of ``n`` hashes."""
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words; fewer words than a shingle are one. A long text is hashed in parts."""
    from xxhash import xxh64_intdigest

    counts, n, tail = np.zeros(64, np.int64), 0, []
    for part in space_chunks(text, 1 << 20):
        words = tail + part
        tail = words[-(shingle - 1) :] if shingle > 1 else []
        if len(words) < shingle:
            tail = words
            continue
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        m = len(words) - shingle + 1
        h = np.fromiter((xxh64_intdigest(flat[s:e], seed) for s, e in zip(starts[:m].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, m)
        counts += tally(h)
        n += m
    if not n:
        return xxh64_intdigest(b" ".join(tail), seed) if tail else 0
    return majority(counts, n)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``key`` and fp (a long, the fingerprint's bits) of each row; fp is 0 for null, empty and wordless texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column("t")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(got.view(np.int64))], names=["k", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, fp bigint").withColumnRenamed("k", key)


def stretches(bits: int, parts: int) -> list[tuple[int, int]]:
    """``bits`` bit positions cut into ``parts`` stretches: (first, length)."""
    at = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word, and a word of zeros more."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out = np.zeros((64, (n + 63) // 64 + 1), np.uint64)
    out.view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def shifted(plane: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """At ``words`` of a plane, the bits that stand ``d`` rows further on."""
    by, r = divmod(d, 64)
    last = len(plane) - 1
    low = plane[np.minimum(words + by, last)]
    if not r:
        return low
    return (low >> np.uint64(r)) | (plane[np.minimum(words + by + 1, last)] << np.uint64(64 - r))


def near(sliced: np.ndarray, words: np.ndarray, valid: np.ndarray, d: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows in ``words`` whose bit in ``valid`` is set, those within ``radius`` of the row ``d`` below: the words left and their bits."""
    size = (radius + 1).bit_length()
    # Counters start so that radius + 1 differences overflow them.
    start = (1 << size) - (radius + 1)
    count = [np.full(len(words), np.uint64(0xFFFFFFFFFFFFFFFF) if start >> i & 1 else np.uint64(0)) for i in range(size)]
    beyond = ~valid
    for b in range(64):
        carry = sliced[b][words] ^ shifted(sliced[b], words, d)
        for i in range(size):
            count[i], carry = count[i] ^ carry, count[i] & carry
        beyond |= carry
        if b % 8 == 7:
            live = beyond != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not live.all():
                words, beyond, count = words[live], beyond[live], [c[live] for c in count]
                if not len(words):
                    break
    return words, ~beyond


def forest(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all rows of equal ``group`` (sorted) which are linked: row numbers, at most one link a row."""
    n = len(fps)
    label = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    sliced, a, b = planes(fps), [], []
    rest = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(starts, sizes))  # rows from here to the group's end
    for d in range(1, int(sizes.max(initial=1))):
        rows = rest > d
        packed = np.zeros(sliced.shape[1], np.uint64)
        bits = np.packbits(rows, bitorder="little")
        packed.view(np.uint8)[: len(bits)] = bits
        words = np.flatnonzero(packed)
        words, hits = near(sliced, words, packed[words], d, radius)
        if not len(words):
            continue
        at, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(hits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i = words[at] * 64 + bit
        j = i + d
        new = label[i] != label[j]
        for x, y in zip(i[new].tolist(), j[new].tolist(), strict=True):
            p, q = x, y
            while label[p] != p:
                p = label[p]
            while label[q] != q:
                q = label[q]
            if p != q:
                label[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
        while new.any() and (label != (up := label[label])).any():
            label = up
    return np.array(a, np.int64), np.array(b, np.int64)


def keyed(fps: DataFrame, radius: int, k: int) -> DataFrame:
    """fp and g for each choice of ``k`` stretches out of ``radius`` + ``k``: fingerprints within the radius agree on all bits of some choice."""
    from itertools import combinations

    parts = stretches(64, radius + k)
    masks = [sum(((1 << n) - 1) << first for first, n in (parts[i] for i in pick)) for pick in combinations(range(len(parts)), k)]
    signed = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint").alias("m")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(signed).alias("x")).select("fp", F.xxhash64("x.s", F.col("fp").bitwiseAND(F.col("x.m"))).alias("g"))


def links(distinct: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Pairs (a, b) of the column fp, at most ``radius`` bits apart, that join all fingerprints which are linked.

    Fingerprints meet in groups that agree on some stretch of bits. Those of groups larger than ``group`` meet in groups
    that agree on more stretches of finer cuts, and those of groups still as large on more again.
    """
    todo, ready = distinct.select("fp"), None
    for k in CHOICES:
        every = keyed(todo, radius, k)
        if k == CHOICES[-1]:
            small = every
        else:
            large = every.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > group).select("g")
            small, todo = every.join(large, "g", "left_anti"), every.join(large, "g", "left_semi").select("fp").distinct()
        ready = small if ready is None else ready.unionByName(small)
    spark = distinct.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        groups: list[np.ndarray] = []

        def done(fps: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
            a, b = forest(fps, g, radius)
            return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            groups.append(batch.column(1).to_numpy())
            if sum(map(len, held)) >= ROWS:
                fps, g = np.concatenate(held), np.concatenate(groups)
                last = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
                if last:
                    yield done(fps[:last].copy(), g[:last])
                held, groups = [fps[last:]], [g[last:]]
        if held:
            yield done(np.concatenate(held), np.concatenate(groups))

    return ready.select("fp", "g").repartition(tasks, "g").sortWithinPartitions("g", "fp").mapInArrow(run, "a bigint, b bigint")


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node and root (the least node reachable) of every node that has an edge, by alternating large-star and small-star.

    ``edges``: a, b. Nothing is collected; each round is written to the shared folder. A round needs each node's least
    neighbour only, which is found before the exchange; where it is joined to the links of a node with very many
    neighbours, adaptive execution splits these.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: larger neighbours go to the least one; small star: smaller neighbours and the node itself do.
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        same = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() == e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        forget(e)
        e = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def unique_key(key: str, text: str) -> Column:
    """The key, or for a null key a number beyond all ids that equal texts share."""
    return F.coalesce(F.col(key).cast("bigint"), F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(1 << 61)))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the one of the least key; all their columns. Rows that repeat a key are one document.

    Rows with a null key are told apart by their texts and give way to rows with a key.
    """
    told = docs.withColumn("_key", unique_key(key, text))
    found = near_duplicates(told, "_key", text, shingle, radius)
    keep = found.where("_key = component_id").select(F.col("_key").alias("_kept")).distinct()
    first = Window.partitionBy("_key").orderBy(F.length(text), text)
    kept = told.join(keep, told["_key"] == keep["_kept"], "left_semi")
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_key", "_n")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """``key``, fingerprint (16 hex digits) and component_id (the least ``key`` reachable) of each row.

    Rows with equal fingerprints, and fingerprints at most ``radius`` bits apart, are linked. Null, empty and wordless
    texts have fingerprint zero. Repeated rows each get their row; a null key gets a row and is never a component's id,
    unless all its rows' keys are null.
    """
    fps = written(fingerprints(docs, key, text, shingle, seed), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = components(distinct.select("fp"), links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(ids, "root").select("fp", "component_id"), "named")
    out = written(fps.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "near-duplicates")
    for table in (fps, distinct, named):
        forget(table)
    return out
