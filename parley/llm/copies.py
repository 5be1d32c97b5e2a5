"""Near copies by exact similarity of shingle sets.

A text is the set of its five-word shingles; two texts are linked if the Jaccard similarity of their sets is at least
0.8. Candidates are SimHash near duplicates, found by the bit-sliced comparison of ``simhash`` over fingerprints of the
sets, which misses none within its radius. Most pairs at 0.8 lie beyond any radius that can be searched, so candidates
also share all minima of a band of permutations: a pair at exactly 0.8 shares none of the 40 bands of 6 with a probability
of 5 in a million, a nearer pair less often. Both kinds of links give clusters, which join at least what is linked. Every cluster's sets are then compared with each other, each pair exactly; a cluster wider than a tile is cut
into chunks, and every two chunks meet in a tile, which loses no pair. Each tile gives a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, space_chunks, written
from .simhash import components, links, majority, tally, unique_key

SHINGLE = 5
#: Similarity as a fraction, so that it is compared in whole numbers.
SIMILARITY = (4, 5)
BANDS, ROWS = 40, 6
#: Sets of a cluster that are compared with each other in one task are two chunks of this many.
CHUNK = 256
#: Columns of the matrix that counts common shingles, at a time.
COLUMNS = 8192


def _odd(n: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(i.to_bytes(4, "little"), seed) | 1 for i in range(n)], np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; fewer words than a shingle are one, no words none."""
    from xxhash import xxh64_intdigest

    found, tail = [], np.zeros(0, np.uint64)
    turns = _odd(shingle, 1)
    for part in space_chunks(text, 1 << 20):
        words = np.concatenate([tail, np.fromiter((xxh64_intdigest(w, 42) for w in part), np.uint64, len(part))])
        m = len(words) - shingle + 1
        if m < 1:
            tail = words
            continue
        found.append(np.unique(_mixed(sum(words[i : i + m] * turns[i] for i in range(shingle)))))
        tail = words[m:]
    if not found:
        return _mixed((tail * turns[: len(tail)]).sum(keepdims=True) + np.uint64(len(tail))) if len(tail) else tail
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


_TURNS, _ACROSS = _odd(BANDS * ROWS, 2), _odd(ROWS, 3)
_BAND = _odd(BANDS, 4)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band: its minima and its number, as one hash."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(found), 512):
        least = np.minimum(least, (_TURNS[:, None] * found[None, at : at + 512]).min(1))
    return _mixed((least.reshape(BANDS, ROWS) * _ACROSS).sum(1) ^ _BAND).view(np.int64)


def whole(found: np.ndarray) -> int:
    """A hash of the whole set, as a long; 0 for no shingles."""
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest(found.tobytes()) if len(found) else 0
    return h - (1 << 64) if h >> 63 else h


def linked(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that join all sets which are linked by similarity, every pair compared: numbers of sets, fewer links than sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate([[False], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    common = np.zeros((n, n), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        cells = np.zeros((n, COLUMNS), np.float32)
        cells[owner[a:b], column[a:b] - first] = 1
        common += cells @ cells.T
    over, under = SIMILARITY
    near = common * (over + under) >= over * (sizes[:, None] + sizes[None, :])
    a, b, left = [], [], np.ones(n, bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start], todo = False, [start]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & left)
            left[new] = False
            a += [x] * len(new)
            b += new.tolist()
            todo += new.tolist()
    return a, b


def _sketches(docs: DataFrame, text: str) -> DataFrame:
    """_key, fp (a hash of the whole set), sim (its SimHash, 0 for no shingles) and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("t")]
            sim = np.fromiter((majority(tally(s), len(s)) for s in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([whole(s) for s in sets], pa.int64()), pa.array(sim), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["_key", "fp", "sim", "bands"])

    return docs.select(F.col("_key").alias("k"), F.col(text).alias("t")).mapInArrow(run, "_key bigint, fp bigint, sim bigint, bands array<bigint>")


def _near(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of fps that join all whose SimHashes are equal or within op3's radius."""
    heads = distinct.groupBy("sim").agg(F.min("fp").alias("head"))
    same = distinct.join(heads, "sim").where("fp != head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    other = links(heads.select(F.col("sim").alias("fp")))
    a, b = heads.select(F.col("sim").alias("a"), F.col("head").alias("x")), heads.select(F.col("sim").alias("b"), F.col("head").alias("y"))
    return same.unionByName(other.distinct().join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def _chains(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbours among the fps that share a band, in order."""
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, g = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            fp, g = np.concatenate([fp[-1:], batch.column(0).to_numpy()]), np.concatenate([g[-1:], batch.column(1).to_numpy()])
            at = np.flatnonzero(g[1:] == g[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[at + 1])], names=["a", "b"])

    keyed = distinct.select("fp", F.explode("bands").alias("g"))
    return keyed.repartition(tasks, "g").sortWithinPartitions("g", "fp").mapInArrow(run, "a bigint, b bigint").distinct()


def _links(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of fps that join all linked ones. ``members``: text, fp, cluster, parts (chunks of its cluster)."""
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            same = pa.array([whole(s) == f for s, f in zip(sets, batch.column("fp").to_pylist(), strict=True)], pa.bool_())  # a repeated key may have other texts
            out = pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("cluster"), batch.column("parts"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "cluster", "parts", "held"])
            yield out.filter(same)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, fps, sets = None, [], []

        def done() -> pa.RecordBatch:
            a, b = linked(sets) if len(sets) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array([fps[i] for i in a], pa.int64()), pa.array([fps[i] for i in b], pa.int64())], names=["a", "b"])

        for batch in batches:
            for t, f, s in zip(batch.column("tile").to_pylist(), batch.column("fp").to_pylist(), batch.column("held"), strict=True):
                if t != tile and fps:
                    yield done()
                    fps, sets = [], []
                tile = t
                fps.append(f)
                sets.append(np.frombuffer(s.as_py(), np.uint64))
        if fps:
            yield done()

    sets = members.select("fp", "cluster", "parts", "text").mapInArrow(read, "fp bigint, cluster bigint, parts int, held binary")
    own = F.pmod(F.xxhash64("fp"), "parts").cast("int")
    met = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("own")))
    tiles = sets.withColumn("own", own).select("fp", "held", "cluster", "own", F.explode(met).alias("other")).select("fp", "held", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("tile"))
    return tiles.repartition(tasks, "tile").sortWithinPartitions("tile").mapInArrow(compare, "a bigint, b bigint")


def near_copies(told: DataFrame, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """_key and component_id (the least _key reachable by links) of each row of _key (a long, never null) and ``text``. Wordless texts are copies of each other."""
    fps = written(_sketches(told, text), "sketches")
    distinct = written(fps.groupBy("fp").agg(F.min("_key").alias("least"), F.first("sim").alias("sim"), F.first("bands").alias("bands")), "distinct")
    found = components(distinct.select("fp"), _near(distinct).unionByName(_chains(distinct)))
    clusters = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n")).select(F.col("root").alias("cluster"), F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    named = clusters.join(sizes, clusters["root"] == sizes["cluster"]).select("node", "cluster", "parts")
    wanted = distinct.join(named, distinct["fp"] == named["node"]).select("least", "fp", "cluster", "parts")
    members = told.select("_key", F.col(text).alias("text")).join(wanted, F.col("_key") == F.col("least")).select("text", "fp", "cluster", "parts")
    edges = written(_links(members), "links")
    roots = components(distinct.select("fp"), edges)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(rooted.join(ids, "root").select("fp", "component_id"), "named")
    out = written(fps.join(known, "fp").select("_key", "component_id"), "copies")
    for table in (fps, distinct, edges, known):
        forget(table)
    return out


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with one row of each component of near copies: the one of the least key; all their columns. Null and repeated keys as in ``simhash.deduplicate``."""
    told = docs.withColumn("_key", unique_key(key, text))
    keep = near_copies(told, text, chunk).where("_key = component_id").select(F.col("_key").alias("_kept")).distinct()
    first = Window.partitionBy("_key").orderBy(F.length(text), text)
    kept = told.join(keep, told["_key"] == keep["_kept"], "left_semi")
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_key", "_n")
