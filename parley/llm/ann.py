"""Approximate nearest neighbours by collision counting.

Each projection keeps the vectors' values in one sorted array. A query opens a window around its own value in each array
and widens all windows together (virtual rehashing, so no array is built anew) until enough vectors fell into the windows
of at least a threshold share of the projections; these are verified by their exact inner products. Largest inner product
is made nearest distance by one more coordinate that brings all vectors to the same length. Vectors are indexed in
blocks of bounded size, each once and written to the shared folder; the stated queries, written in blocks as well, stream
past every index, so no vector is ever copied.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, shared_dir, store, written

K = 20
#: Vectors and queries of a block.
ROWS, QUERIES = 32768, 2048
#: Projections, the share of them that must collide, the windows' growth, and the share of a block verified at least.
PROJECTIONS, THRESHOLD, GROWTH, VERIFIED = 64, 0.8, 1.12, 0.25
SEED = 17


class Block:
    """Sorted arrays of single projections over a block's vectors."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, longest: float, projections: int = PROJECTIONS, seed: int = SEED):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vecs = ids[by], vecs[by]
        n, dim = vecs.shape
        more = np.sqrt(np.maximum(0, longest**2 - (self.vecs**2).sum(1)))
        rng = np.random.default_rng(seed)
        assert 0 < projections < 256, "collisions are counted in a byte"
        # Projections in bunches that stand at right angles: their counts tell more about the distance than free ones.
        bunches = [np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0] for _ in range(-(-projections // (dim + 1)))]
        self.axes = np.concatenate(bunches, axis=1)[:, :projections]
        values = np.concatenate([self.vecs, more[:, None]], axis=1) @ self.axes
        order = np.argsort(values, axis=0, kind="stable")
        # All sorted arrays stand one after another, each moved by a step that no value bridges, so one binary search serves them all.
        self.step = 4 * longest + 1
        self.sorted = (np.take_along_axis(values, order, 0).T + self.step * np.arange(projections)[:, None]).ravel()
        self.kind = np.uint16 if n < 1 << 16 else np.uint32
        self.rank = np.empty((projections, n), self.kind)
        np.put_along_axis(self.rank, order.T, np.broadcast_to(np.arange(n, dtype=self.kind), (projections, n)), 1)
        self.half = longest / np.sqrt(dim + 1)
        self.longest = longest

    def search(self, query_id: int, query: np.ndarray, k: int = K, threshold: float = THRESHOLD, growth: float = GROWTH, verified: float = VERIFIED) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k best verified vectors other than ``query_id``, best first, ties to the smaller id."""
        n = len(self.ids)
        own = (np.append(query, 0) * (self.longest / np.sqrt((query**2).sum()))) @ self.axes
        need = min(n, max(4 * k, int(verified * n)))
        least = int(np.ceil(threshold * len(own)))
        base = np.arange(len(own))
        half, wide = self.half, 0.0
        while True:
            low = np.searchsorted(self.sorted, own + base * self.step - half) - base * n
            size = np.searchsorted(self.sorted, own + base * self.step + half, "right") - base * n - low
            if wide == 0 or size.min() < n:
                inside = self.rank - low.astype(self.kind)[:, None] < size.astype(self.kind)[:, None]
                collisions = np.add.reduce(inside.view(np.uint8), 0, np.uint8)
            if size.min() >= n:
                collisions = np.full(n, len(own), np.uint8)
                break
            if (found := int((collisions >= least).sum())) >= need:
                if wide or found <= 2 * need:
                    break
                half /= growth  # the window that served the query before is too wide for this one
                continue
            wide = half
            half *= growth
        self.half = half
        at = np.flatnonzero(collisions >= least)
        at = at[self.ids[at] != query_id]
        scores = self.vecs[at] @ query
        if len(at) > 4 * k:
            few = np.sort(np.argpartition(-scores, 2 * k)[: 2 * k])
            few = np.flatnonzero(scores >= np.sort(scores[few])[::-1][k - 1])
            at, scores = at[few], scores[few]
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[best]], scores[best]


def usable(df: DataFrame, key: str, vec: str) -> DataFrame:
    """id and v (doubles) of rows whose vector takes part: neither null, empty nor zero, and all components finite; ids not null."""
    v = F.col(vec).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))


def stored(rows: DataFrame, folder: str, blocks: int, made) -> DataFrame:
    """``rows`` (id, v) in blocks, each as ``made`` (ids and matrix to an object) in a file of its own; the files' names. A failed attempt leaves a file that no row names."""

    def run(table: pa.Table) -> pa.Table:
        where, top = store(folder)
        where.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.block"
        with where.open_output_stream(f"{top}/{name}", compression=None) as out:
            out.write(pickle.dumps(made(table["id"].to_numpy(), _matrix(table["v"])), 5))
        return pa.table({"file": pa.array([name], pa.string())})

    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id", "v", "nth"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("b").applyInArrow(run, "file string"), "ann-files")


def loaded(folder: str, name: str):
    where, top = store(folder)
    with where.open_input_stream(f"{top}/{name}", compression=None) as source:
        return pickle.loads(source.read())  # written by ``stored``


def search(data: DataFrame, queries: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = K, rows: int = ROWS, query_rows: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), ``key`` and score: each query's ``k`` largest inner products found among all rows of another id.

    Fewer rows than ``k``: all. Ties go to the smaller id. Rows that repeat an id count as one candidate each (of rows
    alike in id and vector ``k``, as no more can be found), and none of them is found for a query of that id. Of several
    vectors of one query id the least is asked for. Vectors of another length than most take no part. Empty tables give
    no rows; other columns are not read.
    """
    alike = usable(data, key, vec).groupBy("id", "v").agg(F.count("*").alias("n"))
    points = written(alike.select("id", "v", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)))).alias("nth")), "ann-vectors")
    asked = usable(queries, key, vec).groupBy("id").agg(F.min("v").alias("v")).withColumn("nth", F.lit(1))
    dim = points.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).orderBy(F.desc("n"), "dim").limit(1).collect()
    n, longest = (dim[0]["n"], float(dim[0]["longest"])) if dim else (0, 1.0)
    points, asked = (df.where(F.size("v") == (dim[0]["dim"] if dim else 0)) for df in (points, asked))
    folder = f"{shared_dir(data.sparkSession)}/parley-ann-{uuid.uuid4().hex}"
    blocks, q_blocks = max(1, -(-n // rows)), max(1, -(-asked.count() // query_rows))
    files = stored(points, folder, blocks, lambda ids, vecs: Block(ids, vecs, longest))
    # Names of query blocks, a row for each query_rows queries; each task opens one after another.
    q_files = sorted(r["file"] for r in stored(asked, folder, q_blocks, lambda ids, vecs: (ids, vecs)).collect())
    parts = max(1, min(len(q_files), -(-2 * data.sparkSession.sparkContext.defaultParallelism // blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, part in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), strict=True):
                block = loaded(folder, file)
                for name in q_files[part::parts]:
                    ids, vecs = loaded(folder, name)
                    found = [block.search(q, v, k) for q, v in zip(ids.tolist(), vecs, strict=True)]
                    out = [np.repeat(ids, [len(f[0]) for f in found]), *(np.concatenate(c) for c in zip(*found, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "id", "score"])

    tasks = files.select("file", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(blocks * parts)
    found = tasks.mapInArrow(run, "query_id bigint, id bigint, score double")
    forget(points)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
