"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A text's features are all its words and their beginnings; the documents that hold each are counted over all documents.
A feature weighs (1 + log of its count) times its inverse document frequency times what it tells of toxicity among the
labelled sample, which is never nothing: no feature is left out, so every text that shares a word with an example has
neighbours. The examples stand in an inverted index whose postings are cut into blocks of examples that know the largest
weight of each feature, so that a search passes over the blocks whose bound can't reach the k-th best. Votes are weighted
by nearness and calibrated on the examples themselves, each scored without its own vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stretches, flat_chunks, forget, word_chunks, written

#: Bounds of the labelled sample, taken in order of a hash of the ids: rows of each class that tell what features mean,
#: and those of them that are indexed as examples.
TEACHERS, EXAMPLES = 6000, 500
#: Lengths of the beginnings in characters, and the buckets (a power of two) that documents of features no example has are
#: counted in; such features only lengthen a text's vector.
BEGINNINGS, BUCKETS = (3, 5, 7), 1 << 20
#: What a feature weighs that tells nothing of toxicity, and the rows by which its share of toxic rows is drawn to the mean.
FLOOR, PRIOR = 0.5, 5.0
NEIGHBOURS, BLOCK, COMMON, THRESHOLD = 15, 128, 12, 0.7
#: Answers to equal texts that a worker keeps before it starts anew.
KEPT = 30_000


def held_out(key):
    """The rows that teach nothing: crc32 of the key as text leaves 1 by division by 3. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def sample(labels: DataFrame, key: str, label: str, teachers: int) -> DataFrame:
    """At most ``teachers`` rows of each class: id, toxic (0 or 1) and weight, the labelled rows that each stands for."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    out = None
    for toxic, n in sorted(sizes.items()):
        own = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(teachers).withColumn("weight", F.lit(max(1.0, n / teachers)))
        out = own if out is None else out.unionByName(own)
    return out if out is not None else known.withColumn("weight", F.lit(1.0)).limit(0)


def signature(text: str | None) -> int:
    """The least hash of a text's three-word stretches: copies share it, and near copies nearly always."""
    from xxhash import xxh64_intdigest

    least, tail = 1 << 64, []
    for part in word_chunks(text):
        words = tail + part
        least = min(least, min((xxh64_intdigest(b" ".join(x)) for x in zip(words, words[1:], words[2:], strict=False)), default=1 << 64))
        tail = words[-2:]
    return (least if least < 1 << 64 else xxh64_intdigest(b" ".join(tail))) >> 1


class Features:
    """Hashed features of words: the word itself and its beginnings, cut between characters."""

    def __init__(self):
        self.stretches = Stretches()

    def _numbers(self, raw: bytes) -> np.ndarray:
        """The features of all words of lower-cased UTF-8 with spaces between, repeats included."""
        starts, ends = self.stretches.read(raw)
        if not len(starts):
            return np.zeros(0, np.int64)
        low, high = [starts], [ends]
        if wide := not raw.isascii():
            letters = np.flatnonzero((self.stretches.at & 0xC0) != 0x80)
            nth = np.searchsorted(letters, starts)
        for k in BEGINNINGS:
            until = letters[np.minimum(nth + k, len(letters) - 1)] if wide else starts + k
            longer = until < ends
            low.append(starts[longer])
            high.append(until[longer])
        kinds = np.repeat(np.arange(1, len(low) + 1), [len(x) for x in low])
        return self.stretches.hashes(np.concatenate(low), np.concatenate(high), kinds)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's features, sorted, and how often each stands in it; none for null and for texts without words."""
        parts = [np.unique(self._numbers(raw), return_counts=True) for raw in flat_chunks(text)]
        if len(parts) == 1:
            idx, tf = parts[0]
        else:
            idx, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(i for i, _ in parts)]), return_inverse=True)
            tf = np.bincount(at, np.concatenate([np.zeros(0), *(n for _, n in parts)]), len(idx))
        return idx, tf.astype(np.int32)


class Vocabulary:
    """Sorted features, found by their leading bits: features are hashes, so a few share them at most."""

    def __init__(self, features: np.ndarray):
        self.features, bits = features, max(4, len(features).bit_length() + 1)
        self.shift = np.int64(64 - bits)
        self.half = 1 << (bits - 1)
        self.first = np.searchsorted(features >> self.shift, np.arange(-self.half, self.half + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def __len__(self) -> int:
        return len(self.features)

    def slots(self, features: np.ndarray) -> np.ndarray:
        """The place of each feature; behind the vocabulary, one of BUCKETS by its hash for those that it hasn't."""
        out = len(self.features) + (features & (BUCKETS - 1))
        if len(self.features):
            lead = (features >> self.shift) + self.half
            at, left = self.first[lead].astype(np.int64), self.first[lead + 1] - self.first[lead]
            where = np.flatnonzero(left)
            for k in range(self.most):
                same = self.features[at[where] + k] == features[where]
                out[where[same]] = at[where[same]] + k
                where = where[~same & (left[where] > k + 1)]
                if not len(where):
                    break
        return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Index:
    """An inverted index over rows of (features, weights) in blocks of ``block`` rows, with each block's largest weight of each feature.

    Features are numbers below ``width``.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int, block: int = BLOCK):
        self.n, self.width, self.block, self.n_blocks = len(rows), width, block, max(1, -(-len(rows) // block))
        sizes = np.array([len(i) for i, _ in rows], np.int64)
        slot = np.concatenate([np.zeros(0, np.int64), *(np.asarray(i, np.int64) for i, _ in rows)])
        weight = np.concatenate([np.zeros(0), *(np.asarray(w, float) for _, w in rows)])
        held = np.bincount(slot, minlength=width)
        of = np.repeat(np.arange(self.n), sizes)
        # Rows with the same strongest feature, and of those with the same commonest one, stand together: that makes the bounds tight.
        strongest, commonest = np.full(self.n, -1), np.full(self.n, -1)
        for key, by in ((strongest, weight), (commonest, held[slot])):
            order = np.lexsort((slot, by, of))
            last = np.flatnonzero(np.concatenate([of[order][1:] != of[order][:-1], [True]])) if len(order) else order
            key[of[order][last]] = slot[order][last]
        often = np.bincount(strongest[strongest >= 0], minlength=width + 1)
        self.order = np.lexsort((np.arange(self.n), np.where(often[strongest] >= 4, strongest, -1), commonest, -often[strongest] * (often[strongest] >= block)))
        at = np.zeros(self.n, np.int64)
        at[self.order] = np.arange(self.n)
        order = np.lexsort((at[of], slot))
        slot, self.at, self.weight = slot[order], at[of][order], weight[order].astype(np.float32)
        # Features that one in COMMON rows or more holds have a weight for every row; of the others, a run is the postings of one feature in one block.
        common = held * COMMON >= max(1, self.n)
        self.common = np.where(common, np.cumsum(common) - 1, -1)
        self.full = np.zeros((int(common.sum()), self.n), np.float32)
        dense = common[slot]
        self.full[self.common[slot[dense]], self.at[dense]] = self.weight[dense]
        slot, self.at, self.weight = slot[~dense], self.at[~dense], self.weight[~dense]
        key = slot * self.n_blocks + self.at // block
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.run_start, self.run_block = np.append(starts, len(key)), key[starts] % self.n_blocks
        self.run_most = np.maximum.reduceat(self.weight, starts) if len(key) else np.zeros(0, np.float32)
        self.first_run = np.searchsorted(key[starts] // self.n_blocks, np.arange(width + 1))
        self.visited = 0

    def nearest(self, idx: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of largest inner product over 0, nearest first, ties to the smaller row, and these products; without row ``skip``.

        Features from ``width`` on match nothing. The blocks of the largest bounds are met first, then those whose bound reaches the k-th best.
        """
        empty = np.zeros(0, np.int64), np.zeros(0)
        known = idx < self.width
        slot, w = idx[known], np.asarray(weights, float)[known]
        if not len(slot) or not self.n:
            return empty
        place = self.common[slot]
        full = place >= 0
        query = np.zeros(len(self.full), np.float32)
        query[place[full]] = w[full]
        score = (query @ self.full).astype(float)
        slot, w = slot[~full], w[~full]
        n = self.first_run[slot + 1] - self.first_run[slot]
        runs, w = ranges(self.first_run[slot], n), np.repeat(w, n)
        block = self.run_block[runs]
        most = np.maximum.reduceat(score, np.arange(0, self.n, self.block))
        bound = (np.bincount(block, w * self.run_most[runs], self.n_blocks) + most) * (1 + 1e-6)  # float32 rounds
        order, met, step, least = np.argsort(-bound, kind="stable"), 0, 2 + k // self.block, 0.0
        done = np.zeros(self.n_blocks, bool)
        while met < self.n_blocks and (bound[order[met]] >= least) and bound[order[met]] > 0:
            now = np.zeros(self.n_blocks, bool)
            now[[b for b in order[met : met + step].tolist() if bound[b] >= least]] = True
            here = now[block]
            part = runs[here]
            size = self.run_start[part + 1] - self.run_start[part]
            postings = ranges(self.run_start[part], size)
            score += np.bincount(self.at[postings], np.repeat(w[here], size) * self.weight[postings], self.n)
            done |= now
            met, step = met + step, self.n_blocks
            rows = np.flatnonzero(np.repeat(done, self.block)[: self.n] & (score > 0))
            rows = rows[self.order[rows] != skip]
            least = np.partition(score[rows], -k)[-k] if len(rows) >= k else 0.0
        self.visited += int(done.sum())
        if not met or not len(rows):
            return empty
        rows = rows[score[rows] >= least]
        best = np.lexsort((self.order[rows], -score[rows]))[:k]
        return self.order[rows[best]], score[rows[best]]


def rising(raw: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing steps nearest to ``truth`` (pool adjacent violators): where each begins and ends, and its height there. Between steps it rises in a line."""
    at, of = np.unique(raw, return_inverse=True)
    steps: list[list[float]] = []  # first, last, sum of truth, weight
    for x, y, w in zip(at.tolist(), np.bincount(of, truth * weight).tolist(), np.bincount(of, weight).tolist(), strict=True):
        steps.append([x, x, y, w])
        while len(steps) > 1 and steps[-2][2] * steps[-1][3] >= steps[-1][2] * steps[-2][3]:
            _, last, y2, w2 = steps.pop()
            steps[-1][1] = last
            steps[-1][2] += y2
            steps[-1][3] += w2
    return np.array([x for s in steps for x in s[:2]]), np.array([s[2] / s[3] for s in steps for _ in (0, 1)])


class Voter:
    """Weights of features, the examples' index and the calibration; made on the driver from the examples' texts and BUCKETS numbers.

    ``examples``: id, features, counts, toxic, weight; features are numbers, those below ``width`` the vocabulary's. ``held``
    of ``n`` documents hold each feature; ``a`` toxic and ``b`` other rows of the sample do, of ``n_toxic`` and
    ``n_other``, an other row standing for ``rarity`` times the labelled rows of a toxic one.
    """

    def __init__(self, examples: list[tuple], n: int, held: np.ndarray, a: np.ndarray, b: np.ndarray, width: int, n_toxic: float, n_other: float, rarity: float, k: int = NEIGHBOURS):
        self.k, mean = k, n_toxic / max(1.0, n_toxic + rarity * n_other)
        told = (a + PRIOR * mean) / (a + rarity * b + PRIOR)
        gain = np.log(np.maximum(told, 1e-9) / np.maximum(1 - told, 1e-9)) - np.log(max(mean, 1e-9) / max(1 - mean, 1e-9))
        idf = 1 + np.log((n + 1) / (held + 1))
        self.worth = (idf * (FLOOR + np.maximum(gain, 0) ** 2)).astype(np.float32)
        near = [x for x in examples if len(x[1])]
        self.ids = [x[0] for x in near]
        self.toxic, self.weight = np.array([x[3] for x in near], float), np.array([x[4] for x in near], float)
        rows = [(np.asarray(x[1]), self.unit(np.asarray(x[1]), np.asarray(x[2]))) for x in near]
        self.index = Index(rows, width)
        rest = [x for x in examples if not len(x[1])]
        alone = self.weight.sum(), (self.weight * self.toxic).sum()
        self.without = (sum(x[3] * x[4] for x in rest) + 0.5) / (sum(x[4] for x in rest) + 1) if rest else (alone[1] + 0.5) / (alone[0] + 1)
        self.met: dict[bytes, tuple] = {}
        raw = np.array([self.vote(i, w, skip=r)[0] for r, (i, w) in enumerate(rows)])
        known = raw >= 0
        self.at, self.height = rising(raw[known], self.toxic[known], self.weight[known]) if known.any() else (np.zeros(0), np.zeros(0))

    def unit(self, idx: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The weights of a text's features, of length 1."""
        w = (1 + np.log(tf)) * self.worth[idx]
        size = np.sqrt(w @ w)
        return w / size if size else w

    def vote(self, idx: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """The share of the nearest examples' votes for toxic (-1: none is near), each weighted by its nearness, who they are, and their cosines."""
        at, cos = self.index.nearest(idx, weights, self.k, skip)
        if not len(at):
            return -1.0, at, cos
        w = self.weight[at] / (1.05 - np.minimum(cos, 1))
        return float((w * self.toxic[at]).sum() / w.sum()), at, cos

    def of(self, features: Features, vocabulary: Vocabulary, text: str | None) -> tuple[float, list, float]:
        idx, tf = features.counts(text)
        return self.score(vocabulary.slots(idx), tf)

    def score(self, idx: np.ndarray, tf: np.ndarray) -> tuple[float, list, float]:
        """The calibrated score, the ids of the nearest examples as evidence, and the nearest one's cosine. Equal counts are answered once."""
        from xxhash import xxh3_128_digest

        if (got := self.met.get(key := xxh3_128_digest(idx.tobytes() + tf.tobytes()))) is not None:
            return got
        if len(self.met) > KEPT:
            self.met.clear()
        raw, at, cos = self.vote(idx, self.unit(idx, tf)) if len(idx) else (-1.0, np.zeros(0, np.int64), np.zeros(0))
        if raw < 0 or not len(self.at):
            out = min(1.0, max(0.0, float(self.without))), [], 0.0
        else:
            out = float(np.interp(raw, self.at, self.height)), [self.ids[i] for i in at.tolist()], min(1.0, float(cos[0]))
        self.met[key] = out
        return out


def featured(texts: DataFrame) -> DataFrame:
    """u (the row's own number), id, toxic, weight, sig, idx and tf of each row of id, text, toxic, weight."""
    names = ["u", "id", "toxic", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for i, t in enumerate(batch.column("text")):
                t = t.as_py()
                idx, tf = features.counts(t)
                own = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array([signature(t)], pa.int64()), pa.array([idx], pa.list_(pa.int64())), pa.array([tf], pa.list_(pa.int32()))], names=[*names, "sig", "idx", "tf"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select(F.monotonically_increasing_id().alias("u"), "id", "text", "toxic", "weight").mapInArrow(run, f"u bigint, id {kind}, toxic int, weight double, sig bigint, idx array<bigint>, tf array<int>")


def told_apart(rows: DataFrame) -> DataFrame:
    """u, id, toxic and weight of ``featured`` rows: one row of an id, and of copies and near copies the one of the least id with the weight of all."""
    one = rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("idx", "tf"), "u", "toxic", "weight", "sig")).alias("x")).select("id", "x.u", "x.toxic", "x.weight", "x.sig")
    return one.groupBy("sig", "toxic").agg(F.min(F.struct("id", "u")).alias("x"), F.sum("weight").alias("weight")).select("x.u", "x.id", "toxic", "weight")


def chosen(rows: DataFrame, examples: int) -> DataFrame:
    """The first ``examples`` rows of each class by a hash of their ids."""
    toxic, other = (rows.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(examples) for y in (1, 0))
    return toxic.unionByName(other)


def tallied(rows: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """at (a feature's number) and n, the rows of ``text`` that hold it. Tasks add up before anything is exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, known = Features(), vocabulary.value
        n = np.zeros(len(known) + BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column("text"):
                at = known.slots(features.counts(t.as_py())[0])
                np.add.at(n, at, 1)
        at = np.flatnonzero(n)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)].astype(np.int32)), pa.array(n[at[k : k + (1 << 16)]])], names=["at", "n"])

    return rows.select("text").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))


def taught(rows: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """at, a and b: the toxic and the other rows of ``featured`` rows that hold each feature of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        n = np.zeros((2, len(known)), np.int64)
        for batch in batches:
            for idx, toxic in zip(batch.column("idx"), batch.column("toxic").to_pylist(), strict=True):
                at = known.slots(idx.values.to_numpy())
                n[toxic, at[at < len(known)]] += 1
        at = np.flatnonzero(n.sum(0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[1, at]), pa.array(n[0, at])], names=["at", "a", "b"])

    return rows.select("idx", "toxic").mapInArrow(run, "at int, a bigint, b bigint").groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def dense(table: pa.Table, column: str, size: int) -> np.ndarray:
    out = np.zeros(size)
    out[table["at"].to_numpy()] = table[column].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str = "toxic", teachers: int = TEACHERS, examples: int = EXAMPLES) -> Broadcast:
    """The vocabulary (the examples' features) and the ``Voter``, broadcast: as large as the examples' texts, whatever the number of documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    drawn = written(sample(labels, key, label, teachers), "sample")
    vecs = written(featured(rows.join(F.broadcast(drawn), "id")), "teachers")  # at most 2 * teachers rows of numbers, as drawn
    few = written(told_apart(vecs), "apart")
    sums = {r["toxic"]: (r["n"], r["w"]) for r in few.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    (n_toxic, one), (n_other, other) = sums.get(1, (0, 0.0)), sums.get(0, (0, 0.0))
    rarity = (other / n_other) / (one / n_toxic) if n_toxic and n_other else 1.0
    own = vecs.select("u", "idx", "tf").join(F.broadcast(chosen(few, examples)), "u").select("id", "idx", "tf", "toxic", "weight").toArrow()
    found = sorted(zip(own["id"].to_pylist(), [x.values.to_numpy() for x in own["idx"]], [x.values.to_numpy() for x in own["tf"]], own["toxic"].to_pylist(), own["weight"].to_pylist(), strict=True), key=lambda x: x[0])
    scale = {y: sums[y][1] / max(1e-9, sum(x[4] for x in found if x[3] == y)) for y in sums}
    vocabulary = Vocabulary(np.unique(np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)])))
    shipped = spark.sparkContext.broadcast(vocabulary)
    width = len(vocabulary) + BUCKETS
    told = taught(vecs.join(F.broadcast(few.select("u")), "u"), shipped).toArrow()
    held = dense(tallied(rows, shipped).toArrow(), "n", width)
    found = [(i, vocabulary.slots(idx), tf, y, w * scale[y]) for i, idx, tf, y, w in found]
    voter = Voter(found, rows.count(), held, dense(told, "a", width), dense(told, "b", width), len(vocabulary), n_toxic, n_other, rarity)
    for table in (drawn, vecs, few):
        forget(table)
    shipped.unpersist()
    return spark.sparkContext.broadcast((vocabulary, voter))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", teachers: int = TEACHERS, examples: int = EXAMPLES, threshold: float = THRESHOLD) -> DataFrame:
    """``key``, held_out, score (0 to 1), predicted (score >= ``threshold``), evidence (ids of the nearest examples, nearest first) and cosine (the nearest one's).

    Learns from labelled rows that are not held out, at most ``teachers`` of each class, ``examples`` of them indexed.
    Null and empty texts, and texts that share no word with an example, have no evidence and get the share of toxic rows
    among examples without words, or of all if there are none; 0.5 without labels. Labels of one key that differ count
    as toxic; labels other than 0 and 1 and null keys teach nothing. Of different texts of one key one teaches. Repeated
    document rows each get their row; other columns are not read.
    """
    model = fit(docs, labels, key, text, label, teachers, examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vocabulary, voter), features = model.value, Features()
        for batch in batches:
            got = [voter.of(features, vocabulary, t.as_py()) for t in batch.column("text")]
            k = batch.column("k")
            yield pa.RecordBatch.from_arrays([k, pa.array([s for s, *_ in got], pa.float64()), pa.array([e for _, e, _ in got], pa.list_(k.type)), pa.array([c for *_, c in got], pa.float64())], names=["k", "score", "evidence", "cosine"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, f"k {kind}, score double, evidence array<{kind}>, cosine double")
    return out.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "cosine")


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that ``score`` predicts as toxic; all their columns, whatever their names. No text is shuffled.

    Null and empty texts stay unless most examples without words are toxic; repeated rows are judged alike; without
    labels, and of an empty table, all rows stay.
    """
    model = fit(docs, labels, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vocabulary, voter), features = model.value, Features()
        for batch in batches:
            yield batch.filter(pa.array([voter.of(features, vocabulary, t.as_py())[0] < threshold for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
