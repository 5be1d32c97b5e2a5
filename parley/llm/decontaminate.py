"""Benchmark decontamination with suffix arrays over the training documents.

Documents are read in shards of about a million words. Over each shard's word ids a suffix array is built, and every
suffix of every benchmark item is found in it by binary search; the places that share a whole window with it are hit.
(Suffixes shorter than a window can only match within what a longer one matches; a shard's array leaves out stretches
that hold too few benchmark words in a row to contain any window. So both are complete for what is asked.) At each place
hit, the longest verbatim match with any item is taken from the items' own suffix array. No text is shuffled. The
benchmark lies in the shared folder in blocks of bounded size, which tasks read one after another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, store, word_chunks, words_of

WINDOW = 10
#: Words of a shard, UTF-8 bytes of benchmark text in a block, and of documents that a task holds while it reads block after block.
SHARD_WORDS, BLOCK_BYTES, HELD_BYTES = 1 << 20, 2 << 20, 48 << 20


def suffix_array(stream: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in their order, by prefix doubling. Zeros end suffixes: what follows doesn't count."""
    n = len(stream)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64) + (0 if (stream == 0).any() else 1)
    ends = np.flatnonzero(np.append(stream, 0) == 0)
    longest, h = int(np.diff(np.concatenate([[-1], ends])).max()), 1
    order = np.argsort(rank, kind="stable")
    while h < longest:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:]
        after[rank == 0] = 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        made = np.zeros(n, np.int64)
        made[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if not (stream == 0).any():
            made += 1
        if made[order[-1]] - made[order[0]] == n - 1:
            return order
        rank, h = made, 2 * h
    return order


STEP = 16


def common(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How many words from ``at`` in ``a`` and from ``to`` in ``b`` on are alike; zeros end both, and STEP of them stand behind either."""
    n, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(open_):
        x = a[(at + n)[open_][:, None] + np.arange(STEP)]
        run = np.cumprod((x == b[(to + n)[open_][:, None] + np.arange(STEP)]) & (x != 0), axis=1).sum(1)
        n[open_] += run
        open_ = open_[run == STEP]
    return n


class Block:
    """Benchmark items as word ids; windows are its distinct suffixes cut to the window's length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.vocab, self.names = window, {}, sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        rows: dict[tuple[int, ...], set[int]] = {}
        self.texts: list[tuple[int, tuple[int, ...]]] = []  # in order of the items' names
        for item, text in sorted(items):
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text))
            self.texts.append((number[item], ids))
            for at in range(max(1, len(ids) - window + 1)) if ids else ():
                rows.setdefault(ids[at : at + window], set()).add(number[item])
        self.length = np.array([len(w) for w in rows], np.int64)
        self.least = int(self.length.min()) if rows else 0
        self.words = np.zeros((len(rows), window), np.int64)
        for k, w in enumerate(rows):
            self.words[k, : len(w)] = w
        self.owner_at = np.cumsum([0, *(len(s) for s in rows.values())])
        self.owners = np.array([x for s in rows.values() for x in sorted(s)], np.int64)
        self.order: np.ndarray | None = None

    def own_array(self) -> None:
        """The items' own suffix array, made when a first place is hit."""
        if self.order is None:
            starts = np.cumsum([0, *(len(t) + 1 for _, t in self.texts)])
            self.stream = np.zeros(starts[-1] + STEP, np.int64)
            for at, (_, t) in zip(starts, self.texts, strict=False):
                self.stream[at : at + len(t)] = t
            self.starts, self.item = starts[:-1], np.array([i for i, _ in self.texts], np.int64)
            self.order = suffix_array(self.stream[: starts[-1]])

    def longest(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The words of the longest match with any item that begins at each place of a shard (padded by STEP zeros)."""
        self.own_array()
        low = self._bound(stream, at, np.full(len(at), np.iinfo(np.int64).max), False)
        near = [common(stream, at, self.stream, self.order[np.clip(x, 0, len(self.order) - 1)]) for x in (low - 1, low)]
        return np.maximum(*near)

    def witness(self, stream: np.ndarray, at: np.ndarray, length: np.ndarray) -> list[tuple[str, int]]:
        """The first item by name, and the place in it, that has the ``length`` words of each place."""
        low, high = self._bound(stream, at, length, False), self._bound(stream, at, length, True)
        first = np.array([self.order[a:b].min() for a, b in zip(low.tolist(), high.tolist(), strict=True)], np.int64)
        row = np.searchsorted(self.starts, first, "right") - 1
        return [(self.names[i], p) for i, p in zip(self.item[row].tolist(), (first - self.starts[row]).tolist(), strict=True)]

    def _bound(self, stream: np.ndarray, at: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
        """By binary search, the first of the items' suffixes not below each place's ``length`` words (upper: nor beginning with them)."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            suffix = self.order[np.minimum(mid, len(self.order) - 1)]
            same = np.minimum(common(stream, at, self.stream, suffix), length)
            less = np.where(same == length, upper, self.stream[suffix + same] < stream[at + same])
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        return low

    def ids(self, text: str | None) -> np.ndarray:
        """The words of a text as ids; 0 for words that no item has."""
        got = [np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, len(words)) for words in word_chunks(text)]
        return got[0] if len(got) == 1 else np.concatenate([np.zeros(0, np.int32), *got])

    def bounds(self, stream: np.ndarray, order: np.ndarray, upper: bool) -> np.ndarray:
        """For every window, by binary search, the first suffix not below it (upper: not below or starting with it)."""
        low, high = np.zeros(len(self.length), np.int64), np.full(len(self.length), len(order))
        padded = np.concatenate([stream, np.zeros(self.window, np.int64)])
        within = np.arange(self.window) < self.length[:, None]
        while (open_ := low < high).any():
            mid = (low + high) // 2
            there = padded[order[np.minimum(mid, len(order) - 1)][:, None] + np.arange(self.window)]
            there[np.cumsum(there == 0, axis=1) > 0] = 0  # what follows an end doesn't count
            differ = (there != self.words) & within
            first = differ.argmax(axis=1)[:, None]
            sign = np.sign(np.take_along_axis(there - self.words, first, 1)[:, 0]) * differ.any(axis=1)
            right = open_ & ((sign < 0) | (upper & (sign == 0)))
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        return low

    def matches(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``stream`` and the windows that stand there."""
        none = np.zeros(0, np.int64)
        if not len(self.length) or not len(stream):
            return none, none
        zeros = np.flatnonzero(np.append(stream, 0) == 0)
        edges = np.concatenate([[-1], zeros])
        runs = np.flatnonzero(np.diff(edges) - 1 >= self.least)
        if not len(runs):
            return none, none
        first, size = edges[runs] + 1, edges[runs + 1] - edges[runs]  # with the zero that ends it
        place = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        sub = np.append(stream, 0)[place]
        order = suffix_array(sub)
        low, high = self.bounds(sub, order, False), self.bounds(sub, order, True)
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return place[order[at]], np.repeat(np.arange(len(n)), n)


class Found:
    """What a document holds: its number of words, the words hit, the items with windows in it, and its longest match: words, where it begins in the document, the item, and where in the item."""

    def __init__(self, n: int):
        self.hit, self.items, self.best = np.zeros(n, bool), set(), (0, 0, "", 0)

    def add(self, hit: np.ndarray, items: list[str], best: tuple[int, int, str, int]) -> None:
        self.hit |= hit
        self.items.update(items)
        self.best = min(self.best, best, key=lambda x: (-x[0], *x[1:]))


def shard_rows(block: Block, docs: list[np.ndarray]) -> list[tuple[np.ndarray, list[str], tuple[int, int, str, int]]]:
    """Of each document: the words hit (a boolean each), the items with windows in it, and the longest match (see ``Found``)."""
    starts = np.cumsum([0, *(len(d) + 1 for d in docs)])
    stream = np.zeros(starts[-1] + STEP, np.int64)
    for s, d in zip(starts, docs, strict=False):
        stream[s : s + len(d)] = d
    at, there = block.matches(stream[: starts[-1]])
    if not len(at):
        return [(np.zeros(len(d), bool), [], (0, 0, "", 0)) for d in docs]
    cover = np.zeros(starts[-1] + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + block.length[there], -1)
    hit = np.cumsum(cover)[:-1] > 0
    # A window's owners are looked up once a document, however often it stands there.
    n_windows = len(block.length)
    once = np.unique((np.searchsorted(starts, at, "right") - 1) * n_windows + there)
    doc, window = once // n_windows, once % n_windows
    owner_n = np.diff(block.owner_at)[window]
    which = np.repeat(block.owner_at[window] - np.concatenate([[0], np.cumsum(owner_n)[:-1]]), owner_n) + np.arange(owner_n.sum())
    pairs = np.unique(np.repeat(doc, owner_n) * len(block.names) + block.owners[which])
    items: dict[int, list[str]] = {}
    for p in pairs.tolist():
        items.setdefault(p // len(block.names), []).append(block.names[p % len(block.names)])
    # The longest match begins where a window does. Places with whole windows are extended; at others a short item stands.
    order = np.lexsort((-block.length[there], at))
    first = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])]
    at, there = at[first], there[first]
    length, whole = block.length[there].copy(), block.length[there] == block.window
    length[whole] = block.longest(stream, at[whole])
    doc = np.searchsorted(starts, at, "right") - 1
    order = np.lexsort((at, -length, doc))
    first = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
    shown = iter(block.witness(stream, at[first][whole[first]], length[first][whole[first]]))
    who = [next(shown) if w else (block.names[block.owners[block.owner_at[t]]], 0) for w, t in zip(whole[first].tolist(), there[first].tolist(), strict=True)]
    best = {d: (n, p, *w) for d, n, p, w in zip(doc[first].tolist(), length[first].tolist(), (at - starts[doc])[first].tolist(), who, strict=True)}
    return [(hit[s : s + len(d)], items.get(k, []), best.get(k, (0, 0, "", 0))) for k, (s, d) in enumerate(zip(starts, docs, strict=False))]


def _spans(hit: np.ndarray) -> list[int]:
    """Start and end of each stretch, alternately."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()


def in_blocks(benchmark: DataFrame, item: str, item_text: str, block_bytes: int) -> tuple[str, int]:
    """The benchmark written in blocks to the shared folder, an item's rows in one block: the folder and the number of blocks."""
    parts = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = parts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    path = f"{shared_dir(benchmark.sparkSession)}/parley-benchmark-{uuid.uuid4().hex}"
    parts.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(n))).repartition(n, "b").write.partitionBy("b").parquet(path)
    return path, n


class Blocks:
    """The benchmark's blocks, of which one at a time is held."""

    def __init__(self, path: str, n: int, window: int):
        self.path, self.n, self.window = path, n, window
        self.at, self.block = -1, None

    def load(self, b: int) -> Block:
        if b != self.at:
            import pyarrow.parquet as pq
            from pyarrow import fs

            where, top = store(self.path)
            files = [f.path for f in where.get_file_info(fs.FileSelector(f"{top}/b={b}", allow_not_found=True)) if f.path.endswith(".parquet")]
            rows = [r for f in files for r in pq.ParquetFile(where.open_input_file(f)).read(["i", "t"]).to_pylist()]
            self.at, self.block = b, Block([(r["i"], r["t"]) for r in rows], self.window)
        return self.block

    def found(self, texts: list[str | None]) -> list[Found]:
        """What each text holds. The last block stays, so the next texts meet the blocks the other way round."""
        out: list[Found] = []
        for turn, b in enumerate(range(self.n) if self.at <= 0 else range(self.n - 1, -1, -1)):
            block, docs, first, n = self.load(b), [], 0, 0
            for i, text in enumerate(texts):
                docs.append(block.ids(text))
                n += len(docs[-1])
                if n >= SHARD_WORDS or i == len(texts) - 1:
                    if turn == 0:
                        out += [Found(len(d)) for d in docs]
                    for k, row in enumerate(shard_rows(block, docs)):
                        out[first + k].add(*row)
                    docs, first, n = [], i + 1, 0
        return out

    def run(self, batches: Iterator[pa.RecordBatch], column: str, rows: Callable[[pa.RecordBatch, list[Found]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``rows`` of each stretch of a batch that is small enough to be held."""
        most = HELD_BYTES if self.n > 1 else 8 * SHARD_WORDS
        for batch in batches:
            col, at, texts, size = batch.column(column), 0, [], 0
            for i in range(batch.num_rows):
                texts.append(col[i].as_py())
                size += len(texts[-1] or "")
                if size >= most or i == batch.num_rows - 1:
                    yield rows(batch.slice(at, len(texts)), self.found(texts))
                    at, texts, size = i + 1, [], 0


def locate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document row: ``key``, n_words, spans (start and end of each stretch hit, alternately, in words), items
    (sorted as strings), and the longest verbatim match: longest (words), longest_at (where it begins in the document),
    longest_item, item_at (where in the item). Of matches as long, the first in the document, then of the first item by name.

    Null and empty texts have no words. Items without words, or with a null id, match nothing; rows of one id are one
    item. Repeated document rows each get their row; other columns are not read. An empty benchmark hits nothing; the
    last three are null without a hit. Very long texts are read in parts and held as a number a word.
    """
    path, n_blocks = in_blocks(benchmark, item, item_text, block_bytes)
    kind = docs.schema[key].dataType.simpleString()
    kinds = {"n_words": pa.int64(), "spans": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "longest": pa.int32(), "longest_at": pa.int32(), "longest_item": pa.string(), "item_at": pa.int32()}

    def rows(batch: pa.RecordBatch, found: list[Found]) -> pa.RecordBatch:
        told = [(len(f.hit), _spans(f.hit), sorted(f.items), f.best[0], *(f.best[1:] if f.best[0] else (None,) * 3)) for f in found]
        cols = list(zip(*told, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True))], names=["k", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Blocks(path, n_blocks, window).run(batches, "t", rows)

    schema = f"k {kind}, n_words bigint, spans array<int>, items array<string>, longest int, longest_at int, longest_item string, item_at int"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of ``locate``'s rows."""
    hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 1), F.lit(0).cast("bigint"), lambda a, i: a + F.when(i % 2 == 1, F.get("spans", i)).otherwise(-F.get("spans", i)))
    n_hit = F.when(F.size("spans") > 0, hit).otherwise(F.lit(0).cast("bigint"))
    return found.select(
        key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.col("longest").alias("longest_hit"),
        "longest_at", "longest_item", "item_at",
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all their columns, whatever their names.

    Null and empty texts stay; repeated rows are judged alike; an empty benchmark, or one without words or ids, takes none.
    """
    path, n_blocks = in_blocks(benchmark, "item_id", "text", block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Blocks(path, n_blocks, window).run(batches, text, lambda batch, found: batch.filter(pa.array([not f.hit.any() for f in found], pa.bool_())))

    return docs.mapInArrow(run, docs.schema)
