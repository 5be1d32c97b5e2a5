"""What the operators share: the folder all executors see, written tables, and tokenising in Python."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that stand between words: all ASCII but digits and letters.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: The same class as a regular expression over characters, for use after A-Z were lower-cased.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_TO_WORDS = bytes(0x20 if b in SEPARATORS else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased; none for null. One pass of a byte table and one split."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def word_chunks(text: str | None, chunk: int = 1 << 22):
    """``words_of`` in parts of about ``chunk`` bytes, so that a very long text never stands in memory as one list."""
    if not text:
        return
    yield from _split(text.encode("utf-8", "surrogatepass").translate(_TO_WORDS), chunk)


def flat_words(text: str | None) -> bytes:
    """The words of a text, each after a space or more, as one string of UTF-8."""
    return b" " + text.encode("utf-8", "surrogatepass").translate(_TO_WORDS) if text else b""


def flat_chunks(text: str | None, chunk: int = 1 << 20):
    """The text as UTF-8 with a space for each byte between words, A-Z lower-cased; in parts as ``word_chunks``."""
    raw, at = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS) if text else b"", 0
    while at < len(raw):
        gap = raw.find(b" ", at + chunk) if len(raw) - at > chunk else -1
        end = gap if gap >= 0 else len(raw)
        yield raw[at:end]
        at = end


class Stretches:
    """Hashes of stretches of a text, any number at once.

    The hash is a polynomial over the bytes modulo 2**64: of a text's running sums, the difference between two places
    tells the stretch between them.
    """

    BASE, UNBASE, SPREAD = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), 0xD6E8FEB86659FD93

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def read(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Takes words with spaces between; where each begins and ends, in the text with a space put before it."""
        self.at = at = np.frombuffer(b" " + raw + b" ", np.uint8)
        if (n := len(at)) > len(self.up):
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))]) for base in (self.BASE, self.UNBASE))
        space = at == 32
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        if len(starts):
            self.sums = np.zeros(len(at) + 1, np.uint64)
            np.cumsum(at * self.up[: len(at)], out=self.sums[1:])
        return starts, ends

    def hashes(self, low: np.ndarray, high: np.ndarray, kinds: np.ndarray | int = 1) -> np.ndarray:
        """Hashes of the stretches from ``low`` to ``high``, other ones for other kinds."""
        h = (self.sums[high] - self.sums[low]) * self.down[low] + np.asarray(kinds, np.uint64) * np.uint64(self.BASE)
        return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(Stretches.SPREAD)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def space_chunks(text: str | None, chunk: int = 1 << 22):
    """What stands between ASCII white space, A-Z lower-cased, as UTF-8; in parts as ``word_chunks``."""
    if text:
        yield from _split(text.encode("utf-8", "surrogatepass").lower(), chunk)


def _split(raw: bytes, chunk: int):
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + chunk) if len(raw) - at > chunk else None
        end = gap.start() if gap else len(raw)
        yield raw[at:end].split()
        at = end


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or in tests a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="parley-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def store(folder: str):
    """The file system of a folder's URI, and the folder's path in it. Workers reach it without a JVM."""
    from pyarrow import fs

    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parley-{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._parley_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_parley_path", None)
    if path is None:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
