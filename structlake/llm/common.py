"""Shared helpers: tables in the shared folder, and vectorised word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six.
WHITESPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset, a temporary folder is made
    and set in local mode (tests); on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="structlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_open: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession):
    """Tables written inside the block are deleted at its end.

    What is made of them must be stored by then. Tables written outside of any block
    stay until the shared folder is cleared.
    """
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of keys of at most this size is broadcast.
KEY_BYTES, KEY_SLOTS = 16 << 20, 16


def matching(rows: DataFrame, keys: DataFrame, on: list[str], salt: Column, broadcast_bytes: int = KEY_BYTES) -> DataFrame:
    """The rows whose key is one of ``keys`` (a written table without repeats).

    Few keys are broadcast (64 bytes each are reckoned). Many are sent once for each
    of several slots, and the rows of a key are dealt to the slots by ``salt``, so
    that a key with a large part of the rows is spread.
    """
    if keys.count() * 64 <= broadcast_bytes:
        return rows.join(F.broadcast(keys), on, "left_semi")
    spread = keys.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(KEY_SLOTS - 1))))
    return rows.withColumn("_slot", F.pmod(F.xxhash64(salt), F.lit(KEY_SLOTS)).cast("int")).join(spread, [*on, "_slot"], "left_semi").drop("_slot")


def lean(run):
    """A function over Arrow batches whose worker gives freed memory back at the end.

    Spark keeps idle Python workers for later tasks; what they hold adds up.
    """

    @wraps(run)
    def whole(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without_whitespace(text: Column) -> Column:
    """Text without any of the six white-space characters; null gives ''."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITESPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


# --- word hashing over the UTF-8 bytes of many texts at once -----------------

_PRIME = np.uint64(0x9E3779B97F4A7C15)
BLOCK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of all words of a block of texts, without a Python loop.

    A word's hash is a difference of prefix sums of per-byte random values
    times powers of an odd number, brought back to exponent nought.
    """

    def __init__(self, lower: bool):
        table = mix64(np.arange(1, 257, dtype=np.uint64) * _PRIME)
        if lower:
            table[65:91] = table[97:123]
        self.table = table
        self.space = np.zeros(256, dtype=bool)
        self.space[[ord(c) for c in WHITESPACE]] = True
        self._grow(BLOCK_BYTES)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            step = np.full(n, _PRIME, dtype=np.uint64)
            step[0] = 1
            self.power = np.multiply.accumulate(step)
            inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
            step[1:] = inverse
            self.inverse = np.multiply.accumulate(step)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """data: UTF-8 bytes; offsets: starts of the texts and the end.

        Returns (start, end, text number, hash) of every word, in order.
        """
        n = len(data)
        if n > len(self.power):
            self._grow(n)
        edge = np.ones(n + 2, dtype=bool)
        edge[1:-1] = self.space[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        inside = ~edge[1:-1]
        starts = np.flatnonzero(inside & (edge[:-2] | cut[:-1]))
        ends = np.flatnonzero(inside & (edge[2:] | cut[1:])) + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.table[data] * self.power[:n], out=sums[1:])
            if len(starts):
                hashes = mix64((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
            else:
                hashes = np.zeros(0, dtype=np.uint64)
        return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, hashes


def windows(word_text: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words that lie inside one text.

    Returns (index of the first word, hash).
    """
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    last = len(hashes) - width + 1
    at = np.flatnonzero(word_text[:last] == word_text[width - 1 :])
    out = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[at + k]
        return at, mix64(out)


def text_blocks(column, block_bytes: int = BLOCK_BYTES):
    """Cut an Arrow string column into runs of rows of about ``block_bytes``.

    Yields (first row, row after the last, bytes, offsets). Null texts are
    empty. A single text longer than the block makes a block of its own.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        end = min(n, max(end, first + 1))
        part = offsets[first : end + 1]
        yield first, end, data[part[0] : part[-1]], part - part[0]
        first = end
