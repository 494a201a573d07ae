"""What the corpus operators share: vectorised tokens, hashes, tables in the shared folder."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import time
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that are tokenised at once; bounds a Python worker's memory, not what is read.
CHUNK_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new one, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage: only then are the shuffle files of queries that have ended deleted."""
    # What has just ended is held until its listeners have been told.
    time.sleep(0.2)
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, *more: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends there. More tables of its columns are written after it, one at a time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    for part in (df, *more):
        part.write.mode("append").parquet(path)
        if more:
            sweep(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables as stored() returned them, of which nothing will be read any more, and what was shuffled for them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    sweep(tables[0].sparkSession)


#: Tables up to so many bytes, as a broadcast holds them, are broadcast.
SMALL_BYTES = 32_000_000
#: Bytes of a row's columns by type, texts being keys and names here; and of its header.
_WIDTH = {"binary": 40, "string": 64, "bigint": 8, "int": 8, "double": 8, "boolean": 8}
_ROW = 16


def small(df: DataFrame) -> DataFrame:
    """df, a stored table of narrow rows, marked for broadcast if its count times its width allows that."""
    width = _ROW + sum(_WIDTH[kind] for _, kind in df.dtypes)
    return F.broadcast(df) if df.count() * width <= SMALL_BYTES else df


def quoted(*names: str) -> list[Column]:
    """Columns of these very names, dots and ticks in them being no syntax."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores after it as no column of df (in whatever case) has."""
    known, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in known:
            n += "_"
        known.add(n.lower())
        out.append(n)
    return out


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About so many rows of df, or all if there are fewer: those whose hash of the columns is lowest, the bound being set by the count."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.shiftrightunsigned(F.xxhash64(*by), 11) < int(rows / n * 2**53))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with a column number that tells them apart, as a stored table: numbers are drawn once."""
    return stored(rows.withColumn("number", F.monotonically_increasing_id()))


def text_key(column: str | Column = "text") -> Column:
    """16 bytes that stand for a text; null for a null text."""
    return F.unhex(F.md5(F.col(column) if isinstance(column, str) else column))


@functools.cache
def _fold() -> np.ndarray:
    """By code point: its lower case if it belongs to a word (letters, digits, marks), else 0."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalnum() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_CHARS + CHUNK_CHARS // 4)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            tables.append(np.cumprod(step, dtype=np.uint64))
        _powers[:] = tables
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Tokens:
    """Words of several texts, case folded or not, in order: doc (index of the text), start and end (code points in that text), hash."""

    __slots__ = ("doc", "start", "end", "hash", "bounds", "cp", "offset", "inside")

    def __init__(self, texts: list[str], fold: bool = True):
        joined = "\n".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        offset = np.concatenate(([0], np.cumsum(lens + 1)))
        folded = _fold()[cp]
        word = np.zeros(len(cp) + 2, np.int8)
        word[1:-1] = folded != 0
        #: all characters, where each text's begin, and which belong to words
        self.cp, self.offset, self.inside = cp, offset, word[1:-1]
        if not fold:
            folded = cp
        edge = np.flatnonzero(np.diff(word))
        start, end = edge[0::2], edge[1::2]
        #: tokens of text i are bounds[i]:bounds[i + 1]
        self.bounds = np.searchsorted(start, offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        power, inverse = _power_tables(len(cp) + 1)
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(folded * power[: len(cp)], out=sums[1:])
        self.hash = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
        self.start, self.end = start - offset[self.doc], end - offset[self.doc]


def chunks(texts: list[str | None], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of runs of about so many characters; null counts as empty. A longer text is a run of its own."""
    first, run, total = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and total + len(t) > chars:
            yield first, run
            first, run, total = i, [], 0
        run.append(t)
        total += len(t)
    if run:
        yield first, run


def shingles(tokens: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, hash) of each run of width words; of all its words where a text has fewer."""
    n = len(tokens.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = np.diff(tokens.bounds)
    position = np.arange(n) - tokens.bounds[tokens.doc]
    last = position + width <= count[tokens.doc]
    last |= (position == 0) & (count[tokens.doc] < width)
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        part = np.zeros(n, np.uint64)
        if k < n:
            part[: n - k] = tokens.hash[k:]
            same = np.zeros(n, bool)
            same[: n - k] = tokens.doc[k:] == tokens.doc[: n - k]
            part[~same] = 0
        acc = mix(acc * np.uint64(0x100000001B3) + part)
    return tokens.doc[last], acc[last]


def release() -> None:
    """Gives memory that this worker no longer uses back to its executor: workers are kept for tasks of other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow for columns of any names; at the end of a task its memory is released."""
    names = df.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.rename_columns(names) for b in batches)
        finally:
            release()

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(task, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """map_batches(), batch by batch."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if out is None:
                continue
            yield from (out,) if isinstance(out, pa.RecordBatch) else out

    return map_batches(df, run, schema)
