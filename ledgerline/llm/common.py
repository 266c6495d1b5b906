"""Helpers that the corpus operators share: lineage cuts, size-checked broadcasts, vectorised text hashing.

Text hashing works on whole Arrow batches with numpy: bytes are classified by a table, a word's hash is
a difference of prefix sums of a polynomial modulo 2**64, and no Python code runs per word.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table at most this large, as written, may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 6 << 20
#: Rows are handed to Python in Arrow batches of about this size at most; Spark's own limit is 64 MB, for each task, in the JVM and again in Python.
BATCH_BYTES = 2 << 20
#: Bytes of text that are hashed at a time.
CHUNK_BYTES = 1 << 18
#: Allocations from this size on are given back to the system when freed, so that workers don't keep their peak.
GIVE_BACK_BYTES = 1 << 20

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, GIVE_BACK_BYTES)
except (OSError, AttributeError):
    _libc = None


def trim_memory() -> None:
    """Give free memory back to the system, where the C library can."""
    gc.collect()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, where it may be unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, shows its size."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/ledgerline/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._settled_path = path
    return out


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that no result reads any more."""
    for df in settled:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, name: str = "doc") -> Column:
    """All columns of df as one struct, so that their names can't clash with those of helper columns."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias(name)


def running(df: DataFrame, group: str | None, order: list[Column], values: list[str]) -> DataFrame:
    """df with a column before_<value> for each value: its sum over the rows of the group that stand before the row.

    The rows are dealt to ranges of the order, summed within each, and the sums of whole ranges are added:
    no task reads more than a range, or than one row a range, however large a group is. order must tell all
    rows apart, so that equal rows don't share a range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.lit(0) if group is None else F.col(group)
    dealt = df.withColumn("__group", own).repartitionByRange(ranges, F.col("__group").asc_nulls_last(), *order)
    laid = settle(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy("__range", "__group").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    starts = settle(sums.select(F.col("__range").alias("__r"), F.col("__group").alias("__g"), *(F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values)), "range-sums")
    within = Window.partitionBy("__range", "__group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sofar = laid.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    both = sofar.join(maybe_broadcast(starts), (F.col("__range") == F.col("__r")) & F.col("__group").eqNullSafe(F.col("__g")))
    return both.select(*df.columns, *((F.col(f"before_{v}") + F.col(f"__{v}")).alias(f"before_{v}") for v in values))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of few rows and bytes while wide rows are handed to Python; the size counts when rows are handed over, so what is planned here must be settled here."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(key, None) for key in limits}
    for key, most in limits.items():
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, old in before.items():
            spark.conf.set(key, old) if old else spark.conf.unset(key)


def settled_bytes(df: DataFrame) -> int:
    """Bytes of a settled table, asked of the file system that holds it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_path)
    fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return fs.getContentSummary(path).getLength()


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a settled table of a checked size; larger ones keep the shuffle join."""
    return F.broadcast(df) if settled_bytes(df) <= limit else df


def maybe_broadcast_of(df: DataFrame, table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for rows of a settled table whose size allows it."""
    return F.broadcast(df) if settled_bytes(table) <= limit else df


def _byte_class(*spans: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for lo, hi in spans:
        table[lo : hi + 1] = False
    return table


#: Words of letters, digits and non-ASCII characters: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = _byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Words between white space: [^\x20\x09-\x0D]+.
SPACED = _byte_class((0x20, 0x20), (0x09, 0x0D))

_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_LETTER = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs come out far apart."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BACK)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run)
    return _powers[0], _powers[1]


def text_chunks(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row offsets) for runs of rows of about CHUNK_BYTES; nulls are empty, a long text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end - at, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def word_bounds(data: np.ndarray, offs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words, and for each row the number of its first word (rows + 1 numbers)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = words[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word, and for each row the number of its first word (rows + 1 numbers)."""
    starts, ends, first = word_bounds(data, offs, words)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _STEP)), first


def shingle_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of n words; a row with fewer words has its whole sequence as one, a row without words none."""
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), counts)
    m = len(h) - n + 1
    if m > 0:
        s = h[:m].copy()
        for k in range(1, n):
            s *= _STEP
            s += h[k : k + m]
        whole = rows[:m] == rows[n - 1 :]
        s, of = mix(s)[whole], rows[:m][whole]
    else:
        s, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for j, r in enumerate(short):
            x = np.uint64(0x51ED270B0F1F4C35 + int(counts[r]))
            for w in h[first[r] : first[r + 1]]:
                x = np.uint64((int(x) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            extra[j] = x
        s = np.concatenate([s, mix(extra)])
        of = np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        s, of = s[order], of[order]
    return s, of


def distinct_shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in order, all rows together, and where each row's begin (rows + 1 numbers)."""
    s, of = shingle_hashes(h, first, n)
    rows = len(first) - 1
    at = np.searchsorted(of, np.arange(rows + 1))
    parts = [np.unique(s[at[r] : at[r + 1]]) for r in range(rows)]
    begins = np.zeros(rows + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=begins[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), begins


def reduced(op: np.ufunc, values: np.ndarray, begins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """op over each of the given rows' values; the rows aren't empty and the others hold nothing."""
    return op.reduceat(values, begins[rows]) if len(rows) else values[:0]


def int_list(values: np.ndarray, begins: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values))
