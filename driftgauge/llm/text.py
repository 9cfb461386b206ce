"""Vectorised text primitives shared by the operators: words, hashes, and packed shuffles.

Words are maximal runs of characters other than space and TAB..CR. They are found on the UTF-8
bytes of an Arrow string column without making Python strings, so a batch costs a few numpy passes.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import re

import numpy as np
import pyarrow as pa

#: Bytes of text that a task looks at before it sends what it found (a longer text is handled alone and whole), and
#: bytes of one numpy pass, into which any text is cut between words.
CHUNK, PASS = 4 << 20, 1 << 20
#: Powers that a worker keeps; longer runs compute their own and drop them.
KEPT_POWERS = 1 << 16

_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
for _t in (_BYTE, _LOWER):
    _t[_SPACE] = 0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 1 << 12), _ODD, np.uint64)
        step[0] = 1
        made = np.cumprod(step, dtype=np.uint64)
        if n > KEPT_POWERS:
            return made[:n]
        _powers = made
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(lengths: np.ndarray, most: int = CHUNK):
    """(start, stop) of runs of rows whose lengths sum to most, or of one row."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def cuts(buf: np.ndarray, off: np.ndarray, most: int):
    """(start, stop) of runs of some most bytes that end at a text's end or behind white space."""
    at, n = 0, len(buf)
    while at < n:
        end = at + most
        while end < n:
            space = np.flatnonzero(_SPACE[buf[end : end + most]])
            next_text = off[np.searchsorted(off, end)]
            end = min(end + int(space[0]) + 1 if len(space) else end + most, max(int(next_text), end))
            if len(space) or end == next_text:
                break
        yield at, min(end, n)
        at = end


def found_words(buf: np.ndarray, inner: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one pass; inner are the texts' bounds within it."""
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    length = np.diff(np.append(starts, len(buf)))
    rel = np.arange(starts[0], len(buf)) - np.repeat(starts, length)
    return starts, ends, mix(np.add.reduceat(table[buf[starts[0] :]] * powers(int(length.max()))[rel], starts - starts[0]))


class Words:
    """Words of consecutive texts: their hashes, byte bounds, and the text of each."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool):
        table = _LOWER if lower else _BYTE
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for a, b in cuts(buf, off, PASS):
            inner = off[np.searchsorted(off, a, side="right") : np.searchsorted(off, b)] - a
            starts, ends, h = found_words(buf[a:b], inner, table)
            got.append((starts + a, ends + a, h))
        self.starts, self.ends, self.hash = (np.concatenate(x) for x in zip(*got, strict=True))
        n = len(off) - 1
        self.buf, self.n = buf, n
        self.doc = np.searchsorted(off, self.starts, side="right") - 1
        self.count = np.bincount(self.doc, minlength=n)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of each k-word sequence; a text of fewer words, but one, has its whole sequence."""
        h, total = self.hash, len(self.hash)
        if not total:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        acc = np.zeros(total, np.uint64)
        left = self.first[self.doc + 1] - np.arange(total)
        for j in range(k):
            if j < total:
                part = h[j:] * powers(k + 2)[j + 1]
                part[left[: total - j] <= j] = 0
                acc[: total - j] += part
        short = self.count[self.doc] < k
        keep = (left >= k) | (short & (left == self.count[self.doc]))
        acc = acc + np.minimum(left, k).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(acc[keep]), self.doc[keep]


_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD, _M_ARENA_MAX = -1, -3, -8  # fixed values of the C library
#: Freed memory that a worker keeps while a task runs.
KEPT = 4 << 20
_kept = 0


def frugal(kept: int = KEPT) -> None:
    """Let this worker give memory back as soon as more than that is free: Arrow by the C library's allocator, and large blocks mapped."""
    global _kept
    if _kept != kept:
        _kept = kept
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):
            libc = ctypes.CDLL(None)
            libc.mallopt(_M_MMAP_THRESHOLD, 1 << 20 if kept == KEPT else 8 << 20)
            libc.mallopt(_M_TRIM_THRESHOLD, kept)
            libc.mallopt(_M_ARENA_MAX, 2)


def trim() -> None:
    """Give freed memory back to the system, as idle workers stay."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(function, kept: int = KEPT):
    """A task function of tables whose worker is frugal, and gives memory back after each group."""

    def run(*tables):
        frugal(kept)
        try:
            return function(*tables)
        finally:
            trim()

    return (lambda t: run(t)) if function.__code__.co_argcount == 1 else (lambda left, right: run(left, right))


def batches(frames, text: str, most: int = CHUNK):
    """(record batch, bytes, offsets) of at most so many bytes of text, or of one row."""
    frugal()
    for batch in frames:
        if not batch.num_rows:
            continue
        buf, off = string_bytes(batch.column(batch.schema.get_field_index(text)))
        for a, b in slices(np.diff(off), most):
            yield batch.slice(a, b - a), buf[off[a] : off[b]], off[a : b + 1] - off[a]
    trim()


def by_bucket(hashes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that groups hashes by bucket (of their high bits, stable), the buckets there are and their bounds."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    bucket = bucket.astype(np.uint16 if n_buckets <= 65536 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return order, bucket[at].astype(np.int64), np.append(at, len(bucket))


def plan_bytes(df) -> int:
    """Size of the input in bytes as Spark's planner has it: a file size, without a job."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if n < 1 << 55 else 0


def text_bytes(df, text_col: str = "text") -> int:
    """Bytes of all texts, counted by a scan of that column: a function of the rows alone, whatever the files or settings."""
    from pyspark.sql import functions as F

    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long")), F.lit(0))).first()[0]


def bucket_count(df, expand: float, each: int = 8 << 20, size: int | None = None) -> int:
    """Buckets so that one holds about `each` bytes of what the input expands to; at least the shuffle partitions.

    Only for what no result depends on: with a size in bytes, the planner is not asked."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil((plan_bytes(df) if size is None else size) * expand / each), 1)


def checkpoint(df):
    """Cut the lineage in the folder that all executors share, which spark.checkpoint.dir names. Only a session on one machine gets a folder of
    its own where none is set; on a cluster that is an error, as executors would not see each other's files."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if folder is None:
            import os
            import tempfile

            folder = "file://" + os.path.join(tempfile.gettempdir(), "driftgauge-checkpoints")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def unsized(df):
    """A checkpoint of df without the size that the planner supposes. A join's size is the product of its sides' sizes and a checkpoint keeps it, so
    where rounds join a frame with itself that number gets several times the digits each round, until it fills the driver's memory."""
    kept, spark = checkpoint(df), df.sparkSession
    return type(df)(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)


def documents(spark, sf_dir: str, table: str = "documents"):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
