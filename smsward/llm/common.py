"""Shared pieces: table access, shared scratch tables, and numpy tokenising and hashing.

Texts reach Python as Arrow batches and are handled as byte blocks of about half a megabyte, so the
memory of a task is bounded by the block and by the longest single text, not by the partition; what a task has freed
goes back to the system when it ends, as Python workers live on between tasks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smsward.scratch import written  # noqa: F401  (operators take it from here)

U64 = np.uint64
BLOCK = 1 << 19
ROWS = 1000

#: Spaces that separate words: U+0020 and U+0009 to U+000D, as bytes.
SPACES = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: Letters, digits and everything outside ASCII make words; the rest separates them.
LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])

_BASE = U64(0x9E3779B97F4A7C15 | 5)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table, with only the given columns where any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df; for file scans, of the files. 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else 0


def release() -> None:
    """Gives freed memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some rows, so that what is made of a piece in Python is small; memory is released at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser published with MurmurHash3)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(n: int, base: int = int(_BASE)) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, BLOCK + 1)
        up, down = np.full(n, base, U64), np.full(n, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n > 4 * BLOCK:
            _POWERS.pop(base)  # for one very long text only
    return have


def rolling(x: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = int(_BASE)) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of the slices x[start:end]: differences of one prefix sum."""
    up, down = powers(len(x) + 1, base)
    prefix = np.zeros(len(x) + 1, U64)
    np.cumsum(x * down[: len(x)], out=prefix[1:])
    return (prefix[end] - prefix[start]) * up[end]


class Block:
    """Some rows of a batch: their bytes, and their words after words() was called."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def words(self, inside: np.ndarray = SPACES) -> Block:
        """start, end: of each word, in bytes; first: of each row, and after the last, the word's number."""
        m = inside[self.data]
        cut = self.offsets[:-1]
        cut = cut[cut < len(m)]
        before = np.zeros(len(m) + 1, bool)
        before[1:] = m
        after = before[1:].copy()
        after[:-1] = m[1:]
        after[-1:] = False
        before = before[:-1]
        before[cut] = False
        after[cut[cut > 0] - 1] = False
        self.start = np.flatnonzero(m & ~before)
        self.end = np.flatnonzero(m & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        return self

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit hash of each word."""
        return mix(rolling(self.data.astype(U64) + U64(1), self.start, self.end))


def blocks(batches: Iterator[pa.RecordBatch], column: str, lower: bool = False, limit: int = BLOCK) -> Iterator[Block]:
    """Cuts batches into blocks of about limit bytes of the text column; null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        if lower:
            text = pc.utf8_lower(text)
        raw = text.buffers()
        offsets = np.frombuffer(raw[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield Block(batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
    release()


HOT_SHARE, HOT_ROWS, MAX_HOT = 1e-3, 1 << 20, 50_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str = "n", how: str = "inner") -> DataFrame:
    """rows joined to groups, which has one row for each value of the keys and in `count` how many rows hold it.

    Groups over HOT_SHARE of the summed counts, and those over HOT_ROWS rows, are hot, but MAX_HOT groups at most (larger
    counts make as many hot as that); these are broadcast, so that their rows stay where they are. All others meet by shuffle, where
    no key is hot. how: inner or left. Both inputs are read up to three times and ought to be tables or cheap. Keys must not be null.
    """
    size = groups.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    total = size.total or 0
    least = max(min(total * HOT_SHARE, HOT_ROWS), total / MAX_HOT)
    if (size.most or 0) <= least:
        return rows.join(groups, keys, how).drop(count)
    hot, cold = F.broadcast(groups.filter(F.col(count) > least)), groups.filter(F.col(count) <= least)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return rows.join(hot, keys).unionByName(rest).drop(count)


def within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes laid end to end: each element's group, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def pack(a: np.ndarray) -> bytes:
    """Ascending unsigned 32-bit numbers, as compressed differences; starts with their count."""
    d = np.diff(a.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    raw = d.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(d).to_bytes(4, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    if not n:
        return np.zeros(0, np.uint32)
    raw = pa.decompress(b[4:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel(), dtype=np.uint32)
