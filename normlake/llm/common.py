"""Helpers the operators of this folder share: sizes, words as hashes, and packed arrays of hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing id inside arrays; larger than every id, so that a row without id never wins over one with an id.
NO_ID = np.iinfo(np.int64).max
#: Text handled at a time inside a task; longer texts are cut between words.
PIECE_BYTES = 1 << 20
WIDE = np.uint64
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z; everything else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and ASCII other than letters and digits becomes a blank: what is left between blanks are the words.
LOWER_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files a plan scans, from the plan's own statistics; no job. (Estimates of joins are products and no guide.)"""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [leaf for leaf in (leaves.apply(i) for i in range(leaves.size())) if leaf.getClass().getSimpleName() == "LogicalRelation"]
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in files)


def tasks_for(df: DataFrame, target_bytes: int = 64 << 20) -> int:
    """At least the session's shuffle partitions; more where the input is larger than those can hold."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(session, -(-scanned_bytes(df) // target_bytes))


def spread(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: every input bit moves every output bit."""
    x = x.astype(WIDE, copy=True)
    x ^= x >> WIDE(30)
    x *= WIDE(0xBF58476D1CE4E5B9)
    x ^= x >> WIDE(27)
    x *= WIDE(0x94D049BB133111EB)
    x ^= x >> WIDE(31)
    return x


def by_size(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """A batch in runs of rows of about ``most`` bytes of text (one row at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    borders = np.flatnonzero(np.diff(size // most, prepend=0, append=-1) != 0)
    at = 0
    for to in (int(b) + 1 for b in borders[borders < batch.num_rows]):
        yield pa.Table.from_batches([batch.slice(at, to - at)])
        at = to
    if at < batch.num_rows:
        yield pa.Table.from_batches([batch.slice(at)])


_LETTER = mix(np.arange(1, 257, dtype=WIDE) * WIDE(0x9E3779B97F4A7C15))
_STEP = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, dtype=WIDE)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, dtype=WIDE), np.cumprod(np.full(max(n, 64) * 2, _STEP, dtype=WIDE))])
    return _POWERS


def _hash_piece(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of data[first:last] for each word of one piece."""
    length = last - first
    letters = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
    within = letters - np.repeat(first, length)
    value = _LETTER[data[letters]] * _powers(int(length.max()) + 1)[within]
    return mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(WIDE))


def words_of(texts: pa.ChunkedArray | pa.Array, lower: bool = False):
    """Words (runs of other than blanks) of many texts at once.

    Returns the letters, each word's first and end place in them, its 64-bit hash, and for each text where its words begin
    (one entry more than texts). A null text has no words. Memory beyond the texts is bounded by PIECE_BYTES, unless a
    single word is longer.
    """
    array = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks != 1 else texts
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    array = array.fill_null("") if array.null_count else array
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    n = len(array)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint8), empty, empty, np.zeros(0, dtype=WIDE), np.zeros(1, dtype=np.int64)
    borders = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[borders[0] : borders[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    borders = borders - borders[0]
    if lower:
        data = np.frombuffer(LOWER, dtype=np.uint8)[data]
    letter = ~_BLANK[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    inner = borders[(borders > 0) & (borders < len(data))]
    begins[inner] = letter[inner]
    first = np.flatnonzero(begins)
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    ends[inner - 1] = letter[inner - 1]
    last = np.flatnonzero(ends) + 1
    hashes = np.empty(len(first), dtype=WIDE)
    size, at = np.concatenate([[0], np.cumsum(last - first)]), 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(size, size[at] + PIECE_BYTES, side="right")) - 1)
        hashes[at:to] = _hash_piece(data, first[at:to], last[at:to])
        at = to
    return data, first, last, hashes, np.searchsorted(first, borders)


def window_hash(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``length`` words (run i starts at word i; shorter input gives none)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=WIDE)
    step = WIDE((0xD6E8FEB86659FD93 + 2 * seed * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF)
    out = hashes[:n].copy()
    for k in range(1, length):
        out *= step
        out += hashes[k : k + n]
    return mix(out + WIDE(length + seed))


def room(starts: np.ndarray) -> np.ndarray:
    """For each word, how many words its text has from there on."""
    counts = np.diff(starts)
    return np.repeat(starts[1:], counts) - np.arange(int(starts[-1]))


def text_of_word(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes (all lowest bytes first): high bytes that are zero cost a block codec next to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted uint64 array as differences."""
    return planes(np.diff(values, prepend=WIDE(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, WIDE), dtype=WIDE)


def ids_of(column) -> np.ndarray:
    """Ids as int64; a missing id becomes NO_ID."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.int64())
    return array.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def shares(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` shares of the hash space each hash belongs to (by its leading bits, so sorted hashes stay sorted)."""
    return ((hashes >> WIDE(32)) * WIDE(n) >> WIDE(32)).astype(np.int32)


def cuts(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of the ``n`` shares begins in a sorted array (n + 1 entries)."""
    share = shares(sorted_hashes, n)
    return np.searchsorted(share, np.arange(n + 1))


def inside(sorted_set: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    place = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[place] == values


def release() -> None:
    """Gives memory that is free back to the system: a Python worker lives on after its task and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(fn):
    """A worker function on groups (of a key and one table or two) or on batches that leaves no free memory behind."""
    if fn.__code__.co_argcount == 1:
        def on_batches(batches):
            yield from fn(batches)
            release()

        return on_batches

    def on_group(key, table):
        out = fn(key, table)
        release()
        return out

    def on_groups(key, table, other):
        out = fn(key, table, other)
        release()
        return out

    return on_group if fn.__code__.co_argcount == 2 else on_groups
