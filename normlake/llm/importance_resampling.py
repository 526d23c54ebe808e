"""Target-distribution importance resampling over hashed runs of words.

A document's features are its runs of one to ``longest`` words; each falls into one of ``buckets`` by the CRC-32 of its bytes.
Two texts models are counts of buckets: one over all documents, one over the target. A bucket's gain is the logarithm of how
much likelier the target makes it, a document's weight the mean gain of its features, and adding Gumbel noise from the
document's id turns "the highest scores" into a draw without replacement in proportion to the weights.

CRC by position table: without its initial and final value a CRC is linear, so that of a span is the XOR of what each byte
contributes at its distance from the end. ``_AT[distance, byte]`` holds these contributions, ``bitwise_xor.reduceat`` adds
them up over all spans at once, and the initial value adds a constant that depends on the length alone (``_START``). Spans
longer than the table are cut into blocks of its depth, counted from the end, and folded: what came before is moved on by a
block's length (again by the table, as four bytes at the head of a block) and the next block is added.

Bucket counts are summed per task and then grouped: ``buckets`` numbers per task are all that is shuffled, and the same number
reaches the driver, whatever the corpus. Ranks come from counts by score; scores are integers of thousandths of a logarithm,
so there are some ten thousands of them at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.functions.scan import row_number
from normlake.llm.common import LOWER_WORDS, by_size
from normlake.session import ensure_checkpoint_dir

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes that the position table reaches back from a span's end.
DEPTH = 64
#: Blocks of spans whose bytes are looked up at a time.
STEP = 1 << 14
_POLYNOMIAL = 0xEDB88320
_ALL = np.uint32(0xFFFFFFFF)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, np.uint32(_POLYNOMIAL) ^ (value >> 1), value >> 1)
    at, start = np.empty((DEPTH, 256), dtype=np.uint32), np.empty(DEPTH + 1, dtype=np.uint32)
    at[0], start[0] = value, _ALL
    for distance in range(1, DEPTH):
        at[distance] = (at[distance - 1] >> 8) ^ value[at[distance - 1] & 255]
    for length in range(1, DEPTH + 1):
        start[length] = (start[length - 1] >> 8) ^ value[start[length - 1] & 255]
    return at, start


#: What a byte adds at a distance from the end, and what the initial value has become after a number of bytes.
_AT, _START = _tables()
_FLAT = _AT.reshape(-1)


def _moved(state: np.ndarray) -> np.ndarray:
    """States after a block of DEPTH more bytes, as far as they depend on the state."""
    return _AT[DEPTH - 1, state & 255] ^ _AT[DEPTH - 2, state >> 8 & 255] ^ _AT[DEPTH - 3, state >> 16 & 255] ^ _AT[DEPTH - 4, state >> 24]


def _added(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """XOR of the contributions of data[first:last], none empty and none longer than the table."""
    out = np.empty(len(first), dtype=np.uint32)
    for at in range(0, len(first), STEP):
        a, length = first[at : at + STEP], (last[at : at + STEP] - first[at : at + STEP]).astype(np.int32)
        ends = np.cumsum(length, dtype=np.int32)
        run = np.arange(int(ends[-1]), dtype=np.int32)
        byte = data[np.repeat(a - (ends - length), length) + run]
        distance = np.repeat(ends - 1, length) - run
        out[at : at + STEP] = np.bitwise_xor.reduceat(_FLAT[(distance << 8) + byte], ends - length)
    return out


def crc32_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[first:last] for every span (an empty one gives 0)."""
    length = last - first
    blocks = np.maximum(-(-length // DEPTH), 1)
    head = length - (blocks - 1) * DEPTH
    state = _START[head].copy()
    some = np.flatnonzero(head > 0)
    state[some] ^= _added(data, first[some], (first + head)[some])
    number, at = np.flatnonzero(blocks > 1), (first + head)
    while len(number):
        a = at[number]
        state[number] = _moved(state[number]) ^ _added(data, a, a + DEPTH)
        at[number] += DEPTH
        number = number[at[number] < last[number]]
    return state ^ _ALL


def _words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words, each word followed by one space, where words begin and end in them, and where each text's words begin."""
    texts = pa.concat_arrays(texts.chunks).cast(pa.large_string()).fill_null("")
    borders = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[borders[0] : borders[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    data, borders = np.frombuffer(LOWER_WORDS, dtype=np.uint8)[data], borders - borders[0]
    letter = data != 32
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    inner = borders[(borders > 0) & (borders < len(data))]
    begins[inner], ends[inner - 1] = letter[inner], letter[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    starts = np.searchsorted(first, borders)
    size = last - first
    to = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    place = np.arange(len(out))
    out[np.repeat(to - np.cumsum(size) + size, size) + place[: int(size.sum())]] = data[letter]
    return out, to, to + size, starts


def features(texts: pa.ChunkedArray, longest: int, buckets: int):
    """For each length: the bucket of every run of that many words and the text it stands in; and each text's number of words."""
    data, first, last, starts = _words(texts)
    counts = np.diff(starts)
    text = np.repeat(np.arange(len(counts)), counts)
    runs = []
    for length in range(1, longest + 1):
        n = max(len(first) - length + 1, 0)
        whole = np.flatnonzero(text[:n] == text[length - 1 : length - 1 + n])
        runs.append((crc32_spans(data, first[whole], last[whole + length - 1]).astype(np.int64) % buckets, text[whole]))
    return runs, counts


def _count(longest: int, buckets: int):
    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in by_size(batch, "text"):
                for bucket, _ in features(part.column("text"), longest, buckets)[0]:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs over all rows (``buckets`` numbers reach the driver)."""
    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(longest, buckets), "bucket int, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's share in the target over its share in the source, both smoothed by one."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weigh(gain: np.ndarray, longest: int, keep: list[str]):
    def weigh(batches):
        for batch in batches:
            for part in by_size(batch, "text"):
                runs, words = features(part.column("text"), longest, len(gain))
                n, total = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
                for bucket, text in runs:
                    here = np.bincount(text, minlength=len(words))
                    n += here
                    at = np.concatenate([[0], np.cumsum(here)])
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                    total += sums[at[1:]] - sums[at[:-1]]
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield from pa.Table.from_arrays([*(part.column(c) for c in keep), pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)],
                                                names=[*keep, "n_words", "n_features", "weight"]).to_batches()

    return weigh


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise of an id in thousandths: the same on every run; a missing id counts as an empty one."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(named, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
            carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of ``docs``; with ``carry`` the text too.

    ``target`` is read by its column ``text``. Null and empty texts have no features and weight 0. An empty target makes all
    buckets equally likely there. An empty table gives an empty result. Further columns are not read, so their names do not matter.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, "text", longest, buckets))
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keep = ["doc_id", "text"] if carry else ["doc_id"]
    weighed = read.mapInArrow(_weigh(gain, longest, keep), f"doc_id bigint, {'text string, ' if carry else ''}n_words bigint, n_features bigint, weight bigint")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS,
             seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``weights`` with rank: 1, 2, 3 ... for the drawn rows, highest score first, null for the others.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn. Ties go to the smaller
    id, a missing id coming last; rows that share id and score are ranked in any order among themselves.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    weighed = weights(docs, target, longest, buckets, seed, id_col, text_col).checkpoint()
    able = weighed.where(F.col("n_words") >= least_words)
    quota = able.count() * percent // 100
    ranked = row_number(able.withColumn("_down", -F.col("score")), [], "_down", [F.col("doc_id").asc_nulls_last()], "rank").drop("_down")
    rest = weighed.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank"))).unionByName(rest)


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS,
         seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and score of the drawn rows of ``docs``: those at or above the last drawn score and id, so no text is moved.

    Rows that share id and score with the last drawn one all stay. Otherwise as ``resample``.
    """
    ranked = resample(docs, target, percent, least_words, longest, buckets, seed, id_col, text_col)
    last = ranked.where(F.col("rank").isNotNull()).agg(F.max("rank").alias("rank"), F.max_by(F.struct("score", "doc_id"), "rank").alias("row")).first()
    weighed = weights(docs, target, longest, buckets, seed, id_col, text_col, carry=True).where(F.col("n_words") >= least_words)
    if last["rank"] is None:
        return weighed.where(F.lit(False)).select("doc_id", "text", "score")
    score, doc_id = last["row"]
    up_to = F.lit(True) if doc_id is None else F.col("doc_id") <= doc_id
    return weighed.where((F.col("score") > score) | ((F.col("score") == score) & up_to)).select("doc_id", "text", "score")
