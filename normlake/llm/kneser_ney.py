"""Interpolated modified Kneser-Ney bigram model, counted in Spark and applied to the texts it is asked about.

A text is its words and one end; each is predicted from the one before (the first from a begin mark). Texts are dealt once
into chunks by id, and that exchange is reused. Three rounds follow, each moving packed arrays of distinct hashes:

1. A chunk sends its distinct bigrams with their training counts to shares of the hash space. A share merges them into
   one sorted hash array with counts, stores it in the shared folder, and answers each chunk from the memory-mapped file:
   the corpus count of each bigram the chunk sent, in the same order, and which ones the chunk is to speak for (one chunk
   per bigram that occurs in training).
2. A chunk sends its distinct words with training counts, and, for the bigrams it speaks for, how many follow or precede
   each word. Shares merge, store, and answer in the same way.
3. A chunk has every count its texts need and scores them.

So a worker maps the one share it answers from, never the whole model; a word or bigram that is everywhere is one entry per
chunk; and nothing but twelve sums (counts of counts) is shared by all, as a scalar subquery of the same plan.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.llm.common import WIDE, cuts, mix, pack_sorted, planes, released, spread, tasks_for, text_of_word, unpack_sorted, unplanes, words_of
from normlake.session import ensure_checkpoint_dir

BEGIN, END = WIDE(0xB5297A4D3F84D5B5), WIDE(0x68E31DA4C2B2AE35)
_STEP = WIDE(0x9FB21C651E98DF25)
#: Fixed names of what is counted: bigrams with counts 1 to 4; tokens, kinds of tokens, kinds of bigrams, and kinds of tokens
#: that follow 1, 2, 3, 4 others or any.
BIGRAM_SUMS = ("n1", "n2", "n3", "n4")
WORD_SUMS = ("tokens", "kinds", "bigrams", "t1", "t2", "t3", "t4", "t_any")
#: What is known of a word: occurrences, occurrences as context, words it follows, and words that follow it once, twice, more.
STATS = 6
_SENT = pa.schema([("share", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_SENT_SQL = "share int, chunk int, hashes binary, counts binary"
_BACK = pa.schema([("chunk", pa.int32()), ("level", pa.int32()), ("share", pa.int32()), ("counts", pa.binary()), ("own", pa.binary()), ("sums", pa.list_(pa.float64()))])
_BACK_SQL = "chunk int, level int, share int, counts binary, own binary, sums array<double>"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_OUT_SQL = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


#: Counts from here on stand beside a stored column of bytes.
_MARK = 255


def squeezed(raw: bytes) -> bytes:
    """Byte planes under an entropy code, behind their size: a block codec without one leaves small counts and the top planes of gaps as they are."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unsqueezed(block: bytes) -> bytes:
    return pa.Codec("zstd").decompress(block[8:], decompressed_size=int.from_bytes(block[:8], "little"), asbytes=True) if any(block[:8]) else b""


class Chunk:
    """A chunk's texts as numbers: its words (sorted hashes), its distinct bigrams (sorted hashes), and its tokens."""

    def __init__(self, table: pa.Table):
        _, _, _, hashes, starts = words_of(table.column("text"), lower=True)
        n, self.texts = len(hashes), table.num_rows
        order = np.arange(self.texts)
        sequence = np.full(n + 2 * self.texts, BEGIN, dtype=WIDE)
        sequence[np.arange(n) + 2 * text_of_word(starts) + 1] = hashes
        sequence[starts[1:] + 2 * order + 1] = END
        self.words, place = np.unique(sequence, return_inverse=True)
        predicted = np.ones(len(sequence), dtype=bool)
        predicted[starts[:-1] + 2 * order] = False
        at = np.flatnonzero(predicted)
        self.first_token = starts[:-1] + order
        self.sizes = np.diff(starts) + 1
        pairs, of_token = np.unique(place[at - 1].astype(np.int64) * len(self.words) + place[at], return_inverse=True)
        left, right = pairs // len(self.words), pairs % len(self.words)
        bigrams = mix(self.words[left] * _STEP + self.words[right])
        by_hash = np.argsort(bigrams)
        rank = np.empty(len(by_hash), dtype=np.int64)
        rank[by_hash] = np.arange(len(by_hash))
        self.bigrams, self.left, self.right = bigrams[by_hash], left[by_hash], right[by_hash]
        self.token, self.pair = place[at], rank[of_token]
        trained = np.repeat(table.column("training").to_numpy().astype(bool), self.sizes)
        self.trained = np.bincount(self.pair[trained], minlength=len(self.bigrams)).astype(np.uint32)

    def sent(self, key, hashes: np.ndarray, counts: np.ndarray, shares: int) -> pa.Table:
        """Blocks per share; ``counts`` has a row per hash."""
        borders = cuts(hashes, shares)
        rows = {name: [] for name in _SENT.names}
        for share in np.flatnonzero(np.diff(borders)):
            a, b = borders[share], borders[share + 1]
            rows["share"].append(int(share))
            rows["chunk"].append(key[0].as_py())
            rows["hashes"].append(squeezed(pack_sorted(hashes[a:b])))
            rows["counts"].append(squeezed(planes(np.ascontiguousarray(counts[a:b].T.reshape(-1)))))
        return pa.Table.from_pydict(rows, schema=_SENT)

    def bigram_counts(self, told: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of the bigrams, and which ones this chunk speaks for."""
        told = sorted((r for r in told if r["level"] == 1), key=lambda r: r["share"])
        counts = [unplanes(unsqueezed(r["counts"]), np.uint32) for r in told]
        own = [np.unpackbits(np.frombuffer(r["own"], dtype=np.uint8), count=len(c)).astype(bool) for r, c in zip(told, counts)]
        return np.concatenate(counts).astype(np.int64), np.concatenate(own)

    def word_stats(self, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """This chunk's part of what is known of its words (one row per word)."""
        n = len(self.words)
        out = np.zeros((n, STATS), dtype=np.uint32)
        out[:, 0] = np.bincount(self.right, weights=self.trained, minlength=n)
        out[:, 1] = np.bincount(self.left, weights=self.trained, minlength=n)
        out[:, 2] = np.bincount(self.right[own], minlength=n)
        for column, some in ((3, counts == 1), (4, counts == 2), (5, counts > 2)):
            out[:, column] = np.bincount(self.left[own & some], minlength=n)
        return out

    def told_stats(self, told: list[dict]) -> np.ndarray:
        told = sorted((r for r in told if r["level"] == 2), key=lambda r: r["share"])
        return np.concatenate([unplanes(unsqueezed(r["counts"]), np.uint32).reshape(STATS, -1).T for r in told]).astype(np.float64)


def _narrow(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in the narrowest of 8, 16 and 32 bits; or in 8 with the places and values of the few that need more, if that is less."""
    most, large = int(values.max(initial=0)), np.flatnonzero(values >= _MARK)
    width = 1 if most < _MARK else 2 if most < 1 << 16 else 4
    if len(values) + 8 * len(large) < width * len(values):
        return np.minimum(values, _MARK).astype(np.uint8), large.astype(np.uint32), values[large].astype(np.uint32)
    return values.astype(f"u{width}"), large[:0].astype(np.uint32), values[:0].astype(np.uint32)


class Counts:
    """A mapped column of a stored share: ``low``, and where that is all ones the value that stands beside it."""

    def __init__(self, low: np.ndarray, large: np.ndarray, values: np.ndarray):
        self.low, self.large, self.values = low, large, values

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        out = self.low[places].astype(np.uint32)
        if len(self.large):
            marked = np.flatnonzero(out == _MARK)
            out[marked] = self.values[np.searchsorted(self.large, places[marked])]
        return out

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return self[np.arange(len(self.low))].astype(dtype or np.uint32)


def _stored(folder: str, name: str, hashes: np.ndarray, counts: np.ndarray) -> list[Counts]:
    """Writes a share's sorted hashes and counts once (a rerun replaces the file by the same bytes) and maps the counts, column by column.

    Behind a head (how many, the first hash, bytes of the gaps, how many columns; of each its width and how many large counts it
    has) stand the counts, as narrow as they can be, and the gaps between hashes as squeezed byte planes.
    """
    path = os.path.join(folder, name)
    part = f"{path}.{uuid.uuid4().hex}"
    gaps = squeezed(planes(np.diff(hashes, prepend=hashes[:1])))
    columns = [_narrow(c) for c in counts.T]
    first = hashes[:1].view(np.int64)[0] if len(hashes) else 0
    head = np.asarray([len(hashes), first, len(gaps), len(columns), *(v for low, large, _ in columns for v in (low.itemsize, len(large)))], dtype=np.int64)
    with open(part, "wb") as file:
        file.write(head.tobytes())
        for block in (b for column in columns for b in column):
            file.write(block.tobytes())
        file.write(gaps)
    os.replace(part, path)
    return _mapped(path)[0]


def _mapped(path: str) -> tuple[list[Counts], int, np.ndarray]:
    """Counts of a stored share mapped column by column, where its gaps begin, and its head."""
    head = np.fromfile(path, dtype=np.int64, count=4)
    n, wide = int(head[0]), np.fromfile(path, dtype=np.int64, count=2 * int(head[3]), offset=32).reshape(-1, 2).tolist()
    at, out = 32 + 16 * len(wide), []
    for width, large in wide:
        blocks = []
        for dtype, size in ((f"u{width}", n), ("u4", large), ("u4", large)):
            blocks.append(np.memmap(path, dtype=dtype, mode="r", offset=at, shape=(size,)) if size else np.zeros(0, dtype=dtype))
            at += blocks[-1].nbytes
        out.append(Counts(*blocks))
    return out, at, head


def read_share(path: str) -> tuple[np.ndarray, list[Counts]]:
    """Sorted hashes of a stored share, and its counts mapped column by column."""
    mapped, at, head = _mapped(path)
    steps = unplanes(unsqueezed(np.fromfile(path, dtype=np.uint8, count=int(head[2]), offset=at).tobytes()), WIDE)
    return np.cumsum(steps, dtype=WIDE) + head[1].astype(WIDE), mapped


def _answer(level: int, columns: int, folder: str, squeeze: bool = False):
    """Merges a share's blocks, stores the sorted array, and answers each block from it; with ``squeeze`` arrays come and go squeezed."""
    opened, closed = (unsqueezed, squeezed) if squeeze else (bytes, bytes)

    def answer(key, table):
        sent = sorted(table.to_pylist(), key=lambda r: r["chunk"])  # blocks arrive in any order; who speaks for a bigram must not depend on it
        parts = [unpack_sorted(opened(r.pop("hashes"))) for r in sent]
        merged = np.concatenate(parts)
        counts = np.concatenate([unplanes(opened(r.pop("counts")), np.uint32).reshape(columns, -1).T for r in sent])
        order = np.argsort(merged, kind="stable")
        first = np.ones(len(order), dtype=bool)
        ordered = merged[order]
        first[1:] = ordered[1:] != ordered[:-1]
        begin = np.flatnonzero(first)
        total = np.add.reduceat(counts[order].astype(np.int64), begin, axis=0)
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(first) - 1
        mapped = _stored(folder, f"level{level}-{key[0].as_py()}", ordered[begin], total.astype(np.uint32))
        own = np.zeros(len(merged), dtype=bool)
        if level == 1:  # the first block that has a bigram in training speaks for it
            some = np.flatnonzero(counts[:, 0] > 0)
            _, speaker = np.unique(group[some], return_index=True)
            own[some[speaker]] = True
            sums = [float((total[:, 0] == k).sum()) for k in (1, 2, 3, 4)]
        else:
            sums = [float(total[:, 0].sum()), float((total[:, 0] > 0).sum()), float(total[:, 2].sum()), *(float((total[:, 2] == k).sum()) for k in (1, 2, 3, 4)), float((total[:, 2] > 0).sum())]
        rows = {name: [] for name in _BACK.names}
        at = 0
        for number, (row, part) in enumerate(zip(sent, parts)):
            to = at + len(part)
            rows["chunk"].append(row["chunk"])
            rows["level"].append(level)
            rows["share"].append(key[0].as_py())
            rows["counts"].append(closed(planes(np.concatenate([m[group[at:to]] for m in mapped]))))
            rows["own"].append(np.packbits(own[at:to]).tobytes() if level == 1 else None)
            rows["sums"].append(sums if number == 0 else None)
            at = to
        return pa.Table.from_pydict(rows, schema=_BACK)

    return answer


def _send_bigrams(shares: int):
    def send(key, table):
        chunk = Chunk(table)
        return chunk.sent(key, chunk.bigrams, chunk.trained[:, None], shares)

    return send


def _send_words(shares: int):
    def send(key, table, back):
        if not table.num_rows:
            return _SENT.empty_table()
        chunk = Chunk(table)
        return chunk.sent(key, chunk.words, chunk.word_stats(*chunk.bigram_counts(back.to_pylist())), shares)

    return send


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """What is taken off counts 0, 1, 2 and 3 or more; halves of the count where counts of counts are missing."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    rough = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return np.asarray([0.0, *(min(max(d, 0.0), k) for k, d in enumerate(rough, 1))])


def _score():
    def score(key, table, back):
        if not table.num_rows:
            return _OUT.empty_table()
        chunk, told = Chunk(table), back.to_pylist()
        counts, _ = chunk.bigram_counts(told)
        stats = chunk.told_stats(told)
        bigram_sums, word_sums = dict(zip(BIGRAM_SUMS, told[0]["bigram_sums"])), dict(zip(WORD_SUMS, told[0]["word_sums"]))
        off = discounts(*(bigram_sums[k] for k in BIGRAM_SUMS))
        low = discounts(*(word_sums[k] for k in ("t1", "t2", "t3", "t4")))
        seen, context, follows, once, twice, more = stats.T
        even, kinds = 1.0 / (word_sums["kinds"] + 1.0), word_sums["bigrams"]
        if kinds:
            rest = (low[1] * word_sums["t1"] + low[2] * word_sums["t2"] + low[3] * (word_sums["t_any"] - word_sums["t1"] - word_sums["t2"])) / kinds
            below = (follows - low[np.minimum(follows, 3).astype(np.int64)]) / kinds + rest * even
        else:
            below = np.full(len(stats), even)
        known = np.maximum(context, 1.0)
        left_over = np.where(context > 0, (off[1] * once + off[2] * twice + off[3] * more) / known, 1.0)
        direct = (counts - off[np.minimum(counts, 3)]) / known[chunk.left]
        chance = np.log10(np.where(context[chunk.left] > 0, direct, 0.0) + left_over[chunk.left] * below[chunk.right])
        base = np.log10((seen + 1.0) / (word_sums["tokens"] + (word_sums["kinds"] + 1.0)))
        of_text = lambda values: np.add.reduceat(values, chunk.first_token)
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(chunk.sizes.astype(np.int64)), pa.array(of_text((seen > 0).astype(np.int64)[chunk.token])),
                                     pa.array(np.full(chunk.texts, int(word_sums["tokens"]))), pa.array(of_text(base[chunk.token])), pa.array(of_text(chance[chunk.pair]))], schema=_OUT)

    return score


def model_folder(spark) -> str:
    """A new folder for the stored arrays below the shared folder, which workers must see as a path to map files from it."""
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.getCheckpointDir()
    if not shared.startswith(("file:", "/")):
        raise ValueError(f"spark.checkpoint.dir is {shared}; memory-mapped arrays need a shared folder that workers see as a path")
    folder = os.path.join(shared.removeprefix("file://").removeprefix("file:"), f"kneser-ney-{uuid.uuid4().hex}")
    os.makedirs(folder, exist_ok=True)
    return folder


def _sums(back: DataFrame, names: tuple[str, ...]) -> Column:
    some = back.where("sums IS NOT NULL")
    return some.agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(len(names))])).scalar()


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    The model is counted on the rows where ``training`` holds (null counts as not) and scores all rows. ``score`` is the
    log10 probability of the text under the model, ``base_score`` that of its tokens under add-one counts. A null text is
    empty: it has the end as its only token. Without training rows every token has probability one. Repeated rows count as
    often as they occur. Other columns are read only through ``training``. An empty table gives an empty result.
    """
    n = tasks_for(docs)
    chunks = shares = n
    folder = model_folder(docs.sparkSession)
    dealt = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    by_chunk = dealt.withColumn("chunk", spread(F.struct("doc_id", F.length("text")), chunks)).repartition(n, "chunk").groupBy("chunk")
    bigrams = by_chunk.applyInArrow(released(_send_bigrams(shares)), _SENT_SQL).groupBy("share").applyInArrow(released(_answer(1, 1, folder, True)), _BACK_SQL).repartition(n, "chunk")
    sent = by_chunk.cogroup(bigrams.groupBy("chunk")).applyInArrow(released(_send_words(shares)), _SENT_SQL)
    words = sent.groupBy("share").applyInArrow(released(_answer(2, STATS, folder, True)), _BACK_SQL).repartition(n, "chunk")
    back = bigrams.unionByName(words).drop("sums").withColumns({"bigram_sums": _sums(bigrams, BIGRAM_SUMS), "word_sums": _sums(words, WORD_SUMS)})
    return by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(released(_score()), _OUT_SQL)
