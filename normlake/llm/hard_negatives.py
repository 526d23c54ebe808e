"""Hard negatives: rows of another label that come close to a positive's score but not past it.

Candidate rows are put in the order of (label, Hilbert curve) and written to the shared folder as Parquet, a row of that table
being a block: up to BLOCK candidates of one label, their vectors, and a zone map (smallest and largest value of each
dimension). Interval arithmetic over a zone map bounds the inner product of an anchor with everything in a block from both
sides; an anchor reads a block only where these bounds meet one of its windows. A window is a range of scores of which the
first few rows are wanted: all scores for the positives, [least share of p, p] for the negatives of a positive with score p.
Scores found so far raise a window's lower end (its last place, ties by id included), so later blocks are skipped more often.

Blocks are dealt to places, a few hundred MB each. A task takes up the blocks of its place and then reads anchors, packed by
the hundreds, one pack after another: memory follows the place, not the number of anchors. What leaves a task is a window's
first few rows. Anchors are a stated share of the rows and meet all blocks, so the bounds of a block and the packs sent grow
with anchors times blocks; how many blocks are read depends on how well the vectors cluster (README).

Scores are exact integers: products run in float32 where the vectors' lengths prove that every partial sum fits, otherwise
in float64, otherwise in 64-bit integers.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normlake.llm.common import tasks_for
from normlake.session import checkpoint_dir, ensure_checkpoint_dir

EVERY = 100
POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least this many hundredths of the positive.
LEAST_PERCENT = 80
SCALE = 256
BLOCK = 512
PACK = 512
#: Bits per dimension on the Hilbert curve, and how many dimensions (those of largest variance) it runs through.
BITS, CURVE_DIMS = 2, 64
#: Parquet bytes of input that one place stands for.
PLACE_BYTES = 128 << 20
#: Scaled components are cut to +-CUT, so that scores of up to 512 dimensions fit 64 bits.
CUT = 1 << 27
LOW, HIGH = np.iinfo(np.int64).min // 4, np.iinfo(np.int64).max // 4


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (0 to 2**bits - 1 per dimension), as bytes that sort in its order."""
    x = cells.astype(np.uint32).T.copy()
    n, rows = x.shape
    if n == 0:
        return np.zeros((rows, 0), dtype=np.uint8)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the finer squares, dimension by dimension
        below = np.uint32(q - 1)
        for i in range(n):
            turned = (x[i] & np.uint32(q)) != 0
            swap = np.where(turned, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(rows, dtype=np.uint32), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Scaled whole numbers of each vector; shorter vectors are filled up with zeros."""
    size = np.diff(vectors.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(np.clip(flat, -1e300, 1e300) * SCALE), -CUT, CUT).astype(np.int64)
    out = np.zeros((len(size), dims), dtype=np.int64)
    at = np.cumsum(size) - size
    out[np.repeat(np.arange(len(size)), size), np.arange(len(whole)) - np.repeat(at, size)] = whole
    return out


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 16 and 32 bits, told apart by a leading byte."""
    narrow = np.int16 if not values.size or np.abs(values).max() < 1 << 15 else np.int32
    return bytes([np.dtype(narrow).itemsize]) + values.astype(narrow).tobytes()


def _unpacked(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int16 if raw[0] == 2 else np.int32, offset=1).reshape(-1, dims) if dims else np.zeros((0, 0), dtype=np.int16)


def _keys(dims: int, curve: list[int], mean: np.ndarray, width: np.ndarray):
    def keys(batches):
        for batch in batches:
            vectors = batch.column(2)
            whole = matrix(vectors, dims)
            # quarters of a normal distribution: its quartiles lie 0.674 deviations from the mean
            cells = np.clip(np.floor((whole[:, curve] - mean) / width) + (1 << (BITS - 1)), 0, (1 << BITS) - 1)
            key = hilbert_key(np.nan_to_num(cells), BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k.tobytes() for k in key], pa.binary()), pa.array([_packed(v) for v in whole], pa.binary())],
                                             names=["vec_id", "label", "key", "vector"])

    return keys


_CELL_SQL = "place int, kind int, label bigint, n int, ids binary, vectors binary, low binary, high binary"
_CELL = pa.schema([("place", pa.int32()), ("kind", pa.int32()), ("label", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("low", pa.binary()),
                   ("high", pa.binary())])


def _blocks(dims: int):
    """Sorted rows of one partition -> its blocks."""

    def cut(place, label, rows):
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        values = np.stack([_unpacked(r[1], dims)[0] for r in rows]).astype(np.int64) if dims else np.zeros((len(rows), 0), dtype=np.int64)
        low, high = (values.min(axis=0), values.max(axis=0)) if dims else (values[0], values[0])
        return (place, 0, label, len(rows), ids.tobytes(), _packed(values), low.tobytes(), high.tobytes())

    def blocks(batches):
        of, rows = None, []
        for batch in batches:
            done = []
            for place, label, vec_id, vector in zip(*(batch.column(c).to_pylist() for c in ("place", "label", "vec_id", "vector"))):
                if rows and (of != (place, label) or len(rows) == BLOCK):
                    done.append(cut(*of, rows))
                    rows = []
                of = (place, label)
                rows.append((vec_id, vector))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), _CELL)], schema=_CELL)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cut(*of, rows), _CELL)], schema=_CELL)

    return blocks


def _packs(dims: int):
    """Anchors (number, vec_id, label, vector, windows) -> packs; windows are pairs of a lowest and a highest score."""

    def packs(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                number, ids, label = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "vec_id", "label"))
                values = np.stack([_unpacked(v, dims)[0] for v in part.column("vector").to_pylist()]) if dims else np.zeros((len(ids), 0), dtype=np.int16)
                lists = part.column("windows").to_pylist()
                most = max(map(len, lists)) // 2
                windows = np.array([w + [HIGH, LOW] * (most - len(w) // 2) for w in lists], dtype=np.int64)
                row = (0, 1, None, len(ids), np.stack([number, ids, label]).tobytes(), _packed(values), windows.tobytes(), None)
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, _CELL)], schema=_CELL)

    return packs


def _kind_of_product(a: np.ndarray, b: np.ndarray):
    """The narrowest type in which every partial sum of a product of these rows is exact."""
    most = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) * np.sqrt((b.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) * 1.001
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Best:
    """The first ``most`` rows of each anchor's windows among the blocks read so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, most: int):
        self.low, self.high, self.most = low.copy(), high, most
        self.last_id = np.full(low.shape, HIGH, dtype=np.int64)
        empty = np.zeros(0, dtype=np.int64)
        self.slot, self.score, self.ids = empty, empty, empty

    def floor(self, first_id: int) -> np.ndarray:
        """Lowest score that a row with this or a larger id still needs."""
        return self.low + (self.last_id < first_id)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        n = self.low.shape[1]
        slot, at = [self.slot], [np.zeros(0, dtype=np.int64)]
        for w in range(n):
            ok = np.flatnonzero((score >= self.low[row, w]) & (score <= self.high[row, w]))
            slot.append(row[ok] * n + w)
            at.append(ok)
        at = np.concatenate(at)
        slot = np.concatenate(slot)
        score, ids = np.concatenate([self.score, score[at]]), np.concatenate([self.ids, ids[at]])
        order = np.lexsort([ids, -score, slot])
        slot, score, ids = slot[order], score[order], ids[order]
        begin = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        kept = rank < self.most
        full = rank == self.most - 1
        self.low.reshape(-1)[slot[full]] = score[full]
        self.last_id.reshape(-1)[slot[full]] = ids[full]
        self.slot, self.score, self.ids = slot[kept], score[kept], ids[kept]


_FOUND_SQL = "anchor bigint, anchor_id bigint, win int, other_id bigint, score bigint"


def read_blocks(blocks: list[dict], pack: dict, dims: int, same: bool, most: int) -> tuple[pa.RecordBatch, int]:
    """What a pack's windows find in a place's blocks, and how many pairs of anchor and block were read."""
    number, anchor_id, label = np.frombuffer(pack["ids"], dtype=np.int64).reshape(3, -1)
    vectors = _unpacked(pack["vectors"], dims) if dims else np.zeros((len(number), 0), dtype=np.int16)
    windows = np.frombuffer(pack["low"], dtype=np.int64).reshape(len(number), -1)
    best = Best(windows[:, 0::2], windows[:, 1::2], most)
    blocks = [b for b in blocks if (b["label"] == label).any() == same or not same]
    read = 0
    if blocks:
        a = vectors.astype(np.float64)
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        low, high = (np.stack([np.frombuffer(b[c], dtype=np.int64) for b in blocks]).astype(np.float64) for c in ("low", "high"))
        # a float64 sum of such products errs by far less than one part in 2**40
        least, highest = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        slack = 1 + (up @ np.abs(high).T + up @ np.abs(low).T - down @ np.abs(low).T - down @ np.abs(high).T) / 2.0**40
        least, highest = least - slack, highest + slack
        fits = (np.array([b["label"] for b in blocks])[None, :] == label[:, None]) == same
        for n in np.argsort(-highest.max(axis=0), kind="stable").tolist():
            block = blocks[n]
            ids = np.frombuffer(block["ids"], dtype=np.int64)
            floor = best.floor(int(ids.min()))
            row = np.flatnonzero(fits[:, n] & ((highest[:, n, None] >= floor) & (least[:, n, None] <= best.high) & (floor <= best.high)).any(axis=1))
            if not len(row):
                continue
            read += len(row)
            other = _unpacked(block["vectors"], dims) if dims else np.zeros((len(ids), 0), dtype=np.int16)
            kind = _kind_of_product(vectors[row], other)
            score = vectors[row].astype(kind) @ other.T.astype(kind)
            wanted = floor[row].min(axis=1)
            if (wanted <= LOW).any() and score.shape[1] > most + 1:
                wanted = np.maximum(wanted, np.partition(score, -most - 1, axis=1)[:, -most - 1].astype(np.int64))
            r, c = np.nonzero((score >= wanted[:, None]) & (score <= best.high[row].max(axis=1)[:, None]))
            other_row = ids[c] != anchor_id[row[r]]
            r, c = r[other_row], c[other_row]
            best.add(row[r], score[r, c].astype(np.int64), ids[c])
    n = windows.shape[1] // 2
    at = best.slot // n
    return pa.RecordBatch.from_arrays([pa.array(number[at]), pa.array(anchor_id[at]), pa.array((best.slot % n).astype(np.int32)), pa.array(best.ids), pa.array(best.score)],
                                      names=["anchor", "anchor_id", "win", "other_id", "score"]), read


def _search(dims: int, same: bool, most: int):
    def search(batches):
        place, blocks = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["place"] != place:
                    place, blocks = row["place"], []
                if row["kind"] == 0:
                    blocks.append(row)
                else:
                    yield read_blocks(blocks, row, dims, same, most)[0]

    return search


def _meet(blocks: DataFrame, packs: DataFrame, places: int, dims: int, same: bool, most: int) -> DataFrame:
    """Every pack at every place; the first rows of each window over all places."""
    everywhere = packs.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    cells = blocks.unionByName(everywhere).repartitionById(places, "place").sortWithinPartitions("place", "kind")
    found = cells.mapInArrow(_search(dims, same, most), _FOUND_SQL)
    first = Window.partitionBy("anchor_id", "anchor", "win").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_blocks(rows: DataFrame, path: str, places: int, dims: int) -> DataFrame:
    """Rows (vec_id, label, key, vector) in curve order, as blocks with zone maps in Parquet below ``path``."""
    order = ["label", "key", "vec_id"]
    placed = rows.repartitionByRange(places, *order).sortWithinPartitions(*order).withColumn("place", F.spark_partition_id())
    placed.mapInArrow(_blocks(dims), _CELL_SQL).write.parquet(path)
    return rows.sparkSession.read.schema(_CELL_SQL).parquet(path)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, id_col: str = "vec_id",
         vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; positives the first ``positives`` rows of the anchor's label with
    another id; negatives the first ``negatives`` rows of other labels that score at least ``least_percent`` hundredths of the
    positive and at most as much. First are higher scores, then smaller ids. The whole number below SCALE times a component
    stands for it (cut to +-CUT). Rows with a null id, label, vector or component, or a component that is not finite, take no
    part. Shorter vectors are filled up with zeros. Rows that share id, label and vector are one anchor; other rows that share
    an id stay rows of their own, as candidates and as anchors. Further columns are not read. An empty table gives an empty result.

    The blocks lie in the shared folder while this runs; the result is checkpointed there and the blocks are removed.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    usable = F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & usable)
    spread = rows.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.avg("x"), F.coalesce(F.stddev_pop("x"), F.lit(0.0))).orderBy("dim").collect()
    dims, places = len(spread), tasks_for(vectors, PLACE_BYTES)
    curve = sorted(sorted(range(dims), key=lambda d: (-spread[d][2], d))[:CURVE_DIMS])
    mean, width = np.array([spread[d][1] * SCALE for d in curve]), np.array([max(spread[d][2] * 0.674 * SCALE, 1e-9) for d in curve])
    keyed = rows.mapInArrow(_keys(dims, curve, mean, width), "vec_id bigint, label bigint, key binary, vector binary")
    path = f"{checkpoint_dir(spark).rstrip('/')}/hard-negatives-{uuid4().hex}"
    try:
        blocks = write_blocks(keyed, path, places, dims)
        anchors = rows.where(F.col("vec_id") % every == 0).mapInArrow(_keys(dims, curve, mean, width), "vec_id bigint, label bigint, key binary, vector binary")
        anchors = anchors.select("vec_id", "label", "vector").distinct().withColumn("anchor", F.xxhash64("label", "vector")).checkpoint()
        everything = anchors.withColumn("windows", F.array(F.lit(LOW), F.lit(HIGH))).select("anchor", "vec_id", "label", "vector", "windows")
        near = _meet(blocks, everything.mapInArrow(_packs(dims), _CELL_SQL), places, dims, True, positives)
        near = near.select("anchor", "anchor_id", (F.col("rank") - 1).alias("win"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")).checkpoint()
        # ceil(least_percent * p / 100) to p, in whole numbers; none below zero
        low = F.when(F.col("s") >= 0, F.expr(f"({least_percent} * s + 99) div 100")).otherwise(F.lit(HIGH))
        high = F.when(F.col("s") >= 0, F.col("s")).otherwise(F.lit(LOW))
        scores = near.withColumn("s", F.col("positive_score")).groupBy("anchor", "anchor_id").agg(F.array_sort(F.collect_list(F.struct("win", low.alias("low"), high.alias("high")))).alias("w"))
        windowed = anchors.join(scores.withColumnRenamed("anchor_id", "vec_id"), ["anchor", "vec_id"])
        windowed = windowed.select("anchor", "vec_id", "label", "vector", F.flatten(F.transform("w", lambda w: F.array(w["low"], w["high"]))).alias("windows"))
        far = _meet(blocks, windowed.mapInArrow(_packs(dims), _CELL_SQL), places, dims, False, negatives)
        far = far.select("anchor", "anchor_id", "win", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
        found = near.join(far, ["anchor", "anchor_id", "win"])
        return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").checkpoint()
    finally:
        _remove(spark, path)
