"""Exact near-duplicate join of word-shingle sets in the metric space of the Jaccard distance.

1. Equal sets are one set: classes by a 128-bit fingerprint of the set, represented by the smallest id.
2. A set can only have a partner if enough of its shingles occur in other sets. Chunks send their distinct shingles once, as
   packed hashes; a share of the hash space answers with one bit each: also elsewhere or not. Sets with too many shingles of
   their own leave; the others keep their shared shingles only.
3. Pivots and regions. The smallest set that holds a shingle rules it. A set belongs to the regions of the pivots that rule
   its shingles, and is put into as many of them (in one order of pivots, youngest first) as it takes to be sure to meet
   every possible partner: two linked sets share so many shingles that one lies in the window of both. Sets between pivots
   are thereby replicated, sets within one pivot's region are not.
4. Within a region distances to its pivot bound all others by the triangle inequality: only sets whose distances differ by
   no more than the threshold are compared. Regions that fit a task are joined there, a pivot at a time, as long as they
   hold more than one component; larger regions take a pivot's distances in parallel, let go whom the window excludes, and
   are divided again by pivots of their own, round after round.
5. Components of the links, joined back to all rows.

Links inside one component that others imply are not listed; every link between components would be found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlake.llm.common import NO_ID, WIDE, by_size, cuts, ids_of, mix, pack_sorted, planes, room, scanned_bytes, spread, tasks_for, text_of_word, unpack_sorted, unplanes, window_hash, words_of, released
from normlake.llm.components import components
from normlake.session import ensure_checkpoint_dir

SHINGLE, PERCENT = 5, 80
#: A region is joined in one task up to this many shingles (8 bytes each), and beyond it divided.
LOCAL_SHINGLES = 2_000_000
#: Bytes of files that a chunk is made of at least.
CHUNK_BYTES = 512 << 10
#: Parts that a region beyond that is dealt into, each with a copy of its pivot.
SALTS = 64

_SIGNED_SQL = "chunk int, doc_id bigint, n_shingles bigint, one bigint, two bigint"
_SIGNED = pa.schema([("chunk", pa.int32()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])
_SENT_SQL = "share int, chunk int, hashes binary, low binary"
_SENT = pa.schema([("share", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("low", pa.binary())])
_BACK_SQL = "chunk int, doc_id bigint, share int, answer binary"
_BACK = pa.schema([("chunk", pa.int32()), ("doc_id", pa.int64()), ("share", pa.int32()), ("answer", pa.binary())])
_SETS_SQL = "region bigint, id bigint, n bigint, shingles binary"
_SETS = pa.schema([("region", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])
_LINKS_SQL = "a bigint, b bigint"
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def needed(n: np.ndarray | int, percent: int):
    """Shingles that a set of n must share with a partner at least."""
    return -(-n * percent // 100)


def linked(shared: np.ndarray, n: np.ndarray, m: int, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n + m - shared)


def shingle_sets(table: pa.Table, length: int):
    """(text number, shingle) pairs, sorted and distinct, and the set sizes. Fewer words make one shingle, none make none."""
    _, _, _, hashes, starts = words_of(table.column("text"), lower=True)
    counts = np.diff(starts)
    all_runs = window_hash(hashes, length)
    whole = np.flatnonzero(room(starts)[: len(all_runs)] >= length)
    text, shingle = text_of_word(starts)[whole], all_runs[whole]
    for k in range(1, length):
        short = np.flatnonzero(counts == k)
        if len(short):
            text = np.concatenate([text, short])
            shingle = np.concatenate([shingle, window_hash(hashes[starts[short][:, None] + np.arange(k)].reshape(-1), k)[::k]])
    order = np.lexsort([shingle, text])
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    return text[new], shingle[new], np.bincount(text[new], minlength=len(counts))


def _sign(length: int):
    """The size and a 128-bit fingerprint of each row's set, straight from the scan."""

    def sign(batches):
        for table in (part for batch in batches for part in by_size(batch, "text")):
            text, shingle, size = shingle_sets(table, length)
            one, two = np.zeros(len(size), dtype=WIDE), np.zeros(len(size), dtype=WIDE)
            np.add.at(one, text, mix(shingle))
            np.add.at(two, text, mix(shingle ^ WIDE(0x5851F42D4C957F2D)))
            columns = [table.column("chunk"), table.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(mix(one).view(np.int64)), pa.array(mix(two).view(np.int64))]
            yield from pa.Table.from_arrays(columns, schema=_SIGNED).to_batches()

    return sign


def _blocks(chunk: int, hashes: np.ndarray, low: np.ndarray, shares: int) -> pa.Table:
    borders = cuts(hashes, shares)
    rows = {name: [] for name in _SENT.names}
    for share in np.flatnonzero(np.diff(borders)):
        a, b = borders[share], borders[share + 1]
        rows["share"].append(int(share))
        rows["chunk"].append(chunk)
        rows["hashes"].append(pack_sorted(hashes[a:b]))
        rows["low"].append(planes(low[a:b]))
    return pa.Table.from_pydict(rows, schema=_SENT)


class Represented:
    """A chunk's sets that stand for their class, with the sorted distinct shingles of all of them."""

    def __init__(self, table: pa.Table, told: list[dict], length: int):
        text, shingle, size = shingle_sets(table, length)
        ids = ids_of(table.column("doc_id"))
        stand = np.isin(ids, np.asarray([r["doc_id"] for r in told if r["doc_id"] is not None], dtype=np.int64))
        _, first = np.unique(ids, return_index=True)
        once = np.zeros(len(ids), dtype=bool)
        once[first] = True
        some = (stand & once)[text]
        self.ids, self.size, self.text = ids, size, text[some]
        self.distinct, self.place, self.count = np.unique(shingle[some], return_inverse=True, return_counts=True)


def _send_shingles(length: int, shares: int):
    def send(key, table, back):
        if not table.num_rows:
            return _SENT.empty_table()
        sets = Represented(table, back.to_pylist(), length)
        return _blocks(key[0].as_py(), sets.distinct, np.minimum(sets.count, 2).astype(np.uint8), shares)

    return send


def _merged(table: pa.Table, kind):
    sent = table.to_pylist()
    parts = [unpack_sorted(r["hashes"]) for r in sent]
    hashes, values = np.concatenate(parts), np.concatenate([unplanes(r["low"], kind) for r in sent])
    _, group = np.unique(hashes, return_inverse=True)
    return sent, np.cumsum([0, *map(len, parts)]), group, values


def _tell_shared(key, table):
    """One bit per shingle sent: whether two sets hold it."""
    sent, borders, group, count = _merged(table, np.uint8)
    total = np.bincount(group, weights=count)[group] > 1
    rows = {"chunk": [r["chunk"] for r in sent], "doc_id": [None] * len(sent), "share": [key[0].as_py()] * len(sent),
            "answer": [np.packbits(total[a:b]).tobytes() for a, b in zip(borders[:-1], borders[1:])]}
    return pa.Table.from_pydict(rows, schema=_BACK)


def _survive(length: int, percent: int, shares: int):
    """Sets with enough shared shingles, as those shingles; ``n`` stays the size of the whole set."""

    def survive(key, table, back):
        told = back.to_pylist()
        bits = sorted((r for r in told if r["answer"] is not None), key=lambda r: r["share"])
        if not table.num_rows or not bits:
            return _SETS.empty_table()
        sets = Represented(table, told, length)
        borders = cuts(sets.distinct, shares)
        shared = np.concatenate([np.unpackbits(np.frombuffer(r["answer"], dtype=np.uint8), count=int(borders[r["share"] + 1] - borders[r["share"]])) for r in bits]).astype(bool)
        kept = shared[sets.place]
        enough = np.bincount(sets.text[kept], minlength=len(sets.size)) >= np.maximum(needed(sets.size, percent), 1)
        kept &= enough[sets.text]
        text, shingle = sets.text[kept], sets.distinct[sets.place[kept]]
        borders = np.searchsorted(text, np.arange(len(sets.size) + 1))
        rows = {"region": [], "id": [], "n": [], "shingles": []}
        for t in np.flatnonzero(np.diff(borders)):
            rows["region"].append(0)
            rows["id"].append(int(sets.ids[t]))
            rows["n"].append(int(sets.size[t]))
            rows["shingles"].append(shingle[borders[t] : borders[t + 1]].tobytes())
        return pa.Table.from_pydict(rows, schema=_SETS)

    return survive


class Ruled:
    """Rows of sets with, per distinct (region, shingle), a key hash; regions do not mix."""

    def __init__(self, table: pa.Table):
        self.region, self.ids, self.n = (table.column(c).to_numpy().astype(np.int64) for c in ("region", "id", "n"))
        parts = [np.frombuffer(raw, dtype=WIDE) for raw in table.column("shingles").to_pylist()]
        size = np.asarray([len(p) for p in parts], dtype=np.int64)
        self.shingle, self.row = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
        self.borders = np.concatenate([[0], np.cumsum(size)])
        own = mix(self.shingle + mix(self.region.view(WIDE))[self.row])
        self.distinct, self.place, self.count = np.unique(own, return_inverse=True, return_counts=True)


def _send_ids(shares: int):
    """The smallest id that holds each key, and in the sign bit whether several of the chunk do."""

    def send(key, table):
        sets = Ruled(table)
        low = np.full(len(sets.distinct), NO_ID, dtype=np.int64)
        np.minimum.at(low, sets.place, sets.ids[sets.row])
        several = (sets.count > 1).astype(np.int64)
        return _blocks(key[0].as_py(), sets.distinct, np.concatenate([low[:, None], several[:, None]], axis=1).view("V16").reshape(-1), shares)

    return send


def _tell_rulers(key, table):
    """Per key sent: the smallest id that holds it, or NO_ID where no other set does."""
    sent, borders, group, pairs = _merged(table, "V16")
    pairs = pairs.view(np.int64).reshape(-1, 2)
    low = np.full(int(group.max()) + 1, NO_ID, dtype=np.int64)
    np.minimum.at(low, group, pairs[:, 0])
    several = np.bincount(group, weights=1 + pairs[:, 1]) > 1
    answer = np.where(several, low, NO_ID)[group]
    rows = {"chunk": [r["chunk"] for r in sent], "doc_id": [None] * len(sent), "share": [key[0].as_py()] * len(sent),
            "answer": [planes(answer[a:b]) for a, b in zip(borders[:-1], borders[1:])]}
    return pa.Table.from_pydict(rows, schema=_BACK)


def _place(percent: int):
    """A row per set and region its window reaches; the region is the pivot's id, mixed with the region it lies in."""

    def place(key, table, back):
        told = sorted(back.to_pylist(), key=lambda r: r["share"])
        if not table.num_rows or not told:
            return _SETS.empty_table()
        sets = Ruled(table)
        ruler = np.concatenate([unplanes(r["answer"], np.int64) for r in told])[sets.place]
        rows = {"region": [], "id": [], "n": [], "shingles": []}
        for t in range(len(sets.ids)):
            a, b = sets.borders[t], sets.borders[t + 1]
            own = ruler[a:b]
            some = own != NO_ID
            window = int(sets.n[t] - needed(sets.n[t], percent) + 1 - (sets.n[t] - some.sum()))
            if window <= 0:
                continue
            shingles = np.sort(sets.shingle[a:b][some]).tobytes()
            pivots = np.unique(np.sort(own[some])[::-1][:window])
            for pivot in (mix(pivots.view(WIDE)) ^ mix(sets.region[t : t + 1].view(WIDE))).view(np.int64).tolist():
                rows["region"].append(pivot)
                rows["id"].append(int(sets.ids[t]))
                rows["n"].append(int(sets.n[t]))
                rows["shingles"].append(shingles)
        return pa.Table.from_pydict(rows, schema=_SETS)

    return place


class Region:
    """Sets of one region, compared a pivot at a time."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sets: list[bytes], percent: int):
        self.ids, self.n, self.percent = ids, n, percent
        parts = [np.frombuffer(raw, dtype=WIDE) for raw in sets]
        self.size = np.asarray([len(p) for p in parts], dtype=np.int64)
        self.borders = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.concatenate(parts)

    def shared(self, pivot: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Shingles each of the others (row numbers) shares with a sorted set."""
        size = self.size[others]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.borders[others] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        place = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        hits = np.concatenate([[0], np.cumsum(pivot[place] == flat)])
        return hits[ends] - hits[ends - size]

    def links(self) -> list[tuple[int, int]]:
        """Links that connect what links connect: pivots from the smallest component, compared with the other components,
        until one component is left to compare."""
        out: list[tuple[int, int]] = []
        label = np.arange(len(self.ids))
        active = np.ones(len(self.ids), dtype=bool)
        apart = None
        while True:
            names, sizes = np.unique(label[active], return_counts=True)
            if len(names) < 2:
                return out
            # the first pivot is the smallest id, which all distances in the window test refer to
            one = int(np.argmin(self.ids)) if apart is None else int(np.flatnonzero(active & (label == names[np.argmin(sizes)]))[0])
            pivot = self.flat[self.borders[one] : self.borders[one + 1]]
            others = np.flatnonzero(active & (label != label[one]))
            if apart is not None:
                others = others[np.abs(apart[others] - apart[one]) <= 1 - self.percent / 100 + 1e-9]
            shared = self.shared(pivot, others)
            if apart is None:
                apart = np.zeros(len(self.ids))
                apart[others] = 1 - shared / (self.n[others] + self.n[one] - shared)
            near = others[linked(shared, self.n[others], int(self.n[one]), self.percent)]
            out += [(int(self.ids[one]), int(self.ids[x])) for x in near]
            joined = np.isin(label, np.append(label[near], label[one]))
            label[joined] = label[joined].min()
            active[one] = False


def _join_region(percent: int):
    def join(key, table):
        ids = table.column("id").to_numpy()
        _, first = np.unique(ids, return_index=True)
        if len(first) < 2:
            return _LINKS.empty_table()
        sets = table.column("shingles").to_pylist()
        found = Region(ids[first], table.column("n").to_numpy()[first], [sets[i] for i in first], percent).links()
        return pa.Table.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=_LINKS)

    return join


def _to_pivot(percent: int):
    """Distance of each row to its region's pivot."""

    def measure(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch]).to_pylist()
            shared = [len(np.intersect1d(np.frombuffer(r["shingles"], dtype=WIDE), np.frombuffer(r["pivot_shingles"], dtype=WIDE), assume_unique=True)) for r in rows]
            union = [r["n"] + r["pivot_n"] - s for r, s in zip(rows, shared)]
            table = pa.Table.from_batches([batch]).select(["region", "id", "n", "shingles", "pivot"])
            table = table.append_column("apart", pa.array([1 - s / u for s, u in zip(shared, union)], pa.float64()))
            yield from table.append_column("near", pa.array([100 * s >= percent * u for s, u in zip(shared, union)], pa.bool_())).to_batches()

    return measure


def _divide_large(large: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links to the pivots, rows still to be compared) of regions beyond a task: every row against its region's smallest set,
    dealt over SALTS parts; rows linked to the pivot leave unless a row that is not linked lies within their window."""
    pivots = large.groupBy("region").agg(F.min_by(F.struct(F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("shingles").alias("pivot_shingles")), "id").alias("p"))
    pivots = pivots.select("region", "p.*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = large.withColumn("salt", spread(F.col("id"), SALTS)).join(pivots, ["region", "salt"]).where("id != pivot").drop("salt")
    measured = salted.mapInArrow(released(_to_pivot(percent)), "region bigint, id bigint, n bigint, shingles binary, pivot bigint, apart double, near boolean").checkpoint()
    links = measured.where("near").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    nearest = measured.where("NOT near").groupBy("region").agg(F.min("apart").alias("nearest"))
    left = measured.join(nearest, "region").where(~F.col("near") | (F.col("apart") >= F.col("nearest") - (1 - percent / 100) - 1e-9))
    return links, left.select("region", "id", "n", "shingles")


def chunks_for(df: DataFrame, n: int) -> int:
    """Chunks, and shares of the hash space, for ``n`` tasks: two a task, but none of fewer than CHUNK_BYTES of the files read.

    Chunks and shares exchange an array for each pair of them, so on small files their number follows the bytes, not the partitions.
    """
    read = scanned_bytes(df)
    return min(2 * n, -(-read // CHUNK_BYTES)) if read else 2 * n


def _links(sets: DataFrame, n: int, chunks: int, percent: int, local_shingles: int) -> DataFrame:
    shares, found = chunks, None
    while True:
        dealt = sets.withColumn("chunk", spread(F.struct("region", "id"), chunks)).repartition(n, "chunk").groupBy("chunk")
        rulers = dealt.applyInArrow(released(_send_ids(shares)), _SENT_SQL).groupBy("share").applyInArrow(released(_tell_rulers), _BACK_SQL)
        placed = dealt.cogroup(rulers.groupBy("chunk")).applyInArrow(released(_place(percent)), _SETS_SQL).checkpoint()
        sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.length("shingles") / 8).alias("weight")).where("sets > 1")
        known = placed.join(sizes, "region")
        own = known.where(F.col("weight") <= local_shingles).select("region", "id", "n", "shingles").groupBy("region").applyInArrow(released(_join_region(percent)), _LINKS_SQL)
        large = known.where(F.col("weight") > local_shingles).select("region", "id", "n", "shingles")
        found = own if found is None else found.unionByName(own)
        if large.isEmpty():
            return found
        near, sets = _divide_large(large, percent)
        found, sets = found.unionByName(near), sets.checkpoint()


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                 local_shingles: int = LOCAL_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id for every row of ``docs``.

    Words are runs of other than blanks, A-Z lower-cased. Two sets link where 100 * shared >= percent * union. A text of
    fewer words than a shingle has its whole sequence as one; a null, empty or wordless text has an empty set and links with
    nothing, like a row without an id. Rows that share an id and a set are one set. An empty table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    n = tasks_for(docs)
    chunks = shares = chunks_for(docs, n)
    dealt = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = dealt.withColumn("chunk", spread(F.struct("doc_id", F.length("text")), chunks))
    by_chunk = dealt.repartition(n, "chunk").groupBy("chunk")
    signed = dealt.mapInArrow(released(_sign(shingle)), _SIGNED_SQL).checkpoint()
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("one", "two").agg(F.min(F.struct("doc_id", "chunk")).alias("low"))
    stand = classes.select("low.chunk", "low.doc_id", F.lit(None).cast("int").alias("share"), F.lit(None).cast("binary").alias("answer"))
    asked = by_chunk.cogroup(stand.groupBy("chunk")).applyInArrow(released(_send_shingles(shingle, shares)), _SENT_SQL)
    back = asked.groupBy("share").applyInArrow(released(_tell_shared), _BACK_SQL).unionByName(stand)
    sets = by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(released(_survive(shingle, percent, shares)), _SETS_SQL).checkpoint()
    found = components(_links(sets, n, chunks, percent, local_shingles))
    named = classes.select("one", "two", F.col("low.doc_id").alias("class_id")).join(found, F.col("class_id") == found["node"], "left")
    named = named.select(F.col("one").alias("_one"), F.col("two").alias("_two"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    joined = signed.join(named, (signed["one"] == F.col("_one")) & (signed["two"] == F.col("_two")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """``docs`` with one row of each component (the smallest id); columns as they were. Rows without an id all stay."""
    stays = jaccard_join(docs, id_col=id_col, **names).where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(stays, docs[id_col].cast("bigint") == stays["_kept_id"], "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
