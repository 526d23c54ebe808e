"""Substring dedup by level-wise doubling of repeated windows.

Level 1 looks at windows of about half the wanted length: only those that two texts share can be part of a longer repeat.
Each level doubles the length of the survivors (two windows of n words, one word in common, make 2n - 1), the last level is
the wanted length, and what survives it names the words to remove. ``levels(13)`` is 7 and 13.

Level 1 would still move one hash per word. It moves only the smallest-hash window among those inside each full window
(equal full windows choose the same one, so nothing is lost), which is about a quarter.

Texts are dealt once into chunks by id and that exchange is reused at each level. A level sends, per chunk and share of the
hash space, each distinct hash once with the smallest and largest id that has it, as one packed array; a share answers each
chunk with the hashes that matter to it. So a passage that a third of all texts hold costs one entry per chunk. The last
level compares 128 bits; level 1 only prunes, so its 64 bits cannot remove anything wrongly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlake.llm.common import (NO_ID, WIDE, cuts, ids_of, inside, pack_sorted, planes, room, spread, tasks_for, text_of_word, unpack_sorted,
                                 unplanes, window_hash, words_of)

WINDOW = 13
_SENT = pa.schema([("share", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("second", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_SENT_SQL = "share int, chunk int, hashes binary, second binary, low binary, high binary"
_BACK = pa.schema([("chunk", pa.int32()), ("hashes", pa.binary()), ("second", pa.binary()), ("low", pa.binary())])
_BACK_SQL = "chunk int, hashes binary, second binary, low binary"


def levels(window: int) -> list[int]:
    """Window lengths from the first to the last, each at most twice the one before less the shared word."""
    first = (window + 2) // 2
    return [first, window] if first < window else [window]


def _read(table: pa.Table):
    """Ids by row, word hashes, words left in the text from each word on, and the row of each word."""
    data, first, last, hashes, starts = words_of(table.column("text"))
    return ids_of(table.column("doc_id")), data, first, last, hashes, starts, room(starts), text_of_word(starts)


def _smallest_inside(hashes: np.ndarray, left: np.ndarray, short: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each full window: its first word and the place of its smallest short window (the first of equal ones)."""
    starts = np.flatnonzero(left >= window)
    short_hash = window_hash(hashes, short)
    place, best = starts.copy(), short_hash[starts] if len(starts) else np.zeros(0, dtype=WIDE)
    for step in range(1, window - short + 1):
        other = short_hash[starts + step]
        smaller = other < best
        best = np.where(smaller, other, best)
        place[smaller] = starts[smaller] + step
    return starts, place


def _distinct(keys: list[np.ndarray], ids: np.ndarray):
    """Sorted distinct keys with the smallest and the largest id of each."""
    if not len(ids):
        return keys, ids, ids
    order = np.lexsort([ids, *keys[::-1]])
    keys, ids = [k[order] for k in keys], ids[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(ids)) - 1
    return [k[begin] for k in keys], ids[begin], ids[end]


def _send(chunk: int, keys: list[np.ndarray], low: np.ndarray, high: np.ndarray, shares: int) -> pa.Table:
    borders = cuts(keys[0], shares)
    rows = {name: [] for name in _SENT.names}
    for share in np.flatnonzero(np.diff(borders)):
        a, b = borders[share], borders[share + 1]
        rows["share"].append(int(share))
        rows["chunk"].append(chunk)
        rows["hashes"].append(pack_sorted(keys[0][a:b]))
        rows["second"].append(planes(keys[1][a:b]) if len(keys) > 1 else None)
        rows["low"].append(planes(low[a:b]))
        rows["high"].append(planes(high[a:b] - low[a:b]))
    return pa.Table.from_pydict(rows, schema=_SENT)


def _first_level(short: int, window: int, shares: int):
    def send(key, table):
        ids, _, _, _, hashes, _, left, row = _read(table)
        _, place = _smallest_inside(hashes, left, short, window)
        place = np.unique(place)
        keys, low, high = _distinct([window_hash(hashes, short)[place]], ids[row[place]])
        return _send(key[0].as_py(), keys, low, high, shares)

    return send


def _answer(only_later: bool):
    """What a share tells each chunk: hashes that two texts have (or, at the last level, that an earlier text has)."""

    def answer(key, table):
        sent = table.to_pylist()
        parts = [unpack_sorted(r["hashes"]) for r in sent]
        chunk = np.repeat(np.arange(len(sent)), [len(p) for p in parts])
        first = np.concatenate(parts)
        second = np.concatenate([unplanes(r["second"], WIDE) for r in sent]) if sent[0]["second"] is not None else np.zeros(len(first), dtype=WIDE)
        low = np.concatenate([unplanes(r["low"], np.int64) for r in sent])
        high = low + np.concatenate([unplanes(r["high"], np.int64) for r in sent])
        order = np.lexsort([second, first])
        first, second, low, high, chunk = first[order], second[order], low[order], high[order], chunk[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        lowest, highest = np.minimum.reduceat(low, begin)[group], np.maximum.reduceat(high, begin)[group]
        told = lowest < (high if only_later else highest)
        rows = {name: [] for name in _BACK.names}
        by_chunk = np.flatnonzero(told)
        by_chunk = by_chunk[np.argsort(chunk[by_chunk], kind="stable")]
        borders = np.searchsorted(chunk[by_chunk], np.arange(len(sent) + 1))
        for number in np.flatnonzero(np.diff(borders)):
            own = by_chunk[borders[number] : borders[number + 1]]
            rows["chunk"].append(sent[number]["chunk"])
            rows["hashes"].append(pack_sorted(first[own]))
            rows["second"].append(planes(second[own]) if only_later else None)
            rows["low"].append(planes(lowest[own]) if only_later else None)
        return pa.Table.from_pydict(rows, schema=_BACK)

    return answer


def _survivors(back: pa.Table) -> np.ndarray:
    parts = [unpack_sorted(raw) for raw in back.column("hashes").to_pylist()]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=WIDE)


def _candidates(table: pa.Table, back: pa.Table, short: int, window: int):
    """Full windows whose smallest short window survived."""
    read = _read(table)
    starts, place = _smallest_inside(read[4], read[6], short, window)
    return read, starts[inside(_survivors(back), window_hash(read[4], short)[place])] if len(starts) else starts


def _last_level(short: int, window: int, shares: int):
    def send(key, table, back):
        if not table.num_rows or not back.num_rows:
            return _SENT.empty_table()
        (ids, _, _, _, hashes, _, _, row), starts = _candidates(table, back, short, window)
        keys, low, high = _distinct([window_hash(hashes, window)[starts], window_hash(hashes, window, 1)[starts]], ids[row[starts]])
        return _send(key[0].as_py(), keys, low, high, shares)

    return send


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
_OUT_SQL = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


def _remove(window: int):
    """Texts less every word of a window that an earlier text has too."""

    def remove(key, table, back):
        ids, data, first, last, hashes, starts, left, row = _read(table)
        gone = np.zeros(len(hashes), dtype=bool)
        if back.num_rows and len(hashes) >= window:
            told = back.to_pylist()
            a = np.concatenate([unpack_sorted(r["hashes"]) for r in told])
            b = np.concatenate([unplanes(r["second"], WIDE) for r in told])
            low = np.concatenate([unplanes(r["low"], np.int64) for r in told])
            order = np.lexsort([b, a])
            a, b, low = a[order], b[order], low[order]
            at = np.flatnonzero(left >= window)
            one, two = window_hash(hashes, window)[at], window_hash(hashes, window, 1)[at]
            some = inside(a, one)
            at, one, two = at[some], one[some], two[some]
            place = np.searchsorted(a, one)
            found = np.zeros(len(at), dtype=bool)
            lowest = np.zeros(len(at), dtype=np.int64)
            while len(at):  # equal first halves stand next to each other; nearly always there is just one
                here = (place < len(a)) & (a[np.minimum(place, len(a) - 1)] == one) & ~found
                if not here.any():
                    break
                same = here & (b[np.minimum(place, len(a) - 1)] == two)
                lowest[same] = low[place[same]]
                found |= same
                place = place + 1
            hit = at[found & (lowest < ids[row[at]])]
            change = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(change, hit, 1)
            np.add.at(change, hit + window, -1)
            gone = np.cumsum(change[:-1]) > 0
        counts = np.diff(starts)
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), starts[:-1]) * (counts > 0) if len(counts) else counts
        return pa.Table.from_arrays([table.column("doc_id").cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)),
                                     _kept(data, first, last, ~gone, starts)], schema=_OUT)

    return remove


def _kept(data: np.ndarray, first: np.ndarray, last: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space, put together letter by letter over the whole chunk."""
    number = np.flatnonzero(keep)
    size = last[number] - first[number] + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
    step = 1 << 18
    for at in range(0, len(number), step):
        part, sizes = number[at : at + step], size[at : at + step] - 1
        to = np.repeat(ends[at : at + step] - size[at : at + step] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        source = np.repeat(first[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        out[to] = data[source]
    borders = np.searchsorted(number, starts)
    places = np.concatenate([[0], ends])[borders]
    some = np.diff(borders) > 0
    return pa.array([bytes(out[a : b - 1]).decode() if s else "" for a, b, s in zip(places[:-1].tolist(), places[1:].tolist(), some.tolist())], pa.string())


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) for every row of ``docs``.

    A word goes when a window of ``window`` words that covers it also starts in a text with a smaller id. Windows are judged
    on the texts as they come in. Null, empty and shorter texts have no windows and lose nothing. A null id sorts behind all
    others; rows that share an id do not remove each other's words. Other columns are not read. An empty table gives an
    empty result.
    """
    n = tasks_for(docs)
    chunks, shares = n, 2 * n
    level = levels(window)
    short = level[0]
    dealt = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = dealt.withColumn("chunk", spread(F.struct("doc_id", F.length("text")), chunks)).repartition(n, "chunk")
    by_chunk = dealt.groupBy("chunk")
    back = by_chunk.applyInArrow(_first_level(short, window, shares), _SENT_SQL).groupBy("share").applyInArrow(_answer(False), _BACK_SQL)
    back = by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(_last_level(short, window, shares), _SENT_SQL).groupBy("share").applyInArrow(_answer(True), _BACK_SQL)
    return by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(_remove(window), _OUT_SQL)
