"""Byte-level BPE by content-defined chunks: a chunk that many texts share is encoded once, joins are repaired exactly.

Chunks. A rolling hash over the last REACH bytes cuts a text wherever its leading bits are zero, so a passage is cut alike
wherever it stands, whatever is in front of it. Cuts lie between characters and are not closer than LEAST bytes.

Once each. Texts are dealt into places (that exchange is read again at each step). A place sends the distinct hashes of its
chunks, one sorted difference-coded array per share of the hash space; a share tells each place which of them it is to encode
for others too (several places have them, none of a smaller number). Those places send the codes to the shares, the shares
hand them to whoever asked. Chunks of one place only are encoded there. What travels is a hash per distinct chunk and place
and the codes of shared chunks, so a passage that a third of all texts hold costs one entry per place.

Joins. The tokenizer cuts a text into words first, and no word holds a blank behind another character: between a visible
ASCII character and a blank there is a word border in the text and in every piece of it. So the codes of a chunk's own
encoding are exact between two such borders. A join is encoded anew from the nearest border before it to the nearest one
behind it, over further chunks if there is none in the next one; there both sides agree, which is checked on the codes'
lengths. Equal windows are encoded once per slice.

Hashes are 64 bits wide and never trusted: byte-level codes hold their bytes, so every assembled text is compared with the
original bytes and encoded whole should a chunk of equal hash have been another one.

Plain chunks go through tiktoken where the file's merges rank as its ids do, which makes both libraries merge alike; a chunk
with an added token, with long runs, or with characters outside long-settled Unicode blocks (the libraries' tables could
differ) goes through the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from normlake.llm.common import PIECE_BYTES, WIDE, _hash_piece, by_size, cuts, inside, mix, pack_sorted, planes, tasks_for, unpack_sorted, unplanes

#: Bytes the rolling hash looks back.
REACH = 32
#: Leading bits of the rolling hash that must be zero: a cut each 1,024 bytes or so.
BITS = 10
LEAST = 128
#: Bytes of text encoded in one call of the library.
CALL_BYTES = 1 << 20
#: Parquet bytes a place stands for.
PLACE_BYTES = 24 << 20
#: Fixed value: how byte-level BPE cuts a text into words.
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What tiktoken is not given: runs that it merges in quadratic time, and characters outside the blocks from Latin to Cyrillic, punctuation, kana and ideographs.
_UNSETTLED = re.compile("\\S{400}|\\s{400}|[^\t-\r -~\xa0-\u02af\u0391-\u03a9\u03b1-\u03c9\u0410-\u044f\u2010-\u2027\u2030-\u205e\u20ac\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")
_GEAR = (mix(np.arange(1, 257, dtype=WIDE) * WIDE(0xD1B54A32D192ED03)) >> WIDE(32)).astype(np.uint32)


def _byte_of_letter() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: printable ones stand for themselves, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    return letters | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}


class Codec:
    """A tokenizers file, and the bytes of each of its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = (spec["model"]["type"], (spec.get("pre_tokenizer") or {}).get("type"), (spec.get("decoder") or {}).get("type"))
        if kinds != ("BPE", "ByteLevel", "ByteLevel") or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path}: only byte-level BPE without normaliser and without a prefix space keeps a text's bytes")
        added = spec.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: added tokens must stand as they are written")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if any(re.search(r"\s", t["content"]) for t in added):
            raise ValueError(f"{path}: added tokens with blanks would hide word borders")
        byte, special = _byte_of_letter(), {t["id"]: t["content"].encode() for t in added}
        size = max(self.library.get_vocab().values()) + 1
        tokens = [special[i] if i in special else bytes(byte[c] for c in self.library.id_to_token(i) or "") for i in range(size)]
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.special = [c.decode() for c in special.values()]
        self.plain = self._plain(spec, {t: i for i, t in enumerate(tokens) if t and i not in special})

    def _plain(self, spec: dict, ranks: dict[bytes, int]):
        """The same merges for tiktoken; None where ids do not rise with the merges or the words are cut otherwise."""
        vocab = spec["model"]["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        singles = [i for t, i in vocab.items() if len(t) == 1 and i not in set(made)]
        other = any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if other or not spec["pre_tokenizer"].get("use_regex", True) or len(singles) != 256 or any(a >= b for a, b in zip(made, made[1:])) or max(singles) >= min(made, default=256):
            return None
        import tiktoken

        return tiktoken.Encoding("chunks", pat_str=WORD, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _settled(self, text: str) -> bool:
        return self.plain is not None and not _UNSETTLED.search(text) and not any(c in text for c in self.special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out = [np.array(self.plain(t), dtype=np.uint32) if self._settled(t) else None for t in texts]
        rest, at = [n for n, ids in enumerate(out) if ids is None], 0
        while at < len(rest):
            to, size = at, 0
            while to < len(rest) and (to == at or size < CALL_BYTES):
                size += len(texts[rest[to]])
                to += 1
            for n, found in zip(rest[at:to], self.library.encode_batch([texts[n] for n in rest[at:to]], add_special_tokens=False)):
                out[n] = np.array(found.ids, dtype=np.uint32)
            at = to
        return out

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The letters of many ids, in steps that bound the memory beyond them. An id outside the vocabulary has none."""
        ids = np.where((ids >= 0) & (ids < len(self.lengths)), ids, len(self.lengths))
        lengths, begins = np.append(self.lengths, 0), np.append(self.begins, 0)
        parts = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)]
            size = lengths[part]
            ends = np.cumsum(size)
            parts.append(self.letters[np.repeat(begins[part] - (ends - size), size) + np.arange(int(ends[-1]))])
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _hits(data: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash allows a cut (its window may reach into the text before; such places are sorted out later)."""
    found = []
    for at in range(0, len(data), PIECE_BYTES):
        low = max(at - REACH + 1, 0)
        value = _GEAR[data[low : at + PIECE_BYTES]]
        step = 1
        while step < REACH:
            more = value.copy()
            more[step:] += value[:-step] << np.uint32(step)
            value, step = more, step * 2
        found.append(np.flatnonzero(value[at - low :] >> np.uint32(32 - BITS) == 0) + at)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


class Chunks:
    """Chunks of the texts of a table: letters, first and end place, hash, and for each text where its chunks begin."""

    def __init__(self, texts: pa.ChunkedArray):
        array = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks] or [pa.array([], pa.large_string())]).fill_null("")
        borders = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, dtype=np.int64)
        raw = array.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8)[borders[0] : borders[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
        self.borders = borders - borders[0]
        hit = _hits(self.data)
        text = np.searchsorted(self.borders, hit, side="right") - 1
        usable = (hit - self.borders[text] >= REACH) & (hit + 1 < self.borders[text + 1])
        hit, text = hit[usable], text[usable]
        near = np.zeros(len(hit), dtype=bool)
        near[1:] = (np.diff(hit) < LEAST) & (text[1:] == text[:-1])
        cut = hit[~near] + 1
        cut = cut[(self.data[cut] & 0xC0) != 0x80]
        edges = np.unique(np.concatenate([self.borders, cut]))
        self.first, self.last = edges[:-1], edges[1:]
        self.starts = np.searchsorted(self.first, self.borders)
        self.hashes = np.empty(len(self.first), dtype=WIDE)
        at = 0
        while at < len(self.first):
            to = max(at + 1, int(np.searchsorted(self.last, self.first[at] + PIECE_BYTES, side="right")))
            self.hashes[at:to] = _hash_piece(self.data, self.first[at:to], self.last[at:to])
            at = to

    def string(self, first: int, last: int) -> str:
        return self.data[first:last].tobytes().decode()

    def encode(self, tool: Codec, hashes: np.ndarray) -> list[np.ndarray]:
        """Codes of the chunks with these hashes (a hash several chunks have: its first)."""
        known, at = np.unique(self.hashes, return_index=True)
        at = at[np.searchsorted(known, hashes)]
        return tool.encode([self.string(a, b) for a, b in zip(self.first[at].tolist(), self.last[at].tolist())])


def _ranges(source: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = last - first
    ends = np.cumsum(size)
    return source[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


#: The left and the right byte of a place that is a word border in any text.
_VISIBLE, _BLANK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_VISIBLE[33:127] = True
_BLANK[[9, 10, 13, 32]] = True


def assemble(tool: Codec, chunks: Chunks, hashes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each has, from the codes of their distinct chunks (ordered by hash)."""
    counts = np.diff(chunks.starts)
    if not len(chunks.first):
        return np.zeros(0, dtype=np.uint32), counts
    text = np.repeat(np.arange(len(counts)), counts)
    of = np.searchsorted(hashes, chunks.hashes)
    ends = np.concatenate([[0], np.cumsum(tool.lengths[codes])])  # bytes before each token of the store, and after the last
    base = ends[np.concatenate([[0], np.cumsum(lengths)])]
    # Word borders that hold in any text: behind a visible character, before a blank. The ends of a text are borders too.
    sure = np.flatnonzero(_VISIBLE[chunks.data[:-1]] & _BLANK[chunks.data[1:]]) + 1
    sure = np.unique(np.concatenate([sure, chunks.borders]))
    inner = np.flatnonzero(text[1:] == text[:-1])
    join = chunks.last[inner]
    low, high = sure[np.searchsorted(sure, join, side="right") - 1], sure[np.searchsorted(sure, join)]
    # A chunk's own codes hold from the border behind its first join to the border before its last one.
    own_first, own_last = chunks.first.copy(), chunks.last.copy()
    own_first[inner + 1], own_last[inner] = high, low
    used = own_first < own_last
    wanted = [base[of] + (place - chunks.first) for place in (own_first, own_last)]
    first, last = (np.searchsorted(ends, w) for w in wanted)
    wrong = used & ((base[of + 1] - base[of] != chunks.last - chunks.first) | (ends[np.minimum(first, len(codes))] != wanted[0]) | (ends[np.minimum(last, len(codes))] != wanted[1]))
    # Windows, each once though several joins may share it.
    window = np.flatnonzero((np.diff(low, prepend=-1) != 0) & (low < high))
    strings = [chunks.string(a, b) for a, b in zip(low[window].tolist(), high[window].tolist())]
    distinct = {t: n for n, t in enumerate(dict.fromkeys(strings))}
    mended = tool.encode(list(distinct))
    mended_at = len(codes) + np.concatenate([[0], np.cumsum([len(c) for c in mended])]).astype(np.int64)
    number = np.array([distinct[t] for t in strings], dtype=np.int64)
    source = np.concatenate([codes, *mended])
    # Both kinds of pieces in the order of the text.
    place = np.concatenate([own_first[used], low[window]])
    begin, end = np.concatenate([first[used], mended_at[number]]), np.concatenate([last[used], mended_at[number + 1]])
    owner = np.concatenate([text[used], text[inner[window]]])
    order = np.argsort(place, kind="stable")
    begin, end, owner = begin[order], end[order], owner[order]
    bad = np.zeros(len(counts), dtype=bool)
    bad[text[wrong]] = True
    end = np.where(bad[owner] | (end < begin), begin, end)
    size = np.bincount(owner, weights=end - begin, minlength=len(counts)).astype(np.int64)
    ids = _ranges(source, begin, end)
    made = tool.bytes_of(ids)
    at = np.concatenate([[0], np.cumsum(size)])
    bytes_at = np.concatenate([[0], np.cumsum(tool.lengths[ids])])[at]
    bad |= np.diff(bytes_at) != np.diff(chunks.borders)
    if not bad.any() and np.array_equal(made, chunks.data):
        return ids, size
    for n in np.flatnonzero(~bad).tolist():
        bad[n] = not np.array_equal(made[bytes_at[n] : bytes_at[n + 1]], chunks.data[chunks.borders[n] : chunks.borders[n + 1]])
    parts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    for n in np.flatnonzero(bad).tolist():
        parts[n] = tool.encode([chunks.string(chunks.borders[n], chunks.borders[n + 1])])[0]
        size[n] = len(parts[n])
    return np.concatenate(parts), size


_SENT_SQL = "share int, place int, hashes binary"
_SENT = pa.schema([("share", pa.int32()), ("place", pa.int32()), ("hashes", pa.binary())])
_TOLD_SQL = "place int, hashes binary"
_TOLD = pa.schema([("place", pa.int32()), ("hashes", pa.binary())])
_CODED_SQL = "share int, hashes binary, lengths binary, codes binary"
_CODED = pa.schema([("share", pa.int32()), ("hashes", pa.binary()), ("lengths", pa.binary()), ("codes", pa.binary())])
_GIVEN_SQL = "place int, hashes binary, lengths binary, codes binary"
_GIVEN = pa.schema([("place", pa.int32()), ("hashes", pa.binary()), ("lengths", pa.binary()), ("codes", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _offer(shares: int):
    """The distinct hashes of a place, by share."""

    def offer(key, table):
        hashes = np.unique(Chunks(table.column("text")).hashes)
        at = cuts(hashes, shares)
        return _rows([(int(s), key[0].as_py(), pack_sorted(hashes[at[s] : at[s + 1]])) for s in np.flatnonzero(np.diff(at))], _SENT)

    return offer


def _appoint(key, table):
    """To each place the hashes it is to encode for others too: those that several places have and none of smaller number."""
    sent = sorted(table.to_pylist(), key=lambda r: r["place"])
    parts = [unpack_sorted(r["hashes"]) for r in sent]
    hashes, first, count = np.unique(np.concatenate(parts), return_index=True, return_counts=True)
    shared, first = hashes[count > 1], first[count > 1]
    whose = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[first]
    return _rows([(sent[n]["place"], pack_sorted(shared[whose == n])) for n in np.unique(whose).tolist()], _TOLD)


def _encode_shared(path: str, shares: int):
    def encode_shared(key, table, told):
        if not told.num_rows or not table.num_rows:
            return _CODED.empty_table()
        hashes = np.sort(np.concatenate([unpack_sorted(h) for h in told.column("hashes").to_pylist()]))
        codes = Chunks(table.column("text")).encode(codec(path), hashes)
        at = cuts(hashes, shares)
        return _rows([(int(s), pack_sorted(hashes[at[s] : at[s + 1]]), planes(np.array([len(c) for c in codes[at[s] : at[s + 1]]], dtype=np.uint32)),
                       planes(np.concatenate(codes[at[s] : at[s + 1]]))) for s in np.flatnonzero(np.diff(at))], _CODED)

    return encode_shared


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, the codes behind each other, and the number of codes of each hash."""
    rows = table.to_pylist()
    if not rows:
        return np.zeros(0, dtype=WIDE), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    hashes = np.concatenate([unpack_sorted(r["hashes"]) for r in rows])
    lengths = np.concatenate([unplanes(r["lengths"], np.uint32) for r in rows]).astype(np.int64)
    codes = np.concatenate([unplanes(r["codes"], np.uint32) for r in rows])
    order = np.argsort(hashes)
    ends = np.cumsum(lengths)
    return hashes[order], _ranges(codes, (ends - lengths)[order], ends[order]), lengths[order]


def _hand_out(key, sent, coded):
    """To each place the codes of its shared chunks."""
    hashes, codes, lengths = _unpacked(coded)
    ends = np.cumsum(lengths)
    rows = []
    for place, raw in zip(sent.column("place").to_pylist(), sent.column("hashes").to_pylist()) if len(hashes) else ():
        wanted = unpack_sorted(raw)
        at = np.searchsorted(hashes, wanted[inside(hashes, wanted)])
        if len(at):
            rows.append((place, pack_sorted(hashes[at]), planes(lengths[at].astype(np.uint32)), planes(_ranges(codes, (ends - lengths)[at], ends[at]))))
    return _rows(rows, _GIVEN)


def _texts(tool: Codec, ids: np.ndarray, size: np.ndarray) -> pa.Array:
    """The text of each run of ids; bytes that are no UTF-8 become the replacement character."""
    known = np.where((ids >= 0) & (ids < len(tool.lengths)), tool.lengths[np.clip(ids, 0, len(tool.lengths) - 1)], 0)
    ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(size)])].tolist()
    letters = tool.bytes_of(ids)
    return pa.array([letters[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())


def _encoded(path: str, as_bytes: bool, with_text: bool):
    names = ["doc_id", "n_tokens", "ids", *(["decoded"] if with_text else [])]

    def encoded(key, table, given):
        tool, got = codec(path), _unpacked(given)
        parts = []
        own: dict[int, np.ndarray] = {}
        for batch in table.to_batches():
            for part in by_size(batch, "text"):
                chunks = Chunks(part.column("text"))
                wanted = np.unique(chunks.hashes)
                here = inside(got[0], wanted)
                new = [h for h in wanted[~here].tolist() if h not in own]
                own.update(zip(new, chunks.encode(tool, np.array(new, dtype=WIDE)) if new else ()))
                at = np.searchsorted(got[0], wanted[here])
                ends = np.cumsum(got[2])
                lists = [own[h] for h in wanted[~here].tolist()]
                lengths = np.zeros(len(wanted), dtype=np.int64)
                lengths[here], lengths[~here] = got[2][at], [len(c) for c in lists]
                both = np.concatenate([got[1], *lists]) if lists else got[1]
                first = np.zeros(len(wanted), dtype=np.int64)
                first[here] = (ends - got[2])[at]
                first[~here] = len(got[1]) + np.cumsum(lengths[~here]) - lengths[~here]
                ids, size = assemble(tool, chunks, wanted, _ranges(both, first, first + lengths), lengths)
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                if as_bytes:
                    out = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((offsets.to_numpy() * 4).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                else:
                    out = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                texts = [_texts(tool, ids.astype(np.int64), size)] if with_text else []
                parts.append(pa.Table.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(size.astype(np.int64)), out, *texts], names=names))
        empty = [pa.int64(), pa.int64(), pa.binary() if as_bytes else pa.list_(pa.int32()), pa.string()]
        return pa.concat_tables(parts) if parts else pa.table({n: pa.array([], t) for n, t in zip(names, empty)})

    return encoded


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", as_bytes: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids of every row of ``docs``, as the tokenizers library encodes its whole text without adding special tokens.

    ids are an array of int, or with ``as_bytes`` little-endian unsigned 32-bit integers in a binary column. ``with_text`` adds
    what ``decode`` gives for them, without a second Python worker per task.

    ``path`` names a byte-level BPE file that every worker can read; another kind is refused. Strings of added tokens in a text
    become those tokens, as in the library. Null and empty texts have no ids. Rows are encoded each for itself, so repeated
    rows and ids stay as they are; further columns are not read. An empty table gives an empty result.
    """
    n = tasks_for(docs, PLACE_BYTES)
    shares = n
    dealt = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    place = F.pmod(F.xxhash64("doc_id", F.length("text"), F.spark_partition_id()), F.lit(n)).cast("int")
    by_place = dealt.withColumn("place", place).repartition(n, "place").groupBy("place")
    sent = by_place.applyInArrow(_offer(shares), _SENT_SQL).groupBy("share")
    told = sent.applyInArrow(_appoint, _TOLD_SQL).groupBy("place")
    coded = by_place.cogroup(told).applyInArrow(_encode_shared(path, shares), _CODED_SQL).groupBy("share")
    given = sent.cogroup(coded).applyInArrow(_hand_out, _GIVEN_SQL).groupBy("place")
    ids = f"ids {'binary' if as_bytes else 'array<int>'}{', decoded string' if with_text else ''}"
    return by_place.cogroup(given).applyInArrow(_encoded(path, as_bytes, with_text), f"doc_id bigint, n_tokens bigint, {ids}")


def _decoded(path: str, column: str, names: list[str]):
    def decoded(batches):
        tool = codec(path)
        for batch in batches:
            lists = batch.column(column).cast(pa.large_list(pa.int64()))
            for row in range(0, batch.num_rows, 256):
                part = lists.slice(row, 256)
                flat = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                size = np.array([0 if n is None else n for n in pc.list_value_length(part).to_pylist()], dtype=np.int64)
                texts = _texts(tool, flat.astype(np.int64), size)
                yield pa.RecordBatch.from_arrays([*batch.slice(row, 256).columns, texts], names=[*names, "decoded"])

    return decoded


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids, special tokens included, as the library's decode gives it.

    Null ids give an empty text, ids outside the vocabulary nothing, bytes that are no UTF-8 the replacement character. An
    input column called ``decoded`` is replaced.
    """
    kept = encoded.drop("decoded")
    schema = StructType([*kept.schema.fields, StructField("decoded", StringType())])
    return kept.mapInArrow(_decoded(path, ids_col, kept.columns), schema)
