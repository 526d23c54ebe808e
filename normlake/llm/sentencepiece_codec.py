"""SentencePiece encoding and decoding through the tokenizers library.

The model file is a protobuf message; the few fields needed are read from the wire format. From them the tokenizer is
rebuilt: normaliser (white-space rules, the compiled character map where there is one, the dummy prefix and the word-start
mark), unigram scores or, for a pair-merge model, merges in the order of their scores, and byte fallback. Texts are encoded
in Arrow batches by the library's threads.

A pair-merge model none of whose pieces has the word-start mark after another character can never merge across a word
start, so cutting texts there changes nothing and lets the library reuse words; otherwise texts are merged whole.

Parity: every text's pieces are held against the reference library word by word (each distinct word once per task) where the
cut is exact, else text by text; every text is decoded again and held against the text.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlake.llm.common import by_size, released

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Piece kinds and model kinds of the model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of distinct words (ENTRY more for each) whose pieces a task remembers; beyond it the memory is emptied and words are encoded again.
REMEMBERED_BYTES, ENTRY = 24 << 20, 150
#: Bytes of text encoded, and yielded, at a time (one text at least).
SLICE_BYTES = 1 << 20
_CUT = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+\Z")
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("parity", pa.bool_()), ("round_trip", pa.bool_())])
_SCHEMA = "doc_id bigint, ids array<int>, parity boolean, round_trip boolean"


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    mark_blanks: bool = True


def fields(raw: bytes):
    """(number, value) of each field of a protobuf message; length-delimited values as bytes."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        elif tag & 7 in (1, 5):
            size = 8 if tag & 7 == 1 else 4
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"not a model file: wire type {tag & 7}")
        yield tag >> 3, value


def read_model(raw: bytes) -> Model:
    """The fields of a model file that encoding depends on."""
    model = Model()
    for number, value in fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(fields(value))
            model.kind, model.byte_fallback, model.unk_id = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
        elif number == 3:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.mark_blanks = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score of the made piece first, then by the pieces' ids."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    ranked = []
    for made, i in ids.items():
        for cut in range(1, len(made)):
            left, right = ids.get(made[:cut]), ids.get(made[cut:])
            if left is not None and right is not None:
                ranked.append((-model.pieces[i][1], left, right, made[:cut], made[cut:]))
    return [(left, right) for *_, left, right in sorted(ranked)]


def word_cut_is_exact(model: Model) -> bool:
    return model.kind == BPE and model.mark_blanks and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))


def build(model: Model):
    """The tokenizers.Tokenizer of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(model.pieces)}, merges=merges_of(model), unk_token=model.pieces[model.unk_id][0],
                          fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"neither a unigram nor a pair-merge model: {model.kind}")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.mark_blanks else " "))
    if model.mark_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    if word_cut_is_exact(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(rf"{MARK}*[^{MARK}]+|{MARK}+\z"), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


@lru_cache(maxsize=2)
def _loaded(path: str, threads: int):
    import sentencepiece

    os.environ["RAYON_NUM_THREADS"] = str(threads)  # read when the library starts its pool
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    with open(path, "rb") as file:
        raw = file.read()
    model = read_model(raw)
    return model, build(model), sentencepiece.SentencePieceProcessor(model_proto=raw)


def decoded(tokenizer, ids: list[list[int]], model: Model) -> list[str]:
    """Texts of id lists; the dummy prefix is taken off."""
    texts = tokenizer.decode_batch(ids, skip_special_tokens=False)
    return [t[1:] if model.dummy_prefix and t.startswith(" ") else t for t in texts]


class ByText:
    """Whole texts through the library, the reference and back."""

    def __init__(self, model: Model, tokenizer, reference):
        self.model, self.tokenizer, self.reference = model, tokenizer, reference

    def lists(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[bool]]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return ids, list(map(eq, self.reference.encode(texts, num_threads=1), ids)), list(map(eq, decoded(self.tokenizer, ids, self.model), texts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool], list[bool]]:
        """All texts' pieces in a row, where each text's begin, and per text parity and round trip."""
        ids, same, back = self.lists(texts)
        return _flat(ids), _starts(ids), same, back


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), dtype=np.int32)


def _starts(ids: list) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))]).astype(np.int64)


class ByWord(ByText):
    """Each distinct word once: a text's pieces are the pieces of its words in a row (see word_cut_is_exact)."""

    def __init__(self, model: Model, tokenizer, reference):
        super().__init__(model, tokenizer, reference)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.flat, self.start = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.same, self.back = np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)

    def _learn(self, fresh: list[str]) -> None:
        """A word begins with the mark that the dummy prefix gives back, so it is encoded without it; the mark alone (a
        blank at the end of a text) would be an empty text and is a piece of its own."""
        ids, same, back = self.lists([w[1:].replace(MARK, " ") for w in fresh])
        if MARK in fresh:
            ids[fresh.index(MARK)] = [self.reference.piece_to_id(MARK)]
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
        self.start = np.concatenate([self.start, self.start[-1] + _starts(ids)[1:]])
        self.flat = np.concatenate([self.flat, _flat(ids)])
        self.same, self.back = np.append(self.same, same), np.append(self.back, back)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool], list[bool]]:
        words = [_CUT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.held > REMEMBERED_BYTES:
            self._forget()
        fresh = list(set().union(*words).difference(self.number))
        if fresh:
            self._learn(fresh)
            self.held += sum(map(len, fresh)) + ENTRY * len(fresh)
        count = _starts(words)
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(count[-1]))
        size = self.start[number + 1] - self.start[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.start[number] - ends[:-1], size) + np.arange(int(ends[-1]))
        failed = np.concatenate([[0], np.cumsum(~self.same[number])]), np.concatenate([[0], np.cumsum(~self.back[number])])
        same, back = (f[count[1:]] == f[count[:-1]] for f in failed)
        return self.flat[place], ends[count], same.tolist(), [bool(b) and MARK not in t for b, t in zip(back, texts)]


def _codec(path: str, threads: int) -> ByText:
    model, tokenizer, reference = _loaded(path, threads)
    by_word = word_cut_is_exact(model) and model.dummy_prefix and not model.squeeze and not model.charsmap
    return (ByWord if by_word else ByText)(model, tokenizer, reference)


def encode(docs: DataFrame, model: str = MODEL, threads: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, parity, round_trip for every row of ``docs``; no begin or end pieces are added.

    ``parity``: the reference library gives the same pieces. ``round_trip``: the pieces decode to the text (not where the
    text holds the word-start mark itself, or where the model normalises). A null or empty text has no pieces. Repeated
    rows are answered one by one, other columns are not read. ``model`` is a path every worker can open; ``threads`` is
    the size of the library's pool in each worker (the cores of a task).
    """
    def run(batches):
        codec = _codec(model, threads)
        for batch in batches:
            for part in by_size(batch, "text", SLICE_BYTES):
                flat, starts, same, back = codec.encode([t or "" for t in part.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))
                ids = part.column("doc_id").combine_chunks().cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, lists.cast(_ARROW.field("ids").type), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())], schema=_ARROW)
        if isinstance(codec, ByWord):  # the worker lives on after the task
            codec._forget()

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(released(run), _SCHEMA).select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "parity", "round_trip")


def decode(rows: DataFrame, model: str = MODEL, threads: int = 1, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text for every row of ``rows``; null ids give a null text, ids without pieces an empty one."""
    def run(batches):
        own_model, tokenizer, _ = _loaded(model, threads)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = iter(decoded(tokenizer, [i for i in ids if i is not None], own_model))
            out = [None if i is None else next(texts) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(released(run), "doc_id bigint, text string")
