"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

A state of the automaton stands for word runs that end at the same places of the items, so walking a training text through
it gives, at each word, the longest run ending there that some item contains. A place whose longest match reaches
``window`` words marks the words of that match; an item shorter than a window counts only as a whole.

Items go in blocks of at most ``ITEM_WORDS`` words, one automaton and one pass over the texts per block, so a larger
benchmark costs passes, not memory. Texts are streamed in Arrow batches and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlake.llm.common import LOWER_WORDS, released
from normlake.session import ensure_checkpoint_dir

WINDOW = 10
#: Words of test items in one automaton; about a kilobyte of worker memory each.
ITEM_WORDS = 100_000
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("longest", pa.int64()),
                    ("items", pa.list_(pa.string())), ("spans", _SPANS)])
_SCHEMA = "doc_id bigint, text string, n_words bigint, longest bigint, items array<string>, spans array<struct<first:bigint,last:bigint>>"
_WORD = re.compile(rb"[^ ]+")

Item = tuple[str | None, list[bytes]]
Span = tuple[int, int]


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and any non-ASCII characters."""
    return text.encode().translate(LOWER_WORDS).split() if text else []


class Automaton:
    """Generalised suffix automaton over words; transitions, suffix links and longest lengths are parallel lists."""

    def __init__(self, items: list[Item], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, item_words in items:
            last = 0
            for word in item_words:
                last = self._extend(last, word)
        self._label(items)

    def _add(self, length: int, following: dict[bytes, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the run that ends with ``word`` after the run of state ``last``."""
        if word in self.next[last]:  # an earlier item has this run already
            return self._exact(last, word)
        made = self._add(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = made
            last = self.link[last]
        if last >= 0:
            self.link[made] = self._exact(last, word)
        return made

    def _exact(self, last: int, word: bytes) -> int:
        """The state after ``word`` whose longest run is one longer than ``last``'s; split off where there is none yet."""
        target = self.next[last][word]
        if self.length[target] == self.length[last] + 1:
            return target
        part = self._add(self.length[last] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = part
        while last >= 0 and self.next[last].get(word) == target:
            self.next[last][word] = part
            last = self.link[last]
        return part

    def _label(self, items: list[Item]) -> None:
        """Which items a state's runs occur in (runs of a window or more), and which short items are suffixes of it."""
        self.owners: list[set[str]] = [set() for _ in self.next]
        whole: dict[int, int] = {}
        for name, item_words in items:
            state = 0
            for word in item_words:
                state = self.next[state][word]
                up = state
                while name is not None and self.length[up] >= self.window and name not in self.owners[up]:
                    self.owners[up].add(name)
                    up = self.link[up]
            if 0 < len(item_words) < self.window:
                whole[state] = len(item_words)
                if name is not None:
                    self.owners[state].add(name)
        self.short: list[tuple[Span, ...]] = [()] * len(self.next)
        self.window_state = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            self.short[state] = (((whole[state], state),) if state in whole else ()) + self.short[up]
            if self.length[state] >= self.window:
                self.window_state[state] = self.window_state[up] if self.length[up] >= self.window else state

    def scan(self, text_words: list[bytes]) -> tuple[list[Span], set[str], int]:
        """Disjoint hit spans [first, last), the items whose windows occur, and the longest match."""
        following, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        spans: list[Span] = []
        seen: set[int] = set()
        state = matched = longest = 0
        for place, word in enumerate(text_words, 1):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word not in following[state]:
                continue
            state = following[state][word]
            matched += 1
            if matched > longest:
                longest = matched
            reach = 0
            if matched >= window:
                reach = matched
                seen.add(self.window_state[state])
            for size, end in short[state]:
                if size <= matched:
                    reach = max(reach, size)
                    seen.add(end)
            if reach:
                first = place - reach
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, place))
        return spans, set().union(*(self.owners[s] for s in seen)), longest


def merged(spans: Iterable[Span]) -> list[Span]:
    out: list[Span] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def without(text: str, spans: list[Span]) -> str:
    """``text`` less the words of ``spans``, each with the characters up to the next word that stays."""
    raw = text.encode()
    places = [m.start() for m in _WORD.finditer(raw.translate(LOWER_WORDS))] + [len(raw)]
    kept, at = [], 0
    for first, last in spans:
        kept.append(raw[at : places[first]])
        at = places[last]
    return b"".join([*kept, raw[at:]]).decode()


def item_blocks(items: Iterable[Item], size: int = ITEM_WORDS) -> Iterator[list[Item]]:
    """Items in blocks of at most ``size`` words (one item at least)."""
    held, total = [], 0
    for item in items:
        if held and total + len(item[1]) > size:
            yield held
            held, total = [], 0
        held.append(item)
        total += len(item[1])
    yield held


def _pass(block: list[Item], window: int):
    """Adds one block's findings to those of the passes before."""

    def scan(batches):
        automaton = Automaton(block, window)
        for batch in batches:
            rows: list[list] = [[] for _ in _ARROW]
            for doc_id, text, _, longest, items, spans in zip(*(c.to_pylist() for c in batch.columns)):
                text_words = words(text)
                own, found, reach = automaton.scan(text_words)
                spans = merged([*own, *((s["first"], s["last"]) for s in spans)]) if spans else own
                values = (doc_id, text, len(text_words), max(longest, reach), sorted(found.union(items)), [{"first": a, "last": b} for a, b in spans])
                for column, value in zip(rows, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW)], schema=_ARROW)

    return scan


def scan_texts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", item_words: int = ITEM_WORDS) -> DataFrame:
    """doc_id, text, n_words, longest, items, spans for every row of ``docs``.

    ``longest`` is the longest run of words shared with an item, ``spans`` the hit words [first, last), ``items`` the ids of
    the items whose windows occur, sorted as strings. A null or wordless text is never hit; a null or wordless item hits
    nothing; the words of an item with a null id count without a name. Repeated rows are answered one by one. Other columns
    are not read. The benchmark passes through the driver a block at a time, never whole.
    """
    found = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("bigint").alias("n_words"),
                        F.lit(0).cast("bigint").alias("longest"), F.array().cast("array<string>").alias("items"),
                        F.array().cast("array<struct<first:bigint,last:bigint>>").alias("spans"))
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string"), item_text_col)
    for number, block in enumerate(item_blocks(((i, words(t)) for i, t in items.toLocalIterator()), item_words)):
        if number:
            ensure_checkpoint_dir(docs.sparkSession)
            found = found.checkpoint()
        found = found.mapInArrow(released(_pass(block, window)), _SCHEMA)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.0, **names) -> DataFrame:
    """scan_texts with n_hit and the verdict: ``contaminated`` where the hit share of a text's words exceeds ``max_coverage``."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["last"] - s["first"])
    found = scan_texts(docs, benchmark, window, **names).withColumn("n_hit", hit)
    return found.withColumn("contaminated", F.col("n_hit") > F.col("n_words") * F.lit(max_coverage))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.0, id_col: str = "doc_id",
          text_col: str = "text", **names) -> DataFrame:
    """``docs`` with hit spans cut out of the texts, less the rows whose hit share exceeds ``max_coverage``.

    Columns stay as they are; a text without hits stays to the letter.
    """
    cut = F.pandas_udf(lambda texts, spans: _cut_all(texts, spans), "string")
    found = contamination(docs, benchmark, window, max_coverage, id_col=id_col, text_col=text_col, **names).where("n_hit > 0")
    found = found.select(F.col("doc_id").alias("_hit_id"), F.col("text").alias("_hit_text"), "contaminated",
                         cut("text", "spans").alias("_clean")).dropDuplicates(["_hit_id", "_hit_text"])
    same = docs[id_col].cast("bigint").eqNullSafe(found["_hit_id"]) & (docs[text_col] == found["_hit_text"])
    joined = docs.join(found, same, "left").where(F.coalesce(~found["contaminated"], F.lit(True)))
    return joined.select(*[F.coalesce(found["_clean"], docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])


def _cut_all(texts, spans):
    import pandas as pd

    return pd.Series([without(t, [(s["first"], s["last"]) for s in own]) for t, own in zip(texts, spans)])
