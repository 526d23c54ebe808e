"""Exact dedup by deterministic block naming.

Texts are normalised (each run of blanks becomes one) and cut into blocks of fixed size. Blocks are sorted by their bytes
and named by their rank, so two blocks have one name if and only if they are the same bytes. Adjacent pairs of names are
sorted and named in the same way until each text has a single name. Names are compared, never fingerprints, so no two
different texts can share an identity.

The sort is dealt out: a hash of the bytes picks one of many sorts, and a name is (sort, rank in it). A text that occurs
often would meet itself in one sort, so each Arrow batch first collapses its own equal texts to one row with a list of ids.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlake.llm.common import spread, tasks_for, released
from normlake.session import ensure_checkpoint_dir

BLOCK_BYTES = 4096
#: Equal texts collapsed into one row hold at most this many ids; a batch with more copies makes more rows.
MEMBERS = 10_000
_SCHEMA = "rep bigint, block_no int, blocks int, block binary, members array<struct<doc_id:bigint,text_sha256:string>>"
_ARROW = pa.schema([("rep", pa.int64()), ("block_no", pa.int32()), ("blocks", pa.int32()), ("block", pa.binary()),
                    ("members", pa.list_(pa.struct([("doc_id", pa.int64()), ("text_sha256", pa.string())])))])
_BLANKS = frozenset(b" \t\n\r\x0b\x0c")


def squashed(raw: bytes) -> bytes:
    """Each run of blanks as one space, also at the ends."""
    words = b" ".join(raw.split())
    if not raw or not words:
        return b" " if raw else b""
    return (b" " if raw[0] in _BLANKS else b"") + words + (b" " if raw[-1] in _BLANKS else b"")


def _blocks(size: int):
    """Blocks of the distinct texts of each batch; the first block of a text carries the ids that share it."""

    def cut(batches):
        from pyspark import TaskContext

        made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            same: dict[bytes, list] = {}
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                same.setdefault(squashed(raw or b""), []).append(doc_id)
            rows = {name: [] for name in _ARROW.names}
            held = 0
            for text, ids in same.items():
                sha = hashlib.sha256(text).hexdigest()
                n = max(1, -(-len(text) // size))
                for at in range(0, len(ids), MEMBERS):
                    made += 1
                    for i in range(n):
                        rows["rep"].append(made)
                        rows["block_no"].append(i)
                        rows["blocks"].append(n)
                        rows["block"].append(text[i * size : (i + 1) * size])
                        rows["members"].append([{"doc_id": d, "text_sha256": sha} for d in ids[at : at + MEMBERS]] if i == 0 else None)
                    held += len(text)
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_pydict(rows, schema=_ARROW)
                        rows, held = {name: [] for name in _ARROW.names}, 0
            if rows["rep"]:
                yield pa.RecordBatch.from_pydict(rows, schema=_ARROW)

    return cut


def _named(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Adds ``name``: equal for equal columns and for nothing else; (sort, rank in the sort) as one integer."""
    dealt = df.withColumn("_sort", spread(F.struct(*columns), n))
    rank = F.dense_rank().over(Window.partitionBy("_sort").orderBy(*columns))
    return dealt.withColumn("name", F.shiftleft(F.col("_sort").cast("bigint"), 40) + rank).drop("_sort", *columns)


def name_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each text of a batch: ``blocks`` and ``name`` are its identity, ``members`` the rows that have it."""
    ensure_checkpoint_dir(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    n = 8 * tasks_for(docs)
    longest = source.agg(F.max(F.length("text"))).first()[0] or 0
    first = _named(source.mapInArrow(released(_blocks(block_bytes)), _SCHEMA), ["block"], n).checkpoint()
    done = first.where("blocks = 1").select("rep", "blocks", "name", "members")
    if longest <= block_bytes:
        return done
    several = first.where("blocks > 1")
    held = several.where("members is not null").select("rep", "members")
    level = several.select("rep", "blocks", F.col("block_no").alias("place"), "name")
    width, rounds = -(-longest // block_bytes), 0
    while width > 1:
        pairs = level.groupBy("rep", "blocks", F.shiftright("place", 1).alias("place")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        level = _named(pairs, ["left", "right"], n)
        width, rounds = -(-width // 2), rounds + 1
        if rounds % 4 == 0 and width > 1:
            level = level.checkpoint()
    return done.unionByName(level.join(held, "rep").select("rep", "blocks", "name", "members"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Of equal texts the row with the smallest id stays. A null text counts as empty; an empty text equals only empty texts.
    A null id sorts behind every id; where all ids of a group are null, its rows stay. Rows that repeat the id that stays
    all stay: an id stands for one row. An empty table gives an empty result. Other columns are not read.
    """
    names = name_texts(docs, id_col, text_col, block_bytes)
    groups = names.groupBy("blocks", "name").agg(
        F.min(F.array_min(F.transform("members", lambda m: m["doc_id"]))).alias("keep_id"),
        F.sum(F.size("members")).cast("bigint").alias("group_size"))
    rows = names.join(groups, ["blocks", "name"]).select("keep_id", "group_size", F.explode("members").alias("m"))
    return rows.select(F.col("m.doc_id").alias("doc_id"), "keep_id", "group_size",
                       F.col("m.doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("m.text_sha256").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts (the smallest id); columns as they were."""
    stays = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(stays, docs[id_col].cast("bigint").eqNullSafe(stays["_kept_id"]), "left_semi")
