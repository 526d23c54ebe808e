"""Documents to training tokens: five stages, each an operator of ``normlake.llm``.

Every stage but the last returns the columns of ``documents`` and works on all that the stage before kept.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from normlake.llm.common import table
from normlake.llm.decontaminate import clean
from normlake.llm.exact_dedup import drop_copies
from normlake.llm.jaccard_join import drop_near_copies
from normlake.llm.quality import keep_good
from normlake.llm.sentencepiece_codec import encode
from normlake.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the smallest doc_id stays."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go (no hit share is tolerated)."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, parity, round_trip of what is left."""
    return encode(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_copies), ("jaccard_join", near_copies), ("decontamination", decontamination), ("sentencepiece", pieces)]
#: A fitted classifier and a tokenizer are not SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's rows are written as Parquet below the shared folder and reread as the next one's input."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
