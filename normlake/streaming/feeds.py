"""Append-only logs as streams. Each feed has a batch twin; what a batch has seen before is a small state table on shared
storage, written per micro-batch, so a replayed batch overwrites its own output and nothing is counted twice."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions import scan
from ..session import checkpoint_dir
from ..sources.tables import SCHEMAS


def feed_folder(spark: SparkSession, name: str, source: str, stream: DataFrame) -> str:
    """The folder of a feed on the shared storage: the same one for the same name, source and result columns.

    A feed that runs again goes on from its log, so only what has arrived since is read and added; a feed whose columns have
    changed begins anew beside the old one. In a local session that names no shared folder every run begins anew.
    """
    key = hashlib.sha256(f"{source.rstrip('/')}|{stream.schema.json()}".encode()).hexdigest()[:16]
    return f"{checkpoint_dir(spark).rstrip('/')}/feeds/{name}-{key}"


def read_feed(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a table that keep arriving in ``folder``."""
    reader = spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_append(stream: DataFrame, folder: str) -> DataFrame:
    """Drains the stream into a parquet table and reads it back.

    The sink notes which files belong to which batch, so a batch that is replayed adds nothing twice. Of an aggregation a
    row appears once its window has closed and stays; the state keeps open windows only.
    """
    query = (stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_updates(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Drains an aggregation and gives every group as it stands, open windows too: a batch writes the groups it has changed, the
    latest row of a group holds."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/log")
             .outputMode("update").trigger(availableNow=True).start())
    query.awaitTermination()
    written = stream.sparkSession.read.schema(StructType(stream.schema.fields).add("batch", LongType())).parquet(f"{folder}/rows")
    values = [c for c in stream.columns if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_l")).select(*keys, "_l.*")


Step = Callable[[DataFrame, "DataFrame | None"], "tuple[DataFrame, DataFrame]"]


def run_incremental(stream: DataFrame, folder: str, step: Step) -> DataFrame:
    """Every micro-batch goes through ``step(batch, state) -> (rows, new state)``; rows and state are written per batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{folder}/state/batch={batch_id - 1}") if batch_id else None
        rows, after = step(batch, state)
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows").drop("batch")


def capture_step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Version capture of new files: the state holds the latest version of every regulation, one row each.

    Captures of a batch follow the state in time order; a capture equal to the one before it opens no version. A capture
    that arrives after a later one of its regulation was stored is named LATE and opens none: numbers once given stay.
    """
    columns = ["regulation_id", "capture_id", "fetched_at", "content_hash", "parser_version", "year"]
    place, late = F.struct("fetched_at", "capture_id"), None
    if state is not None:
        heads = state.select("regulation_id", place.alias("_head"))
        placed = batch.join(heads, "regulation_id", "left").withColumn("_late", F.coalesce(place <= F.col("_head"), F.lit(False)))
        late = placed.filter("_late").select(*columns, F.lit("LATE").alias("change_origin"), F.lit(None).cast("bigint").alias("version_no"))
        batch = placed.filter("NOT _late").select(*columns)
    rows = batch.select(*columns, F.lit(False).alias("_seed"), F.lit(0).cast("bigint").alias("_base"))
    if state is not None:
        seeds = state.select(*columns, F.lit(True).alias("_seed"), F.col("version_no").alias("_base"))
        touched = batch.select("regulation_id").distinct()
        rows = rows.unionByName(seeds.join(touched, "regulation_id", "left_semi"))
    order = [F.col("fetched_at"), F.col("capture_id")]
    linked = scan.previous(rows.withColumn("_now", F.struct("content_hash", "parser_version")), ["regulation_id"], "year", order, "_now", "_before")
    before = F.col("_before")
    text, parser = before["content_hash"] == F.col("content_hash"), before["parser_version"] == F.col("parser_version")
    origin = (
        F.when(before.isNull(), "INITIAL").when(text & parser, "UNCHANGED").when(text, "PARSER_REPROCESSING").when(parser, "SOURCE_CHANGE")
        .otherwise("SOURCE_AND_PARSER_CHANGE"))
    named = linked.withColumn("change_origin", F.when(F.col("_seed"), "SEED").otherwise(origin))
    # a seed opens the numbers its version has reached, every later change one more
    opened = named.withColumn("_new", F.when(F.col("_seed"), F.col("_base")).when(F.col("change_origin") == "UNCHANGED", 0).otherwise(1))
    numbered = scan.running_sum(opened, ["regulation_id"], "year", order, "_new", "version_no")
    out = numbered.filter(~F.col("_seed")).select(*columns, "change_origin", "version_no")
    out = out if late is None else out.unionByName(late)
    everything = numbered.select(*columns, "version_no")
    if state is not None:
        everything = everything.unionByName(state.select(*columns, "version_no").join(batch.select("regulation_id").distinct(), "regulation_id", "left_anti"))
    latest = everything.groupBy("regulation_id").agg(F.max_by(F.struct(*columns[1:], "version_no"), F.struct("fetched_at", "capture_id")).alias("_l"))
    return out, latest.select("regulation_id", "_l.*")


def continuity_step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Audit entries as they arrive: the state is the last entry of every log; breaks of the link are emitted."""
    columns = ["user_id", "event_id", "ts", "hour", "entry_hash", "previous_hash"]
    rows = batch.select(*columns, F.lit(False).alias("_seed"))
    if state is not None:
        rows = rows.unionByName(state.select(*columns, F.lit(True).alias("_seed")))
    order = [F.col("ts"), F.col("event_id")]
    linked = scan.previous(rows, ["user_id"], "hour", order, "entry_hash", "_before")
    broken = linked.filter(~F.col("_seed") & ~F.col("previous_hash").eqNullSafe(F.col("_before"))).select("user_id", "event_id")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct(*columns[1:]), F.struct("ts", "event_id")).alias("_l")).select("user_id", "_l.*")
    return broken, last


def windowed(stream: DataFrame, at: str, delay: str | None, width: str, slide: str | None, by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates per event-time window, for the append mode: a window comes out when the newest row is ``delay`` past its end.

    Rows of windows that have come out are dropped as late, so the state holds the windows of the last ``delay`` and no others.
    Without a delay, for ``run_updates``, no row is ever late and the state holds one row per window and group.
    """
    return _closed(stream.withWatermark(at, delay) if delay else stream, F.window(at, width, slide) if slide else F.window(at, width), by, aggregates)


def sessions(stream: DataFrame, at: str, delay: str, gap: str, by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates per session: rows of one key of which none lies ``gap`` or more behind the one before. Otherwise as ``windowed``."""
    return _closed(stream.withWatermark(at, delay), F.session_window(at, gap), by, aggregates)


def _closed(stream: DataFrame, window: Column, by: list[str], aggregates: tuple[Column, ...]) -> DataFrame:
    counted = stream.groupBy(window.alias("w"), *by).agg(*aggregates)
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in counted.columns if c != "w"])
