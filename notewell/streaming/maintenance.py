"""Streams: changed paths into index generations, calls into session windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.operators import indexing
from notewell.sources.generations import Generations

CHANGES = "path string, content string, deleted boolean, seq long"


def changes(spark: SparkSession, folder: str, files_per_batch: int = 400) -> DataFrame:
    """The stream of change records dropped as JSON lines into a folder."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).json(folder)


def coalesced(batch: DataFrame) -> DataFrame:
    """The last change of each path; rows without content that aren't deletions are left alone."""
    last = batch.groupBy("path").agg(F.max_by(F.struct("content", "deleted"), "seq").alias("c")).select("path", "c.content", F.coalesce("c.deleted", F.lit(False)).alias("deleted"))
    return last.where(F.col("deleted") | F.col("content").isNotNull())


def index_writer(generations: Generations, stream: str = "") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that publishes the changes of a batch as a generation.

    A generation names the last batch of every stream, so a batch that runs again after it was
    published changes nothing, and batches of another stream, or of a stream begun anew, are no repeats. Every
    batch is applied whole, whatever its size.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        held = generations.applied(stream)
        if held is not None and held >= batch_id:
            return
        changed = coalesced(batch).persist()
        try:
            if not changed.isEmpty():
                indexing.apply(generations, changed, {stream: batch_id})
        finally:
            changed.unpersist()

    return apply


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave to the stream of a checkpoint; a stream begun anew has another."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first().id


def run_index(spark: SparkSession, folder: str, root: str, checkpoint: str):
    """Apply all waiting changes to the index under ``root`` and stop."""
    generations = Generations(spark, root)

    def apply(batch: DataFrame, batch_id: int) -> None:
        index_writer(generations, stream_id(batch.sparkSession, checkpoint))(batch, batch_id)

    return changes(spark, folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_windows(calls: DataFrame, gap: str = "900 seconds", late: str = "1 hour") -> DataFrame:
    """(session, start, end, calls, errors) of a stream or table of calls with a session gap.

    The exact runs of a table are in operators.telemetry; here an event's own length doesn't count.
    """
    marked = calls.withColumn("started_at", F.col("started_at").cast("timestamp"))
    if calls.isStreaming:
        marked = marked.withWatermark("started_at", late)
    grouped = marked.groupBy("session", F.session_window("started_at", gap).alias("w")).agg(
        F.count("*").alias("calls"), F.sum((~F.col("outcome").isin("ok", "duplicate")).cast("bigint")).alias("errors")
    )
    return grouped.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls", "errors")
