"""Streams: dictionaries and QA findings over arriving segment and pair files, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scriptorium.operators import qa


def arriving(spark: SparkSession, path: str, schema: StructType | str, files_a_batch: int = 64) -> DataFrame:
    """Parquet files as they arrive, at most so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream's event times as instants, which watermarks need, with its watermark; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value) over tumbling or sliding windows; on a stream, events later than ``late`` are left
    out and a window is final when the watermark passes it."""
    frame = F.window("ts", length, slide) if slide else F.window("ts", length)
    source = _watermarked(events, late)
    out = source.groupBy(frame.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, n, value): a user's events with no gap of that length between them."""
    source = _watermarked(events, late)
    out = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("w.start").alias("start"), "n", "value")


def running_cores(segments: DataFrame) -> DataFrame:
    """The dictionary of cores with counts so far, kept in the stream's state (output mode complete or update)."""
    return segments.filter(~F.col("passthrough")).groupBy(F.col("core").alias("text")).agg(F.count(F.lit(1)).alias("count"))


def qa_findings(pairs: DataFrame) -> DataFrame:
    """Findings of each arriving pair; a projection, so it needs no state."""
    return qa.pair_findings(pairs, F.lit(False))


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A stream into Parquet, each batch in a folder of its own that a repeated batch overwrites."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
