"""Incremental ingest: a stream of text files or chunk rows into unit and step tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwright.operators.units import text_units


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text) of text files as they arrive."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.concat(F.lit("doc_"), F.substring(F.md5(F.col("_metadata.file_path")), 1, 12)).alias("document_id"), F.col("value").alias("text"))


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Units of each batch, written as a batch's own folder; a batch that is run again overwrites it."""

    def batch(rows: DataFrame, number: int) -> None:
        text_units(rows, "document_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, time_col: str, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """(window start, event_type, n): counts in tumbling windows behind a watermark; works on streams and tables."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
