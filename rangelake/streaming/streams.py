"""Streams of documents: the batch operators on readStream sources, and an index that grows by appending."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from rangelake.operators.index import build_index
from rangelake.operators.scan import extract_path, scan_collections
from rangelake.sources.files import DOCUMENT


def read_document_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """path and content of files as they appear."""
    reader = spark.readStream.format("binaryFile").schema(DOCUMENT)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path).select("path", "content")


def stream_ranges(docs: DataFrame, targets: Sequence[str] | None = None, *, json_path: str | None = None, keep: Sequence[str] = ("path",), **options) -> DataFrame:
    """scan_collections, or extract_path if json_path is given, over a stream: no state, so late and early documents are alike."""
    return extract_path(docs, "content", json_path, keep=keep, **options) if json_path else scan_collections(docs, "content", targets, keep=keep, **options)


def stream_index(docs: DataFrame, targets: Sequence[str] | None = None, *, keep: Sequence[str] = ("path",), event_time: str | None = None, delay: str = "1 hour", **options) -> DataFrame:
    """Postings of new documents. With event_time, a document that a source delivers again within the delay is indexed once."""
    if event_time:
        docs = docs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keep))
    ranges = scan_collections(docs, "content", targets, keep=keep, include_content=True, hashes=False, validate_structure=False, validate_utf8=False)
    return build_index(ranges, keep=keep, **options)


def append_parquet(df: DataFrame, path: str, checkpoint: str, *, available_now: bool = True):
    """Starts a query that appends to Parquet, once each row under its checkpoint."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def for_each_batch(df: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, *, available_now: bool = True):
    """Starts a query that hands each batch of ranges to callback(batch, number); a batch may come again after a failure."""
    writer = df.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
