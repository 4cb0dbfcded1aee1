"""Documents from files: a row (path, content) per file."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangelake.functions.json import json_valid

DOCUMENT = "path string, modificationTime timestamp, length long, content binary"


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path and content of all files; a path without any raises, as Spark's readers do."""
    return spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select("path", "content")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a Hadoop path or pattern has a file, in whatever store it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return bool(found)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is, if it is there and the session still runs."""
    with contextlib.suppress(Exception):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def read_or_report(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, content and error: paths that aren't there are rows with an error in place of content."""
    there = [p for p in paths if exists(spark, p)]
    gone = [p for p in paths if p not in there]
    missing = spark.createDataFrame([(p, None, f"File not found: {p}") for p in gone], "path string, content binary, error string")
    return read_documents(spark, there).withColumn("error", F.lit(None).cast("string")).unionByName(missing) if there else missing


def from_text(df: DataFrame, column: str, *, most_bytes: int | None = None, content: str = "content", check: bool = False) -> DataFrame:
    """df with a text column's bytes as content, and without texts over a size, if one is given. check adds error, for texts that aren't JSON."""
    out = df.withColumn(content, F.col(column).cast("binary"))
    out = out if most_bytes is None else out.filter(F.octet_length(content) <= most_bytes)
    return out.withColumn("error", F.when(~json_valid(content), F.lit("Invalid JSON"))) if check else out


def write_documents(df: DataFrame, path: str, *, content: str = "content", mode: str = "error") -> None:
    """One line of text per document; documents mustn't hold line breaks."""
    df.select(F.col(content).cast("string").alias("value")).write.mode(mode).text(path)


def foreach_range(ranges: DataFrame, callback: Callable) -> None:
    """Calls callback(row) on the executors for each range as its partition is read."""
    ranges.foreach(callback)
