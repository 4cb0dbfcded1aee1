"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six bytes that end a word.
SPACES = " \t\n\x0b\x0c\r"
#: A key filter has 2**FILTER_WORD_BITS words of 64 bits: 4 MB of data, however many keys go in.
FILTER_WORD_BITS = 18
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, bound their batches, and make sure that checkpoint() has a folder.

    The folder is the one named in spark.checkpoint.dir; where that is unset, a local session gets a
    temporary one and any other raises. Batches to Python workers get BATCH_ROWS rows, unless the
    session has set a number of its own: whole texts can be long.
    """
    sc = spark.sparkContext
    if not spark._jsparkSession.conf().contains(BATCH_CONF):
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="rangelake-"))
    if not getattr(sc, "_rangelake_shipped", False):
        root = Path(__file__).resolve().parents[1]
        with tempfile.NamedTemporaryFile(prefix="rangelake-", suffix=".zip", delete=False) as f:
            with zipfile.ZipFile(f, "w") as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, Path(root.name) / p.relative_to(root))
        sc.addPyFile(f.name)
        sc._rangelake_shipped = True


def folder(spark: SparkSession, name: str) -> str:
    """A new place under the checkpoint folder, which all executors share; what is written there goes when the session ends."""
    ready(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is, if it is there and the session still runs."""
    with contextlib.suppress(Exception):
        sc = spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet under the checkpoint folder and read again.

    Like checkpoint() this cuts lineage and survives lost executors. Unlike it, it also drops what the
    optimizer has inferred about the columns, which in iterated joins grows until planning stands
    still. The files go when the session ends.
    """
    path = folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the JVM's byte loop, other texts the character table."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A Bloom filter with one hash over 64-bit keys, as at most 2**18 rows (word, bits).

    Its size doesn't grow with the keys, so it can always be broadcast. Where it is full it lets all
    rows pass, which costs time but no rows.
    """
    k = F.col(key)
    return (
        keys.groupBy(k.bitwiseAND(F.lit(2**FILTER_WORD_BITS - 1)).alias("_kf_word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({key}, {FILTER_WORD_BITS}) & 63 as int))")).alias("_kf_bits"))
    )


def may_have(df: DataFrame, bits: DataFrame, key: str, flag: str) -> DataFrame:
    """df with a boolean column flag: false only for rows whose key isn't among those of key_filter()."""
    word = F.col(key).bitwiseAND(F.lit(2**FILTER_WORD_BITS - 1))
    hit = F.expr(f"coalesce(getbit(_kf_bits, cast(shiftrightunsigned({key}, {FILTER_WORD_BITS}) & 63 as int)) = 1, false)")
    return df.join(F.broadcast(bits), word == F.col("_kf_word"), "left").withColumn(flag, hit).drop("_kf_word", "_kf_bits")
