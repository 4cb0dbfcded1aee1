"""Column functions over JSON text and UTF-8 bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType

from rangelake import kernel

#: The four bytes that end something in JSON text; a byte pattern of UTF-8 that precedes them can't hide them.
DELIMITERS = b'{}"\\'
#: A batch for a Python worker ends at so many bytes; a worker holds its batch several times, as bytes, objects and results.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session sends batches of at most BATCH_BYTES to Python workers, unless it has set a number of its own. A larger document is a batch by itself."""
    if not df.sparkSession._jsparkSession.conf().contains(BATCH_CONF):
        df.sparkSession.conf.set(BATCH_CONF, BATCH_BYTES)
    return df


def binary(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("binary")


@arrow_udf(BooleanType())
def _json_valid(v: pa.Array) -> pa.Array:
    return pa.array([kernel.valid_json(x.as_py()) for x in v], pa.bool_())


def json_valid(c: Column | str) -> Column:
    """Whether the text is one JSON value, strictly; false for null and blank."""
    return _json_valid(binary(c))


def valid_utf8(c: Column | str) -> Column:
    """Whether the bytes are UTF-8; null stays null."""
    return F.is_valid_utf8(binary(c).cast("string"))


def utf8_delimiter_safe(c: Column | str) -> Column:
    """Whether a buffer ends where it may be cut: false for null and empty, else true, since an ASCII last byte is always a character of its own."""
    return F.coalesce(F.octet_length(binary(c)) > 0, F.lit(False))


def valid_delimiter_at(c: Column | str, pos: Column | int) -> Column:
    """Whether the byte at pos (from 0) may be taken as a delimiter: false out of range; true for other bytes and for delimiters whose bytes before form whole characters."""
    b, at = binary(c), F.lit(pos) if isinstance(pos, int) else pos
    here = F.substring(b, at + 1, F.lit(1))
    inside = (at >= 0) & (at < F.octet_length(b))
    before = F.is_valid_utf8(F.substring(b, F.lit(1), at).cast("string"))
    return F.coalesce(F.when(~inside, F.lit(False)).when(~here.isin(*[bytes([x]) for x in DELIMITERS]), F.lit(True)).otherwise(before), F.lit(False))


def slice_bytes(c: Column | str, start: Column | str, length: Column | str) -> Column:
    """length bytes from byte start (from 0)."""
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.substring(binary(c), (as_col(start) + 1).cast("int"), as_col(length).cast("int"))
