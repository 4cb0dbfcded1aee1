"""Reports on JSON structure and UTF-8."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from rangelake import kernel
from rangelake.functions.json import binary

_REPORT = [("is_valid_utf8", pa.bool_()), ("utf8_error", pa.string()), ("is_valid_structure", pa.bool_()), ("bytes_checked", pa.int64())]
_KIND = StructType().add("is_valid_utf8", BooleanType()).add("utf8_error", StringType()).add("is_valid_structure", BooleanType()).add("bytes_checked", LongType())


@arrow_udf(_KIND)
def _check(v: pa.Array) -> pa.Array:
    rows = []
    for x in v:
        data = x.as_py()
        error = "no text" if data is None else kernel.utf8_error(data)
        rows.append((error is None, error, error is None and kernel.valid_json(data), len(data or b"")))
    return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * 4, _REPORT)], fields=[pa.field(*f) for f in _REPORT])


def validation_report(df: DataFrame, content: str, *, keep: Sequence[str] = ()) -> DataFrame:
    """keep, is_valid_utf8, utf8_error (with the byte where it is), is_valid_structure and bytes_checked; null is invalid and has no bytes."""
    return df.select(*keep, F.inline_outer(F.array(_check(binary(content)))))
