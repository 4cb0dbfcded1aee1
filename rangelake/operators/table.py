"""Sorting and filtering of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_sort(df: DataFrame, column: str, *, descending: bool = False) -> DataFrame:
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc())


def table_filter(df: DataFrame, term: str | None, columns: list[str] | None = None) -> DataFrame:
    """Rows with term in some column, in any case; empty cells, zeros and false never match, an empty term keeps all."""
    if not term:
        return df
    kinds = dict(df.dtypes)

    def hit(c: str):
        text = F.contains(F.lower(F.col(c).cast("string")), F.lit(term.lower()))
        if kinds[c] == "boolean":
            text &= F.col(c)
        elif kinds[c] not in ("string", "date", "timestamp", "binary") and kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
            text &= F.col(c) != 0
        return F.coalesce(text, F.lit(False))

    return df.filter(reduce(lambda a, b: a | b, [hit(c) for c in columns or df.columns], F.lit(False)))
