"""Arithmetic of scan reports, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024


def throughput(n_bytes: Column, milliseconds: Column) -> Column:
    """MiB a second; times under a tenth of a millisecond count as that."""
    return (n_bytes / MIB) / (F.greatest(milliseconds.cast("double"), F.lit(0.1)) / 1000)


def position_percent(start: Column, total: Column) -> Column:
    """Where in a document a range starts, in percent with one digit; 0 for an empty document."""
    return F.when(total > 0, F.round(start / total * 100, 1)).otherwise(F.lit(0.0))


def width_percent(length: Column, total: Column) -> Column:
    """A range's share of a document in percent with two digits, 1 at least."""
    return F.when(total > 0, F.round(F.greatest(length / total * 100, F.lit(1.0)), 2)).otherwise(F.lit(1.0))
