"""Keyword tables: a prefix tree's questions asked of rows (keyword, datum), as a bag."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from rangelake import kernel
from rangelake.functions.json import binary

_PAIR = pa.list_(pa.struct([("keyword", pa.string()), ("datum", pa.string())]))


def utf8_safe(c: Column) -> Column:
    """Text without what isn't UTF-8, such as half a pair of surrogates."""
    return F.when(F.is_valid_utf8(c), c).otherwise(F.regexp_replace(F.make_valid_utf8(c), "\ufffd", ""))


def build_terms(df: DataFrame, words: Column, datum: Column, *, keep: tuple[str, ...] = (), ensure_utf8: bool = True) -> DataFrame:
    """keep, keyword and datum: a row per item and word; null and empty words give none, repeats stay. ensure_utf8 drops from keywords what isn't UTF-8."""
    found = df.select(*keep, F.explode(words).alias("keyword"), datum.alias("datum"))
    return (found.withColumn("keyword", utf8_safe(F.col("keyword"))) if ensure_utf8 else found).filter("keyword <> ''")


def prefix_search(terms: DataFrame, text: str, *, normalize: bool = False) -> DataFrame:
    """Rows whose keyword starts with text, case and all; none for an empty text, and none whose datum is null.

    normalize trims and lower-cases text first. The predicate reaches a Parquet scan of terms.
    """
    text = text.strip().lower() if normalize else text
    if not text:
        return terms.filter(F.lit(False))
    return terms.filter(F.startswith("keyword", F.lit(text)) & F.col("datum").isNotNull())


def contains_exact(terms: DataFrame, keyword: str) -> DataFrame:
    """One row: found."""
    return terms.filter(F.col("keyword") == keyword).limit(1).agg((F.count("*") > 0).alias("found"))


def term_count(terms: DataFrame) -> DataFrame:
    return terms.agg(F.count("*").alias("n_terms"))


def ordered_matches(terms: DataFrame) -> DataFrame:
    """Breadth-first order of a tree: shorter keywords first."""
    return terms.orderBy(F.length("keyword"), "keyword")


def distinct_matches(terms: DataFrame) -> DataFrame:
    return terms.select("datum").distinct()


@arrow_udf(ArrayType(StructType([StructField("keyword", StringType()), StructField("datum", StringType())])))
def _json_terms(v: pa.Array) -> pa.Array:
    return pa.array([[{"keyword": k, "datum": d} for k, d in kernel.json_terms(x.as_py())] for x in v], _PAIR)


def json_terms(df: DataFrame, content: str, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, keyword and datum of whole JSON documents: member names, words of over two characters in strings, numbers as written."""
    return df.select(*keep, F.inline_outer(_json_terms(binary(content)))).filter(F.col("keyword").isNotNull())
