"""One row per document: what a service would answer to a request that holds the document.

Each answer has keep, success and error. All that an answer gathers belongs to one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangelake import kernel
from rangelake.functions.json import binary, json_valid, slice_bytes
from rangelake.operators.index import build_index, search
from rangelake.operators.scan import RANGE, _collections_udf, _path_udf, scan_collections
from rangelake.operators.terms import _json_terms
from rangelake.operators.validate import validation_report


def _object(content: Column, r: Column, hashes: bool, with_content: bool) -> Column:
    piece = slice_bytes(content, r["start_position"], r["length"])
    whole = (r["length"] > 0) & ~F.coalesce(F.startswith(r["error"], F.lit("Object size")), F.lit(False))
    none = F.lit(None).cast("string")
    return F.struct(
        r["start_position"].alias("start_position"), r["length"].alias("length"), r["item_index"].alias("item_index"),
        (F.when(whole, F.md5(piece)) if hashes else none).alias("hash"), (F.when(whole, F.decode(piece, "UTF-8")) if with_content else none).alias("json_content"),
    )


def scan_response(
    df: DataFrame, content: str, targets: Sequence[str] | None = None, *, keep: Sequence[str] = (),
    include_content: bool = True, hashes: bool = True, max_object_size: int = kernel.MAX_OBJECT_SIZE,
) -> DataFrame:
    """keep, success, error, collections map<name, array of objects> and stats (bytes_processed, total_objects_found, collections_scanned)."""
    udf = _collections_udf(targets, True, True, max_object_size, True)
    got = df.select(*keep, binary(content).alias("_b"), F.explode(F.array(udf(binary(content)))).alias("_r"))
    ranges = F.coalesce("_r.ranges", F.array().cast(f"array<{RANGE}>"))
    names = F.array_distinct(F.transform(ranges, lambda r: r["collection"]))

    def objects(name: Column) -> Column:
        return F.transform(F.filter(ranges, lambda r: r["collection"] == name), lambda r: _object(F.col("_b"), r, hashes, include_content))

    stats = F.struct(
        F.coalesce(F.octet_length("_b"), F.lit(0)).cast("long").alias("bytes_processed"),
        F.size(ranges).cast("long").alias("total_objects_found"), F.size(names).cast("long").alias("collections_scanned"),
    )
    collections = F.map_from_entries(F.transform(names, lambda name: F.struct(name, objects(name))))
    error = F.col("_r.doc_error")
    return got.select(*keep, error.isNull().alias("success"), error.alias("error"), collections.alias("collections"), stats.alias("stats"))


def path_response(
    df: DataFrame, content: str, json_path: str, *, keep: Sequence[str] = (), strict: bool = False,
    include_content: bool = True, hashes: bool = True, max_object_size: int = kernel.MAX_OBJECT_SIZE,
) -> DataFrame:
    """keep, success, error, json_path, objects and total_found."""
    udf = _path_udf(json_path, strict, False, max_object_size, True)
    got = df.select(*keep, binary(content).alias("_b"), F.explode(F.array(udf(binary(content)))).alias("_r"))
    objects = F.transform("_r.ranges", lambda r: _object(F.col("_b"), r, hashes, include_content))
    error = F.col("_r.doc_error")
    return got.select(
        *keep, error.isNull().alias("success"), error.alias("error"), F.lit(json_path).alias("json_path"),
        objects.alias("objects"), F.size("_r.ranges").cast("long").alias("total_found"),
    )


def term_response(df: DataFrame, content: str, term: str | None, *, keep: Sequence[str] = ()) -> DataFrame:
    """keep, success, error, matches (distinct data whose keyword starts with term, in the document's order) and total_indexed.

    A blank term matches nothing. Case counts: keywords are lower-cased, and term isn't.
    """
    got = df.select(*keep, F.explode(F.array(F.struct(json_valid(content).alias("ok"), _json_terms(binary(content)).alias("terms")))).alias("_r"))
    hits = F.filter("_r.terms", lambda t: F.startswith(t["keyword"], F.lit(term))) if term and term.strip() else F.slice("_r.terms", F.lit(1), F.lit(0))
    return got.select(
        *keep, F.col("_r.ok").alias("success"), F.when(~F.col("_r.ok"), F.lit("Invalid JSON")).alias("error"),
        F.array_distinct(F.transform(hits, lambda t: t["datum"])).alias("matches"), F.size("_r.terms").cast("long").alias("total_indexed"),
    )


def search_response(
    df: DataFrame, content: str, targets: Sequence[str] | None, term: str, *, keep: Sequence[str],
    fields: Sequence[str] = (), ngrams: bool = False, max_results: int = 10,
) -> DataFrame:
    """keep, success, error, total_matches, offsets (ascending) and objects (the first max_results by position) of each document; keep has to name it."""
    objects = "array<struct<start_position: bigint, length: bigint, item_index: int, json_content: string>>"

    def answer(rows: DataFrame, success: bool, error: str | None, *found: Column) -> DataFrame:
        kinds = {"total_matches": "bigint", "offsets": "array<bigint>", "objects": objects}
        return rows.select(*keep, F.lit(success).alias("success"), F.lit(error).cast("string").alias("error"), *(c.cast(k).alias(n) for c, (n, k) in zip(found, kinds.items())))

    if not term or not term.strip():
        return answer(df, False, "Search term is required.", F.lit(0), F.array(), F.array())
    ranges = scan_collections(df, content, targets, keep=keep, include_content=True, hashes=False, validate_utf8=False, validate_structure=False)
    hits = search(build_index(ranges, keep=keep, fields=fields, ngrams=ngrams), term.lower(), keep=keep)
    found = ranges.join(hits, [*keep, "start_position"], "left_semi")
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy(*keep).orderBy("start_position")))
    taken = F.when(F.col("_n") <= max(1, max_results), F.struct("start_position", "length", "item_index", F.col("content").alias("json_content")))
    answers = ranked.groupBy(*keep).agg(F.count("*").alias("total_matches"), F.sort_array(F.collect_list("start_position")).alias("offsets"), F.array_sort(F.collect_list(taken)).alias("objects"))
    every = df.select(*keep).join(answers, list(keep), "left")
    none = F.array().cast("array<bigint>"), F.array().cast(objects)
    return answer(every, True, None, F.coalesce("total_matches", F.lit(0)), F.coalesce("offsets", none[0]), F.coalesce("objects", none[1]))


def validate_response(df: DataFrame, content: str, *, keep: Sequence[str] = ()) -> DataFrame:
    """keep, success, error and the columns of validation_report()."""
    report = validation_report(df, content, keep=keep)
    return report.select(*keep, F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), *report.columns[len(keep) :])
