"""Byte ranges of JSON objects: named array collections, and the first array at a dotted path.

A small Arrow kernel finds offsets; content and hashes are JVM expressions over an object's bytes, so
Catalyst drops them when they aren't used. These bytes are cut out of the document before its ranges
become rows: a row that carried its whole document would, at the next Python function, sort or shuffle,
cost as much as the document. `inline_outer` with a filter, not `inline`, is used on the kernel's result:
`inline` makes the optimizer infer a size predicate and run the kernel twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

from rangelake import kernel
from rangelake.functions.json import binary, bounded, slice_bytes

RANGE = "struct<collection: string, activation: int, item_index: int, start_position: bigint, length: bigint, error: string>"
RESULT = f"struct<doc_error: string, ranges: array<{RANGE}>>"
_RANGE = pa.struct([("collection", pa.string()), ("activation", pa.int32()), ("item_index", pa.int32()), ("start_position", pa.int64()), ("length", pa.int64()), ("error", pa.string())])
_RESULT = pa.struct([("doc_error", pa.string()), ("ranges", pa.list_(_RANGE))])
_NAMES = [f.name for f in _RANGE]


def _result(rows: list[tuple[str | None, list[tuple]]]) -> pa.Array:
    """Columns of the kernel's tuples: no dictionary for each range."""
    ends = [0]
    flat: list[tuple] = []
    for _, ranges in rows:
        flat += ranges
        ends.append(len(flat))
    columns = list(zip(*flat)) if flat else [[]] * len(_NAMES)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RANGE)], fields=list(_RANGE))
    return pa.StructArray.from_arrays([pa.array([e for e, _ in rows], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], fields=list(_RESULT))


def _bytes(v: pa.Array):
    """The documents of a batch, one at a time, so that a batch isn't held twice."""
    return (x.as_py() for x in v)


def targets_of(targets: Sequence[str] | None) -> dict[str, str]:
    """Folded name -> spelling. Blank names don't count; none at all means the default names; names that differ in case only raise."""
    names = [t for t in targets or () if t and t.strip()] or list(kernel.DEFAULT_COLLECTIONS)
    out = {kernel.fold(n): n for n in names}
    if len(out) < len(names):
        raise ValueError(f"targets repeat a name: {names}")
    return out


def _collections_udf(targets, validate_utf8, validate_structure, max_object_size, continue_on_error):
    wanted = targets_of(targets)
    options = {"utf8": validate_utf8, "structure": validate_structure, "max_size": max_object_size, "keep_errors": continue_on_error}

    @arrow_udf(RESULT)
    def run(v: pa.Array) -> pa.Array:
        return _result([(None, []) if d is None else kernel.scan_ranges(d, wanted, **options) for d in _bytes(v)])

    return run


def _path_udf(json_path, strict, validate_utf8, max_object_size, continue_on_error, buffer_size=kernel.BUFFER_SIZE):
    if not json_path or not json_path.strip():
        raise ValueError("JSON path cannot be empty")
    segments = kernel.path_segments(json_path, strict)
    options = {"strict": strict, "utf8": validate_utf8, "max_size": max_object_size, "keep_errors": continue_on_error, "buffer_size": buffer_size}

    @arrow_udf(RESULT)
    def run(v: pa.Array) -> pa.Array:
        rows = []
        for d in _bytes(v):
            error, found = (None, []) if d is None else kernel.path_ranges(d, segments, **options)
            rows.append((error, [(None, 0, i, s, n, None) for i, s, n in found]))
        return _result(rows)

    return run


def _exploded(df: DataFrame, content: str, udf, keep: Sequence[str], pieces: bool) -> DataFrame:
    """keep, the range columns and, if pieces, _piece: the object's bytes, null if it was too large or cut off. The document stays behind."""
    found = bounded(df).select(*keep, binary(content).alias("_content"), udf(binary(content)).alias("_r"))

    def cut(document: Column, r: Column) -> Column:
        whole = (r["length"] > 0) & F.coalesce(~r["error"].startswith("Object size"), F.lit(True))
        return F.struct(*(r[n].alias(n) for n in _NAMES), F.when(whole, slice_bytes(document, r["start_position"], r["length"])).alias("_piece"))

    # the outer transform binds the document: the optimizer would put the expression that makes it into the inner one, once for each range
    cuts = F.element_at(F.transform(F.array("_content"), lambda d: F.transform("_r.ranges", lambda r: cut(d, r))), 1)
    return found.select(*keep, F.inline_outer(cuts if pieces else F.col("_r.ranges"))).filter(F.col("start_position").isNotNull())


def _doc_errors(df: DataFrame, content: str, udf, keep: Sequence[str]) -> DataFrame:
    """keep and doc_error, where there is one; the generator keeps the filter from going below the kernel and running it twice."""
    return bounded(df).select(*keep, F.explode_outer(F.array(udf(binary(content))["doc_error"])).alias("doc_error")).filter(F.col("doc_error").isNotNull())


def _with_bytes(ranges: DataFrame, keep: Sequence[str], include_content: bool, hashes: bool, *more: Column) -> DataFrame:
    """The range columns; rows whose object was too large or cut off have neither content nor hash."""
    return ranges.select(
        *keep, *more, "item_index", "start_position", "length", (F.col("start_position") + F.col("length")).alias("end_position"),
        (F.md5("_piece") if hashes else F.lit(None).cast("string")).alias("hash"),
        (F.decode("_piece", "UTF-8") if include_content else F.lit(None).cast("string")).alias("content"), "error",
    )


def scan_collections(
    df: DataFrame, content: str, targets: Sequence[str] | None = None, *, keep: Sequence[str] = (), include_content: bool = False, hashes: bool = True,
    validate_utf8: bool = True, validate_structure: bool = True, max_object_size: int = kernel.MAX_OBJECT_SIZE, continue_on_error: bool = True,
) -> DataFrame:
    """A row per object in arrays named by targets (without regard to case, at any depth): keep, collection,
    object_type, activation, item_index, start_position, length, end_position, hash, content, error.

    Offsets are bytes from the document's start. Rows with an error are kept, or dropped if
    continue_on_error is false; they take an index either way. Documents that fail as a whole give no
    rows: see scan_errors. Null documents give none.
    """
    found = _exploded(df, content, _collections_udf(targets, validate_utf8, validate_structure, max_object_size, continue_on_error), keep, include_content or hashes)
    return _with_bytes(found, keep, include_content, hashes, F.col("collection"), F.col("collection").alias("object_type"), F.col("activation"))


def scan_errors(
    df: DataFrame, content: str, targets: Sequence[str] | None = None, *, keep: Sequence[str] = (), validate_utf8: bool = True,
    validate_structure: bool = False, max_object_size: int = kernel.MAX_OBJECT_SIZE, continue_on_error: bool = True,
) -> DataFrame:
    """keep and doc_error of the documents whose scan fails or ends inside an object."""
    udf = _collections_udf(targets, validate_utf8, validate_structure, max_object_size, continue_on_error)
    return _doc_errors(df, content, udf, keep)


def extract_path(
    df: DataFrame, content: str, json_path: str, *, keep: Sequence[str] = (), strict: bool = False, include_content: bool = True, hashes: bool = True,
    validate_utf8: bool = False, max_object_size: int = kernel.MAX_OBJECT_SIZE, continue_on_error: bool = True, buffer_size: int = kernel.BUFFER_SIZE,
) -> DataFrame:
    """A row per object that lies directly in the first array at json_path: keep, json_path, item_index, start_position, length, end_position, hash, content, error.

    Names are compared without regard to case unless strict. Objects over the size limit are left out
    and take no index; a single token over both that limit and buffer_size fails its document. Documents
    that fail, or aren't JSON up to the array's end, give no rows: see path_errors.
    """
    found = _exploded(df, content, _path_udf(json_path, strict, validate_utf8, max_object_size, continue_on_error, buffer_size), keep, include_content or hashes)
    return _with_bytes(found, keep, include_content, hashes, F.lit(json_path).alias("json_path"))


def path_errors(
    df: DataFrame, content: str, json_path: str, *, keep: Sequence[str] = (), strict: bool = False, validate_utf8: bool = False,
    max_object_size: int = kernel.MAX_OBJECT_SIZE, continue_on_error: bool = True, buffer_size: int = kernel.BUFFER_SIZE,
) -> DataFrame:
    """keep and doc_error of the documents whose path scan fails."""
    udf = _path_udf(json_path, strict, validate_utf8, max_object_size, continue_on_error, buffer_size)
    return _doc_errors(df, content, udf, keep)


def path_stats(
    df: DataFrame, content: str, json_path: str, *, key: str, strict: bool = False, validate_utf8: bool = False,
    max_object_size: int = kernel.MAX_OBJECT_SIZE, continue_on_error: bool = True, buffer_size: int = kernel.BUFFER_SIZE,
) -> DataFrame:
    """Per document: key, bytes_processed (up to the array's end, if there is one), objects_found and error_count.

    A failed document counts one error and no objects; null documents have no bytes.
    """
    segments = kernel.path_segments(json_path, strict)
    options = {"strict": strict, "utf8": validate_utf8, "max_size": max_object_size, "keep_errors": continue_on_error, "buffer_size": buffer_size}
    kind = [("bytes_processed", pa.int64()), ("objects_found", pa.int64()), ("error_count", pa.int64())]

    @arrow_udf("struct<bytes_processed: bigint, objects_found: bigint, error_count: bigint>")
    def run(v: pa.Array) -> pa.Array:
        got = [(None, [], 0) if d is None else kernel.path_scan(d, segments, **options) for d in _bytes(v)]
        columns = [pa.array([x[k] for x in ((n, len(found), int(error is not None)) for error, found, n in got)], pa.int64()) for k in range(3)]
        return pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in kind])

    return bounded(df).select(key, F.inline_outer(F.array(run(binary(content)))))


def index_path(df: DataFrame, content: str, json_path: str, *, keep: Sequence[str] = ()) -> DataFrame:
    """keep, start_position, end_position and content of extract_path."""
    return extract_path(df, content, json_path, keep=keep).select(*keep, "start_position", "end_position", "content")


@arrow_udf(ArrayType(StringType()))
def _top_level(v: pa.Array) -> pa.Array:
    return pa.array([kernel.top_level_arrays(d) if (d := x.as_py()) is not None else None for x in v], pa.list_(pa.string()))


def detect_collections(df: DataFrame, content: str, *, keep: Sequence[str] = ()) -> DataFrame:
    """keep, position and collection: the array-valued members of root objects, in order; the default names where there are none."""
    names = F.coalesce(_top_level(binary(content)), F.array(*map(F.lit, kernel.DEFAULT_COLLECTIONS)))
    return bounded(df).select(*keep, F.posexplode(names).alias("position", "collection"))


def with_properties(ranges: DataFrame, extractor: Column | Callable[[str], dict]) -> DataFrame:
    """ranges (with content) and properties map<string,string>.

    extractor: a Column over content, or a Python function of the text that runs in Arrow batches; where
    it raises, properties are null and error says so.
    """
    if isinstance(extractor, Column):
        return ranges.withColumn("properties", extractor)
    kind = pa.struct([("p", pa.map_(pa.string(), pa.string())), ("e", pa.string())])

    @arrow_udf("struct<p: map<string,string>, e: string>")
    def run(v: pa.Array) -> pa.Array:
        out = []
        for x in v:
            try:
                out.append({"p": None if x.as_py() is None else [(str(k), None if w is None else str(w)) for k, w in extractor(x.as_py()).items()], "e": None})
            except Exception as e:  # noqa: BLE001  whatever a user's function raises is the row's error
                out.append({"p": None, "e": f"Property extraction failed: {e}"})
        return pa.array(out, kind)

    got = bounded(ranges).withColumn("_x", run("content"))
    return got.withColumn("properties", F.col("_x.p")).withColumn("error", F.coalesce("_x.e", "error") if "error" in ranges.columns else F.col("_x.e")).drop("_x")


def with_validation(ranges: DataFrame, validator: Callable[[Column], Column]) -> DataFrame:
    """ranges (with content), and an error for content that a caller's own test, a builder of a boolean column, turns down; errors that are there stay."""
    return ranges.withColumn("error", F.coalesce("error", F.when(~F.coalesce(validator(F.col("content")), F.lit(False)), F.lit(kernel.INVALID_STRUCTURE))))


def collection_counts(ranges: DataFrame, *keys: str) -> DataFrame:
    """Objects by collection, and by keys before it."""
    return ranges.groupBy(*keys, "collection").agg(F.count("*").alias("n_objects"))


def scan_stats(
    df: DataFrame, content: str, targets: Sequence[str] | None = None, *, key: str, validate_utf8: bool = True,
    validate_structure: bool = True, max_object_size: int = kernel.MAX_OBJECT_SIZE, continue_on_error: bool = True,
) -> DataFrame:
    """Per document: key, bytes_processed, objects_found, collections_scanned and error_count, from one pass of the kernel.

    A failed document counts one error and no objects; null documents have no bytes.
    """
    udf = _collections_udf(targets, validate_utf8, validate_structure, max_object_size, continue_on_error)
    size = F.coalesce(F.octet_length(binary(content)), F.lit(0)).cast("long")
    found = bounded(df).select(key, size.alias("bytes_processed"), udf(binary(content)).alias("_r"))
    names = F.array_distinct(F.transform("_r.ranges", lambda r: r["collection"]))
    return found.select(
        key, "bytes_processed", F.size("_r.ranges").cast("long").alias("objects_found"),
        F.size(names).cast("long").alias("collections_scanned"), F.col("_r.doc_error").isNotNull().cast("long").alias("error_count"),
    )
