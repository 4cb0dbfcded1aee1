"""An inverted keyword index: postings (keep, keyword, start_position) as a DataFrame, kept as Parquet sorted by keyword."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rangelake import kernel
from rangelake.functions import match, tokenize
from rangelake.functions.json import bounded
from rangelake.operators.scan import scan_collections

MAX_FETCH_SIZE = 1024 * 1024
_FIELD = pa.list_(pa.struct([("field", pa.string()), ("number", pa.int32()), ("value", pa.string())]))


def _field_strings_udf(fields: Sequence[str]):
    wanted = list(fields)

    @arrow_udf("array<struct<field: string, number: int, value: string>>")
    def run(v: pa.Array) -> pa.Array:
        ends, flat = [0], []
        for text in v.to_pylist():
            flat += kernel.field_strings(text, wanted)
            ends.append(len(flat))
        fields, numbers, values = zip(*flat) if flat else ([], [], [])
        rows = pa.StructArray.from_arrays([pa.array(fields, pa.string()), pa.array(numbers, pa.int32()), pa.array(values, pa.string())], fields=list(_FIELD.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return run


def field_strings(df: DataFrame, content: str = "content", fields: Sequence[str] = (), *, keep: Sequence[str] = ()) -> DataFrame:
    """keep, field, number and value: the strings below the top-level fields named, or below all; malformed objects give none."""
    return bounded(df).select(*keep, F.inline_outer(_field_strings_udf(fields)(F.col(content)))).filter(F.col("value").isNotNull())


def build_index(
    ranges: DataFrame, content: str = "content", *, keep: Sequence[str] = (), fields: Sequence[str] = (), case_sensitive: bool = False, least: int = 2,
    ngrams: bool = False, longest_ngram: int = 2, separators: str = tokenize.SEPARATORS, tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Postings keep, keyword, start_position of ranges with content; repeats stay.

    n-grams run over the words kept of one string. No shuffle: the index grows by appending postings of new documents.
    """
    strings = field_strings(ranges, content, fields, keep=[*keep, "start_position"])
    words = tokenizer(F.col("value")) if tokenizer else tokenize.words(F.col("value"), least=least, lower=not case_sensitive, separators=separators)
    split = strings.select(*keep, "start_position", words.alias("_words"))
    every = F.concat("_words", tokenize.ngrams(F.col("_words"), longest_ngram)) if ngrams else F.col("_words")
    return split.select(*keep, F.explode(every).alias("keyword"), "start_position").filter("keyword <> ''")


def postings_lists(index: DataFrame, *keys: str) -> DataFrame:
    """keys, keyword and its distinct offsets, ascending. keys have to tell documents apart, so that a list is no longer than one document's."""
    if not keys:
        raise ValueError("offsets mean nothing without the columns that name their document")
    return index.groupBy(*keys, "keyword").agg(F.sort_array(F.collect_set("start_position")).alias("offsets"))


def save_index(index: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Parquet in ranges of keywords, sorted in each file, so that a prefix reads few row groups. A keyword of many postings is split by position."""
    index.repartitionByRange("keyword", "start_position").sortWithinPartitions("keyword", "start_position").write.mode(mode).parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def search(index: DataFrame, text: str, *, keep: Sequence[str] = ()) -> DataFrame:
    """keep and start_position of keywords that start with text (as it is: callers fold its case), without repeats. Empty text finds nothing."""
    hits = index.filter(F.startswith("keyword", F.lit(text))) if text else index.filter(F.lit(False))
    return hits.select(*keep, "start_position").distinct()


def search_objects(index: DataFrame, ranges: DataFrame, text: str, *, keep: Sequence[str] = (), max_object_size: int = MAX_FETCH_SIZE) -> DataFrame:
    """The ranges that search() finds, up to a size."""
    hits = search(index, text, keep=keep)
    return ranges.filter(F.col("length") <= max_object_size).join(hits, [*keep, "start_position"], "left_semi")


def fetch_objects(index: DataFrame, docs: DataFrame, content: str, targets: Sequence[str] | None, text: str, *, keep: Sequence[str], max_object_size: int = MAX_FETCH_SIZE) -> DataFrame:
    """Like search_objects(), from documents: those without a hit are never scanned. keep has to name the documents."""
    hits = search(index, text, keep=keep)
    found = docs.join(hits.select(*keep).distinct(), list(keep), "left_semi")
    ranges = scan_collections(found, content, targets, keep=keep, include_content=True, hashes=False, validate_utf8=False, validate_structure=False)
    return ranges.filter(F.col("length") <= max_object_size).join(hits, [*keep, "start_position"], "left_semi")


def semantic_search(index: DataFrame, ranges: DataFrame, term: str, *, keep: Sequence[str] = (), max_results: int = 10) -> DataFrame:
    """The first max_results matching objects by position; the term is trimmed of nothing but lower-cased. Blank terms raise."""
    if not term or not term.strip():
        raise ValueError("Search term is required.")
    return search_objects(index, ranges, term.lower(), keep=keep).orderBy(*keep, "start_position").limit(max(1, max_results))


def matched_words(df: DataFrame, text: str, *, value: str = "value", tokenizer: str | None = None, engine: str | None = None) -> Column:
    """The distinct words of a column that match text, in order."""
    words, test = tokenize.TOKENIZERS.get(tokenizer)(F.col(value)), match.ENGINES.get(engine)
    return F.array_distinct(F.filter(words, lambda w: test(w, F.lit(text))))


def match_objects(ranges: DataFrame, text: str, content: str = "content", *, keep: Sequence[str] = (), fields: Sequence[str] = (), tokenizer: str | None = None, engine: str | None = None) -> DataFrame:
    """keep, start_position and matched: objects with a word that the engine matches, and which words."""
    strings = field_strings(ranges, content, fields, keep=[*keep, "start_position"])
    hits = strings.withColumn("_m", matched_words(strings, text, tokenizer=tokenizer, engine=engine)).filter(F.size("_m") > 0)
    return hits.groupBy(*keep, "start_position").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_m")))).alias("matched"))


def highlight(value: Column, term: str) -> Column:
    """value with hits of term, in any case of any alphabet, between <mark> and </mark>."""
    literal = "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in term)
    return F.regexp_replace(value, f"(?iu)({literal})", "<mark>$1</mark>") if term else value
