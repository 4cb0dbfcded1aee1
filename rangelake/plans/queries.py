"""The driver's queries for the JSON operators, and their DuckDB SQL.

Documents are put together from table rows by the same concatenation in both engines, so the SQL can
tell every offset from the lengths of the pieces before it, without a JSON reader.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangelake.functions import match, tokenize
from rangelake.functions.json import binary, utf8_delimiter_safe, valid_delimiter_at
from rangelake.operators import index as ix
from rangelake.operators import scan as sc
from rangelake.operators import terms as tm
from rangelake.operators.table import table_filter, table_sort
from rangelake.operators.validate import validation_report
from rangelake.plans.builder import extract, scan
from rangelake.sources import generate as gen
from rangelake.sources.chunked import JsonRangesSource
from rangelake.sources.files import from_text, read_or_report, remove
from rangelake.streaming.streams import append_parquet, read_document_stream, stream_index

OVERSIZE, LIMIT = 900, 20


def _escaped(c: str) -> str:
    """A SQL expression for the inside of a JSON string; the same in both engines."""
    for raw, mark in ((92, "chr(92)"), (34, "chr(34)"), (10, "'n'"), (13, "'r'"), (9, "'t'")):
        c = f"replace({c}, chr({raw}), chr(92) || {mark})"
    return c


#: Per kind of document: its table and filter, the column that groups rows, their order, the piece of a row, and what stands before and after the pieces.
KINDS = {
    "conv": ("conversations", "true", "conv_id", "turn", """'{"turn":' || turn || ',"role":"' || coalesce(role, '') || '","text":"' || """ + _escaped("coalesce(text, '')") + """ || '"}'""", """'{"note":"{ ' || chr(92) || '"turns' || chr(92) || '": [ decoy","Turns" : [' """, "']}'"),
    "cust": ("orders", "true", "o_custkey", "o_orderkey", """'{"orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}'""", """'{"Orders":['""", """'],"decoy":"' || chr(92) || '"flags' || chr(92) || '": [{}","FLAGS":[{"a":[1,{"flags":[{}]}]},[{"b":"}"}], 7]}'"""),
    "part": ("part", "true", "p_brand", "p_partkey", """'{"key":' || p_partkey || ',"name":"' || p_name || '","type":"' || p_type || '","size":' || p_size || '}'""", """'{"items":['""", "']}'"),
    "user": ("events", "true", "user_id", "event_id", """'{"id":' || event_id || ',"type":"' || event_type || '","props":' || coalesce(props, 'null') || '}'""", """'{"x":[0,{"log":['""", "']}]}'"),
    "text": ("documents", "true", "doc_id", "doc_id", """'{"id":' || doc_id || ',"text":"' || """ + _escaped("coalesce(text, '')") + """ || '"}'""", """'{"items":['""", "']}'"),
    "deep": ("orders", "true", "o_custkey", "o_orderkey", """'{"orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '"}'""", """'{"company":{"orders":{"count":1},"Dept":{"n' || chr(92) || 'u0061me":"x","Orders":['""", """']}},"later":{}}'"""),
    "nation": ("nation", "true", "n_regionkey", "n_nationkey", """'{"key":' || n_nationkey || ',"name":"' || n_name || '"}'""", """'{"a":[{"z":1},{"B":['""", """'],"b":[{"no":1}]}],"a2":{"b":[{"no":2}]}}'"""),
    "sup": ("supplier", "true", "s_nationkey", "s_suppkey", """'{"suppkey":' || s_suppkey || ',"name":"' || s_name || '"}'""", """'{"data":['""", "']}'"),
}


def docs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """k and content: one document per group, its pieces in order."""
    table, where, key, order, piece, head, tail = KINDS[kind]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").filter(where).select(F.col(key).alias("k"), F.col(order).alias("o"), F.expr(piece).alias("p"))
    if key == order:
        return rows.select("k", F.concat(F.expr(head), "p", F.expr(tail)).cast("binary").alias("content"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "p"))), lambda x: x["p"]), ", ")
    return rows.groupBy("k").agg(body.alias("body")).select("k", F.concat(F.expr(head), "body", F.expr(tail)).cast("binary").alias("content"))


def _pieces(kind: str) -> str:
    """SQL: k, p, i (from 0), n (bytes), s (where the piece starts), last."""
    table, where, key, order, piece, head, _ = KINDS[kind]
    return f"""SELECT *, cast(strlen(p) AS BIGINT) AS n, cast(strlen({head}) + coalesce(sum(strlen(p) + 2) OVER (PARTITION BY k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s,
  cast(row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS INT) AS i, row_number() OVER (PARTITION BY k ORDER BY o DESC) = 1 AS last
FROM (SELECT {key} AS k, {order} AS o, {piece} AS p FROM {table} WHERE {where})"""


def _whole(kind: str) -> str:
    """SQL: k and t, the document."""
    table, where, key, order, piece, head, tail = KINDS[kind]
    return f"SELECT k, {head} || string_agg(p, ', ' ORDER BY o) || {tail} AS t FROM (SELECT {key} AS k, {order} AS o, {piece} AS p FROM {table} WHERE {where}) GROUP BY k"


RANGE = ["k", "collection", "item_index", "start_position", "length", "end_position", "hash"]
_SQL_RANGE = "k, '{0}' AS collection, i AS item_index, s AS start_position, n AS length, s + n AS end_position, md5(p) AS hash"


def _ranges(kind: str, *targets: str, **options):
    return lambda spark, d: sc.scan_collections(docs(spark, d, kind), "content", targets, keep=["k"], **options)


def _scan_truncated(spark, d):
    cut = docs(spark, d, "conv").withColumn("content", F.expr("substring(content, 1, octet_length(content) - 3)"))
    return sc.scan_collections(cut, "content", ["turns"], keep=["k"]).select("k", "item_index", "start_position", "length", "hash", "error")


def _scan_stop(spark, d):
    cut = docs(spark, d, "conv").withColumn("content", F.expr("substring(content, 1, octet_length(content) - 3)"))
    return sc.scan_errors(cut, "content", ["turns"], keep=["k"], continue_on_error=False)


def _scan_bad_utf8(spark, d):
    broken = docs(spark, d, "part").withColumn("content", F.expr("concat(content, X'C328')"))
    return sc.scan_stats(broken, "content", key="k").select("k", "objects_found", "error_count")


def _scan_properties(spark, d):
    got = scan(docs(spark, d, "part"), keep=("k",)).for_collections("items").extract_properties(F.from_json("content", "map<string,string>")).run()
    return got.select("k", "item_index", F.col("properties")["name"].alias("name"), F.col("properties")["size"].cast("int").alias("size"))


def _nations(spark, d, path, strict=False):
    return sc.extract_path(docs(spark, d, "nation"), "content", path, keep=["k"], strict=strict)


def _part_terms(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return tm.build_terms(part, F.split("p_name", "[ ,.;:_-]+"), F.col("p_partkey"))


def _part_index(spark, d, **options):
    return ix.build_index(sc.scan_collections(docs(spark, d, "part"), "content", ["items"], keep=["k"], include_content=True, hashes=False, validate_structure=False), keep=["k"], fields=["NAME"], **options)


def _part_ranges(spark, d):
    return sc.scan_collections(docs(spark, d, "part"), "content", ["items"], keep=["k"], include_content=True)


def _conv_index(spark, d, **options):
    found = sc.scan_collections(docs(spark, d, "conv"), "content", ["turns"], keep=["k"], include_content=True, hashes=False, validate_structure=False)
    return ix.build_index(found, keep=["k"], fields=["role", "text"], **options)


def _matches(engine: str, query: str):
    return lambda spark, d: spark.read.parquet(f"{d}/part.parquet").filter(match.ENGINES.get(engine)(F.col("p_name"), F.lit(query))).select("p_partkey", "p_name")


#: A text whose words are also separated by a no-break space, an ideographic space and a tab; the same in both engines.
_TOKEN_TEXT = "replace(replace(replace(coalesce(text, ''), ', ', ',\u00a0'), '. ', '.\u3000'), ' de ', chr(9) || 'de-')"


def _tokens(name: str):
    def run(spark, d):
        found = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tokenize.TOKENIZERS.get(name)(F.expr(_TOKEN_TEXT)).alias("tokens"))
        # a column of its own is exploded in generated code; without _outer the optimizer would infer a filter and make the tokens twice
        rows = found.select("doc_id", F.explode_outer("tokens").alias("token")).filter("token IS NOT NULL")
        return rows.groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))

    return run


def _validate(spark, d):
    broken = F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("}"))).when(F.col("event_id") % 5 == 1, F.expr("substring(props, 1, length(props) - 1)")).when(F.col("event_id") % 5 == 2, F.lit(" ")).otherwise(F.col("props"))
    return validation_report(spark.read.parquet(f"{d}/events.parquet").withColumn("content", broken), "content", keep=["event_id"])


def _bytes_safe(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").withColumn("b", binary(F.concat("n_name", F.lit("é}"))))
    return n.select("n_nationkey", utf8_delimiter_safe("b").alias("safe"), valid_delimiter_at("b", F.octet_length("b") - 1).alias("at_end"), valid_delimiter_at("b", F.octet_length("b")).alias("past_end"), valid_delimiter_at("b", -1).alias("before"))


def _shared(spark: SparkSession) -> str:
    """A new folder that all executors see, for queries that need files; what is in it goes when the session ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    path = f"{at or tempfile.mkdtemp(prefix='rangelake-')}/query-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def _written(spark, d, kind: str) -> str:
    """A folder with a file for each document."""
    at = _shared(spark)
    docs(spark, d, kind).select("k", F.col("content").cast("string").alias("value")).write.partitionBy("k").text(at)
    return at


def _written_lines(spark, d, kind: str) -> str:
    """A folder of files with a document on each line, for kinds of which there are as many as the table grows."""
    at = _shared(spark)
    docs(spark, d, kind).select(F.col("content").cast("string").alias("value")).write.text(at)
    return at


def _index_stream(spark, d):
    at = _shared(spark)
    docs(spark, d, "part").select(F.col("content").cast("string").alias("value")).write.text(f"{at}/docs")
    postings = stream_index(read_document_stream(spark, f"{at}/docs/part-*"), ["items"], keep=(), fields=["name"])
    append_parquet(postings, f"{at}/index", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/index").groupBy("keyword").agg(F.count("*").alias("n"))


def _chunks(spark, path: str, stream: bool = False, **options):
    spark.dataSource.register(JsonRangesSource)
    return (spark.readStream if stream else spark.read).format("json_ranges").options(path=path, **options).load()


def _chunked(spark, d):
    return _chunks(spark, _written(spark, d, "part"), targets="items", chunkSize=4096).groupBy("collection").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.count("error").alias("errors"))


def _missing_files(spark, d):
    got = read_or_report(spark, [f"{d}/region.parquet", f"{d}/no_such_file.json"])
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").isNull().alias("missing"), F.col("error").like("File not found: %").alias("reported"))


def _generated(spark, d):
    rows = gen.generate(spark, "catalog", 1000)["items"]
    return sc.scan_collections(gen.documents(rows, "items", 100), "content", ["items"], keep=["doc_id"]).groupBy("collection").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


def _generated_path(spark, d):
    made = gen.documents(gen.generate(spark, "catalog", 1000)["items"], "employees", 1000, path="company.departments.engineering")
    return extract(made, "company.departments.engineering.employees").run().agg(F.count("*").alias("n"), F.max("item_index").alias("last"))


def _record_counts(spark, d):
    return gen.record_counts(gen.generate(spark, "ecommerce", 50) | {f"m_{k}": v for k, v in gen.generate(spark, "movies", 50).items()})


QUERIES = {
    "scan_turns": lambda s, d: _ranges("conv", "turns")(s, d).select(RANGE),
    "scan_multi": lambda s, d: _ranges("cust", "orders", "flags")(s, d).select(RANGE),
    "scan_defaults": lambda s, d: _ranges("part")(s, d).select(RANGE),
    "scan_default_data": lambda s, d: _ranges("sup")(s, d).select(RANGE),
    "scan_nested_depth": lambda s, d: _ranges("user", "log")(s, d).select(RANGE),
    "scan_content": lambda s, d: _ranges("part", "items", include_content=True, hashes=False)(s, d).select("k", "item_index", "content", "hash"),
    "scan_slice_roundtrip": lambda s, d: _ranges("text", "items", include_content=True)(s, d).select(*RANGE, F.length("content").alias("n_chars"), "error"),
    "scan_oversize": lambda s, d: _ranges("text", "items", max_object_size=OVERSIZE, include_content=True)(s, d).select("k", "item_index", "length", "hash", F.col("content").isNotNull().alias("has_content"), "error"),
    "scan_oversize_dropped": lambda s, d: _ranges("conv", "turns", max_object_size=OVERSIZE, continue_on_error=False)(s, d).select("k", "item_index", "start_position", "length", "error"),
    "scan_truncated": _scan_truncated,
    "scan_stop_on_error": _scan_stop,
    "scan_invalid_utf8": _scan_bad_utf8,
    "scan_properties": _scan_properties,
    "scan_stats": lambda s, d: sc.scan_stats(docs(s, d, "cust"), "content", ["orders", "flags", "nothing"], key="k"),
    "scan_counts": lambda s, d: sc.collection_counts(_ranges("cust", "Orders", "Flags")(s, d), "k"),
    "path_nested": lambda s, d: sc.extract_path(docs(s, d, "deep"), "content", "company.dept.orders", keep=["k"]).select("k", "item_index", "start_position", "length", "hash", "content"),
    "path_first_only": lambda s, d: _nations(s, d, "a.b").select("k", "item_index", "start_position", "length", "content"),
    "path_strict": lambda s, d: _nations(s, d, "a.B", strict=True).select("k", "item_index", "start_position", "length"),
    "path_strict_other": lambda s, d: _nations(s, d, "a.b", strict=True).select("k", "item_index", "content"),
    "path_not_found": lambda s, d: _nations(s, d, "no.such.path").select("k", "item_index", "content"),
    "path_oversize": lambda s, d: sc.extract_path(docs(s, d, "conv"), "content", "turns", keep=["k"], max_object_size=OVERSIZE, hashes=False).select("k", "item_index", "start_position", "length"),
    "path_malformed": lambda s, d: sc.path_errors(docs(s, d, "conv").withColumn("content", F.expr("substring(content, 1, octet_length(content) - 3)")), "content", "turns", keep=["k"]).select("k", F.col("doc_error").startswith("Path scan failed:").alias("failed")),
    "path_index": lambda s, d: sc.index_path(docs(s, d, "deep"), "content", "company.dept.orders", keep=["k"]),
    "detect_collections": lambda s, d: sc.detect_collections(docs(s, d, "cust"), "content", keep=["k"]),
    "trie_prefix": lambda s, d: tm.prefix_search(_part_terms(s, d), "bo").select("keyword", "datum"),
    "trie_exact": lambda s, d: tm.contains_exact(_part_terms(s, d), "bolt").union(tm.contains_exact(_part_terms(s, d), "bol")),
    "trie_count": lambda s, d: tm.term_count(_part_terms(s, d)),
    "trie_ordered": lambda s, d: tm.ordered_matches(tm.prefix_search(_part_terms(s, d), " R", normalize=True).select("keyword").distinct()),
    "trie_json_terms": lambda s, d: tm.json_terms(s.read.parquet(f"{d}/events.parquet"), "props", keep=("event_id",)),
    "trie_json_words": lambda s, d: tm.json_terms(docs(s, d, "sup"), "content", keep=("k",)).groupBy("k", "keyword", "datum").agg(F.count("*").alias("n")),
    "index_postings": lambda s, d: _part_index(s, d),
    "index_count": lambda s, d: tm.term_count(_part_index(s, d)),
    "index_ngrams": lambda s, d: _conv_index(s, d, ngrams=True, least=3).groupBy("keyword").agg(F.count("*").alias("n")),
    "index_minlen": lambda s, d: _part_index(s, d, least=6).groupBy("keyword").agg(F.count("*").alias("n")),
    "index_case": lambda s, d: _conv_index(s, d, case_sensitive=True).groupBy("keyword").agg(F.count("*").alias("n")),
    "postings_lists": lambda s, d: ix.postings_lists(_part_index(s, d), "k").select("k", "keyword", F.size("offsets").alias("n"), F.array_join(F.col("offsets").cast("array<string>"), ",").alias("offsets")),
    "search_prefix": lambda s, d: ix.search(_part_index(s, d), "bo", keep=["k"]),
    "search_phrase": lambda s, d: ix.search(_part_index(s, d, ngrams=True), "red b", keep=["k"]),
    "search_objects": lambda s, d: ix.fetch_objects(_part_index(s, d), docs(s, d, "part"), "content", ["items"], "bo", keep=["k"]).select("k", "start_position", "content"),
    "search_objects_topk": lambda s, d: ix.semantic_search(_part_index(s, d), _part_ranges(s, d), "BO", keep=["k"], max_results=LIMIT).select("k", "start_position", "content"),
    "match_prefix": _matches("prefix", "RE"),
    "match_contains": _matches("contains", "OL"),
    "match_exact": _matches("exact", "RED BOLT"),
    "match_fuzzy": _matches("fuzzy", "smaal"),
    "match_objects": lambda s, d: ix.match_objects(_part_ranges(s, d), "bo", keep=["k"], fields=["name"], tokenizer="whitespace", engine="prefix").select("k", "start_position", F.array_join("matched", ",").alias("matched")),
    "highlight": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", ix.highlight(F.col("p_name"), "BO").alias("marked")),
    "tok_word_split": _tokens("word-split"),
    "tok_whitespace": _tokens("whitespace"),
    "tok_ngram2": _tokens("ngram-2"),
    "tok_char3": _tokens("char-ngram-3"),
    "validate_report": _validate,
    "validate_bytes": _bytes_safe,
    "table_sort": lambda s, d: table_sort(s.read.parquet(f"{d}/supplier.parquet"), "s_suppkey", descending=True).select("s_suppkey", "s_name"),
    "table_filter": lambda s, d: table_filter(s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey"), "07"),
    "upload_cap": lambda s, d: from_text(s.read.parquet(f"{d}/documents.parquet"), "text", most_bytes=OVERSIZE).agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes")),
    "missing_files": _missing_files,
    "generate_catalog": _generated,
    "generate_nested": _generated_path,
    "generate_counts": _record_counts,
    "index_stream": _index_stream,
    "chunked_scan": _chunked,
}

_WORDS = "string_split_regex(p_name, '[ ,.;:_-]+')"
def _part_words(least: int) -> str:
    return f"SELECT k, s AS start_position, unnest(list_filter(string_split_regex(lower(regexp_extract(p, '\"name\":\"([^\"]*)\"', 1)), '[ ,.;:_/()-]+'), lambda w: length(w) >= {least})) AS keyword FROM ({_pieces('part')})"

def _conv_words(lower: bool, least: int) -> str:
    """Words of each string of a turn, as a list in its order."""
    f = "lower" if lower else ""
    return f"""SELECT list_filter(string_split_regex({f}(v), '[ ,.;:_/()-]+'), lambda w: length(w) >= {least}) AS ws FROM (
  SELECT coalesce(role, '') AS v FROM conversations UNION ALL SELECT coalesce(text, '') FROM conversations) WHERE trim(v) <> ''"""


def _token_sql(tokens: str) -> str:
    """tokens: an expression over v, in which all white space has become spaces by a table of characters."""
    return f"""SELECT token, count(*) AS n, min(doc_id) AS first_id FROM (
  SELECT doc_id, unnest({tokens}) AS token FROM (SELECT doc_id, translate({_TOKEN_TEXT}, chr(160) || chr(12288) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12), '       ') AS v FROM documents)) GROUP BY token"""


_SPACED = "list_filter(string_split(v, ' '), lambda w: length(w) >= {0})"
_TOKEN_SQL = {
    "tok_word_split": _token_sql("list_filter(string_split(translate(v, ',.-_/();:', '         '), ' '), lambda w: length(w) >= 2)"),
    "tok_whitespace": _token_sql(_SPACED.format(1)),
    "tok_ngram2": f"""WITH t AS (SELECT doc_id, row_number() OVER () AS r, {_SPACED.format(2)} AS ws FROM (
  SELECT doc_id, translate({_TOKEN_TEXT}, chr(160) || chr(12288) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12), '       ') AS v FROM documents)),
w AS (SELECT doc_id, r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS a FROM t),
b AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY r ORDER BY i) AS z FROM w)
SELECT token, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, a AS token FROM b UNION ALL SELECT doc_id, a || ' ' || z FROM b WHERE z IS NOT NULL) GROUP BY token""",
    "tok_char3": f"""WITH t AS (SELECT doc_id, row_number() OVER () AS r, string_split(lower(translate({_TOKEN_TEXT}, ' ' || chr(160) || chr(12288) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12), '')), '') AS cs FROM documents),
c AS (SELECT doc_id, r, unnest(range(1, len(cs) + 1)) AS i, unnest(cs) AS a FROM t),
g AS (SELECT doc_id, a || lead(a) OVER p || lead(a, 2) OVER p AS token FROM c WINDOW p AS (PARTITION BY r ORDER BY i))
SELECT token, count(*) AS n, min(doc_id) AS first_id FROM g WHERE token IS NOT NULL GROUP BY token""",
}


ORACLE_SQL = {
    "scan_turns": f"SELECT {_SQL_RANGE.format('turns')} FROM ({_pieces('conv')})",
    "scan_multi": f"""WITH p AS ({_pieces('cust')}) SELECT {_SQL_RANGE.format('orders')} FROM p
UNION ALL SELECT k, 'flags', i, f.s + o, cast(n AS BIGINT), f.s + o + n, h FROM (SELECT k, s + n + strlen('],"decoy":"\\"flags\\": [{{}}","FLAGS":[') AS s FROM p WHERE last) f,
  (VALUES (0, 0, strlen('{{"a":[1,{{"flags":[{{}}]}}]}}'), md5('{{"a":[1,{{"flags":[{{}}]}}]}}')), (1, strlen('{{"a":[1,{{"flags":[{{}}]}}]}},['), strlen('{{"b":"}}"}}'), md5('{{"b":"}}"}}'))) v(i, o, n, h)""",
    "scan_defaults": f"SELECT {_SQL_RANGE.format('items')} FROM ({_pieces('part')})",
    "scan_default_data": f"SELECT {_SQL_RANGE.format('data')} FROM ({_pieces('sup')})",
    "scan_nested_depth": f"SELECT {_SQL_RANGE.format('log')} FROM ({_pieces('user')})",
    "scan_content": f"SELECT k, i AS item_index, p AS content, cast(NULL AS VARCHAR) AS hash FROM ({_pieces('part')})",
    "scan_slice_roundtrip": f"SELECT {_SQL_RANGE.format('items')}, cast(length(p) AS INT) AS n_chars, cast(NULL AS VARCHAR) AS error FROM ({_pieces('text')})",
    "scan_oversize": f"SELECT k, i AS item_index, n AS length, CASE WHEN n <= {OVERSIZE} THEN md5(p) END AS hash, n <= {OVERSIZE} AS has_content, CASE WHEN n > {OVERSIZE} THEN 'Object size (' || n || ') exceeds maximum ({OVERSIZE})' END AS error FROM ({_pieces('text')})",
    "scan_oversize_dropped": f"SELECT k, i AS item_index, s AS start_position, n AS length, cast(NULL AS VARCHAR) AS error FROM ({_pieces('conv')}) WHERE n <= {OVERSIZE}",
    "scan_truncated": f"SELECT k, i AS item_index, s AS start_position, CASE WHEN last THEN 0 ELSE n END AS length, CASE WHEN NOT last THEN md5(p) END AS hash, CASE WHEN last THEN 'Invalid JSON structure' END AS error FROM ({_pieces('conv')})",
    "scan_stop_on_error": f"SELECT k, 'Incomplete JSON object starting at position ' || s || '.' AS doc_error FROM ({_pieces('conv')}) WHERE last",
    "scan_invalid_utf8": f"SELECT DISTINCT k, cast(0 AS BIGINT) AS objects_found, cast(1 AS BIGINT) AS error_count FROM ({_pieces('part')})",
    "scan_properties": f"SELECT k, i AS item_index, regexp_extract(p, '\"name\":\"([^\"]*)\"', 1) AS name, cast(regexp_extract(p, '\"size\":([0-9]+)', 1) AS INT) AS size FROM ({_pieces('part')})",
    "scan_stats": f"WITH n AS (SELECT k, count(*) AS c FROM ({_pieces('cust')}) GROUP BY k) SELECT k, cast(strlen(t) AS BIGINT) AS bytes_processed, c + 2 AS objects_found, cast(2 AS BIGINT) AS collections_scanned, cast(0 AS BIGINT) AS error_count FROM ({_whole('cust')}) JOIN n USING (k)",
    "scan_counts": f"WITH n AS (SELECT k, count(*) AS c FROM ({_pieces('cust')}) GROUP BY k) SELECT k, 'Orders' AS collection, c AS n_objects FROM n UNION ALL SELECT k, 'Flags', 2 FROM n",
    "path_nested": f"SELECT k, i AS item_index, s AS start_position, n AS length, md5(p) AS hash, p AS content FROM ({_pieces('deep')})",
    "path_first_only": f"SELECT k, i AS item_index, s AS start_position, n AS length, p AS content FROM ({_pieces('nation')})",
    "path_strict": f"SELECT k, i AS item_index, s AS start_position, n AS length FROM ({_pieces('nation')})",
    "path_strict_other": f"""SELECT DISTINCT k, cast(0 AS INT) AS item_index, '{{"no":1}}' AS content FROM ({_pieces('nation')})""",
    "path_not_found": "SELECT n_regionkey AS k, cast(0 AS INT) AS item_index, n_name AS content FROM nation WHERE false",
    "path_oversize": f"SELECT k, cast(row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS INT) AS item_index, s AS start_position, n AS length FROM ({_pieces('conv')}) WHERE n <= {OVERSIZE}",
    "path_malformed": f"SELECT DISTINCT k, true AS failed FROM ({_pieces('conv')})",
    "path_index": f"SELECT k, s AS start_position, s + n AS end_position, p AS content FROM ({_pieces('deep')})",
    "detect_collections": f"SELECT k, position, collection FROM (SELECT DISTINCT k FROM ({_pieces('cust')})), (VALUES (cast(0 AS INT), 'Orders'), (1, 'FLAGS')) v(position, collection)",
    "trie_prefix": f"SELECT keyword, p_partkey AS datum FROM (SELECT p_partkey, unnest({_WORDS}) AS keyword FROM part) WHERE starts_with(keyword, 'bo')",
    "trie_exact": f"WITH w AS (SELECT unnest({_WORDS}) AS keyword FROM part) SELECT (SELECT count(*) FROM w WHERE keyword = x) > 0 AS found FROM (VALUES ('bolt'), ('bol')) v(x)",
    "trie_count": f"SELECT count(*) AS n_terms FROM (SELECT unnest({_WORDS}) AS keyword FROM part) WHERE keyword <> ''",
    "trie_ordered": f"SELECT DISTINCT keyword FROM (SELECT unnest({_WORDS}) AS keyword FROM part) WHERE starts_with(keyword, 'r') ORDER BY length(keyword), keyword",
    "trie_json_terms": "SELECT event_id, unnest(['k', regexp_extract(props, '([0-9]+)', 1)]) AS keyword, unnest(['k', regexp_extract(props, '([0-9]+)', 1)]) AS datum FROM events WHERE props IS NOT NULL",
    "trie_json_words": f"""WITH p AS ({_pieces('sup')}), t AS (
  SELECT k, unnest(['suppkey', 'name']) AS datum FROM p UNION ALL SELECT DISTINCT k, 'data' FROM p UNION ALL SELECT k, regexp_extract(p, '"suppkey":([0-9]+)', 1) FROM p
  UNION ALL SELECT k, unnest(list_filter(string_split_regex(regexp_extract(p, '"name":"([^"]*)"', 1), '[ ,.;:_-]'), lambda w: length(w) > 2)) FROM p)
SELECT k, lower(datum) AS keyword, datum, count(*) AS n FROM t GROUP BY k, datum""",
    "index_postings": _part_words(2),
    "index_count": f"SELECT count(*) AS n_terms FROM ({_part_words(2)})",
    "index_ngrams": f"WITH w AS ({_conv_words(True, 3)}) SELECT keyword, count(*) AS n FROM (SELECT unnest(ws) AS keyword FROM w UNION ALL SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) > 1) GROUP BY keyword",
    "index_minlen": f"SELECT keyword, count(*) AS n FROM ({_part_words(6)}) GROUP BY keyword",
    "index_case": f"SELECT keyword, count(*) AS n FROM (SELECT unnest(ws) AS keyword FROM ({_conv_words(False, 2)})) GROUP BY keyword",
    "postings_lists": f"SELECT k, keyword, cast(count(DISTINCT start_position) AS INT) AS n, string_agg(DISTINCT start_position, ',' ORDER BY start_position) AS offsets FROM ({_part_words(2)}) GROUP BY k, keyword",
    "search_prefix": f"SELECT DISTINCT k, start_position FROM ({_part_words(2)}) WHERE starts_with(keyword, 'bo')",
    "search_phrase": f"SELECT k, s AS start_position FROM ({_pieces('part')}) WHERE regexp_matches(p, '\"name\":\"([^\"]* )?red b')",
    "search_objects": f"SELECT k, s AS start_position, p AS content FROM ({_pieces('part')}) WHERE regexp_matches(p, '\"name\":\"([^\"]* )?bo')",
    "search_objects_topk": f"SELECT k, s AS start_position, p AS content FROM ({_pieces('part')}) WHERE regexp_matches(p, '\"name\":\"([^\"]* )?bo') ORDER BY 1, 2 LIMIT {LIMIT}",
    "match_prefix": "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 're')",
    "match_contains": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ol')",
    "match_exact": "SELECT p_partkey, p_name FROM part WHERE lower(p_name) = 'red bolt'",
    "match_fuzzy": "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'smaal') OR list_min(list_transform(range(0, least(length(p_name), 6) + 1), lambda i: levenshtein(left(lower(p_name), i), 'smaal'))) <= 1",
    "match_objects": f"SELECT k, s AS start_position, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_extract(p, '\"name\":\"([^\"]*)\"', 1), '\\s+'), lambda w: starts_with(lower(w), 'bo')))), ',') AS matched FROM ({_pieces('part')}) WHERE regexp_matches(p, '\"name\":\"([^\"]* )?bo')",
    "highlight": r"SELECT p_partkey, regexp_replace(p_name, '(?i)(bo)', '<mark>\1</mark>', 'g') AS marked FROM part",
    "validate_report": "SELECT event_id, true AS is_valid_utf8, cast(NULL AS VARCHAR) AS utf8_error, event_id % 5 > 2 AS is_valid_structure, cast(CASE event_id % 5 WHEN 0 THEN strlen(props) + 1 WHEN 1 THEN strlen(props) - 1 WHEN 2 THEN 1 ELSE strlen(props) END AS BIGINT) AS bytes_checked FROM events",
    "validate_bytes": "SELECT n_nationkey, true AS safe, true AS at_end, false AS past_end, false AS before FROM nation",
    "table_sort": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey DESC",
    "table_filter": "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE (s_suppkey <> 0 AND contains(cast(s_suppkey AS VARCHAR), '07')) OR contains(lower(s_name), '07') OR (s_nationkey <> 0 AND contains(cast(s_nationkey AS VARCHAR), '07'))",
    "upload_cap": f"SELECT count(*) AS n, cast(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE strlen(text) <= {OVERSIZE}",
    "missing_files": "SELECT * FROM (VALUES ('region.parquet', false, cast(NULL AS BOOLEAN)), ('no_such_file.json', true, true)) v(name, missing, reported)",
    "generate_catalog": "SELECT 'items' AS collection, cast(1000 AS BIGINT) AS n, cast(0 AS BIGINT) AS errors",
    "generate_nested": "SELECT cast(1000 AS BIGINT) AS n, cast(999 AS INT) AS last",
    "generate_counts": "SELECT * FROM (VALUES ('products', cast(50 AS BIGINT)), ('reviews', 75), ('orders', 40), ('m_shows', 50), ('m_reviews', 100)) v(collection, n_records)",
    "index_stream": f"SELECT keyword, count(*) AS n FROM ({_part_words(2)}) GROUP BY keyword",
    "chunked_scan": f"SELECT 'items' AS collection, count(*) AS n, cast(sum(n) AS BIGINT) AS bytes, cast(0 AS BIGINT) AS errors FROM ({_pieces('part')})",
} | _TOKEN_SQL
