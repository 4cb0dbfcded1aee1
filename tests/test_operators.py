"""The JSON operators on DataFrames."""

import hashlib
import json
import re

import pyarrow as pa
import pytest
from oracle import DATA
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rangelake.functions import match, metrics, tokenize
from rangelake.functions.json import json_valid, utf8_delimiter_safe, valid_delimiter_at
from rangelake.functions.registry import Registry
from rangelake.operators import index as ix
from rangelake.operators import scan as sc
from rangelake.operators import terms as tm
from rangelake.operators.table import table_filter, table_sort
from rangelake.operators.validate import validation_report
from rangelake.plans import responses as rs
from rangelake.plans.builder import extract, python_nodes, scan
from rangelake.plans.queries import QUERIES
from rangelake.sources import generate as gen
from rangelake.sources.chunked import JsonRangesSource
from rangelake.sources.files import exists, foreach_range, from_text, read_documents, read_or_report, write_documents
from rangelake.streaming.streams import append_parquet, for_each_batch, read_document_stream, stream_index, stream_ranges

CATALOG = json.dumps({"shows": [
    {"id": "s1", "title": "Cast Away", "cast": ["Tom Hanks", "Helen Hunt"], "description": "stream data pipelines"},
    {"id": "s2", "title": "The Godfather", "cast": ["Al Pacino"], "description": "A crime classic"},
    {"id": "s3", "title": "Dark 漢字", "cast": ["Tom Hanks"], "description": "streaming analytics; the end"},
]}, ensure_ascii=False)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("cat", CATALOG.encode()), ("bad", b'{"shows":[{"a":1}]}\xc3\x28'), ("none", None), ("two", b'{"Items":[{"a":1},{"a":}],"shows":[{"b":[{"c":2}]}]}')], "id string, content binary")


def test_slices_hashes_and_one_python_node(docs):
    got = sc.scan_collections(docs, "content", ["shows", "items"], keep=["id"], include_content=True)
    assert python_nodes(got) == 1
    data = {r.id: r.content for r in docs.collect() if r.content}
    rows = got.collect()
    assert {(r.id, r.collection, r.item_index) for r in rows} == {("cat", "shows", 0), ("cat", "shows", 1), ("cat", "shows", 2), ("two", "items", 0), ("two", "items", 1), ("two", "shows", 0)}
    for r in rows:
        piece = bytes(data[r.id][r.start_position : r.end_position])
        assert r.content == piece.decode() and r.hash == hashlib.md5(piece).hexdigest()
        assert (r.error == "Invalid JSON structure") == (r.id == "two" and r.item_index == 1)
    assert python_nodes(sc.scan_errors(docs, "content", ["shows"], keep=["id"])) == python_nodes(sc.scan_stats(docs, "content", key="id")) == python_nodes(sc.path_errors(docs, "content", "shows")) == 1
    assert [(r.id, r.doc_error[:12]) for r in sc.scan_errors(docs, "content", ["shows"], keep=["id"]).collect()] == [("bad", "Scan failed:")]
    stats = {r.id: tuple(r)[1:] for r in sc.scan_stats(docs, "content", ["shows", "items"], key="id").collect()}
    assert stats["none"] == (0, 0, 0, 0) and stats["bad"][1:] == (0, 0, 1) and stats["two"][1:] == (3, 2, 0)


def test_content_is_pruned_when_unused(docs):
    plan = sc.scan_collections(docs, "content", ["shows"], keep=["id"], include_content=True).select("id", "start_position")._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "decode" not in plan


def test_rows_do_not_carry_their_document(spark):
    """Neither the ranges' rows nor the expressions evaluated for each of them know the whole document."""
    made = spark.range(2).select("id", F.concat(F.lit('{"shows":['), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit('{"a":'), i, F.lit("}"))), ","), F.lit("]}")).cast("binary").alias("content"))
    plan = scan(made, keep=("id",)).for_collections("shows")
    for got in (plan.extract_properties(F.from_json("content", "map<string,string>")).run(), plan.extract_properties(lambda t: json.loads(t)).run(), extract(made, "shows", keep=("id",)).run()):
        nodes = got._jdf.queryExecution().optimizedPlan()
        while nodes.nodeName() != "Generate":
            assert "_content" not in nodes.output().mkString(",") and "concat" not in nodes.simpleString(1000)
            nodes = nodes.children().apply(0)
        assert "_content" not in nodes.output().mkString(",") and nodes.simpleString(10000).count("concat(") <= 1
        assert {(r.id, r.item_index) for r in got.collect()} == {(k, i) for k in range(2) for i in range(3)}


def test_targets(docs):
    with pytest.raises(ValueError):
        sc.scan_collections(docs, "content", ["a", "A"])
    assert sc.targets_of(["", " "]) == sc.targets_of(None)
    with pytest.raises(ValueError):
        sc.extract_path(docs, "content", " ")


def test_properties(docs):
    ranges = sc.scan_collections(docs, "content", ["shows"], keep=["id"], include_content=True)
    got = sc.with_properties(ranges, lambda t: {"title": json.loads(t)["title"]}).collect()
    assert {r.properties["title"] for r in got if r.id == "cat"} == {"Cast Away", "The Godfather", "Dark 漢字"}
    assert [r.error for r in got if r.id == "two"] == ["Property extraction failed: 'title'"]


def test_builders(docs):
    plan = scan(docs, keep=("id",)).for_collections("shows")
    assert "content" in plan.run().columns and plan.run().filter("content is not null or hash is null").count() == 0
    assert plan.with_content().with_hashes(False).run().filter("hash is not null or content is null").count() == 0
    assert plan.skip_validation().run().filter("id = 'bad'").count() == 1
    assert plan.with_max_object_size(20).stop_on_error().run().count() == 1
    assert plan.errors().count() == 1
    assert extract(docs, "shows", keep=("id",)).run().filter("id = 'cat'").count() == 3
    assert extract(docs, "Shows", keep=("id",)).strict_mode().run().count() == 0
    assert extract(docs, "shows", keep=("id",)).with_utf8_validation().errors().filter("id = 'bad'").count() == 1


def test_own_validator(docs):
    plan = scan(docs, keep=("id",)).for_collections("items", "shows").with_validator(lambda c: ~F.contains(c, F.lit("Dark")))
    assert {(r.id, r.item_index) for r in plan.run().filter("error is not null").collect()} == {("cat", 2)} and "content" not in plan.run().columns
    assert plan.stop_on_error().run().count() == plan.run().count() - 1


def test_metrics(spark):
    r = spark.range(1).select(metrics.throughput(F.lit(1 << 20), F.lit(0)), metrics.throughput(F.lit(1 << 21), F.lit(1000)), metrics.position_percent(F.lit(1), F.lit(3)), metrics.position_percent(F.lit(1), F.lit(0)), metrics.width_percent(F.lit(1), F.lit(1000)), metrics.width_percent(F.lit(1), F.lit(8))).first()
    assert [round(x, 4) for x in r] == [10000, 2, 33.3, 0, 1, 12.5]


def test_index_and_search(docs, spark, tmp_path):
    ranges = sc.scan_collections(docs, "content", ["shows"], keep=["id"], include_content=True).cache()
    build = lambda **o: ix.build_index(ranges, keep=["id"], **o)
    found = lambda index, text: ix.search(index, text, keep=["id"]).count()
    assert found(build(fields=["CAST"]), "hanks") == 2 and found(build(fields=["title"]), "hanks") == 0
    assert found(build(fields=["cast"], ngrams=True), "tom hanks") == 2 and found(build(), "stream") == 2 and found(build(), "streami") == 1 and found(build(), "") == 0
    assert found(build(least=4), "the") == 0 and found(build(least=4), "dark") == 1
    assert found(build(case_sensitive=True), "tom") == 0 and found(build(case_sensitive=True), "Tom") == 2
    index = build(ngrams=True)
    ix.save_index(index, str(tmp_path / "index"))
    loaded = ix.load_index(spark, str(tmp_path / "index"))
    assert loaded.count() == index.count()
    assert "StringStartsWith" in ix.search(loaded, "str")._jdf.queryExecution().executedPlan().toString()
    assert [json.loads(r.content)["id"] for r in ix.semantic_search(loaded, ranges, "STREAM", keep=["id"], max_results=1).collect()] == ["s1"]
    assert ix.search_objects(loaded, ranges, "dark", keep=["id"]).first().content.count("漢字") == 1
    assert ix.search_objects(loaded, ranges, "dark", keep=["id"], max_object_size=5).count() == 0
    with pytest.raises(ValueError):
        ix.semantic_search(loaded, ranges, "  ")
    assert ix.postings_lists(index, "id").filter("keyword = 'hanks'").first().offsets == sorted(r.start_position for r in ix.search(index, "hanks", keep=["id"]).collect())
    assert [r.matched for r in ix.match_objects(ranges, "pac", keep=["id"], fields=["cast"], tokenizer="word-split", engine="contains").collect()] == [["Pacino"]]


def test_objects_of_documents_with_hits(docs, spark):
    ranges = sc.scan_collections(docs, "content", ["shows"], keep=["id"], include_content=True)
    index = ix.build_index(ranges, keep=["id"])
    got = ix.fetch_objects(index, docs, "content", ["shows"], "hanks", keep=["id"])
    assert sorted(json.loads(r.content)["id"] for r in got.collect()) == ["s1", "s3"]
    assert ix.fetch_objects(index, docs, "content", ["shows"], "hanks", keep=["id"], max_object_size=5).count() == 0
    with pytest.raises(ValueError):
        ix.postings_lists(index)


@pytest.mark.parametrize("value, term, want", [
    ("le café, LE CAFÉ", "café", "le <mark>café</mark>, LE <mark>CAFÉ</mark>"), (r"a\Eb.c", r"\Eb", r"a<mark>\Eb</mark>.c"), ("a.c abc", ".", "a<mark>.</mark>c abc"), ("x [y] z", "[Y]", "x <mark>[y]</mark> z"),
    ("no", "", "no"), ("ab", "$1", "ab"), ("a😀b", "😀", "a<mark>😀</mark>b"),
])
def test_highlight(spark, value, term, want):
    assert spark.range(1).select(ix.highlight(F.lit(value), term).alias("x")).first().x == want


def test_extractor_errors_stop(docs):
    plan = scan(docs, keep=("id",)).for_collections("shows").extract_properties(lambda t: {"title": json.loads(t)["title"]})
    assert plan.run().filter("error is not null").count() == 1
    assert plan.stop_on_error().run().count() == plan.run().count() - 1


def test_half_pairs_of_surrogates(spark):
    rows = spark.sql("SELECT cast(X'61EDA08062' AS string) AS w, 1 AS d UNION ALL SELECT cast(X'EDA080' AS string), 2 UNION ALL SELECT 'é\ufffd', 3")
    assert sorted((r.keyword, r.datum) for r in tm.build_terms(rows, F.array("w"), F.col("d")).collect()) == [("ab", 1), ("é\ufffd", 3)]
    assert tm.build_terms(rows, F.array("w"), F.col("d"), ensure_utf8=False).count() == 3


def test_path_statistics_and_token_limit(spark):
    body = json.dumps({"a": [{"b": "x" * 300}, {"c": 1}], "z": 1}).encode()
    docs = spark.createDataFrame([("ok", body), ("bom", b"\xef\xbb\xbf" + body), ("bad", b'{"a":[{"b":1}'), ("none", None)], "id string, content binary")
    got = {r.id: tuple(r)[1:] for r in sc.path_stats(docs, "content", "a", key="id").collect()}
    upto = body.index(b"]") + 1
    assert got == {"ok": (upto, 2, 0), "bom": (upto + 3, 2, 0), "bad": (13, 0, 1), "none": (0, 0, 0)}
    assert sc.extract_path(docs, "content", "a", keep=["id"], max_object_size=50).filter("id = 'ok'").count() == 1  # the string fits a read buffer
    errors = sc.path_errors(docs, "content", "a", keep=["id"], max_object_size=50, buffer_size=100).filter("id = 'ok'").collect()
    assert len(errors) == 1 and "is longer than 100" in errors[0].doc_error
    assert python_nodes(sc.path_stats(docs, "content", "a", key="id")) == 1


def test_responses(docs, spark):
    got = {r.id: r for r in rs.scan_response(docs, "content", ["shows", "items"], keep=["id"]).collect()}
    assert [o.item_index for o in got["cat"].collections["shows"]] == [0, 1, 2] and got["cat"].success and got["cat"].stats.total_objects_found == 3
    assert not got["bad"].success and got["bad"].error.startswith("Scan failed:") and got["bad"].collections == {}
    assert set(got["two"].collections) == {"items", "shows"} and got["two"].stats.collections_scanned == 2 and got["none"].collections == {}
    assert python_nodes(rs.scan_response(docs, "content", ["shows"], keep=["id"])) == 1
    paths = {r.id: r for r in rs.path_response(docs, "content", "shows", keep=["id"]).collect()}
    assert paths["cat"].total_found == 3 and json.loads(paths["cat"].objects[1].json_content)["id"] == "s2" and not paths["two"].success
    terms = {r.id: r for r in rs.term_response(docs, "content", "strea", keep=["id"]).collect()}
    assert terms["cat"].matches == ["stream", "streaming"] and terms["cat"].total_indexed > 20 and not terms["bad"].success and terms["bad"].error == "Invalid JSON"
    assert {r.id: r.matches for r in rs.term_response(docs, "content", " ", keep=["id"]).collect()}["cat"] == []
    found = {r.id: r for r in rs.search_response(docs, "content", ["shows"], "Hanks", keep=["id"], fields=["cast"], max_results=1).collect()}
    assert found["cat"].total_matches == 2 and len(found["cat"].offsets) == 2 and [json.loads(o.json_content)["id"] for o in found["cat"].objects] == ["s1"]
    assert found["none"].total_matches == 0 and found["none"].objects == []
    assert {(r.success, r.error) for r in rs.search_response(docs, "content", ["shows"], " ", keep=["id"]).collect()} == {(False, "Search term is required.")}
    assert {r.id: r.utf8_error for r in rs.validate_response(docs, "content", keep=["id"]).collect()}["bad"] == "invalid UTF-8 at byte 19"


def test_terms(spark):
    items = spark.createDataFrame([("java", 1), ("javascript", 2), ("python", None), ("java", 3), ("", 4), (None, 5), ("a$b", 6)], "w string, d int")
    terms = tm.build_terms(items, F.array("w"), F.col("d"))
    assert tm.term_count(terms).first().n_terms == 5
    assert sorted(r.datum for r in tm.prefix_search(terms, "java").collect()) == [1, 2, 3]
    assert tm.prefix_search(terms, "py").count() == tm.prefix_search(terms, "").count() == tm.prefix_search(terms, "Java").count() == 0
    assert tm.prefix_search(terms, " JAVA ", normalize=True).count() == 3
    assert tm.contains_exact(terms, "java").first().found and not tm.contains_exact(terms, "jav").first().found and not tm.contains_exact(terms, "a").first().found


@pytest.mark.parametrize("engine, word, query, want", [
    ("prefix", "Wireless", "wire", True), ("prefix", "wireless", "less", False), ("contains", "wireless", "LESS", True), ("exact", "wireless", "Wireless", True), ("exact", "wireless", "wire", False),
    ("fuzzy", "wireless", "wireles", True), ("fuzzy", "python", "pythn", True), ("fuzzy", "abc", "xyz", False), ("fuzzy", "ab", "ac", False), ("fuzzy", "ab", "ab", True),
])
def test_engines(spark, engine, word, query, want):
    assert spark.range(1).select(match.ENGINES.get(engine)(F.lit(word), F.lit(query)).alias("x")).first().x is want


@pytest.mark.parametrize("name, text, want", [
    ("word-split", "hello world, foo-bar x", ["hello", "world", "foo", "bar"]), ("whitespace", "hello  foo-bar", ["hello", "foo-bar"]), ("ngram-2", "ab cd ef", ["ab", "cd", "ef", "ab cd", "cd ef"]),
    ("ngram-2", "ab", ["ab"]), ("char-ngram-3", "A bcd", ["abc", "bcd"]), ("char-ngram-3", "ab", []),
    ("word-split", "red\u3000bolt\u00a0small", ["red", "bolt", "small"]), ("whitespace", "a\u2003b\ufeffc", ["a", "b", "c"]), ("char-ngram-3", "a\u00a0b\u202fcd", ["abc", "bcd"]),
])
def test_tokenizers(spark, name, text, want):
    assert spark.range(1).select(tokenize.TOKENIZERS.get(name)(F.lit(text)).alias("x")).first().x == want


@pytest.mark.parametrize("name", tokenize.TOKENIZERS.names())
def test_tokenizers_look_white_space_up(spark, name):
    """No pattern has a class beyond ASCII, whose parts are tried in turn for each character: that took most of ngram-2's time. Each kind of white space separates, others don't."""
    plan = spark.range(1).select(tokenize.TOKENIZERS.get(name)(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "regexp_" in plan and not re.search(r", \[[^\]]*?(\\u|[^\x00-\x7f])", plan)
    white = [*range(9, 14), 32, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
    rows = spark.createDataFrame([(c, f"aab{chr(c)}{chr(c)}ccd") for c in [*white, 0, 28, 31, 133, 0x180E, 0x200B, 0x1F600]], "c int, t string")
    for r in rows.select("c", tokenize.TOKENIZERS.get(name)(F.col("t")).alias("x")).collect():
        two = ["aab", "ccd", *(["aab ccd"] if name == "ngram-2" else [])]
        assert (r.x == ["aab", "abc", "bcc", "ccd"] if name == "char-ngram-3" else r.x == two) == (r.c in white)


@pytest.mark.parametrize("longest, want", [(1, []), (2, ["a b", "b c"]), (3, ["a b", "b c", "a b c"]), (9, ["a b", "b c", "a b c"])])
def test_ngrams(spark, longest, want):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>").select(tokenize.ngrams(F.col("w"), longest).alias("x")).collect()
    assert sorted(r.x for r in rows) == sorted([want, [], []])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_tokens_are_made_once(spark):
    """Tokens are a column of their own, so that exploding and counting them is generated code, and no inferred filter makes them again."""
    plan = QUERIES["tok_ngram2"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and re.search(r"Generate explode\(tokens#\d+\)", plan)


def test_registry():
    r = Registry("thing", a=len)
    assert r.register("b", str).names() == ["a", "b"] and r.active() == "a" and r.set_active("b").get() is str and r.call("a", "xy") == 2
    for bad in (lambda: r.register("c", 1), lambda: r.get("c"), lambda: r.set_active("c")):
        with pytest.raises((TypeError, KeyError)):
            bad()
    assert r.summary() == {"kind": "thing", "active": "b", "names": ["a", "b"]}


def test_validation(spark):
    rows = [(1, b"{}"), (2, b"{"), (3, None), (4, b"\xc3\x28"), (5, "é".encode())]
    got = {r.id: tuple(r)[1:] for r in validation_report(spark.createDataFrame(rows, "id int, content binary"), "content", keep=["id"]).collect()}
    assert got == {1: (True, None, True, 2), 2: (True, None, False, 1), 3: (False, "no text", False, 0), 4: (False, "invalid UTF-8 at byte 0", False, 2), 5: (True, None, False, 2)}
    one = spark.createDataFrame([("é}".encode(), b"", None)], "a binary, e binary, n binary")
    r = one.select(*(utf8_delimiter_safe(c).alias(f"s{c}") for c in "aen"), *(valid_delimiter_at("a", k).alias(f"p{k + 1}") for k in (-1, 0, 1, 2, 3)), valid_delimiter_at("n", 0).alias("null"), json_valid("a").alias("v")).first()
    assert tuple(r) == (True, False, False, False, True, True, True, False, False, False)


def test_every_delimiter_byte(spark):
    """A delimiter after a cut-off character isn't safe; after a whole one it is."""
    rows = [(bytes(p) + d, ok) for d in (b"{", b"}", b'"', b"\\") for p, ok in (((), True), ((0x41,), True), ((0xC3,), False), ((0xC3, 0xA9), True), ((0xE6, 0xBC), False), ((0xE6, 0xBC, 0xA2), True), ((0xFF,), False))]
    df = spark.createDataFrame(rows, "b binary, ok boolean")
    assert df.filter(valid_delimiter_at("b", F.octet_length("b") - 1) != F.col("ok")).count() == 0


def test_tables(spark):
    df = spark.createDataFrame([(0, "zero", True), (7, None, False), (70, "Seven", None)], "n int, s string, b boolean")
    assert [r.n for r in table_sort(df, "n", descending=True).collect()] == [70, 7, 0]
    assert [r.n for r in table_filter(df, "7").collect()] == [7, 70] and [r.n for r in table_filter(df, "SEV").collect()] == [70]
    assert table_filter(df, "0").count() == 1 and table_filter(df, "tru").count() == 1 and table_filter(df, "false").count() == 0 and table_filter(df, "").count() == 3


def test_files_streams_and_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(CATALOG)
    there, gone = str(tmp_path / "in" / "0.json"), str(tmp_path / "none.json")
    assert exists(spark, there) and not exists(spark, gone)
    got = {r.path.rsplit("/", 1)[1]: r.error for r in read_or_report(spark, [there, gone]).collect()}
    assert got == {"0.json": None, "none.json": f"File not found: {gone}"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_documents(spark, gone).count()
    stream = read_document_stream(spark, str(tmp_path / "in"))
    append_parquet(stream_index(stream, ["shows"], fields=["cast"]), str(tmp_path / "index"), str(tmp_path / "c1")).awaitTermination()
    append_parquet(stream_index(stream, ["shows"], fields=["cast"]), str(tmp_path / "index"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).filter("keyword = 'hanks'").count() == 6
    seen = []
    for_each_batch(stream_ranges(stream, ["shows"]), lambda df, n: seen.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    for_each_batch(stream_ranges(stream, json_path="shows"), lambda df, n: seen.append(df.count()), str(tmp_path / "c3")).awaitTermination()
    assert seen == [9, 9]
    spark.dataSource.register(JsonRangesSource)
    chunks = spark.read.format("json_ranges").option("path", there).option("targets", "shows").option("chunkSize", "7").load()
    whole = sc.scan_collections(read_documents(spark, there), "content", ["shows"]).select("item_index", "start_position", "length")
    assert sorted(map(tuple, chunks.select("item_index", "start_position", "length").collect())) == sorted(map(tuple, whole.collect()))
    with pytest.raises(Exception, match="File not found"):
        spark.read.format("json_ranges").option("path", gone).load().count()


@pytest.mark.parametrize("size", [1, 3, 7, 64, 5000])
@pytest.mark.parametrize("options", [{"targets": "shows"}, {"jsonPath": "shows"}])
def test_chunks_of_any_size(spark, tmp_path, size, options):
    at = tmp_path / "a b.json"
    at.write_bytes(b"\xef\xbb\xbf" * ("jsonPath" in options) + CATALOG.encode())
    spark.dataSource.register(JsonRangesSource)
    rows = spark.read.format("json_ranges").options(path=str(at), chunkSize=size, includeContent=True, hashes=True, validateUtf8=True, **options).load().collect()
    data = at.read_bytes()
    assert [json.loads(r.content)["id"] for r in rows] == ["s1", "s2", "s3"] and not any(r.error for r in rows)
    assert all(data[r.start_position : r.start_position + r.length] == r.content.encode() and r.hash == hashlib.md5(r.content.encode()).hexdigest() for r in rows)
    at.write_bytes(CATALOG.encode() + b"\xe6\xbc")  # ends within a character
    rows = spark.read.format("json_ranges").options(path=str(at), chunkSize=size, validateUtf8=True, targets="shows").load().collect()
    assert [r.error for r in rows] == [None] * 3 + [f"Scan failed: invalid UTF-8 at byte {len(CATALOG.encode())}"]
    at.write_bytes(b'{"shows":[{"a":1},{"b":"\xff"},{"c":3}]}')
    rows = spark.read.format("json_ranges").options(path=str(at), chunkSize=size, validateUtf8=True, **options).load().collect()
    assert rows[-1].error.endswith("failed: invalid UTF-8 at byte 24") and rows[-1].item_index is None


@pytest.mark.parametrize("options, want", [
    ({"targets": "x", "maxObjectSize": "9"}, [(0, None), (1, "Object size (23) exceeds maximum (9)"), (2, "Invalid JSON structure"), (3, "Invalid JSON structure")]),
    ({"targets": "x", "maxObjectSize": "9", "continueOnError": "false"}, [(0, None), (None, "Incomplete JSON object starting at position 42.")]),
    ({"targets": "x", "validateStructure": "false"}, [(0, None), (1, None), (2, None), (3, "Stream ended before JSON object was closed.")]),
    ({"jsonPath": "x"}, [(0, None), (1, None), (None, "Path scan failed: malformed JSON at byte 36")]),
])
def test_chunk_options(spark, tmp_path, options, want):
    at = tmp_path / "d.json"
    at.write_text('{"x":[{"a":1},{"b":"0123456789abcde"},{b},{"c":3')
    spark.dataSource.register(JsonRangesSource)
    for size in (2, 100):
        rows = spark.read.format("json_ranges").options(path=str(at), chunkSize=size, includeContent=True, **options).load().collect()
        assert [(r.item_index, r.error) for r in rows] == want or options.get("jsonPath") and [(r.item_index, (r.error or "")[:17] or None) for r in rows] == [(i, (e or "")[:17] or None) for i, e in want]


def test_chunked_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.dataSource.register(JsonRangesSource)

    def run():
        rows = spark.readStream.format("json_ranges").options(path=str(tmp_path / "in"), targets="shows", chunkSize=9).load()
        append_parquet(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    (tmp_path / "in" / "1.json").write_text(CATALOG)
    assert run() == 3
    (tmp_path / "in" / "2.json").write_text(CATALOG)
    (tmp_path / "in" / "_hidden.json").write_text(CATALOG)
    assert run() == 6 and run() == 6


def test_download_and_upload(spark, tmp_path):
    texts = spark.createDataFrame([("{}",), ("{",), ("x" * 50,), (None,)], "t string")
    got = from_text(texts, "t", most_bytes=10, check=True)
    assert sorted((r.t, r.error) for r in got.collect()) == [("{", "Invalid JSON"), ("{}", None)]
    write_documents(got, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["{", "{}"]


def test_callback_sees_each_range(docs, spark):
    seen = spark.sparkContext.accumulator(0)
    foreach_range(sc.scan_collections(docs, "content", ["shows"], keep=["id"]), lambda r: seen.add(1))
    assert seen.value == 4


@pytest.mark.parametrize("kind, counts", [("ecommerce", {"products": 20, "reviews": 30, "orders": 16}), ("movies", {"shows": 20, "reviews": 40}), ("blog", {"authors": 10, "posts": 20, "comments": 30}), ("employees", {"departments": 12, "employees": 20}), ("catalog", {"items": 20})])
def test_generators(spark, kind, counts):
    made = gen.generate(spark, kind, 20, seed=3)
    assert {k: v.count() for k, v in made.items()} == counts
    again = gen.generate(spark, kind, 20, seed=3)
    for k in made:
        assert sorted(made[k].collect()) == sorted(again[k].collect()) and made[k].filter(~json_valid("json")).count() == 0
    tips = gen.suggestions(kind)
    text = " ".join(r.json for v in made.values() for r in v.collect()).lower()
    assert all(t in text for t in tips["terms"]) and all(f'"{f.lower()}"' in text for f in tips["fields"])
    with pytest.raises(KeyError):
        gen.generate(spark, "other", 5)
    assert set(gen.generate(spark, "other", 5, strict=False)) == {"products", "reviews", "orders"}


def test_thousand_objects(spark):
    items = gen.documents(gen.generate(spark, "catalog", 1000)["items"], "items", 1000)
    got = sc.scan_collections(items, "content", ["items"])
    assert got.count() == 1000 and got.agg(F.max("item_index")).first()[0] == 999 and got.filter("error is not null").count() == 0
    index = scan(items).for_collections("items").build_index(fields=["name", "category"])
    assert index.filter("keyword = 'books'").count() == 200


def test_entry_without_the_llm_folders(spark, monkeypatch):
    import sys

    import __spark_entry__ as entry

    assert "scan_turns" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("rangelake.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n.startswith("rangelake.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert "scan_turns" in entry.queries() and not any(n.startswith("op") for n in entry.queries())


def test_chunked_lines_and_small_files(spark, tmp_path):
    """Lines are documents of their own, also behind one that fails or ends early, and small files share a task."""
    spark.dataSource.register(JsonRangesSource)
    lines = [b'{"shows":[{"a":1},{"b":"\xc3\xa9"}]}', b"", b'{"shows":[{"a"', b'{"shows":[{"a":1}]}\xc3\x28 and more', b'{"shows":[{"c":3}],"x":[{"d":4}]}']
    for k in range(40):
        (tmp_path / f"{k}.json").write_bytes(b"\n".join(lines[k % 5 :]))
    for size in (1, 5, 50, 1 << 20):
        df = spark.read.format("json_ranges").options(path=str(tmp_path), targets="shows", lines=True, chunkSize=size, includeContent=True, hashes=True).load()
        assert df.rdd.getNumPartitions() == 1
        got = [(r.item_index, r.start_position, r.content, (r.error or "")[:12]) for r in df.collect() if r.path.endswith("/0.json")]
        assert got[:3] == [(0, 10, '{"a":1}', ""), (1, 18, '{"b":"é"}', ""), (0, 10, None, "Invalid JSON")]
        assert got[-1] == (0, 10, '{"c":3}', "") and sum(g[3] == "Scan failed:" for g in got) == 1
    path = spark.read.format("json_ranges").options(path=str(tmp_path / "0.json"), jsonPath="shows", lines=True, chunkSize=4).load()
    assert [r.start_position for r in path.collect() if r.error is None][-1] == 10


def test_batches_are_bounded_by_bytes(spark):
    """Python functions of scans, and those behind them, see a few megabytes at a time; a number that the session has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    @arrow_udf("long")
    def together(v: pa.Array) -> pa.Array:
        return pa.array([v.nbytes] * len(v), pa.int64())

    session = spark.newSession()
    ours = session.range(0, 60, 1, 1).select("id", F.concat(F.lit('{"shows":[{"a":"'), F.repeat(F.lit("x"), 500_000), F.lit('"}]}')).cast("binary").alias("content"))
    ranges = sc.scan_collections(ours, "content", ["shows"], include_content=True, hashes=False)
    assert ranges.select(together("content").alias("n")).agg(F.max("n")).first()[0] < 6_000_000
    assert session.conf.get(name).startswith("4194304")
    own = spark.newSession()
    own.conf.set(name, "9000000")
    sc.scan_collections(own.createDataFrame([(b"{}",)], "content binary"), "content", ["shows"])
    assert own.conf.get(name).startswith("9000000")
