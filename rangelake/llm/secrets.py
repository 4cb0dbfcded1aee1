"""Secret scans over a stored blob ledger, with DataFrame functions only.

Every version of every document is addressed by its content's SHA-256. The ledger, a folder of Parquet
by rule version, says which (blob, rule version) pairs have been scanned and what was found; an update
scans only pairs that it lacks, each blob once however many paths hold it, and appends them, findings or
none. Findings are joined back to all paths. Texts that occur once and are new are scanned where they
are read. Which those are reaches the scan as a Bloom filter of
fixed size over all other blobs; what passes it is settled exactly, and only those texts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangelake.llm.common import folder, key_filter, may_have, ready
from rangelake.sources.files import exists

RULE_VERSION = "3"
#: Kind, what a span matches, and a group of it with its least length (0: the span).
#: A match that is too short is dropped after it has taken its characters.
BASE_RULES = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: A private key from its header to its END line, if no other header or END comes first; where END is missing,
#: over the base64 lines that follow, with fields such as DEK-Info before them and a short last line.
#: No look-around and no possessive counts, which DuckDB lacks; groups repeat few times, which Java needs.
_BEGIN = r"-{4,5} ?BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)? ?-{4,5}"
_TO_END = r"[^-]*(?:-{1,3}[^-]+){0,250}-{4,5} ?END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)? ?-{4,5}"
_LINES = r"""(?:\s*[A-Za-z]+(?:-[A-Za-z]+){0,3}: [^\n]*\n){0,8}[A-Za-z0-9+/=\s\\"'>#|]*[A-Za-z0-9+/]{20,}(?:={1,2}|[\s\\"'>#|]+n?[A-Za-z0-9+/]{1,19}={1,2}|\r?\n[ \t>#|]*=?[A-Za-z0-9+/]{1,19}[ \t]*(?:\r?\n|\z))?"""
MORE_RULES = [
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", _BEGIN + rf"(?:{_TO_END}|{_LINES})?", 0, 0),
    ("vcs", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
]
RULES = BASE_RULES + MORE_RULES
SPAN = "struct<kind:string,at:int,start:int,end:int>"


def spans_of(text: Column, kind_at: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<SPAN> of one rule's matches: code points, end exclusive.

    The text is cut into (gap, match) pairs up to its end, so that places are running sums of lengths.
    """
    cut = rf"(?s)(.*?)(?:({pattern})|\z)"
    gaps, found = (F.regexp_extract_all(text, F.lit(cut), F.lit(k)) for k in (1, 2))
    value = F.regexp_extract_all(text, F.lit(cut), F.lit(3)) if group else found
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("found"), value.alias("value"))
    start = lambda a, x: a["pos"] + F.length(x["gap"])
    end = lambda a, x: start(a, x) + F.length(x["found"])
    span = lambda a, x: F.struct(F.lit(kind).alias("kind"), F.lit(kind_at).alias("at"), start(a, x).alias("start"), end(a, x).alias("end"))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    keep = lambda x: (F.length(x["found"]) > 0) & (F.length(x["value"]) >= least)
    step = lambda a, x: F.struct(end(a, x).alias("pos"), F.when(keep(x), F.concat(a["spans"], F.array(span(a, x)))).otherwise(a["spans"]).cast(f"array<{SPAN}>").alias("spans"))
    walked = F.aggregate(pairs, zero, step, lambda a: a["spans"])
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(df: DataFrame) -> DataFrame:
    """df (text not null) with spans, by start and then by the order of RULES."""
    every = F.concat(*(spans_of(F.col("text"), k, *r) for k, r in enumerate(RULES)))
    order = lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["at"] - y["at"])
    return df.withColumn("spans", F.array_sort(every, order))


def ledger_schema() -> str:
    return f"blob string, rule_version string, spans array<{SPAN}>"


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(blobs, new ledger rows): the narrow table (doc_id, blob) of docs, and (blob, rule_version, spans) for each pair that ledger lacks.

    Null texts count as empty. A blob without findings gets a ledger row as well, with no spans.
    """
    ready(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    versions = docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob"))
    blobs = versions.select("doc_id", "blob")
    key = F.xxhash64("blob")
    many = blobs.groupBy("blob").agg(F.count("*").alias("n")).filter("n > 1").select(key.alias("_key"))
    seen = None if ledger is None else ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct()
    others = many if seen is None else many.union(seen.select(key.alias("_key")))
    marked = may_have(versions.withColumn("_key", key), key_filter(others, "_key"), "_key", "_hit")
    once = marked.filter("not _hit").select("blob", "text")
    # a blob's copies meet pre-aggregated: each task sends one text at most
    rest = marked.filter("_hit").select("blob", "text")
    if seen is not None:
        rest = rest.join(seen, "blob", "left_anti")
    rest = rest.groupBy("blob").agg(F.first("text").alias("text"))
    new = with_spans(once).union(with_spans(rest)).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    return blobs, new


def read_ledger(spark: SparkSession, path: str, rule_version: str | None = None) -> DataFrame | None:
    """The rows of the ledger at path, each pair once, or those of one rule version; None if there is no ledger yet.

    A pair is there twice only if two updates ran at the same time; their spans are the same.
    """
    if not exists(spark, f"{path}/*"):
        return None
    rows = spark.read.schema(ledger_schema()).parquet(path)
    rows = rows if rule_version is None else rows.filter(F.col("rule_version") == rule_version)
    return rows.dropDuplicates(["blob", "rule_version"])


def update_ledger(docs: DataFrame, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans the pairs of docs that the ledger at path lacks and appends them; the narrow table (doc_id, blob) of docs.

    docs may hold any number of versions of a document, a row each. An update that breaks off appends
    nothing and can run again.
    """
    blobs, new = scan_unseen(docs, read_ledger(docs.sparkSession, path, rule_version), rule_version)
    new.write.mode("append").partitionBy("rule_version").parquet(path)
    return blobs


def compact_ledger(spark: SparkSession, path: str, to: str) -> None:
    """Writes the ledger at path to a new folder, each pair once, in fewer files sorted by blob."""
    rows = read_ledger(spark, path)
    rows.repartitionByRange("rule_version", "blob").sortWithinPartitions("blob").write.partitionBy("rule_version").parquet(to)


def _found(docs: DataFrame, ledger: str | None, rule_version: str) -> tuple[DataFrame, DataFrame]:
    """((doc_id, blob) of docs, (blob, spans) of the ledger where there are spans), after an update of the ledger, or of one of its own."""
    path = ledger or folder(docs.sparkSession, "ledger")
    blobs = update_ledger(docs, path, rule_version)
    rows = docs.sparkSession.read.schema(ledger_schema()).parquet(path)
    return blobs, rows.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans")


def scan_secrets(docs: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Per row of docs: doc_id, blob, spans array<struct<kind, at, start, end>>, by the ledger at a path, which is updated.

    Without a path the ledger lives as long as the session. Null texts count as empty and have no
    spans. Repeated rows and null doc_ids get their text's spans; an empty table gives no rows; other
    columns aren't read.
    """
    blobs, found = _found(docs, ledger, rule_version)
    out = blobs.join(found, "blob", "left")
    return out.select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def redact_secrets(docs: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION, mark: str = "[SECRET]") -> DataFrame:
    """docs with every stretch of text that a span covers replaced by mark; n_chars, if there is one, follows the new text.

    Texts without spans and null texts stay as they are, and so do all other columns. The ledger is as in scan_secrets().
    """
    found = _found(docs, ledger, rule_version)[1].select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    blob = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    # only texts with findings are joined; a Bloom filter of their blobs lets the rest stay in place
    marked = may_have(docs.withColumn("_blob", blob).withColumn("_key", F.xxhash64("_blob")), key_filter(found.select(F.xxhash64("_blob").alias("_key")), "_key"), "_key", "_hit")
    clean = marked.filter("not _hit").select(docs.columns)
    hit = marked.filter("_hit").join(found, "_blob", "left")
    step = lambda a, s: F.struct(
        F.greatest(a["pos"], s["end"]).alias("pos"),
        F.when(s["start"] >= a["pos"], F.concat(a["text"], F.substring("text", a["pos"] + 1, s["start"] - a["pos"]), F.lit(mark))).otherwise(a["text"]).alias("text"),
    )
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("text"))
    text = F.aggregate("_spans", zero, step, lambda a: F.concat(a["text"], F.substring("text", a["pos"] + 1, F.length("text"))))
    hit = hit.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.union(hit.select(docs.columns))
