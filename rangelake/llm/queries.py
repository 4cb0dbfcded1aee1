"""The queries of this subpackage: thin layers that derive the contracts' columns from the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangelake.llm.bpe import bpe_encode
from rangelake.llm.common import LOWER, UPPER, table
from rangelake.llm.exact_dedup import exact_dedup
from rangelake.llm.langid import fit_unigrams, identify
from rangelake.llm.line_dedup import LEAST_WORDS, repeated_units
from rangelake.llm.minhash import near_duplicates
from rangelake.llm.packing import pack_documents
from rangelake.llm.quality_gam import fit_quality_gam, quality_scores
from rangelake.llm.quality_rules import fit_quality_rules, quality_rules
from rangelake.llm.secrets import RULES, scan_secrets
from rangelake.llm.token_counts import token_counts

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), BYTE_BPE, with_ids=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, all_digests=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _crc(mod: int):
    """crc32 of doc_id as text; a null doc_id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_unigrams(docs.filter(_crc(5) != 0), PIECES)
    return identify(docs, model).select("doc_id", (_crc(5) == 0).alias("held_out"), "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["at"] < 3)
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), PIECES)


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality_gam(docs.filter(_crc(4) != 2), table(spark, sf_dir, "labels").filter(_crc(4) != 2))
    return quality_scores(docs, model).select("doc_id", (_crc(4) == 2).alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_exact_dedup, op3_language_id, op4_quality_rules, op5_secret_scan, op6_line_dedup, op7_minhash_dedup, op8_token_counts, op9_quality_gam, op10_packing)}


def _op5_sql() -> str:
    """Each rule as (gap, match) pairs, like the operator; places are sums of lengths before them."""
    parts = []
    for at, (kind, pattern, group, least) in enumerate(RULES):
        cut = rf"(?s)(.*?)(?:({pattern})|\z)".replace("'", "''")
        value = f"regexp_extract_all(t, '{cut}', 3)" if group else "found"
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {at} AS kat, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS b, length(found[i]) AS n "
            f"FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM (SELECT *, {value} AS vals FROM (SELECT doc_id, t, regexp_extract_all(t, '{cut}', 1) AS gaps, regexp_extract_all(t, '{cut}', 2) AS found FROM d))) "
            f"WHERE length(found[i]) > 0 AND length(vals[i]) >= {least}"
        )
    spell = "kind || ':' || cast(b AS BIGINT) || ':' || cast(b + n AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (WHERE kat = 0) AS a, count(*) FILTER (WHERE kat = 1) AS k, count(*) FILTER (WHERE kat = 2) AS h,
  coalesce(string_agg({spell}, ',' ORDER BY b, kat) FILTER (WHERE kat < 3), '') AS base, string_agg({spell}, ',' ORDER BY b, kat) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


ORACLE_SQL = {
    "op2_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op5_secret_scan": _op5_sql(),
    "op6_line_dedup": rf"""
WITH d AS (SELECT DISTINCT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, ls[i] AS t, cast(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS b FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
s AS (SELECT doc_id, b AS lb, regexp_extract_all(t, '[^.!?]*[.!?]+|[^.!?]+') AS ss FROM l),
t AS (SELECT doc_id, cast(lb + coalesce(list_sum(list_transform(ss[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS b, ss[i] AS t FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)),
w AS (SELECT doc_id, b, b + length(t) AS e, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n, translate(array_to_string(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), ' '), '{UPPER}', '{LOWER}') AS norm FROM t),
c AS (SELECT *, row_number() OVER p AS k, sum(n) OVER p AS c1, sum(n) OVER p - n AS c0 FROM w WHERE n > 0 WINDOW p AS (PARTITION BY doc_id ORDER BY b)),
m AS (SELECT x.doc_id, x.k AS a, y.k AS z FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.k >= x.k AND y.k < x.k + {LEAST_WORDS} AND y.c1 - x.c0 >= {LEAST_WORDS}),
r AS (SELECT doc_id, a, min(z) AS z FROM m GROUP BY doc_id, a UNION SELECT doc_id, max(a), z FROM m GROUP BY doc_id, z),
u AS (SELECT r.doc_id, min(b) AS b, max(e) AS e, sum(n) AS n_words, string_agg(norm, ' ' ORDER BY k) AS norm FROM r JOIN c ON r.doc_id = c.doc_id AND c.k BETWEEN r.a AND r.z GROUP BY r.doc_id, r.a, r.z),
f AS (SELECT *, first(doc_id) OVER p AS keep_doc_id, first(b) OVER p AS keep_start, first(e) OVER p AS keep_end FROM u WINDOW p AS (PARTITION BY norm ORDER BY doc_id, b, e))
SELECT doc_id, cast(b AS INT) AS start, cast(e AS INT) AS "end", cast(n_words AS INT) AS n_words, keep_doc_id, cast(keep_start AS INT) AS keep_start
FROM f WHERE NOT (doc_id = keep_doc_id AND b >= keep_start AND b < keep_end)""",
    "op7_minhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, comp) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.comp = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(comp) AS component_id FROM r GROUP BY doc_id) USING (doc_id)""",
}
