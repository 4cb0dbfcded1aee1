"""Exact deduplication by progressive refinement, with DataFrame functions only.

Rows are grouped by length, then by a hash of their first characters, then by a hash of the whole
text; whole texts are hashed only where the groups before left more than one row. Length and prefix
hash come from one scan and are counted in one shuffle of (length, hash, count) rows: Parquet holds no
text lengths, so a scan for the lengths alone would read the same bytes twice. Which groups survived
reaches the second scan as a Bloom filter of fixed size, so no text is ever shuffled, and rows that
pass it wrongly only cost their hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm.common import ascii_lower, key_filter, may_have, ready

PREFIX_CHARS = 64
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, *, all_digests: bool = False) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest doc_id stays; rows that repeat it, doc_id and text, stay with it. A null
    doc_id is kept only if its group has no other. text_sha256 (of the normalised text) is null for
    rows whose text was never read whole, unless all_digests. The other columns of docs pass through;
    columns of docs with the names added here are replaced. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    docs = docs.drop(*ADDED)
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.octet_length(text), ascii_lower(F.left(text, F.lit(PREFIX_CHARS))))
    sized = docs.select(F.octet_length(text).alias("_len"), key.alias("_key"))
    survivors = sized.groupBy("_len", "_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    digest = F.sha2(ascii_lower(text).cast("binary"), 256)
    hashed = may_have(docs.withColumn("_key", key), key_filter(survivors, "_key"), "_key", "_hit")
    hashed = hashed.withColumn("text_sha256", digest if all_digests else F.when(F.col("_hit"), digest))
    # a row that is alone already has a (length, prefix) hash of its own: as a join key, that makes none hot
    alone = F.concat(F.lit("-"), F.hex("_key"))
    hashed = hashed.withColumn("_full", F.coalesce("text_sha256", alone)).drop("_key")
    groups = (
        hashed.filter("_hit").select(F.octet_length(text).alias("_len"), F.col("text_sha256").alias("_full"), "doc_id")
        .groupBy("_full", "_len").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1").drop("_len")
    )
    out = hashed.join(groups, "_full", "left").drop("_full", "_hit")
    return out.withColumns({
        "keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")),
        "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
        "kept": F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")),
    }).select(*docs.columns, *ADDED)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts: one that exact_dedup() keeps.

    Of rows that repeat one doc_id and a text equal but for case, any one stays. Only rows of groups are
    shuffled, after each task has left one row a group.
    """
    own = {c: f"_own_{c}" if c in ADDED else c for c in docs.columns}
    found = exact_dedup(docs.withColumnsRenamed(own)).filter("kept")
    columns = [F.col(name).alias(c) for c, name in own.items()]
    several = found.filter("group_size > 1").dropDuplicates(["keep_id", "text_sha256"])
    return found.filter("group_size = 1").select(columns).union(several.select(columns))
