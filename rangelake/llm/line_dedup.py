"""Substring dedup by hashing of lines and sentences.

A text is cut at the ends of lines and sentences. Units are runs of consecutive pieces, across lines, that
have just enough words: from each piece on, and up to each piece, the shortest such run. So short lines
and sentences are joined to their neighbours, a long one is a unit by itself, and what repeats, piece by
piece, is covered by units that lie in it, whatever stands around it. A unit is normalised (A-Z
lower-cased, white space between words one space) and hashed; digests are grouped over the whole table,
the occurrence ranked first, by doc_id and place, stays, and all others are spans to remove, with their
places in the original text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm.common import SPACES, cut, key_filter, may_have, ready
from rangelake.llm.minhash import STEP, mix

#: Words that a unit has at least: fewer may well meet again by chance, or as a common line of many pages.
LEAST_WORDS = 20
#: Ends a piece within a line: a stop that isn't followed by another one.
JOINED = re.compile(r"([.!?])(?=[^.!?\x20\x09-\x0D])")
#: By ASCII character: 1 for a stop, 2 for white space; what isn't ASCII counts as the last.
KINDS, BREAK = np.array([1 if chr(k) in ".!?" else 2 if chr(k) in SPACES else 0 for k in range(128)], np.uint8), ord("\n")
#: Odd bases of the two halves of a digest, and how many words a worker knows the hashes of.
BASES, WORDS_KEPT = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), 200_000
_powers: dict[int, np.ndarray] = {}


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n - 1), modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        with np.errstate(over="ignore"):
            held = _powers[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, base, np.uint64)]), dtype=np.uint64)
    return held[:n]


def pieces(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end and number of words of each piece with a word, hashes of all words); code points, end exclusive.

    A piece ends with a run of stops or before the end of its line; a word that goes on behind a stop is
    two words.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = KINDS[np.minimum(c, 127)]
    stop, blank = kind == 1, kind == 2
    begins = np.ones(len(c), bool)
    begins[1:] = (c[:-1] == BREAK) | (stop[:-1] & ~stop[1:])
    word = ~blank
    word[1:] &= blank[:-1] | begins[1:]
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(c))
    counts = np.add.reduceat(word, starts, dtype=np.int64)
    ends = ends - (c[ends - 1] == BREAK)
    have = counts > 0
    words = JOINED.sub(r"\1 ", text).encode("utf-8", "surrogatepass").lower().split()
    return starts[have], ends[have], counts[have], np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def units(text: str, least: int) -> tuple[np.ndarray, ...] | None:
    """(start, end, words, two halves of a digest) of each unit of a text; None if the text has fewer words in all.

    A run's digest comes from sums of its words' hashes times powers of a base, taken from two running sums.
    """
    starts, ends, counts, hashes = pieces(text)
    if len(hashes) < least:
        return None
    upto = np.concatenate([[0], np.cumsum(counts)])
    last = np.searchsorted(upto, upto[:-1] + least, "left") - 1  # of the shortest run from each piece on
    first = np.searchsorted(upto, upto[1:] - least, "right") - 1  # of the shortest run up to each piece
    k = np.arange(len(counts))
    n = len(counts)
    a, b = np.divmod(np.unique(np.concatenate([(k * n + last)[last < n], (first * n + k)[first >= 0]])), n)
    low, high = upto[a], upto[b + 1]
    h, halves = hashes, []
    with np.errstate(over="ignore"):
        for base in BASES:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base, len(h)), dtype=np.uint64)])
            back = powers(pow(base, -1, 1 << 64), len(h) + 1)[low]
            halves.append(mix((total[high] - total[low]) * back + (high - low).astype(np.uint64) * STEP).view(np.int64))
            h = mix(h)
    return starts[a], ends[b], high - low, *halves


def repeated_units(docs: DataFrame, *, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per unit to remove: doc_id, start, end, n_words, keep_doc_id, keep_start.

    Null texts, and texts with fewer words in all, have no units. Null doc_ids rank last. Rows that
    repeat one another, doc_id and text, are one occurrence: what the first of them keeps, all keep. An
    empty table gives no rows; other columns aren't read. Units may overlap; one that overlaps the
    occurrence of it that stays, in the same document, isn't removed. Only digests and places are
    shuffled; a unit that a third of all documents share is one row a task in the grouping, and its
    occurrences meet their group in a join whose skewed partitions Spark splits. Occurrences of digests
    that are there once don't get to that join, by a Bloom filter.
    """
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, found = [], []
            for k, t in enumerate(batch["text"]):
                if t and (u := units(t, least_words)):
                    ids.append(np.full(len(u[0]), k))
                    found.append(u)
            if not found:
                continue
            columns = [np.concatenate(c) for c in zip(*found)]
            out = pd.DataFrame(dict(zip(("start", "end", "n_words", "hi", "lo"), columns)))
            doc_id = batch["doc_id"].iloc[np.concatenate(ids)].reset_index(drop=True)
            out.insert(0, "doc_id", doc_id.astype(object).where(doc_id.notna(), None) if doc_id.isna().any() else doc_id)
            yield out

    every = cut(docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start int, end int, n_words int, hi long, lo long"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start", "end")
    # grouped by one column more than is joined on, so that the join has exchanges that can be split
    groups = cut(
        every.groupBy("hi", "lo", "n_words").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
        .select("hi", "lo", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").alias("keep_start"), F.col("first.end").alias("keep_end"))
    )
    again = may_have(every, key_filter(groups, "hi"), "hi", "_hit").filter("_hit").drop("_hit").join(groups, ["hi", "lo"])
    stays = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("start") >= F.col("keep_start")) & (F.col("start") < F.col("keep_end"))
    return again.filter(~stays).select("doc_id", "start", "end", "n_words", "keep_doc_id", "keep_start")


def without_repeats(docs: DataFrame, *, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the repeated units cut out of text, and n_chars, if there is one, following it.

    Documents without such units stay as they are. Rows with one doc_id are taken as copies of one
    document; a null doc_id's text stays whole.
    """
    again = repeated_units(docs, least_words=least_words).filter(F.col("doc_id").isNotNull())
    spans = again.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    step = lambda a, s: F.struct(
        F.greatest(a["pos"], s["end"]).alias("pos"), F.when(s["start"] > a["pos"], F.concat(a["text"], F.substring("text", a["pos"] + 1, s["start"] - a["pos"]))).otherwise(a["text"]).alias("text")
    )
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("text"))
    text = F.aggregate("_spans", zero, step, lambda a: F.concat(a["text"], F.substring("text", a["pos"] + 1, F.length("text"))))
    out = docs.join(spans, docs["doc_id"] == F.col("_id"), "left").withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)
