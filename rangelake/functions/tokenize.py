"""Tokenizers: builders of array<string> columns. The registry is open to more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangelake.functions.registry import Registry

#: What separates words of an index.
SEPARATORS = " ,.;:-_/()"
#: White space of the named tokenizers: more than the six ASCII characters of Java's own class.
SPACE = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _runs(value: Column, character: str, least: int) -> Column:
    """Runs of at least so many characters: one pass with a pattern compiled once, where split() compiles it for each row."""
    return F.regexp_extract_all(value, F.lit(f"{character}{{{least},}}"), F.lit(0))


def _between(value: Column, separators: str, least: int) -> Column:
    """Runs of at least so many characters between separators, each looked up in a table: a pattern tries the parts of a class beyond ASCII in turn, for each character."""
    return _runs(F.translate(value, separators, " " * len(separators)), "[^ ]", least)


def words(value: Column, *, least: int = 2, lower: bool = True, separators: str = SEPARATORS) -> Column:
    """Words of at least so many characters between separators; white space other than a space separates only if listed."""
    inside = "".join("\\" + c for c in separators)
    return _runs(F.lower(value) if lower else value, f"[^{inside}]" if separators else r"(?s:.)", max(1, least))


def ngrams(kept: Column, longest: int) -> Column:
    """All runs of 2 to longest kept words, joined by a space."""
    places = lambda n: F.sequence(F.lit(1), F.size(kept) - n + 1)
    pairs = F.transform(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(kept, i + 1)))
    if longest == 2:  # the same without a slice for each place
        return pairs
    runs = F.transform(F.sequence(F.lit(2), F.least(F.lit(longest), F.size(kept))), lambda n: F.transform(places(n), lambda i: F.array_join(F.slice(kept, i, n), " ")))
    return F.when((F.size(kept) > 1) & F.lit(longest > 1), F.flatten(runs)).otherwise(F.array().cast("array<string>"))


def word_split(value: Column) -> Column:
    return _between(value, SPACE + ",.-_/();:", 2)


def whitespace(value: Column) -> Column:
    return _between(value, SPACE, 1)


def _once(value: Column, build: Callable[[Column], Column]) -> Column:
    """build(value), in which value is worked out once, however often build names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), build), 1)


def ngram_2(value: Column) -> Column:
    return _once(_between(value, SPACE, 2), lambda kept: F.concat(kept, ngrams(kept, 2)))


def char_ngram_3(value: Column) -> Column:
    """Every three characters in a row of the lower-cased text without white space: one pass that looks ahead at each place."""
    return F.regexp_extract_all(F.translate(F.lower(value), SPACE, ""), F.lit("(?s)(?=(...))"), F.lit(1))


TOKENIZERS = Registry("tokenizer", **{"word-split": word_split, "whitespace": whitespace, "ngram-2": ngram_2, "char-ngram-3": char_ngram_3})
