"""Match engines: builders of boolean columns from a word column and a query. The registry is open to more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangelake.functions.registry import Registry


def prefix(word: Column, query: Column) -> Column:
    return F.startswith(F.lower(word), F.lower(query))


def contains(word: Column, query: Column) -> Column:
    return F.contains(F.lower(word), F.lower(query))


def exact(word: Column, query: Column) -> Column:
    return F.lower(word) == F.lower(query)


def fuzzy(word: Column, query: Column) -> Column:
    """A prefix match, or some beginning of the word, of at most the query's length and a third more, within an edit distance of that third."""
    w, q = F.lower(word), F.lower(query)
    most = F.floor(F.length(q) / 3).cast("int")
    near = F.exists(F.sequence(F.lit(0), F.least(F.length(w), F.length(q) + most)), lambda i: F.levenshtein(F.substring(w, F.lit(1), i), q) <= most)
    return F.startswith(w, q) | F.when(most == 0, w == q).otherwise(near)


ENGINES = Registry("match engine", prefix=prefix, contains=contains, exact=exact, fuzzy=fuzzy)
