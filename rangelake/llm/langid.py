"""Language identification with segmentation-marginalised unigrams.

Each language has probabilities for the pieces of one fixed public vocabulary. A word's probability is
the sum over all ways to cut it into pieces, which a forward algorithm gets in one pass; a text's is
the product over its words. Probabilities are learned from word counts of all training texts by
expectation-maximisation: the expected piece counts under all segmentations, from forward and backward
sums. Words of equal length are worked through together as arrays.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm.common import ready

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Additive smoothing of expected counts, and rounds of training.
SMOOTH, ROUNDS = 0.1, 2
#: Symbols after which the sums over segmentations are rescaled.
RESCALE = 16
#: Words that a worker keeps scores or counts of at a time.
TABLE_SIZE = 150_000
#: Words of a language that training takes at a time, whatever the size of batches.
TOGETHER = 10_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; none if no character is a letter."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(any(map(str.isalpha, w)) for w in found) else []


class Vocabulary:
    """The plain pieces of a `sentencepiece` file; one more number stands for any other character."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.size = len(self.pieces) + 1
        self.longest = max(map(len, self.pieces))
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.powers = np.array([pow(int(MULTIPLIER), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(MULTIPLIER) + ord(c) + 1) & (1 << 64) - 1
        return h

    def spans(self, words: list[str]) -> np.ndarray:
        """[word, end, length]: the piece of that many characters up to end, or -1. All words are of one length."""
        n, m = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, m).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n, m + 1), np.uint64)
        for k in range(m):
            prefix[:, k + 1] = prefix[:, k] * MULTIPLIER + codes[:, k]
        out = np.full((n, m + 1, self.longest + 1), -1, np.int32)
        for size in range(1, min(m, self.longest) + 1):
            h = prefix[:, size:] - prefix[:, : m + 1 - size] * self.powers[size]
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            out[:, size:, size] = np.where(self.sorted[at] == h, self.order[at], self.size - 1 if size == 1 else -1)
        return out


def forward(spans: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(alpha[word, end, column], scale or None, log-probability[word, column]) for p[piece, column].

    The last row of p stands for "no such piece" and is zero. Sums are rescaled after every RESCALE
    symbols, however short the word: pieces may be as rare as the corpus is large. The sum itself is
    alpha * exp(scale); None stands for zeros, for words that have no rescaling.
    """
    n, m1, longest = spans.shape
    columns = p.shape[1]
    alpha = np.zeros((n, m1, columns))
    alpha[:, 0] = 1
    scale = np.zeros((n, m1, columns)) if m1 > RESCALE else None
    for end in range(1, m1):
        total = np.zeros((n, columns))
        for size in range(1, min(end, longest - 1) + 1):
            total += alpha[:, end - size] * p[spans[:, end, size]]
        alpha[:, end] = total
        if scale is not None:
            scale[:, end] = scale[:, end - 1]
            if end % RESCALE == 0:
                low = max(0, end - longest + 1)
                alpha[:, low : end + 1] /= total[:, None]  # each language by itself: their ratio grows without bound
                scale[:, low : end + 1] += np.log(total)[:, None]
    logs = np.log(alpha[:, -1])
    return alpha, scale, logs if scale is None else logs + scale[:, -1]


def expected(spans: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected count of each piece over words of one language; p: one column.

    beta carries alpha's scale and is divided by the word's probability, so that the product of both
    at one place needs no scale; between two places the difference of their scales is left.
    """
    n, m1, longest = spans.shape
    alpha, scale, _ = forward(spans, p)
    alpha, q = alpha[:, :, 0], p[:, 0]
    beta = np.zeros((n, m1))
    beta[:, -1] = weight / alpha[:, -1]
    counts = np.zeros(len(p))
    for end in range(m1 - 1, 0, -1):
        for size in range(1, min(end, longest - 1) + 1):
            piece = spans[:, end, size]
            through = q[piece] * beta[:, end]
            if scale is not None:
                through *= np.exp(scale[:, end - size, 0] - scale[:, end, 0])
            beta[:, end - size] += through
            counts += np.bincount(np.where(piece < 0, len(p) - 1, piece), alpha[:, end - size] * through, len(p))
    return counts


def by_length(words: list[str], block: int = 4096):
    groups = defaultdict(list)
    for k, w in enumerate(words):
        groups[len(w)].append(k)
    for size, at in sorted(groups.items()):
        step = max(1, block * 16 // size)
        for i in range(0, len(at), step):
            yield at[i : i + step]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


@dataclass
class Unigrams:
    """p[piece, language], with one more row of zeros."""

    path: str
    languages: list[str]
    p: np.ndarray

    def score_words(self, words: list[str]) -> np.ndarray:
        """log P(word | language) for each word."""
        vocab, out = vocabulary(self.path), np.zeros((len(words), len(self.languages)))
        marked = [MARK + w for w in words]
        for at in by_length(marked):
            out[at] = forward(vocab.spans([marked[k] for k in at]), self.p)[2]
        return out


def fit_unigrams(docs: DataFrame, path: str, *, rounds: int = ROUNDS, smooth: float = SMOOTH) -> Unigrams:
    """Learns from text and lang of all rows of docs that have both.

    The driver gets one number for each language and piece of the vocabulary, so what it collects is
    bounded by the vocabulary and the number of languages. Words are counted in the tasks and then by
    (lang, word); a frequent word is one row a task.
    """
    spark = docs.sparkSession
    ready(spark)

    def count(batches):
        held: dict[str, Counter] = defaultdict(Counter)
        size = 0

        def given():
            for lang, counts in held.items():
                yield pd.DataFrame({"lang": lang, "word": list(counts), "n": list(counts.values())})

        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                counts = held[lang]
                size -= len(counts)
                counts.update(words_of(text))
                size += len(counts)
                if size > TABLE_SIZE:
                    yield from given()
                    held.clear()
                    size = 0
        yield from given()

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    words = rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).checkpoint()
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    size = vocabulary(path).size
    p = np.full((size, len(languages)), 1 / size)
    for _ in range(rounds if languages else 0):
        held = np.vstack([p, np.zeros((1, len(languages)))])

        def expect(batches, held=held):
            vocab, total = vocabulary(path), np.zeros_like(held)
            waiting: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))

            def work(lang: str) -> None:
                column, (marked, weight) = languages.index(lang), waiting.pop(lang)
                weight = np.array(weight, float)
                for at in by_length(marked):
                    total[:, column] += expected(vocab.spans([marked[k] for k in at]), held[:, column : column + 1], weight[at])

            for b in batches:
                for lang, w, n in zip(b["lang"], b["word"], b["n"]):
                    marked, weight = waiting[lang]
                    marked.append(MARK + w)
                    weight.append(n)
                for lang in [x for x, (marked, _) in waiting.items() if len(marked) >= TOGETHER]:
                    work(lang)
            for lang in list(waiting):
                work(lang)
            piece, column = np.nonzero(total[:-1])
            if len(piece):
                yield pd.DataFrame({"piece": piece, "col": column, "n": total[piece, column]})

        got = words.mapInPandas(expect, "piece int, col int, n double").groupBy("piece", "col").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full_like(p, smooth)
        np.add.at(counts, (got["piece"].to_numpy(int), got["col"].to_numpy(int)), got["n"].to_numpy(float))
        p = counts / counts.sum(axis=0)
    return Unigrams(path, languages, np.vstack([p, np.zeros((1, p.shape[1]))]))


def identify(docs: DataFrame, model: Unigrams) -> DataFrame:
    """Per row of docs: doc_id, lang_pred and score, the posterior of that language with even odds before.

    Only text is looked at. Null texts and texts without a letter are `und` with score 0, and so is
    every text if nothing was learned. Ties go to the language first in order. Rows are independent:
    repeated rows, null doc_ids and an empty table need no rule. Nothing is shuffled.
    """
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary of numbers for each language

    def run(batches):
        m = held.value
        number: dict[str, int] = {}
        table = np.zeros((0, len(m.languages)))
        for b in batches:
            texts = [words_of(t) if m.languages else [] for t in b["text"]]
            if len(number) > TABLE_SIZE:
                number, table = {}, table[:0]
            fresh = list(dict.fromkeys(w for ws in texts for w in ws if w not in number))
            number.update(zip(fresh, range(len(number), len(number) + len(fresh))))
            table = np.concatenate([table, m.score_words(fresh)]) if fresh else table
            pred, score = [], []
            for ws in texts:
                if not ws:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                z = table[np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                k = int(z.argmax())
                pred.append(m.languages[k])
                score.append(float(1 / np.exp(z - z[k]).sum()))
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "lang_pred": pred, "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")
