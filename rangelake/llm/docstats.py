"""Statistics of a whole text that the quality operators share."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

from rangelake.llm.common import SPACES

SYMBOLS = "#*$%&|<>"
MARKS = {k: v.encode() for k, v in {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".", "loud": "!?", "comma": ",;:", "bracket": "()[]{}\"'"}.items()}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "stop_share", "loud_share",
    "comma_share", "bracket_share", "distinct_share", "line_words", "longest_word", "short_word_share", "top_word_share",
]


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur twice or more, the first time included."""
    if len(ids) < 4:
        return 0
    pair = ids[:-2] * distinct + ids[1:-1]
    if distinct >= 1 << 20:  # three ids don't fit 63 bits: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, counts = np.unique(pair * distinct + ids[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum())


def describe(text: str | None) -> tuple[list[int], list[float]]:
    """(BASE, FEATURES) of a text; words are runs of anything but ASCII white space, null has none."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeats = repeat_words(ids, len(number))
    size = max(1, len(data))
    share = {k: (len(data) - len(data.translate(None, v))) / size for k, v in MARKS.items()}
    lengths = np.fromiter(map(len, number), np.int64, len(number)) if number else np.zeros(1, np.int64)
    counts = np.bincount(ids, minlength=1) if n else np.zeros(1, np.int64)
    short = int(counts[lengths <= 3].sum()) if n else 0
    return [n, chars, symbols, dup, repeats], [
        math.log1p(n), chars / max(1, n), symbols / max(1, chars), dup / max(1, lines), repeats / max(1, n), share["upper"], share["digit"], share["stop"], share["loud"],
        share["comma"], share["bracket"], len(number) / max(1, n), n / max(1, lines), float(lengths.max()), short / max(1, n), float(counts.max()) / max(1, n),
    ]


def describe_all(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    base, features = [], []
    for t in texts:
        b, f = describe(t)
        base.append(b)
        features.append(f)
    return np.array(base, np.int64).reshape(-1, len(BASE)), np.array(features, np.float64).reshape(-1, len(FEATURES))
