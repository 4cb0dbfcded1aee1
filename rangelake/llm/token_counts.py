"""Token counts of whole texts through overlapping chunks.

A huge text is never encoded at once: chunks that overlap are encoded with offsets, and two
neighbours are spliced at a token boundary that both have and that is proven stable. Stable means
that no piece of the vocabulary spans it: pieces never hold a word mark after another character, so
merging can't reach across a space that follows a character other than a space. If an overlap has no
such boundary, it is widened until it has one or the text ends.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from rangelake.llm.common import ready

MARK = "▁"
CHUNK, OVERLAP = 16_384, 256
#: In UTF-8, a space after a character that is neither a space nor the word mark itself.
STABLE = re.compile(rb"(?<=[^ ])(?<!\xe2\x96\x81) ")


def whole(data: bytes, at: int) -> int:
    """The largest place up to at that doesn't split a character."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


class ChunkCounter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.sp, self.chunk, self.overlap = sentencepiece.SentencePieceProcessor(model_file=path), chunk, overlap
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        #: Whether the vocabulary lets a space be a stable boundary at all; else texts are taken whole.
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces)

    def _begins(self, data: bytes) -> list[int]:
        """Where each token of a chunk begins, in its bytes."""
        return [p.begin for p in self.sp.encode(data.decode("utf-8"), return_type="proto").pieces]

    def count(self, text: str) -> int:
        data = text.encode("utf-8")
        if len(data) <= self.chunk or not self.splits:
            return len(self.sp.encode(text))
        return sum(n for _, _, n in self.spliced(data))

    def spliced(self, data: bytes) -> list[tuple[int, int, int]]:
        """(begin, end, tokens) of the stretches that the chunks contribute; they tile the text."""
        out, begin, cut, size, known = [], 0, 0, self.chunk, None  # begin: where this chunk starts; cut: where its tokens start to count
        while True:
            end = whole(data, begin + size) if begin + size < len(data) else len(data)
            mine = known or [begin + b for b in self._begins(data[begin:end])]
            known = None
            held = set(mine)
            if end == len(data):
                return [*out, (cut, end, sum(b >= cut for b in mine))]
            width = self.overlap
            while True:  # the next chunk starts width before this one's end
                ahead = max(cut, whole(data, max(0, end - width)))
                edges = [m.start() for m in STABLE.finditer(data, ahead, end) if m.start() > ahead]
                if edges:
                    known = [ahead + b for b in self._begins(data[ahead : whole(data, ahead + self.chunk)])]
                    theirs = set(known)
                    edges = [x for x in edges if x in theirs and x in held]
                if edges:
                    at = edges[len(edges) // 2]
                    out.append((cut, at, sum(cut <= b < at for b in mine)))
                    begin, cut, size = ahead, at, self.chunk
                    break
                if ahead == cut:  # no boundary since the last splice: this chunk grows
                    size *= 2
                    known = None
                    break
                width *= 2


_loaded: dict[tuple, ChunkCounter] = {}


def token_counts(docs: DataFrame, path: str, *, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens as the `sentencepiece` file at path gives them, over_limit.

    Null texts count as empty: 0 bytes, 0 tokens. Rows are independent, so repeated rows, null doc_ids
    and an empty table need no rule; columns other than doc_id and text aren't read. Nothing is
    shuffled, and memory is bounded by one text and one chunk's tokens, unless a text has no space for
    longer than a chunk.
    """
    ready(docs.sparkSession)

    def run(batches):
        key = path, chunk, overlap
        if key not in _loaded:
            _loaded[key] = ChunkCounter(*key)
        counter = _loaded[key]
        for b in batches:
            texts = [t or "" for t in b["text"]]
            n = [counter.count(t) for t in texts]
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
