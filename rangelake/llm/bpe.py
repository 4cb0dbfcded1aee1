"""Byte-level BPE encoding and decoding.

Encoding keeps the symbols of a pretoken in a doubly linked list and the mergeable neighbours in a
priority queue of merge ranks; entries that a later merge has made stale are skipped when they come
up. Decoding concatenates the vocabulary's strings. Encodings of pieces between single spaces are
kept in a bounded table of the worker: such a piece never shares a pretoken with its neighbours.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm.common import ready

#: How byte-level BPE splits text before merging, with white space as Unicode has it.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A space between two other characters that aren't white space; pretokens never cross it.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = re.compile(r"\s |\s\Z| \s| \Z|\A ")
#: Marks that, alone after letters, are a pretoken of their own.
SINGLE = frozenset(".,;:!?")
#: Entries after which a worker's table of encoded pieces starts anew, and the longest piece kept in it.
TABLE_SIZE, LONGEST_KEPT = 250_000, 64


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder for a `tokenizers` file of a byte-level BPE vocabulary.

    Special tokens of the file are matched in texts before anything else, as that library does by
    default. Any string has an encoding, the empty one too, and decode(encode(s)) == s.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.strings[i] = bytes(symbols[c] for c in t)
        for t, i in self.special.items():
            self.strings[i] = t.encode()
        first = [0] * 256
        for c, b in symbols.items():
            first[b] = vocab[c]
        self.first = first
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a] << 20 | vocab[b]] = r
            self.made.append(vocab[a + b])
        self.pretokens = regex.compile(PRETOKENS)
        self.table: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pretoken."""
        sym, n = [self.first[b] for b in data], len(data)
        if n < 2:
            return sym
        rank, made = self.rank, self.made
        get = rank.get
        due = [get(a << 20 | b, -1) for a, b in zip(sym, sym[1:])]
        heap = [r << 32 | i for i, r in enumerate(due) if r >= 0]
        due.append(-1)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if due[i] != r:  # stale: a merge has since taken or changed this pair
                continue
            j = after[i]
            k = after[j]
            sym[i] = made[r]
            sym[j] = due[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
                due[i] = r = get(sym[i] << 20 | sym[k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                due[i] = -1
            h = before[i]
            if h >= 0:
                due[h] = r = get(sym[h] << 20 | sym[i], -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        return [s for s in sym if s >= 0]

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            got = np.array(self.merge(part.encode("utf-8", "surrogatepass")), "<u4").tobytes()
            if len(part) <= LONGEST_KEPT:
                if len(self.parts) >= TABLE_SIZE:
                    self.parts.clear()
                self.parts[part] = got
        return got

    def _piece(self, piece: str) -> bytes:
        if piece[1:].isalpha() and piece[0] == " ":
            got = self._part(piece)
        elif piece[-1:] in SINGLE and piece[1:-1].isalpha() and piece[0] == " ":
            got = self._part(piece[:-1]) + self._part(piece[-1])
        else:
            got = b"".join([self._part(p) for p in self.pretokens.findall(piece)])
        if len(piece) <= LONGEST_KEPT:
            if len(self.table) >= TABLE_SIZE:
                self.table.clear()
            self.table[piece] = got
        return got

    def _plain(self, text: str) -> bytes:
        head, *rest = text.split(" ") if not ODD_SPACE.search(text) else LONE_SPACE.split(text)
        out, get, piece = [self._piece(head)], self.table.get, self._piece
        for w in rest:
            w = " " + w
            out.append(get(w) or piece(w))
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_special is None:
            return self._plain(text)
        out = []
        for k, s in enumerate(self.split_special.split(text)):
            if k % 2:
                out.append(self.special[s].to_bytes(4, "little"))
            elif s:
                out.append(self._plain(s))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


class RankBPE(ByteBPE):
    """The same ids, with pieces up to LONGEST_KEPT characters merged by `tiktoken`: for operators that only need ids."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        special = set(self.special.values())
        ranks = {b: i for i, b in enumerate(self.strings) if b and i not in special}
        if any(a >= b for a, b in zip(self.made, self.made[1:])):
            raise ValueError(f"{path}: ids aren't in the order of merges")
        self.coder = tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, piece: str) -> bytes:
        if len(piece) > LONGEST_KEPT:
            return super()._piece(piece)
        if len(self.table) >= TABLE_SIZE:
            self.table.clear()
        self.table[piece] = got = array("I", self.coder.encode_ordinary(piece)).tobytes()
        return got


_loaded: dict[tuple, ByteBPE] = {}


def loaded(path: str, kind: type[ByteBPE] = ByteBPE) -> ByteBPE:
    """The worker's encoder for this file."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def bpe_encode(docs: DataFrame, path: str, *, with_ids: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids (array<int>, on request), ids_sha256 and decoded_sha256.

    path: the tokenizer file, at the same place on every worker. Null texts count as empty: no ids and
    the digests of the empty string. Rows are independent, so repeated rows, null doc_ids and an empty
    table need no rule; columns other than doc_id and text aren't read. No row is shuffled; a lost
    executor costs the running tasks only.
    """
    ready(docs.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            out = []
            for text in b["text"]:
                ids = bpe.encode_bytes(text or "")
                back = bpe.decode_bytes(ids).decode("utf-8", "replace").encode("utf-8")
                out.append((len(ids) // 4, np.frombuffer(ids, "<i4") if with_ids else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            got = pd.DataFrame(out, columns=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])
            got.insert(0, "doc_id", b["doc_id"].array)
            yield got if with_ids else got.drop(columns="ids")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens long, {'ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string")


def bpe_decode(ids: DataFrame, path: str) -> DataFrame:
    """Per row of ids (doc_id, ids array<int>): doc_id and text, the vocabulary's strings put together.

    Bytes that aren't UTF-8 become U+FFFD. Null ids count as none; ids outside the vocabulary raise.
    """
    ready(ids.sparkSession)

    @F.pandas_udf("string")
    def join(col: pd.Series) -> pd.Series:
        bpe = loaded(path)
        return col.map(lambda x: bpe.decode(x if x is not None else []))

    return ids.select("doc_id", join("ids").alias("text"))
