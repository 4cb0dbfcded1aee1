"""Best-fit packing of tokenised documents into sequences of a fixed length.

Residual packing: every window of pieces is packed best-fit by itself, and what the windows leave over
meets in one task, where whole bins are packed as items.

Best-fit opens a bin only for a piece that fits nowhere, so at most one bin of a packing is half empty
or more. Two bins that are fuller can't be put together: of W packings at most W bins can be put into
others, each into one of them. If any bin has room for one, the emptiest bins have it, so these W and the
W emptiest of all others (ties by number) give as few sequences as all bins would. The last task gets
these 2 W rows, where W is the number of windows; nothing is capped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm.bpe import RankBPE, loaded
from rangelake.llm.common import ready

LENGTH, END_ID = 1024, 2
#: Nothing reads these two any more; a test sets them.
KEEP = FAN_IN = None
#: Pieces that one task packs together.
WINDOW = 200_000
PIECE = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, offset long"


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences behind a first piece of what is over."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))]


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Indices by bin: largest item first, each into the fullest bin that has room, ties to the oldest bin."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(length + 1)]  # bins by free places, as stacks
    free: list[int] = []  # the free places that some bin has, sorted
    for i in order:
        size = sizes[i]
        k = bisect_left(free, size)
        if k == len(free):
            bins.append([i])
            left, b = length - size, len(bins) - 1
        else:
            room = free[k]
            b = open_at[room].pop()
            if not open_at[room]:
                del free[k]
            bins[b].append(i)
            left = room - size
        if left:
            if not open_at[left]:
                insort(free, left)
            open_at[left].append(b)
    return bins


def _round(items: pd.DataFrame, level: int, start: int, length: int) -> pd.DataFrame:
    """Packs items (size, pieces) into bins numbered from start."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    sizes, pieces = items["size"].tolist(), items["pieces"].tolist()
    bins = best_fit(sizes, length)
    held = []
    for b in bins:
        at, own = 0, []
        for i in b:
            for p in pieces[i]:
                p = tuple(p.values()) if isinstance(p, dict) else tuple(p)
                own.append((*p[:5], at))
                at += p[3]
        held.append(own)
    return pd.DataFrame({"bin": [level << 58 | part << 34 | start + k for k in range(len(bins))], "size": [sum(sizes[i] for i in b) for b in bins], "pieces": held})


def pack_documents(docs: DataFrame, path: str, *, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's tokens are its text's by the `tokenizers` file at path, then end_id; a null or empty
    text has end_id alone. Documents longer than length tokens are cut, all others stay whole. The
    pieces of a sequence lie gapless from offset 0. Repeated rows are documents of their own; null
    doc_ids stay null; an empty table gives no rows; other columns aren't read. Only (length, checksum)
    of pieces are kept, in a checkpoint after both steps, so texts are encoded once, never shuffled, and
    a lost executor costs the running step's tasks.
    """
    spark = docs.sparkSession
    ready(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"bin long, size int, pieces array<struct<{', '.join(x.replace(' ', ': ', 1) for x in PIECE.format(kind=kind).split(', '))}>>"

    def first(batches):
        bpe = loaded(path, RankBPE)
        end = int(end_id).to_bytes(4, "little")
        size, pieces, made = [], [], 0

        def flush():
            return _round(pd.DataFrame({"size": size, "pieces": pieces}), 0, made, length)

        for b in batches:
            for doc, text in zip(b["doc_id"].tolist(), b["text"]):
                ids = bpe.encode_bytes(text or "") + end
                doc = None if doc is None or doc != doc else doc
                for k, (s, n) in enumerate(cut(len(ids) // 4, length)):
                    size.append(n)
                    pieces.append([(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), 0)])
            if len(size) >= WINDOW:
                yield (out := flush())
                made, size[:], pieces[:] = made + len(out), [], []
        if size:
            yield flush()

    def again(batches):
        held = [b for b in batches if len(b)]
        if held:
            yield _round(pd.concat(held).sort_values(["size", "bin"], ascending=[False, True], ignore_index=True), 1, 0, length)

    out = docs.select("doc_id", "text").mapInPandas(first, schema).checkpoint()
    light, place = F.col("size") * 2 <= length, F.struct("size", "bin")
    if n := out.filter(light).count():
        # the n emptiest of the other bins that have room: those up to the n-th in order
        last = out.filter(~light & (F.col("size") < length)).select("size", "bin").orderBy("size", "bin").limit(n).agg(F.max(place).alias("p")).first().p
        meets = light if last is None else light | (place <= F.struct(F.lit(last["size"]).alias("size"), F.lit(last["bin"]).alias("bin")))
        out = out.filter(~meets).union(out.filter(meets).repartition(1).mapInPandas(again, schema).checkpoint())
    return out.select(F.explode("pieces").alias("p"), F.col("bin").alias("sequence_id")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
