"""Packing (operator 9): sum-of-squares online packing of token sequences.

Each partition packs its own documents as they come, so nothing is shuffled and a
retried task packs the same again.  A document is its token ids plus an end id.
Whole windows of a long document become sequences of their own; the rest of s ids
goes to the fill level h (0: a new sequence) that minimises the sum of squares of
``levels``, the counts of partly filled sequences per level.  Putting it at h changes
that sum by 2 (levels[h + s] - levels[h]) + 2, with no first term for a sequence it
fills and no second one for a new sequence.  At the end of a partition the
sequences still open are strung together, cut into whole windows, and the last part
into powers of two, which need no padding; so only there are short documents cut.

A null or empty text is just the end id.  Repeated rows, null ids and clashing extra
columns are packed row by row; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridepulse.llm.tokens import tokenizer

#: (document row, ids before the piece, the piece's ids as bytes)
Piece = tuple[int, int, bytes]


class SumOfSquares:
    """Places pieces of 1 to size - 1 ids; ``place`` gives back a sequence's pieces once it is full."""

    def __init__(self, size: int):
        self.size = size
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(size)]

    def place(self, piece: Piece) -> list[Piece] | None:
        s = len(piece[2]) // 4
        best, gain = 0, 2 * int(self.levels[s]) + 1
        there = np.flatnonzero(self.levels[1:self.size - s + 1]) + 1
        if len(there):
            change = 2 * (self.levels[there + s] - self.levels[there]) + 2
            if there[-1] + s == self.size:
                change[-1] = 1 - 2 * self.levels[there[-1]]
            i = len(there) - 1 - int(np.argmin(change[::-1]))  # of equal ones the fullest
            if change[i] <= gain:
                best = int(there[i])
        pieces = self.open[best].pop() if best else []
        if best:
            self.levels[best] -= 1
        pieces.append(piece)
        if best + s == self.size:
            return pieces
        self.levels[best + s] += 1
        self.open[best + s].append(pieces)
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """What is still open, strung together and cut into whole windows and then powers of two."""
        line = [p for level in reversed(self.open) for pieces in level for p in pieces]
        left, sequence, room = sum(len(p[2]) // 4 for p in line), [], 0
        for row, start, ids in line:
            while ids:
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                take = min(room, len(ids) // 4)
                sequence.append((row, start, ids[:4 * take]))
                ids, start, room, left = ids[4 * take:], start + take, room - take, left - take
                if not room:
                    yield sequence
                    sequence = []


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id",
         text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    ``sequence_id`` carries the partition's number in its upper bits.  The last
    windows are padded to ``size`` only in that their length is a power of two.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size has to be a power of two")
    names = ["__id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    end, whole = end_id.to_bytes(4, "little"), 4 * size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, packer, out = tokenizer(path), SumOfSquares(size), []
        number = TaskContext.get().partitionId() << 33
        waiting: dict[int, list] = {}  # rows with a piece in an open sequence: id, tokens, pieces out
        row = 0

        def emit(sequence: list[tuple[object, int, int, bytes]]) -> None:
            nonlocal number
            offset = 0
            for doc, tokens, start, ids in sequence:
                n = len(ids) // 4
                out.append((doc, start, n, zlib.crc32(ids), tokens, number, offset)
                           + ((np.frombuffer(ids, dtype="<u4").astype("int64"),) if with_ids else ()))
                offset += n
            number += 1

        def flush() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=names)
            out.clear()
            return made

        for b in batches:
            for doc, text in zip(b["__id"].array, b["__text"]):
                ids = words.encode(text) + end
                tokens, cut = len(ids) // 4, len(ids) // whole * whole
                doc = None if doc is pd.NA else doc
                for at in range(0, cut, whole):
                    emit([(doc, tokens, at // 4, ids[at:at + whole])])
                if cut < len(ids):
                    waiting[row] = (doc, tokens)
                    full = packer.place((row, cut // 4, ids[cut:]))
                    if full:
                        emit([(*waiting.pop(r), start, part) for r, start, part in full])
                    row += 1
            if out:
                yield flush()
        for sequence in packer.rest():
            emit([(*waiting[r], start, part) for r, start, part in sequence])
        if out:
            yield flush()

    own = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = own.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = own.mapInPandas(run, schema + ", ids array<long>" * with_ids)
    return packed.withColumnRenamed("__id", id_col)
