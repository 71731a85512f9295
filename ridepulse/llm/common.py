"""Helpers the operators share: row numbers, written tables, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridepulse.session import checkpoint_dir, freed_shuffles

#: Words are maximal runs of these characters after lower-casing A-Z (ASCII letters, digits, all non-ASCII).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CHUNK_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(__row, __id, __text): one row per input row, a null text as ''.

    ``__row`` tells repeated rows and null ids apart.  It is ``row_col`` where the input has row numbers, else the
    row's place in its input partition.  Such a place holds within one job only: another scan of the same table may be
    split in another way (executors come and go).  So it is used once, and what needs the rows again writes them with
    their numbers first (``numbered``).
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return df.select(number.alias("__row"), F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder, read back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """All of ``df`` written once with a row number in a column of a free name, and that name."""
    name, taken = "__row", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


# --- words and their hashes, vectorised over a block of texts -------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_POWERS = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads close 64-bit values over the whole range."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 2 * len(_POWERS)), _MULT, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


class Words:
    """The words of a block of texts: ``hash[i]`` of word i, ``doc[i]`` its text, ``first[d]`` text d's first word."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.buf = _LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
        ends = np.cumsum(np.array([len(r) + 1 for r in raw], dtype=np.int64))
        is_word = _IS_WORD[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]  # the block ends in a blank, so every word ends
        n = self.end - self.start
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(at, n)
        if len(n):
            value = (self.buf[is_word].astype(np.uint64) + np.uint64(1)) * _powers(int(n.max()))[place]
            self.hash = mix(np.add.reduceat(value, at))
        else:
            self.hash = np.zeros(0, dtype=np.uint64)
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def count(self, d: int) -> int:
        return int(self.first[d + 1] - self.first[d])

    def of(self, d: int) -> np.ndarray:
        return self.hash[self.first[d]:self.first[d + 1]]

    def text(self, i: int, k: int) -> str:
        """Words i .. i+k-1 as text, joined by blanks."""
        return " ".join(self.buf[s:e].tobytes().decode("utf-8", "replace")
                        for s, e in zip(self.start[i:i + k], self.end[i:i + k]))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words that lies in one text."""
        return gram_hashes(self.hash, self.doc, k)


def gram_hashes(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = total * _MULT + hashes[j:j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return at, mix(total[at])


def blocks(texts: list[str], limit: int = _CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters, so that temporary arrays stay small."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
