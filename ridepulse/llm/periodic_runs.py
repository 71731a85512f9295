"""Periodic run detection (operator 12): dictionary of basic factors.

A run is a maximal stretch of words with smallest period q whose length is at least
``REPEATS`` * q and ``SHORTEST``.  Factors of 2^k words get integer names, level by level:
a factor's name is the pair of its halves' names, sorted and numbered anew.  Each occurrence
of a factor looks at its successor, the next occurrence of the same name.  A successor at a
distance d in (2^(k-1), 2^k] lies within a window of twice the factor's length; consecutive
positions with the same d are an arithmetic progression that proposes the period d for all
their words.  In a run of period q the factor covers a whole period, so its successor is
exactly q on: every run is one such progression, of the level with 2^(k-1) < q <= 2^k, and a
progression long enough for 4 d words cannot have a smaller period.  Proposals are extended
while the next word fits (which a progression already does, so the check costs nothing) and
equal ones are merged.

Names that occur once in a text can't be part of a repeat and are left out of the next level,
so ordinary text is done after a few levels.  Names are exact: no hash decides anything.

Map-only; a block of texts is worked on at once in arrays, and a very long text is a block of
its own.  Words are maximal runs of characters other than ASCII blanks; null texts count as
empty and have no words.  Repeated rows and null ids are worked on row by row; extra columns
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridepulse.llm.common import blocks

REPEATS, SHORTEST = 4, 6


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail where crc32 of the decimal id ends in 0 (null ids: unchanged)."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[:n - a]


def runs(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of the word sequence ``names``, cut where ``doc`` (ascending) changes.

    Sorted by start and period.
    """
    total = len(names)
    found = [np.zeros((0, 3), dtype=np.int64)]
    if total < SHORTEST:
        return tuple(found[0].T)
    longest = int(np.bincount(doc - doc[0]).max())
    place = np.arange(total, dtype=np.int64)
    code = doc.astype(np.int64) * (int(names.max()) + 1) + names
    at = np.full(total, -1, dtype=np.int64)
    k = 0
    while True:
        width = 1 << k
        order = np.argsort(code, kind="stable")  # places ascend within a name
        fresh = np.diff(code[order], prepend=-1) != 0
        name = np.cumsum(fresh) - 1
        again = np.bincount(name)[name] > 1
        order, name = order[again], name[again]
        here = place[order]
        at[:] = -1
        at[here] = name
        if not len(here):
            break
        step = here[1:] - here[:-1]
        near = (name[1:] == name[:-1]) & (step <= width) & (2 * step > width)
        first, period = here[:-1][near], step[near]
        order = np.argsort(first)
        first, period = first[order], period[order]
        if len(first):  # consecutive places with one distance: an arithmetic progression
            head = np.concatenate(([True], (np.diff(first) != 1) | (np.diff(period) != 0)))
            start = np.flatnonzero(head)
            count = np.diff(np.append(start, len(first)))
            begin, p = first[start], period[start]
            length = count + p + width - 1
            enough = length >= np.maximum(SHORTEST, REPEATS * p)
            found.append(_extended(names, doc, begin[enough], length[enough], p[enough]))
        if REPEATS * (width + 1) > longest:  # the next level proposes periods above width only
            break
        place = np.sort(here)
        right = place + width
        inside = right < total
        place, right = place[inside], right[inside]
        inside = (at[right] >= 0) & (doc[right] == doc[place])
        place, right = place[inside], right[inside]
        code = at[place] * (total + 1) + at[right]
        k += 1
    out = np.unique(np.concatenate(found), axis=0)
    out = out[np.lexsort((out[:, 2], out[:, 0]))]
    return out[:, 0], out[:, 1], out[:, 2]


def _extended(names: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Proposals as rows (start, length, period), stretched to both sides while the words keep the period."""
    total = len(names)
    start, end = start.copy(), start + length
    open_ = np.arange(len(start))
    while len(open_):
        b, p = start[open_], period[open_]
        left = np.maximum(b - 1, 0)
        open_ = open_[(b > 0) & (names[left] == names[left + p]) & (doc[left] == doc[b])]
        start[open_] -= 1
    open_ = np.arange(len(start))
    while len(open_):
        e, p = end[open_], period[open_]
        right = np.minimum(e, total - 1)
        open_ = open_[(e < total) & (names[right] == names[right - p]) & (doc[right] == doc[e - 1])]
        end[open_] += 1
    return np.stack([start, end - start, period], axis=1)


def _greater(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """Order of runs: larger length / period first (exactly), then start, then period."""
    return b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]


def summary(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """The result columns of one text from its runs (start, length, period)."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    keep = words
    if found:
        drop = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, q in found:
            drop[s + q] += 1
            drop[s + n] -= 1
        gone = np.cumsum(drop)[:-1] > 0
        keep = [w for w, g in zip(words, gone.tolist()) if not g]
        s, n, q = min(found, key=cmp_to_key(_greater))
        best = (s, n, q, 1000 * n // q)
    else:
        best = (None, None, None, None)
    return (len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest())


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """Per row: id, n_runs, the run with the greatest exponent (start, length, period, exponent_milli), the digest of
    all runs and that of the text with every run cut to its first period.  ``planted`` applies ``plant`` first."""
    return _mapped(docs, id_col, text_col, planted, COLUMNS, lambda words, found: [summary(words, found)])


def all_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, period), one row per run."""
    return _mapped(docs, id_col, text_col, False, "start long, length long, period long", lambda words, found: found)


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every run cut to its first period, words joined by one blank."""

    def cut(words, found):
        gone = np.zeros(len(words), dtype=bool)
        for s, n, q in found:
            gone[s + q:s + n] = True
        return [(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode("utf-8", "replace"),)]

    return _mapped(docs, id_col, text_col, False, f"{text_col} string", cut)


def _mapped(docs: DataFrame, id_col: str, text_col: str, planted: bool, columns: str, rows_of) -> DataFrame:
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["__text"].tolist()
            for lo, hi in blocks(texts):
                ids = b["__id"].iloc[lo:hi].array
                words = [t.encode("utf-8", "surrogatepass").split() for t in texts[lo:hi]]
                if planted:
                    words = [plant(w, None if pd.isna(i) else int(i)) for w, i in zip(words, ids)]
                sizes = np.array([len(w) for w in words], dtype=np.int64)
                number: dict[bytes, int] = {}
                seq = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], dtype=np.int64)
                doc = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
                start, length, period = runs(seq, doc)
                first = np.cumsum(sizes) - sizes
                edge = np.searchsorted(start, np.append(first, len(seq)))
                rows, at = [], []
                for d in range(len(words)):
                    s = slice(edge[d], edge[d + 1])
                    mine = list(zip((start[s] - first[d]).tolist(), length[s].tolist(), period[s].tolist()))
                    new = rows_of(words[d], mine)
                    rows += new
                    at += [d] * len(new)
                out = pd.DataFrame(rows, columns=names, dtype=object)
                out.insert(0, "__id", ids[np.array(at, dtype=np.int64)] if at else ids[:0])
                yield out

    # batches are split into blocks of about a megabyte of text, so arrays stay small
    own = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = own.schema["__id"].dataType.simpleString()
    return own.mapInPandas(run, f"__id {kind}, {columns}").withColumnRenamed("__id", id_col)
