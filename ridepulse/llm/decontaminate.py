"""Benchmark decontamination (operator 3): size-partitioned MinHash containment search.

A test item is the set of its five-word shingles (a shorter item: its one run of all
words).  Items are partitioned by the size of that set, in powers of two; in the
partition of sizes up to u an item's signature is its m(u) = floor((1 - t) u) + 1
smallest shingles under a hash permutation.  A text that holds at least a share t of an
item misses at most (1 - t) u of its shingles, so it holds at least one of the
signature, however long the text is: the search loses nothing.  (A fixed number of
minima for text and item would: next to a long text a short item's share of the
minima vanishes.)  Each candidate is then verified by exact shingle containment, word
by word.

The texts are read once, in parallel and without a shuffle.  Items go to every task
in blocks of at most ``block_shingles`` shingles, one pass over the texts for each block,
so what a task holds does not grow with the benchmark.

Items without words match nothing; null texts count as empty.  Repeated rows and items
are searched one by one; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridepulse.llm.common import Words, blocks, mix, rows

K = 5
SHARE = 0.8


class Items:
    """A block of test items: their shingles by length and hash, signatures and sizes."""

    def __init__(self, ids: list, texts: list[str], k: int = K, share: float = SHARE):
        self.ids = ids
        self.sizes = np.zeros(len(ids), dtype=np.int64)
        #: by shingle length and hash: (item, the shingle's words, whether it is in the item's signature)
        self.owners: dict[int, dict[int, list[tuple[int, str, bool]]]] = {}
        w = Words(texts)
        lengths = np.minimum(np.diff(w.first), k)
        for size in np.unique(lengths[lengths > 0]).tolist():
            owners = self.owners[size] = {}
            at, gram = w.grams(size)
            of_item = w.doc[at]
            for item in np.flatnonzero(lengths == size).tolist():
                mine = slice(*np.searchsorted(of_item, [item, item + 1]))
                found = {w.text(int(i), size): g for i, g in zip(at[mine], gram[mine].tolist())}
                self.sizes[item] = len(found)
                upper = 1 << (len(found) - 1).bit_length()  # the partition's largest size
                m = int(np.floor((1 - share) * upper + 1e-9)) + 1
                least = np.sort(mix(np.array(list(found.values()), dtype=np.uint64)))[:m].tolist()
                for text, g in found.items():
                    signed = int(mix(np.array([g], dtype=np.uint64))[0]) <= least[-1]
                    owners.setdefault(g, []).append((item, text, signed))
        self.need = np.ceil(self.sizes * share - 1e-9).astype(np.int64)
        self.hashes = {size: np.array(sorted(o), dtype=np.uint64) for size, o in self.owners.items()}
        self.signatures = {size: np.array(sorted(g for g, of in o.items() if any(s for _, _, s in of)), dtype=np.uint64)
                           for size, o in self.owners.items()}

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) for every item of which a text holds enough."""
        for lo, hi in blocks(texts):
            w = Words(texts[lo:hi])
            for size, hashes in self.hashes.items():
                at, gram = w.grams(size)
                if not len(at):
                    continue
                hit = np.flatnonzero(_among(gram, hashes))
                if not len(hit):
                    continue
                docs = w.doc[at[hit]]
                owners = self.owners[size]
                signed = _among(gram[hit], self.signatures[size])
                candidates = {(d, item) for d, g in zip(docs[signed].tolist(), gram[hit][signed].tolist())
                              for item, _, own in owners[g] if own}
                if not candidates:
                    continue
                shared: dict[tuple[int, int], set[str]] = {c: set() for c in candidates}
                wanted = np.isin(docs, [d for d, _ in candidates])
                seen = set()
                for d, i, g in zip(docs[wanted].tolist(), at[hit][wanted].tolist(), gram[hit][wanted].tolist()):
                    if (d, g) in seen:
                        continue
                    words = w.text(i, size)
                    seen.add((d, g))
                    for item, text, _ in owners[g]:
                        if (d, item) in shared and text == words:
                            shared[d, item].add(text)
                for (d, item), found in shared.items():
                    if len(found) >= self.need[item]:
                        yield lo + d, item, len(found)


def _among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def item_blocks(items: DataFrame, id_col: str, text_col: str, k: int, share: float, block_shingles: int) -> list[Items]:
    """The benchmark in blocks of bounded size, in id order."""
    own = items.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).orderBy("i", "t")
    out, ids, texts, size = [], [], [], 0
    for r in own.toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"]) // 4 + 1  # at least its words
        if size >= block_shingles:
            out.append(Items(ids, texts, k, share))
            ids, texts, size = [], [], 0
    return out + ([Items(ids, texts, k, share)] if ids else [])


def contained(docs: DataFrame, items: DataFrame, k: int = K, share: float = SHARE, block_shingles: int = 1_000_000,
              id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(__row, id, item id, n_shingles, shared, containment) for every text that holds a share of an item."""
    own = rows(docs, id_col, text_col).select("__row", "__id", "__text")
    id_type, item_type = own.schema["__id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"__row long, __id {id_type}, __item {item_type}, n_shingles long, shared long"

    def searching(block: Items):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = list(block.search(b["__text"].tolist()))
                at = [d for d, _, _ in found]
                yield pd.DataFrame({
                    "__row": b["__row"].to_numpy()[at], "__id": b["__id"].array[at],
                    "__item": pd.Series([block.ids[i] for _, i, _ in found], dtype=object if found else None),
                    "n_shingles": [int(block.sizes[i]) for _, i, _ in found], "shared": [n for _, _, n in found]})
        return run

    passes = [own.mapInPandas(searching(b), schema) for b in item_blocks(items, item_id, item_text, k, share, block_shingles)]
    found = reduce(DataFrame.unionByName, passes) if passes else docs.sparkSession.createDataFrame([], schema)
    return found.select("__row", F.col("__id").alias(id_col), F.col("__item").alias(item_id), "n_shingles", "shared",
                        (F.col("shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", k: int = K, share: float = SHARE,
                      block_shingles: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns and without a shuffle."""
    for block in item_blocks(items, item_id, item_text, k, share, block_shingles):
        docs = docs.where(~_holds(block)(F.coalesce(F.col(text_col), F.lit(""))))
    return docs


def _holds(block: Items):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), dtype=bool)
        for d, _, _ in block.search(texts.tolist()):
            out[d] = True
        return pd.Series(out)
    return holds
