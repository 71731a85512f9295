"""MinHash near-dedup (operator 8): order MinHash with banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence
number so that repeats stay apart (a text of fewer words is one shingle).  A sketch
entry takes the few smallest labelled shingles under one hash function and keeps them
in text order; two texts agree in an entry if they have the same shingles in the same
order.  Long texts have ``LONG`` = (64 entries of 8 shingles), short ones ``SHORT`` =
(16 entries of 2); texts in between have both, so every pair of similar length shares a
kind.  At a similarity of 0.8 a pair misses every entry with a probability below 1e-4.

Candidates are verified by banded alignment: the longest common subsequence of the
labelled shingles within a band around the diagonal.  The band is as wide as a pair
of the required similarity can drift, so it loses nothing.  Similarity is
common / (n1 + n2 - common), the Jaccard similarity of shingles that agree in order.

Groups without all pairs: texts with the same words are one class, and only its first
row (the representative) goes on.  In a bucket (texts with an equal sketch entry) the
members are compared with its ``CENTRES`` centres, those with the most neighbours over
all buckets; in buckets of up to ``FEW`` members with each other.  After the components
of these links are known, members that are not connected to a bucket's further centres
are compared with twice as many, and so on for as long as a round connects any.

What is still open then, the buckets whose members are not all compared and not all in
one component (a common header, say), is finished exactly.  The texts of open buckets are
dealt anew by their first shingles in one fixed order with the frequent ones last: similar texts of n
shingles have ``SIMILARITY`` * n in common, so they share one of the n - ceil(SIMILARITY * n) + 1 first
of each, and the place of the first shared one bounds their lengths.  Those smaller buckets go through the same
rounds until every two members are compared or connected, empty rounds or not.  So any two
similar texts that share a sketch entry end in one class.

Rows with null or empty texts (no words) form one class.  Repeated rows are copies.
Null ids are smallest.  An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridepulse.llm.common import Words, blocks, gram_hashes, mix, numbered, rows, written
from ridepulse.llm.graph import components, grown

K = 5
SIMILARITY = 0.8
#: (entries, shingles in each, fewest and most shingles of a text); the ranges overlap by 1 / SIMILARITY.
LONG = (64, 8, 24, None)
SHORT = (16, 2, 0, 30)
#: What is computed at once: hash values of a sketch, characters of texts, shingles kept of texts met before.
_ELEMENTS = 1 << 18
_BLOCK = 1 << 18
_HELD = 1 << 20
CENTRES, FEW = 3, 16
#: So many frequent shingles are put last: a fixed bound of what is sent to every task.
HEAVY = 1 << 16
#: Texts whose buckets are looked up together; more of them send fewer rows and hold more.
SHARD = 256
#: First shingles of texts that a task looks at together.
PART = 1 << 17
#: So many row numbers are broadcast at most; more of them are joined by a shuffle of both sides.
NUMBERS = 1 << 22


def labelled_shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of a text's word hashes, in text order."""
    size = min(k, len(words))
    if not size:
        return np.zeros(0, dtype=np.uint64)
    _, grams = gram_hashes(words, np.zeros(len(words), dtype=np.int8), size)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    place = np.arange(len(grams))
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    nth = np.empty(len(grams), dtype=np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return mix(grams + nth * np.uint64(0xD6E8FEB86659FD93) + np.uint64(size))


def _functions(entries: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, entries, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[:, None], rng.integers(0, 1 << 63, entries, dtype=np.uint64)[:, None]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The order MinHash entries of a text as 64-bit bucket numbers; entries of different functions never meet."""
    out = []
    n = len(shingles)
    for kind, (entries, take, least, most) in enumerate((LONG, SHORT)):
        if not n or n < least or most is not None and n > most:
            continue
        a, b = _functions(entries, kind)
        step = max(1, _ELEMENTS // n)
        for lo in range(0, entries, step):
            values = ((shingles[None, :] * a[lo:lo + step] + b[lo:lo + step]) >> np.uint64(32)).astype(np.uint32)
            if n > take:
                at = np.argpartition(values, take - 1, axis=1)[:, :take]
                at.sort(axis=1)
            else:
                at = np.broadcast_to(np.arange(n), (len(values), n))
            entry = np.arange(lo, lo + len(values), dtype=np.uint64) + np.uint64(kind << 20)
            for j in range(at.shape[1]):
                entry = mix(entry * np.uint64(0x9E3779B97F4A7C15) + shingles[at[:, j]])
            out.append(entry)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def aligned(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> int:
    """Common subsequence length of two labelled shingle sequences within the band, 0 if it can't be enough."""
    total = len(x) + len(y)
    least = similarity / (1 + similarity) * total - 1e-9
    if min(len(x), len(y)) < least:
        return 0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if len(i) < least:
        return 0
    inside = np.abs(i - j) <= total - 2 * least + 1e-6
    order = np.argsort(i[inside])
    j = j[inside][order]
    if len(j) < 2 or np.all(j[1:] > j[:-1]):
        return len(j)
    tails: list[int] = []  # labelled shingles are unique, so the longest increasing run of places is the alignment
    for p in j.tolist():
        at = bisect_left(tails, p)
        tails[at:at + 1] = [p]
    return len(tails)


def similar(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    common = aligned(x, y, similarity)
    return common >= similarity * (len(x) + len(y) - common) - 1e-9 and common > 0


def sketches(own: DataFrame, k: int = K) -> DataFrame:
    """(__row, __id, digest of the words, n shingles, entries) of every row of ``own`` (__row, __id, __text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["__text"].tolist()
            for lo, hi in blocks(texts, _BLOCK):
                w = Words(texts[lo:hi])
                digest, size, entries = [], [], []
                for d in range(hi - lo):
                    words = w.of(d)
                    shingles = labelled_shingles(words, k)
                    digest.append(blake2b(words.tobytes(), digest_size=16).digest())
                    size.append(len(shingles))
                    entries.append(sketch(shingles).view(np.int64))
                yield pd.DataFrame({"__row": b["__row"][lo:hi].to_numpy(), "__id": b["__id"].array[lo:hi], "digest": digest,
                                    "n": size, "entries": entries})

    return own.mapInPandas(run, f"__row long, __id {own.schema['__id'].dataType.simpleString()}, digest binary, n long, "
                                "entries array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of representatives whose texts are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}  # a centre meets many members: keep the last few texts' shingles
        size = 0

        def of(row: int, text: str) -> np.ndarray:
            nonlocal size
            if row not in held:
                shingles = labelled_shingles(Words([text]).hash, k)
                if len(held) >= 64 or size + len(shingles) > _HELD:
                    held.clear()
                    size = 0
                held[row] = shingles
                size += len(shingles)
            return held[row]

        for p in batches:
            keep = [similar(of(a, x), of(b, y), similarity) for a, b, x, y in zip(p["a"], p["b"], p["text_a"], p["text_b"])]
            yield p.loc[keep, ["a", "b"]]

    a = texts.select(F.col("__row").alias("a"), F.col("__text").alias("text_a"))
    b = texts.select(F.col("__row").alias("b"), F.col("__text").alias("text_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def _sent(numbers: DataFrame) -> DataFrame:
    """The row numbers of a written table, marked for broadcast up to a fixed bound: texts and entries, which are many
    times as large, are then picked where they lie, without a shuffle."""
    return F.broadcast(numbers) if numbers.limit(NUMBERS + 1).count() <= NUMBERS else numbers


def _shared(entries: DataFrame) -> DataFrame:
    """The rows of ``entries`` (__row, bucket, ...) in buckets of two and more, with the bucket's ``size`` and the row's ``pop``."""
    sizes = written(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
    shared = written(entries.join(sizes, "bucket"), "shared")
    popular = written(shared.groupBy("__row").agg(F.sum("size").alias("pop")), "popular")
    return written(shared.join(popular, "__row"), "shared")


def _heavy(texts: DataFrame, k: int, most: int) -> list[int]:
    """The ``most`` most frequent shingles or fewer, the most frequent one last.

    They only set an order, so shingles that occur once in a block of texts need not be counted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi in blocks(b["__text"].tolist(), _BLOCK):
                w = Words(b["__text"][lo:hi].tolist())
                found = [labelled_shingles(w.of(d), k) for d in range(hi - lo)]
                value, often = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *found]), return_counts=True)
                yield pd.DataFrame({"bucket": value[often > 1].view(np.int64), "often": often[often > 1]})

    top = texts.mapInPandas(run, "bucket long, often long").groupBy("bucket").agg(F.sum("often").alias("often")) \
        .orderBy(F.desc("often"), "bucket").limit(most)
    return [r.bucket for r in top.collect()][::-1]


def _prefixes(texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """(__row, n, bucket, upto): the first shingles of every text (__row, comp, n, __text) in one order for all texts, so
    many that two similar texts share one, as far as texts of another component share them too.  The ``HEAVY`` most
    frequent shingles come last, the others in the order of their hashes.

    ``at`` is the shingle's place in its text.  If it is the first that two texts share, they have at most n - at + 1 in
    common, which lets the other one have at most ``upto`` shingles.

    A text is one row with all its first shingles, dealt to shards of about ``PART`` of them.  A shard names each of its
    shingles once, with its shortest text there and the least and largest component, in one row per part of the
    shingles' hashes; the parts tell the shards which of them join components.
    """
    heavy = np.array(_heavy(texts, k, HEAVY), dtype=np.int64)
    place = np.argsort(heavy)
    known = heavy[place]

    def first(shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        rank = np.zeros(n, dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
            rank = np.where(known[at] == shingles, place[at] + 1, 0)
        return shingles[np.lexsort((shingles, rank))[:n - int(np.ceil(n * similarity - 1e-6)) + 1]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi in blocks(b["__text"].tolist(), _BLOCK):
                w = Words(b["__text"][lo:hi].tolist())
                own = [labelled_shingles(w.of(d), k).view(np.int64) for d in range(hi - lo)]
                yield pd.DataFrame({"shard": b["shard"][lo:hi].to_numpy(), "__row": b["__row"][lo:hi].to_numpy(),
                                    "comp": b["comp"][lo:hi].to_numpy(), "n": [len(s) for s in own], "bucket": [first(s) for s in own]})

    def spread(b: pd.DataFrame) -> pd.DataFrame:
        many = b["bucket"].map(len).to_numpy(dtype=np.int64)
        at = np.concatenate([np.arange(1, m + 1) for m in many])
        m = b[["__row", "comp", "n"]].loc[b.index.repeat(many)].reset_index(drop=True)
        n = m["n"].to_numpy()
        return m.assign(bucket=np.concatenate(b["bucket"].tolist()),
                        upto=np.minimum(n / similarity, (n - at + 1) * ((1 + similarity) / similarity) - n) + 1e-6)

    def named(b: pd.DataFrame) -> pd.DataFrame:
        each = spread(b).groupby("bucket").agg(least=("n", "min"), low=("comp", "min"), high=("comp", "max")).reset_index()
        part = (mix(each["bucket"].to_numpy().view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        shard = b["shard"].iloc[0]
        return pd.DataFrame([(p, shard, *(g[c].to_numpy() for c in ("bucket", "least", "low", "high"))) for p, g in each.groupby(part)],
                            columns=["part", "shard", "bucket", "least", "low", "high"])

    def joining(b: pd.DataFrame) -> pd.DataFrame:
        many = b["bucket"].map(len).to_numpy(dtype=np.int64)
        each = pd.DataFrame({"shard": np.repeat(b["shard"].to_numpy(), many)} | {c: np.concatenate(b[c].tolist()) for c in ("bucket", "least", "low", "high")})
        whole = each.groupby("bucket").agg(least=("least", "min"), low=("low", "min"), high=("high", "max"))
        whole = whole.loc[whole["low"] < whole["high"], "least"]  # others have no partner there, or one that they are connected to
        each = each[["shard", "bucket"]].merge(whole, left_on="bucket", right_index=True)
        return pd.DataFrame([(s, g["bucket"].to_numpy(), g["least"].to_numpy()) for s, g in each.groupby("shard")],
                            columns=["shard", "bucket", "least"])

    def kept(b: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(todo):
            return pd.DataFrame(columns=["__row", "n", "bucket", "upto"])
        least = pd.Series(np.concatenate(todo["least"].tolist()), index=np.concatenate(todo["bucket"].tolist()), name="least")
        m = spread(b).merge(least, left_on="bucket", right_index=True)
        return m.loc[m["upto"] >= m["least"], ["__row", "n", "bucket", "upto"]]

    entries = F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1
    parts = (texts.agg(F.sum(entries)).first()[0] or 0) // PART + 1
    each = written(texts.withColumn("shard", F.pmod(F.xxhash64("__row"), F.lit(parts))).mapInPandas(
        run, "shard long, __row long, comp long, n long, bucket array<long>"), "prefixes")
    seen = each.groupBy("shard").applyInPandas(
        named, "part long, shard long, bucket array<long>, least array<long>, low array<long>, high array<long>")
    todo = seen.groupBy("part").applyInPandas(joining, "shard long, bucket array<long>, least array<long>")
    return written(each.groupBy("shard").cogroup(todo.groupBy("shard")).applyInPandas(
        kept, "__row long, n long, bucket long, upto double"), "rare")


def _packed(members: DataFrame) -> DataFrame:
    """One row per text with arrays of its buckets (as many as its entries), dealt to shards of about ``SHARD`` texts."""
    inside = [c for c in ("bucket", "size", "upto") if c in members.columns]
    texts = written(members.groupBy("__row", "n", "pop").agg(F.collect_list(F.struct(*inside)).alias("in")), "packed")
    shards = texts.count() // SHARD + 1
    return texts.select(F.pmod(F.xxhash64("__row"), F.lit(shards)).alias("shard"), "__row", "n", "pop",
                        *[F.col(f"in.{c}").alias(c) for c in inside])


def _open(texts: DataFrame, comp: DataFrame, above: int) -> DataFrame:
    """The members of the buckets of more than ``above`` texts that are not all in one component, with their component.

    ``texts`` (from ``_packed``) of a shard name a bucket once, with the least and the largest component that they have
    there, however many of them are in it: a large group, which shares its buckets, costs its texts and not its members.
    """
    inside = [c for c in ("bucket", "size", "upto") if c in texts.columns]
    own = written(texts.join(comp, texts["__row"] == comp["node"], "left").drop("node")
                  .withColumn("comp", F.coalesce("comp", "__row")), "own")

    def spread(b: pd.DataFrame) -> pd.DataFrame:
        at = np.repeat(np.arange(len(b)), b["bucket"].map(len).to_numpy(dtype=np.int64))
        parts = {c: np.concatenate(b[c].tolist()) for c in inside}
        return pd.DataFrame({c: b[c].to_numpy()[at] for c in ("shard", "__row", "n", "pop", "comp")} | parts)

    def named(b: pd.DataFrame) -> pd.DataFrame:
        m = spread(b)
        return m[m["size"] > above].groupby(["shard", "bucket"])["comp"].agg(low="min", high="max").reset_index()

    def kept(b: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame(columns=names)
        m = spread(b)
        return m.loc[m["bucket"].isin(todo["bucket"]), names]

    names = ["__row", "n", "pop", "comp", *inside]
    types = {"upto": "double"}
    seen = written(own.groupBy("shard").applyInPandas(named, "shard long, bucket long, low long, high long"), "seen")
    mixed = seen.groupBy("bucket").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("bucket")
    todo = seen.select("shard", "bucket").join(mixed, "bucket").select("shard", "bucket")
    return written(own.groupBy("shard").cogroup(todo.groupBy("shard")).applyInPandas(
        kept, ", ".join(f"{c} {types.get(c, 'long')}" for c in names)), "placed")


def links(own: DataFrame, one: DataFrame, k: int = K, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between representatives, the rows of ``one`` (__row, n, entries), enough to connect every
    group; and the components (node, comp) that they make.  ``own`` is the written table of (__row, __text)."""
    shared = _shared(one.select("__row", "n", F.explode("entries").alias("bucket")))
    sharing = _sent(written(shared.select("__row").distinct(), "sharing"))
    texts = written(own.select("__row", "__text").join(sharing, "__row", "left_semi"), "texts")
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("pop"), F.desc("__row")))

    def around(members: DataFrame, above: int, upto: int, few: int) -> DataFrame:
        """Pairs of a bucket's centres (its members number ``above`` + 1 to ``upto``) with all less popular members;
        up to ``few`` members, all are centres."""
        if "upto" not in members.columns:
            members = members.withColumn("upto", (F.col("n") + 1e-9) / similarity)  # a longer one can't be similar
        centres = members.withColumn("nth", nth).where(F.col("nth") <= max(upto, few)) \
            .where((F.col("nth") > above) & ((F.col("nth") <= upto) | (F.col("size") <= few))) \
            .select("bucket", F.col("__row").alias("centre"), F.col("n").alias("n_c"), F.col("upto").alias("upto_c"),
                    F.col("pop").alias("pop_c"), F.col("comp").alias("comp_c"))
        less = (F.col("pop") < F.col("pop_c")) | (F.col("pop") == F.col("pop_c")) & (F.col("__row") < F.col("centre"))
        near = (F.col("n") <= F.col("upto_c")) & (F.col("n_c") <= F.col("upto"))
        met = members.join(written(centres, "centres"), "bucket").where(less & near & (F.col("comp") != F.col("comp_c")))
        return met.select(F.least("__row", "centre").alias("a"), F.greatest("__row", "centre").alias("b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        return written(_verify(written(pairs, "pairs"), texts, k, similarity), "links")

    found = verified(around(shared.withColumn("comp", F.col("__row")), 0, CENTRES, FEW))
    comp, upto = components(found), CENTRES
    large = _packed(shared.where(F.col("size") > max(upto, FEW)))
    while True:  # more centres for the members that are not connected yet, as long as that connects any
        placed = _open(large, comp, upto)
        more = verified(around(placed, upto, 2 * upto, 0))
        upto *= 2
        if more.isEmpty():
            break
        found, comp = written(found.unionByName(more), "links"), grown(comp, more)

    left = written(placed.where(F.col("size") > upto).select("__row", "comp", "n").distinct(), "left")
    if left.isEmpty():
        return found, comp
    shared = _shared(_prefixes(texts.join(left, "__row"), k, similarity))
    above, upto = 0, CENTRES
    while True:  # until every two members of a bucket are compared or connected
        placed = _open(_packed(shared), comp, max(above, FEW) if above else 1)
        if placed.isEmpty():
            return found, comp
        more = verified(around(placed, above, upto, 0 if above else FEW))
        if not more.isEmpty():
            found, comp = written(found.unionByName(more), "links"), grown(comp, more)
        shared, above, upto = placed.drop("comp"), upto, 2 * upto


def near_duplicates(docs: DataFrame, k: int = K, similarity: float = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row: __row, id, class_id (smallest id), class_size, kept (the row with that id), n_links and n_copies.

    ``n_links`` counts the verified links of the row's text, ``n_copies`` the rows with the same words.
    """
    own = rows(docs, id_col, text_col, row_col)
    own = own if row_col else written(own, "own-rows")  # the texts are read again by their numbers
    found = written(sketches(own, k), "sketches")
    copies = written(found.groupBy("digest").agg(F.min("__row").alias("rep"), F.count(F.lit(1)).alias("n_copies")), "copies")
    member = written(found.select("__row", "__id", "digest").join(copies, "digest").drop("digest"), "members")
    others = _sent(member.where("__row <> rep").select("__row"))
    one = found.join(others, "__row", "left_anti").select("__row", "n", "entries")
    verified, comp = links(own, one, k, similarity)
    degree = verified.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    of_rep = written(copies.select("rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left").select(
        "rep", F.coalesce("comp", "rep").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "of-rep")
    placed = written(member.join(of_rep, "rep").drop("rep"), "placed")
    classes = written(placed.groupBy("comp").agg(F.min(F.struct("__id", "__row")).alias("first"),
                                                 F.count(F.lit(1)).alias("class_size")), "classes")
    return placed.join(classes, "comp").select(
        "__row", F.col("__id").alias(id_col), F.col("first.__id").alias("class_id"), "class_size",
        (F.col("first.__row") == F.col("__row")).alias("kept"), "n_links", "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class."""
    own, row = numbered(docs)
    kept = near_duplicates(own, id_col=id_col, text_col=text_col, row_col=row, **options).where("kept").select(F.col("__row").alias(row))
    return own.join(kept, row, "left_semi").drop(row)
