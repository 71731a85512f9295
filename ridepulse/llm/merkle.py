"""Merkle dataset manifest (operator 11): cogrouped subtree exchange.

Every row is a leaf: the digest of its fields, each framed by its length in bytes.  Per group
(``lang``) the leaves ascend by id, and two consecutive nodes become the digest of both (a
last one alone: of itself) until one is left, the group's subroot.  The subroots, in the order of
their groups, make the root in the same way.

Places.  Leaves are written once, without their texts, and dealt by range of (group, id, leaf,
row), so a group's size does not matter.  A row's place is its place in the range partition plus the rows
of its group in earlier partitions; that takes one line per (partition, group).

Up.  A superblock is 2^bits consecutive nodes of a group.  Superblocks are reduced alone
(``applyInPandas``), their digests are the nodes of the next, 2^bits times smaller table, and
so on to the subroots and the root.  Down.  The outer nodes that a superblock's proofs require
are the path of its own digest in the table above.  Leaves and that path are cogrouped by superblock;
one call finishes the local reduction, joins the local siblings with the outer ones and folds
every leaf up to the root.  No task ever holds more than a superblock and one path.

Ids order as in Spark (nulls first), equal ids by their leaf, equal rows in any order (they
have the same leaf).  Null fields are ``-``, so a null text differs from an empty one; a null group is the
first one.  Tampering (to show what verification catches) adds 1 to ``n_chars`` where 7
divides crc32 of the decimal id; rows with a null id or a null ``n_chars`` stay.  Extra columns
are not looked at, and an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridepulse.llm.common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 10
_NODE = "no long, pos long, total long, digest string"
_PATH = "no long, pos long, subroot string, root string, path array<string>"
_RESULT = "subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
           tampered_col: str = "n_chars") -> DataFrame:
    """(__row, __id, __group, leaf, forged): ``forged`` is the tampered leaf, null where nothing is changed."""

    def leaf(change: bool) -> Column:
        one_more = (F.col(tampered_col).cast("decimal(20,0)") + 1).cast("string")
        return F.sha2(F.concat(*[framed(one_more if change and f == tampered_col else F.col(f)) for f in fields]), 256)

    hit = (F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0) & F.col(tampered_col).isNotNull()
    return docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), F.col(group_col).alias("__group"),
                       leaf(False).alias("leaf"), F.when(hit, leaf(True)).alias("forged"))


def placed(own: DataFrame) -> DataFrame:
    """``leaves`` with ``no`` (number of the group), ``pos`` (place in it) and ``total`` (leaves of the group)."""
    keys = ["__group", "__id", "leaf", "__row"]
    ranged = written(own.repartitionByRange(*keys).sortWithinPartitions(*keys)
                     .withColumn("at", F.monotonically_increasing_id()), "merkle-ranged").withColumn("part", F.shiftright("at", 33))
    runs = written(ranged.groupBy("part", "__group").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "merkle-runs")
    # one row per partition: does its first group go on from the partition before, and how many groups began earlier
    parts = runs.groupBy("part").agg(F.count(F.lit(1)).alias("groups"), F.min(F.struct("first", "__group")).alias("lo"),
                                     F.max(F.struct("first", "__group")).alias("hi"))
    line = Window.orderBy("part")
    goes_on = F.lag(F.lit(True)).over(line).isNotNull() & F.lag("hi").over(line)["__group"].eqNullSafe(F.col("lo.__group"))
    parts = parts.withColumn("goes_on", F.when(goes_on, 1).otherwise(0)) \
        .withColumn("before", F.coalesce(F.sum(F.col("groups") - F.col("goes_on")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .select("part", (F.col("before") - F.col("goes_on")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    runs = runs.join(parts, "part").withColumn("no", (F.col("before") + nth).cast("long")).drop("before")
    of_group = Window.partitionBy("no")
    runs = runs.withColumn("total", F.sum("n").over(of_group)).withColumn("skip", F.coalesce(
        F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first"))
    runs = written(runs.select("part", F.col("__group").alias("g"), "no", "total", "skip"), "merkle-runs")
    return ranged.join(runs.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("__group").eqNullSafe(F.col("g"))).select(
        "__id", "leaf", "forged", "no", (F.col("at") + F.col("skip")).alias("pos"), "total")


# --- inside a superblock --------------------------------------------------------------------

def _levels(total: int, bits: int) -> int:
    """Levels that a superblock is reduced by: all of the group's if it has no other superblock."""
    return min(bits, (total - 1).bit_length())


def _reduce(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, the given ones first."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def _siblings(levels: list[list[str]], i: int) -> list[str]:
    """The path of node i: each level's sibling with its side before it, or an empty string."""
    path = []
    for nodes in levels[:-1]:
        other = i ^ 1
        path.append(("<" if other < i else ">") + nodes[other] if other < len(nodes) else "")
        i >>= 1
    return path


def fold(node: str, path: Sequence[str]) -> str:
    for step in path:
        node = digest(step[1:], node) if step[:1] == "<" else digest(node, step[1:])
    return node


def _up(nodes: DataFrame, bits: int) -> DataFrame:
    """The digests of the superblocks of ``nodes``: the nodes of the table above."""

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        total = int(b["total"].iloc[0])
        top = _reduce(b.sort_values("pos")["digest"].tolist(), _levels(total, bits))[-1][0]
        return pd.DataFrame([(key[0], key[1], -(-total >> bits) if total > 1 << bits else 1, top)], columns=["no", "pos", "total", "digest"])

    return nodes.groupBy("no", F.shiftright("pos", bits).alias("block")).applyInPandas(run, _NODE)


def _down(nodes: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """The paths of ``nodes`` from the paths of their superblocks."""

    def run(key: tuple, b: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        b, o = b.sort_values("pos"), o.iloc[0]
        levels = _reduce(b["digest"].tolist(), _levels(int(b["total"].iloc[0]), bits))
        return pd.DataFrame({"no": key[0], "pos": b["pos"], "subroot": o["subroot"], "root": o["root"],
                             "path": [_siblings(levels, i) + list(o["path"]) for i in range(len(b))]})

    return nodes.groupBy("no", F.shiftright("pos", bits).alias("block")).cogroup(outer.groupBy("no", "pos")).applyInPandas(run, _PATH)


def _finish(own: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """Local reduction, proof joining and folding of the leaves of a superblock."""

    def run(key: tuple, b: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        b, o = b.sort_values("pos"), o.iloc[0]
        above, root = list(o["path"]), o["root"]
        levels = _reduce(b["leaf"].tolist(), _levels(int(b["total"].iloc[0]), bits))
        proofs, folded, seen = [], [], {}  # leaves that are not changed meet at the superblock's digest: one way up
        for i, (leaf, forged) in enumerate(zip(b["leaf"].tolist(), b["forged"].tolist())):
            path = _siblings(levels, i)
            proofs.append(digest(*[s[1:] for s in path], *[s[1:] for s in above]))
            top = fold(forged or leaf, path)
            if top not in seen:
                seen[top] = fold(top, above)
            folded.append(seen[top])
        return pd.DataFrame({"__id": b["__id"], "leaf": b["leaf"], "subroot": o["subroot"], "root": root, "proof_sha256": proofs,
                             "folded_root": folded, "verified": [f == root for f in folded]})

    kind = own.schema["__id"].dataType.simpleString()
    return own.groupBy("no", F.shiftright("pos", bits).alias("block")).cogroup(outer.groupBy("no", "pos")).applyInPandas(
        run, f"__id {kind}, leaf string, {_RESULT}")


def _tables(nodes: DataFrame, bits: int) -> Iterator[DataFrame]:
    """The tables of the trees over ``nodes``, lowest first; a tree that has come to one node does not go on."""
    while True:
        yield nodes
        nodes = nodes.where("total > 1")
        if nodes.isEmpty():
            return
        nodes = written(_up(nodes, bits), "merkle-nodes")


def _roots(tables: list[DataFrame]) -> DataFrame:
    out = tables[0].where("total = 1")
    for t in tables[1:]:
        out = out.unionByName(t.where("total = 1"))
    return out


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             tampered_col: str = "n_chars", bits: int = BITS) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256 (digest of the proof's siblings in order), folded_root and verified."""
    own = written(leaves(docs, fields, id_col, group_col, tampered_col), "merkle-leaves")
    own = written(placed(own), "merkle-placed")
    trees = list(_tables(own.select("no", "pos", "total", F.col("leaf").alias("digest")), bits))
    subroots = written(_roots(trees).select("no", "digest"), "merkle-subroots")
    groups = subroots.count()
    tops = list(_tables(subroots.select(F.lit(0).cast("long").alias("no"), F.col("no").alias("pos"),
                                        F.lit(groups).cast("long").alias("total"), "digest"), bits))
    path = _roots(tops[-1:]).select("no", "pos", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
                                    F.array().cast("array<string>").alias("path"))
    for table in tops[-2::-1] if len(tops) > 1 else []:
        path = written(_down(table, path, bits), "merkle-paths")
    start = written(path.select(F.col("pos").alias("no"), "root", "path").join(subroots, "no").select(
        "no", F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "root", "path"), "merkle-paths")

    def with_single(table: DataFrame, above: DataFrame | None) -> DataFrame:
        """The outer paths that ``table`` needs: those of the table above, and the subroots' own for its trees of one node."""
        single = start.join(table.where("total = 1").select("no"), "no", "left_semi")
        return single if above is None else single.unionByName(above)

    above = None
    for table in trees[:0:-1]:
        above = written(_down(table, with_single(table, above), bits), "merkle-paths")
    return _finish(own, with_single(trees[0], above), bits).withColumnRenamed("__id", id_col)
