"""Exact dedup (operator 4): deterministic block naming.  DataFrame functions only.

Texts are cut into blocks of ``BLOCK`` characters.  Equal blocks get the same integer
name: blocks are shuffled and sorted by content, and each run of equal blocks is named
by the number of its first occurrence.  Then the names of adjacent blocks are paired,
pairs are sorted and named in the same way, and so on until every text has one name.
Two texts have the same (number of blocks, name) exactly if they are equal: no hash
decides anything, so there is nothing to collide.

Hot blocks: a block may be a third of all rows.  A first pass counts block hashes and
takes the ``hot`` most frequent ones, so every other block has less than 1 / hot of the
rows.  Occurrences of the hot ones are spread over ``salts`` keys; each key's run is
named alone and a second, small pass unites the names of equal blocks.  The hash only
chooses where a block is sorted.  Pairs of names are always named in these two steps,
since they are small.  The text moves through one shuffle; everything after it is
integers, written to the shared checkpoint folder after every round.

A null text counts as empty, and empty texts equal each other.  Of equal texts the
row with the largest id stays (null ids are smallest; of equal ids one row stays), so
repeated rows collapse to one.  Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridepulse.llm.common import numbered, rows, written

BLOCK = 8192


def _first_of(value: str, *keys: str) -> Column:
    """The smallest ``value`` of the rows with equal keys: the head of their run in sorted order."""
    return F.first(value).over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))


def _unite(named: DataFrame, *keys: str) -> DataFrame:
    """``name`` for each row: the heads of runs that were named apart (by salt) get the smallest head's."""
    heads = named.where("occ = head AND one_of_many").select(*keys, F.col("head").alias("__head"))
    names = heads.select("__head", _first_of("__head", *keys).alias("__name"))
    return named.join(names, F.col("head") == F.col("__head"), "left") \
        .withColumn("name", F.coalesce("__name", "head")).drop("__head", "__name", "head", "one_of_many", *keys)


def named_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
                hot: int | None = None, salts: int | None = None, row_col: str | None = None) -> DataFrame:
    """(__row, __id, __sha, n, name): equal texts have equal (n, name), different ones do not."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, salts = hot or max(1024, 4 * parts), salts or max(16, parts)
    own = rows(docs, id_col, text_col, row_col)
    cut = F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))

    spread = own.select(F.explode(F.transform(cut, lambda b: F.xxhash64(b))).alias("hot")) \
        .groupBy("hot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "hot").limit(hot)
    blocks = own.select("__row", "__id", F.sha2("__text", 256).alias("__sha"), cut.alias("cut")).select(
        "__row", "__id", "__sha", F.size("cut").alias("n"), F.posexplode_outer("cut").alias("pos", "block"))
    blocks = blocks.withColumn("pos", F.coalesce("pos", F.lit(0))).withColumn("block", F.coalesce("block", F.lit(""))) \
        .withColumn("__sha", F.when(F.col("pos") == 0, F.col("__sha"))).withColumn("occ", F.monotonically_increasing_id())
    # at most ``hot`` hashes are broadcast
    blocks = blocks.join(F.broadcast(spread.select("hot")), F.xxhash64("block") == F.col("hot"), "left") \
        .withColumn("one_of_many", F.col("hot").isNotNull()) \
        .withColumn("salt", F.when(F.col("one_of_many"), F.pmod(F.xxhash64("__row"), F.lit(salts))).otherwise(0))
    level = blocks.withColumn("head", _first_of("occ", "block", "salt")).withColumn(
        "block", F.when(F.col("one_of_many") & (F.col("occ") == F.col("head")), F.col("block"))).drop("salt", "hot")
    first = written(level, "blocks")

    texts = first.where("pos = 0").select("__row", "__id", "__sha")
    longest = first.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    names = _unite(first.drop("__id", "__sha"), "block")
    done, width = [names.where("n <= 1").select("__row", "n", "name")], 1
    while width < longest:
        width *= 2
        left = F.col("pos") % 2 == 0
        pairs = names.where(f"n > {width // 2}").groupBy("__row", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(left, F.col("name"))).alias("a"), F.max(F.when(~left, F.col("name"))).alias("b"),
            F.max(F.when(left, F.col("occ"))).alias("occ"))
        pairs = pairs.withColumn("b", F.coalesce("b", F.lit(-1))).withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(salts))) \
            .withColumn("head", _first_of("occ", "a", "b", "salt")).withColumn("one_of_many", F.lit(True)).drop("salt")
        names = _unite(written(pairs, "pairs"), "a", "b")
        done.append(names.where(f"n > {width // 2} AND n <= {width}").select("__row", "n", "name"))
    return texts.join(reduce(DataFrame.unionByName, done), "__row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: __row, id, keep_id, group_size, kept and text_sha256."""
    named = written(named_texts(docs, id_col, text_col, **options), "names")
    groups = written(named.groupBy("n", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("__id", "__row")).alias("keep")), "groups")
    return named.join(groups, ["n", "name"]).select(
        "__row", F.col("__id").alias(id_col), F.col("keep.__id").alias("keep_id"), "group_size",
        (F.col("keep.__row") == F.col("__row")).alias("kept"), F.col("__sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay."""
    own, row = numbered(docs)
    kept = exact_dedup(own, id_col, text_col, row_col=row).where("kept").select(F.col("__row").alias(row))
    return own.join(kept, row, "left_semi").drop(row)
