import hashlib
import random
from collections import defaultdict

import pytest

from ridepulse.llm.block_naming import exact_dedup, keep_one
from tests_llm import clash


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    return sorted(((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs), key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "text_sha256").collect()), key=str)


def test_odd_rows(odd, none):
    df, pairs = odd
    got = exact_dedup(df)
    assert rows(got) == brute(pairs)
    assert got.where("kept").count() == len({t or "" for _, t in pairs})
    assert exact_dedup(none).count() == 0 and keep_one(none).count() == 0


@pytest.mark.parametrize("block,hot,salts", [(1, 2, 3), (3, 1, 2), (8, 1024, 16), (50, 4, 1)])
def test_any_block_size(spark, block, hot, salts):
    """Texts over two letters share most blocks and pairs; a third of the rows are one text."""
    rng = random.Random(block)
    pairs = [(i, "".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 5, 9, 33, 64])))) for i in range(120)]
    pairs += [(1000 + i, "ab" * 30) for i in range(60)]
    got = exact_dedup(clash(spark, pairs).repartition(5), block=block, hot=hot, salts=salts)
    assert rows(got) == brute(pairs)


def test_one_row_of_each_stays_with_its_columns(spark):
    df = clash(spark, [(1, "x"), (2, "x"), (2, "x"), (3, None), (4, "")])
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "x"), (4, "")]


def test_rows_are_told_apart_whatever_the_splits(spark, tmp_path):
    """Scans that are split differently, and an input that has a column of the row number's name."""
    pairs = [(i, f"text {i % 40}") for i in range(120)]
    spark.createDataFrame([(i, t, f"r{i}") for i, t in pairs], "doc_id long, text string, __row string") \
        .repartition(6).write.parquet(f"{tmp_path}/t")
    try:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        kept = keep_one(spark.read.parquet(f"{tmp_path}/t"))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "64")
        assert kept.columns == ["doc_id", "text", "__row"]
        assert sorted((r.doc_id, r["__row"]) for r in kept.collect()) == [(i, f"r{i}") for i in range(80, 120)]
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
