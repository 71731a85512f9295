"""A corpus pipeline over ``documents``: STAGES in turn, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; all but the last return the columns of ``documents``.

1. toxicity: rows that the classifier calls toxic go; it is fitted on the stage's own
   documents and the ``labels`` table.
2. exact dedup: of equal texts the row with the largest id stays.
3. MinHash near-dedup: one row of each near-duplicate class stays.
4. decontamination: rows that hold a ``benchmark`` item go.
5. packing: what is left becomes sequences of 2048 tokens, one row per piece.

Null texts count as empty.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridepulse.llm import block_naming, decontaminate, near_dup, toxicity
from ridepulse.llm.common import written
from ridepulse.llm.packing import pack
from ridepulse.llm.queries import table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return block_naming.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", reject_toxic), ("exact dedup", exact_dedup), ("near dedup", near_dedup),
          ("decontamination", drop_contaminated), ("packing", pack_sequences)]

#: Training, sketches and tokenisation have no SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
