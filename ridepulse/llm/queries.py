"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL where there is one.

Each applies its operator with production parameters to the whole table and
returns the full result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridepulse.llm import block_naming, decontaminate, merkle, near_dup, private_data, toxicity
from ridepulse.llm.license_scan import license_scan
from ridepulse.llm.packing import pack
from ridepulse.llm.periodic_runs import periodic_runs
from ridepulse.llm.secret_scan import secret_scan, span_text
from ridepulse.llm.sharding import place
from ridepulse.llm.token_counts import token_counts
from ridepulse.llm.url_filter import text_words, url_filter

SHARDS = [f"shard-{i:03d}" for i in range(128)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts in every document."""
    return license_scan(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with at least 0.8 of the item's shingles in the document."""
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("__row")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents and the one that stays."""
    return block_naming.exact_dedup(table(spark, sf_dir, "documents")).drop("__row")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the training folds' positives and unlabelled text."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("__row")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; weak candidates only beside their complements."""
    found = secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("__row")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url; words are learnt from the pages' own text."""
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, text_words(pages))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what tampering does to the root."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic word runs of every document."""
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the words beside it that give it away."""
    found = private_data.private_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < private_data.GENERALISE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    text = private_data.span_text
    return found.select("doc_id", count(0).alias("n_email"), count(1).alias("n_ip"), count(2).alias("n_card"), count(3).alias("n_phone"),
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_token_counts, op3_decontaminate, op4_exact_dedup, op5_toxicity, op6_sharding, op7_secret_scan,
    op8_near_duplicates, op9_packing, op10_url_filter, op11_merkle_manifest, op12_periodic_runs, op13_private_data)}

SQL: dict[str, str] = {
    "op4_exact_dedup": """
SELECT doc_id, MAX(doc_id) OVER same AS keep_id, COUNT(*) OVER same AS group_size,
  doc_id = MAX(doc_id) OVER same AS kept, sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY COALESCE(text, ''))""",
}
