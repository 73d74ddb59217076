"""A corpus pipeline over `documents`: quality, line dedup, near-dedup, mixing, encoding.

Each stage takes what the one before it kept, all rows and whole texts, and all but
the last return the columns of `documents`. Near-duplicates are those of five-word
shingles with a similarity of 0.8 or more.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockline.llm import bpe, lines, minhash, quality
from dockline.llm.common import LOWEST, stored
from dockline.llm.queries import BYTE_RANKS, mixture


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the cascade."""
    return quality.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs; a text that loses all its lines goes."""
    found = lines.without_repeats(docs)
    n_chars = F.when(F.col("_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    left = found.filter((F.col("_n_removed") == 0) | (F.col("_n_removed") < F.col("_n_lines")))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest id, null ids last, ties by the text's hash."""
    return minhash.one_of_each(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    plan = mixture(docs).filter("copies > 0").select(
        F.struct(F.coalesce("doc_id", F.lit(LOWEST)), "_th").alias("_key"), F.sequence(F.lit(1), F.col("copies")).alias("_epochs")
    ).distinct()
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), F.xxhash64(F.coalesce("text", F.lit(""))))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"))
    return packed.join(plan, "_key").select("_row", F.explode("_epochs")).select("_row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes."""
    return bpe.encode_documents(docs, BYTE_RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # SQL cannot state byte-level BPE; tests/llm compares with a brute-force version

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
