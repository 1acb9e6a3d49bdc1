"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on every row that its
predecessor kept; all but the last return the columns of ``documents``.  SQL
cannot express the learned first stage, so ``ORACLE_SQL`` is None and the
stages are tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provena.llm import byte_bpe, decontaminate, exact_dedup, minhash_dedup, toxicity
from provena.llm.common import materialise, row_mark, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.non_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    found = exact_dedup.exact_dedup(docs.select("doc_id", "text"), carry={"mark": row_mark("_id", "_text")})
    return without(docs, found.where("not kept").select("doc_id", "mark"), "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similarity 0.8 on shingles of five words."""
    found = minhash_dedup.near_duplicates(docs.select("doc_id", "text"), k=5, numerator=80, denominator=100, bands=32, min_agree=74, marks=True)
    return without(docs, found.where("not kept").select("doc_id", "mark"), "doc_id", "text")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    import public_tokenizers

    vocab = byte_bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.encode(docs.select("doc_id", "text"), vocab, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
