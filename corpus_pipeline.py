"""From raw documents to packed training sequences: the stages in order, each on all that the one before kept.

1. The quality classifier rejects documents. 2. Lines that several documents hold stay in one of them; a
document of which nothing is left goes. 3. Of documents linked by five-word shingles at 0.8 or more, one
stays. 4. Documents that hold a benchmark item go. 5. What is left is tokenised and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspan.llm import decontaminate, jaccard, line_dedup, packing, quality
from knowspan.llm._scratch import Scratch, documents

#: Tokenizers, trained classifiers and packing aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select(docs, documents(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(spark, docs).where("n_dropped = 0 or n_dropped < n_lines and trim(text) <> ''")
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.select(*(length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(spark, docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(spark, docs, documents(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("quality_classifier", good),
    ("line_dedup", fresh_lines),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", uncontaminated),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
    return docs
