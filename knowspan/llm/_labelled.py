"""Labelled documents, for the classifiers: all of them (``texts``), or a bounded sample.

The sample takes the labelled doc_ids with the smallest hashes, so many of each class at most; the bound
is a parameter of each classifier. A doc_id with several labels counts for the largest, one with several
texts gives its smallest text. Texts are never cut; a sample ends where its texts, in the order of those
hashes, reach ``BYTES`` in total, so what a driver holds is bounded too. Everything but fitting reads all rows and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Labelled rows that are broadcast at most, at about 50 bytes; more are shuffled.
BROADCAST = 2_000_000


def known(labels: DataFrame, label: str, classes: list[int], where: Column | None = None) -> DataFrame:
    """doc_id, label: one row for a labelled doc_id."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where("doc_id is not null").where(F.col("label").isin(*classes))
    if where is not None:
        rows = rows.where(where)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def texts(docs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, lang, label of the labelled documents, whole; ``rows``: how many are known. A null text is empty."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"))
    return own.join(F.broadcast(known) if rows <= BROADCAST else known, "doc_id")


#: Bytes of all texts of a sample.
BYTES = 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, classes: list[int], where: Column | None = None) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled documents of each class; one row for a repeated doc_id."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null and label is not null")
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id", F.lit(17))
    picked = None
    for value in classes:  # each a top-k: a task hands on ``most`` rows at most
        own = known.where(F.col("label") == value).orderBy(order, "doc_id").limit(most)
        picked = own if picked is None else picked.unionByName(own)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
    found = texts.join(F.broadcast(picked), "doc_id")  # len(classes) * most rows of 12 bytes
    found = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    run = Window.partitionBy("label").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # ``most`` rows of a class
    before = F.coalesce(F.sum(F.octet_length("text")).over(run), F.lit(0))
    return found.withColumn("_before", before).where(F.col("_before") < BYTES // len(classes)).drop("_before")
