"""Benchmark decontamination: short test items inside long documents (operator 8), DataFrame functions only.

Words are the runs of other than white space (\\x20, \\x09-\\x0D) of the lower-cased text; a set holds
the distinct runs of five words, or the whole sequence as one where there are fewer. An item leaks
into a document that holds at least ``threshold`` of the item's set.

The Jaccard similarity of an item and a document a thousand times as long is near zero, so sketches aren't
compared by it. Items are partitioned by the size of their sets, powers of ``BASE`` apart. An item's sketch
holds its k smallest hashes. A document of containment t misses at most m = q - ceil(t q) of the q shingles and
so at most m of the k minima; k is 2 m + 4 (or q), and a document holding k - m minima is a candidate. Each
partition has a threshold, the largest hash in its items' sketches, and a document has a sketch for each
partition that it is large enough for: its hashes up to that threshold (a bottom sketch). Only sketches
meet, partition by partition, and nothing is lost, however long the document. Candidates are verified on
whole sets. There is a row of thresholds for each partition, 64 at most, whatever the size of the benchmark.

Nulls: a null or empty text has an empty set, which nothing contains and which leaks nowhere. Rows with
a null doc_id or item_id take no part. Rows that repeat an id are one document or item with the union of
their sets. Empty tables: no rows. Extra columns are ignored (kept by ``clean``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.llm._scratch import Scratch, documents

WORDS = 5
THRESHOLD = 0.8
#: Sizes of items in one partition differ by less than this factor.
BASE = 2
#: A side of at most so many rows (16 to 40 bytes each) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def sized(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def shingles(rows: DataFrame, key: str, size: int = WORDS) -> DataFrame:
    """key, words (in the text), shingle: a row for each place, not yet distinct."""
    text = F.btrim(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    words = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), text.alias("_t")).where("_t <> ''")
    hashed = words.select(key, F.transform(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)).alias("_h"))
    places = hashed.select(key, "_h", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_h") - size, F.lit(0)))).alias("_i"))
    window = F.xxhash64(*(F.get("_h", F.col("_i") + k) for k in range(size)))
    return places.select(key, F.size("_h").alias("words"), F.when(F.size("_h") >= size, window).otherwise(F.xxhash64("_h")).alias("shingle"))


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """doc_id, item_id, shared, n_shingles, containment of each document and item it contains."""
    scratch = Scratch(spark, "leaks")
    items = scratch.table("items", shingles(benchmark, "item_id", size).select("item_id", "shingle").distinct())
    per = F.count("*").over(Window.partitionBy("item_id"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("shingle"))
    misses = F.col("q") - F.ceil(F.col("q") * threshold - 1e-9)
    ranked = items.withColumn("q", per).withColumn("misses", misses).withColumn("rank", rank)
    ranked = ranked.withColumn("k", F.least("q", 2 * F.col("misses") + 4))
    part = F.floor(F.log2(F.col("q").cast("double")) / F.log2(F.lit(float(BASE)))).cast("int").alias("part")
    held = F.ceil(F.col("q") * threshold - 1e-9).cast("bigint").alias("held")
    ranked = ranked.where("rank <= k").select("item_id", "shingle", part, held, (F.col("k") - F.col("misses")).alias("need"))
    sketch = scratch.table("sketch", ranked)
    parts = sketch.groupBy("part").agg(F.max("shingle").alias("tau"), F.min("held").alias("least")).collect()
    own = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in ("part", "tau", "least"))) for r in parts)) if parts else None
    known = sketch.select("shingle").distinct()
    found = shingles(docs, "doc_id", size).join(sized(known, known.count()), "shingle", "left_semi")  # others can't meet
    found = found.withColumn("_held", F.greatest(F.col("words") - size + 1, F.lit(1)))
    if own is None:
        found = found.where("false").withColumn("part", F.lit(0))
    else:
        fits = F.filter(own, lambda p: (F.col("shingle") <= p["tau"]) & (F.col("_held") >= p["least"]))
        found = found.select("doc_id", "shingle", "_held", F.explode(F.transform(fits, lambda p: p["part"])).alias("part"))
    hits = found.join(sized(sketch, sketch.count()), ["part", "shingle"]).where("_held >= held")
    hits = hits.groupBy("doc_id", "item_id", "shingle").agg(F.first("need").alias("need"))
    candidates = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need")
    candidates = scratch.table("candidates", candidates.select("doc_id", "item_id"))
    n = candidates.count()
    some = docs.join(sized(candidates.select("doc_id").distinct(), n), "doc_id", "left_semi")
    whole = items.join(sized(candidates.select("item_id").distinct(), n), "item_id", "left_semi")
    met = shingles(some, "doc_id", size).select("doc_id", "shingle").join(sized(whole, items.count()), "shingle")
    met = met.join(sized(candidates, n), ["doc_id", "item_id"], "left_semi").distinct()
    shared = met.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    joined = shared.join(sizes, "item_id").withColumn("containment", F.col("shared") / F.col("n_shingles"))
    joined = joined.where(F.col("shared") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))
    return joined.select("doc_id", "item_id", "shared", "n_shingles", "containment")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """The documents into which no item leaks; rows with a null doc_id stay."""
    dirty = Scratch(spark, "dirty").table("ids", leaks(spark, docs, benchmark, threshold, size).select("doc_id").distinct())
    return docs.join(sized(dirty, dirty.count()), "doc_id", "left_anti").select(*docs.columns)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_SETS = r"""
  SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL) t,
       LATERAL unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i)
  WHERE len(w) > 0"""
QUERIES = {"op8_benchmark_decontamination": op8_benchmark_decontamination}
SQL = {
    "op8_benchmark_decontamination": f"""
WITH d AS ({_SETS.format(key="doc_id", table="documents")}), b AS ({_SETS.format(key="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, b.item_id, count(*) AS shared, n_shingles, count(*) / n_shingles AS containment
FROM d JOIN b ON d.s = b.s JOIN n ON n.item_id = b.item_id
GROUP BY doc_id, b.item_id, n_shingles HAVING count(*) * 10 >= n_shingles * 8
"""
}
