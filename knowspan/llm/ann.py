"""Nearest neighbours by inner product over randomly rotated one-bit codes (operator 3).

The index keeps for each vector x, less the mean c of all vectors, the signs of its rotation packed into
bits, and correction scalars: the norm of x - c, the inner product of the unit vector with its code, and
that of x with the centre. For a query q the code estimates the inner product without bias,

    <q, x> = <q, c> + |x - c| <q', o> ,   <q', o> ~ <q', code> / <code, o> ,

with an error that is below ``EPSILON`` sqrt((1 - s^2) / s^2 / (D - 1)) |q'| (s = <code, o>) except for a
vanishing share. In each block of vectors, those whose upper bound reaches the k-th largest lower bound
are reranked by their exact inner product in double precision; the k best of each block are merged. A product
of matrices narrows what is reranked to those within its rounding error of the k-th.

Queries and vectors meet in blocks of bounded size, dealt by hash, so neither a large number of equal
vectors nor a large query set is one group. Codes are of the vectors over a power of two that bounds all components,
so no finite vector overflows. Rotation, centre and codes are the whole index: the centre is
an average over all vectors, nothing is sampled.

Vectors that are null, zero, hold null or non-finite components or haven't the length that most vectors
have take no part, nor do rows with a null vec_id. Of rows that repeat a vec_id one is kept (the smallest
vector). Ties go to the smaller vec_id. Fewer candidates than k: all are returned. Empty input: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.llm._scratch import Scratch, documents

K = 20
EPSILON = 3.0
#: Vectors and queries in a block; a task holds one of each.
BLOCK, QUERY_BLOCK = 8_192, 1_024
SEED = 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("embedding"), sound.alias("_sound")).where("_sound")
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def centre(rows: DataFrame, dim: int, power: int) -> np.ndarray:
    """The mean of all vectors over 2**power; each task hands on one row of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            x = np.ldexp(batch.column(0).flatten().to_numpy(), -power).reshape(-1, dim)
            total, n = total + x.sum(0), n + len(x)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(dim + 1), pa.int32()), "x": np.append(total, n)})

    sums = rows.select("embedding").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    values = {r.i: r.x for r in sums.collect()}  # dim + 1 rows
    return np.array([values.get(i, 0.0) for i in range(dim)]) / max(values.get(dim, 0.0), 1.0)


def encode(rows: DataFrame, c: np.ndarray, turn: np.ndarray, power: int) -> DataFrame:
    """Adds code (packed bits), far = |x - c| and fit = <code, o>."""
    dim = len(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ldexp(batch.column(1).flatten().to_numpy(), -power).reshape(-1, dim) - c
            far = np.sqrt((x * x).sum(1))
            unit = (x / np.where(far > 0, far, 1)[:, None]) @ turn.T
            bits = np.packbits(unit > 0, axis=1)
            fit = np.abs(unit).sum(1) / dim**0.5
            codes = pa.array([row.tobytes() for row in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, codes, pa.array(far), pa.array(fit)], ["vec_id", "embedding", "code", "far", "fit"])

    return rows.mapInArrow(run, "vec_id bigint, embedding array<double>, code binary, far double, fit double")


def nearest_in_block(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, far: np.ndarray, fit: np.ndarray, own: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int, power: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, vec_ids, exact scores) of each query's k nearest here. ``own``: the queries' ids, which aren't candidates."""
    dim, near = len(c), np.ldexp(queries, -power)
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(dim**0.5)
    turned = near @ turn.T
    length = np.sqrt((near * near).sum(1))
    estimate = turned.astype(np.float32) @ signs.T / np.maximum(fit, 1e-9)[None, :].astype(np.float32)
    estimate = (near @ c)[:, None] + far[None, :] * estimate
    spread = far * np.sqrt(np.maximum(1 - fit**2, 0)) / np.maximum(fit, 1e-9) / max(dim - 1, 1) ** 0.5 * EPSILON + 1e-6 * (far + 1)
    error = length[:, None] * spread[None, :]
    low = estimate - error
    other = ids[None, :] != own[:, None]
    low[~other] = -np.inf
    bound = np.partition(low, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(queries), -np.inf)
    keep = (estimate + error >= bound[:, None]) & other
    if power < 500 and len(ids) > k:  # products of larger vectors may overflow to equal scores
        held = np.ldexp(vectors, -power)
        product = np.where(keep, near @ held.T, -np.inf)
        slack = 1e-14 * dim * length * np.sqrt((held * held).sum(1)).max() + 1e-300  # more than both ways of summing differ
        keep &= product >= (np.partition(product, -k, axis=1)[:, -k] - slack)[:, None]
    out = []
    for q in range(len(queries)):
        at = np.flatnonzero(keep[q])
        with np.errstate(over="ignore", invalid="ignore"):
            scores = exact(queries[q], vectors[at])
        best = np.lexsort((ids[at], -scores))[:k]
        out.append((q, ids[at][best], scores[best]))
    return out


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of components whatever the block."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1] if len(vectors) else 0):
        total += vectors[:, j] * query[j]
    return total


def search(spark: SparkSession, vectors: DataFrame, is_query: "F.Column", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row that ``is_query`` picks, among all other rows."""
    scratch = Scratch(spark, "ann")
    rows = scratch.table("vectors", usable(vectors))
    lengths = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("top")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n, power = lengths[0].dim, lengths[0].n, math.frexp(lengths[0].top)[1]
    rows = rows.where(F.size("embedding") == dim)
    c, turn = centre(rows, dim, power), rotation(dim)
    index = scratch.table("index", encode(rows, c, turn, power))
    asked = index.where(is_query)
    blocks, parts = -(-n // BLOCK), max(1, -(-asked.count() // QUERY_BLOCK))
    deal = lambda seed, count: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    here = index.withColumn("block", deal(1, blocks)).withColumn("part", each(parts))
    there = asked.select("vec_id", "embedding", deal(2, parts).alias("part")).withColumn("block", each(blocks))

    def meet(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(queries) or not len(held):
            return empty
        q = np.stack(queries["embedding"].to_numpy())
        codes = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1)
        own, found = queries["vec_id"].to_numpy(), []
        args = held["vec_id"].to_numpy(), np.stack(held["embedding"].to_numpy()), codes, held["far"].to_numpy(), held["fit"].to_numpy()
        for a in range(0, len(q), 256):
            for i, ids, scores in nearest_in_block(q[a : a + 256], *args, own[a : a + 256], c, turn, k, power):
                found.append(pd.DataFrame({"query_id": own[a + i], "vec_id": ids, "score": scores}))
        return pd.concat(found) if found else empty

    met = there.groupBy("block", "part").cogroup(here.groupBy("block", "part")).applyInPandas(meet, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op3_rotated_codes": op3_rotated_codes}
SQL = {
    "op3_rotated_codes": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""
}
