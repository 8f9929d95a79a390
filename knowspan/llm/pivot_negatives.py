"""Hard negatives by a pivot table (operator 13).

Every vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm of all, and an anchor q a
zero there. Then |q - x|^2 = |q|^2 + M^2 - 2 <q, x>: the inner product is a Euclidean distance, and
with the stored distances of x to some pivots the triangle inequality brackets it,

    |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p) .

The pivot table holds each vector with its distances to all pivots, ordered by label, nearest pivot and
distance, so that rows read together have like distances. Anchors come in parts of at most
about ``PART``, sent to all tasks; the table is scanned for each part and never shuffled. Of rows read
together and anchors, those are left out whose bracket, first of all these rows, then of the row itself,
lies below the anchor's worst hit so far or outside the wanted scores. The exact inner products of what
survives decide, so pivots change the time and no result.

The first scan finds each anchor's positives, the second the best negatives in the band of each positive.
A task hands on its best few for each anchor. Pivots are chosen, far from one another, among ``SAMPLE``
vectors at most. Brackets are in double precision with a margin for rounding.

Scores are integers: components are floor(scale * x). Where sums don't fit in 53 bits they are added in
64; vectors whose products reach 2^56 raise ValueError. A shorter vector counts as padded with
zeros. Rows with a null label, vector or vec_id or a null or non-finite component take no part; zero
vectors do. Of rows that repeat a vec_id the one with the smallest label, then vector, is kept. Ties go
to the smaller vec_id. An anchor without positives, or a positive without negatives in its band, has no
row. Empty input: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.llm._scratch import Scratch, documents

POSITIVES, NEGATIVES = 5, 10
#: Wanted negatives: LOW * positive <= 100 * negative <= HIGH * positive.
LOW, HIGH = 30, 90
PIVOTS, SAMPLE = 12, 4_096
#: Anchors in a part, about; each part is one scan of the table.
PART = 8_192
#: Rows of the table in a task, about, where the table is large.
TASK_ROWS = 1 << 18
_FOUND = "anchor_id bigint, vec_id bigint, score bigint"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(vectors: DataFrame, label: Column, scale: float) -> DataFrame:
    """vec_id, label, x (whole numbers) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), v.alias("x"), sound.alias("_sound"))
    rows = rows.where("_sound and label is not null").select("vec_id", F.struct("label", F.transform("x", lambda x: F.floor(x * scale)).alias("x")).alias("s"))
    return rows.groupBy("vec_id").agg(F.min("s").alias("s")).select("vec_id", "s.label", "s.x")


def square(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)


class Space:
    """What all tasks know: the length of vectors, M^2, the pivots, and how products are added."""

    def __init__(self, dim: int, top: float, whole: type, pivots: np.ndarray):
        self.dim, self.top, self.whole, self.pivots = dim, top, whole, pivots

    def matrix(self, lists: pa.ListArray) -> np.ndarray:
        """Vectors as rows, padded with zeros."""
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(sizes), self.dim), np.int64)
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out

    def placed(self, x: np.ndarray, anchor: bool = False) -> np.ndarray:
        """With the component that makes all vectors equally long; anchors have a zero there."""
        x = x.astype(np.float64)
        return np.column_stack([x, np.zeros(len(x)) if anchor else np.sqrt(np.maximum(self.top - square(x), 0))])

    def distances(self, placed: np.ndarray) -> np.ndarray:
        far = square(placed)[:, None] + square(self.pivots)[None, :] - 2 * placed @ self.pivots.T
        return np.sqrt(np.maximum(far, 0))


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """Rows far from one another: each next one is the farthest from those taken."""
    taken, far = [0], square(x - x[0])
    while len(taken) < count and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, square(x - x[taken[-1]]))
    return x[taken]


def space_of(rows: DataFrame) -> tuple[Space | None, int]:
    """The space of ``rows`` and their number."""
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    top = F.array_max(F.transform("x", lambda v: F.abs(v.cast("double"))))
    n, dim, most, largest = rows.agg(F.count("*"), F.max(F.size("x")), F.max(norm), F.max(top)).first()
    if not n:
        return None, 0
    if dim * (largest or 0) ** 2 >= 2.0**56:
        raise ValueError("a hundred inner products of these vectors don't fit in 64 bits")
    space = Space(dim, most or 0.0, np.float64 if dim * (largest or 0) ** 2 < 2.0**52 else np.int64, np.zeros((0, dim + 1)))
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SAMPLE).select("x").toArrow()  # SAMPLE vectors at most
    space.pivots = spread(space.placed(space.matrix(some.column("x"))), PIVOTS)
    return space, n


def pivot_table(rows: DataFrame, space: Space, n: int, scratch: Scratch) -> DataFrame:
    """vec_id, label, x and d, the distances to the pivots, rows of like distances side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.distances(space.placed(space.matrix(batch.column(2))))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["vec_id", "label", "x", "d", "cell", "near"])

    measured = rows.select("vec_id", "label", "x").mapInArrow(run, "vec_id bigint, label bigint, x array<bigint>, d array<double>, cell int, near double")
    order = ["label", "cell", "near", "vec_id"]  # vec_id divides what is equal
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    return scratch.table("pivots", measured.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("cell", "near"))


class Hits:
    """The best rows of each (anchor, band) that a task has seen: scores descending, ties by vec_id."""

    def __init__(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.anchors, self.low, self.high, self.k = anchors, low, high, k
        self.scores = np.full((len(anchors), k), np.iinfo(np.int64).min)
        self.ids = np.full((len(anchors), k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        """What a row has to reach, by band."""
        return np.maximum(self.low, self.scores[:, -1])

    def add(self, bands: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Rows (ids) with their scores by band; ``fits`` tells which count."""
        least = np.iinfo(np.int64).min
        every = np.concatenate([self.scores[bands], np.where(fits, scores, least)], axis=1)
        names = np.concatenate([self.ids[bands], np.where(fits, ids[None, :], np.iinfo(np.int64).max)], axis=1)
        best = np.lexsort((names, -np.maximum(every, least + 1)), axis=1)[:, : self.k]
        self.scores[bands], self.ids[bands] = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)


def scan(table: DataFrame, space: Space, queries: dict[str, np.ndarray], same: bool, k: int) -> DataFrame:
    """anchor_id, vec_id, score: each task's ``k`` best rows of each band.

    ``queries``: anchor_id, label, x by anchor; of, low, high by band (of: the anchor's place). ``same``: rows of the anchor's label, else of the others."""
    sent = table.sparkSession.sparkContext.broadcast(queries)  # a part of the anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        placed = space.placed(q["x"], anchor=True)
        dq, both, exact = space.distances(placed), square(placed) + space.top, q["x"].astype(space.whole)
        slack = 1e-9 * both + 1
        hits = Hits(q["anchor_id"][q["of"]], q["low"], q["high"], k)
        for batch in batches:
            ids, labels, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), space.matrix(batch.column(2)).astype(space.whole)
            d = batch.column(3).flatten().to_numpy().reshape(len(ids), -1)
            near, far = d.min(0), d.max(0)
            least = np.maximum(np.maximum(near - dq, dq - far), 0).max(1)  # no row here is nearer to the anchor
            most = (dq + far).min(1)  # nor farther
            above, below = (both - least**2) / 2 + slack, (both - most**2) / 2 - slack
            useful = (above[q["of"]] >= hits.floor()) & (below[q["of"]] <= hits.high)
            bands = np.flatnonzero(useful & (np.isin(q["label"][q["of"]], labels) if same else (labels != labels[0]).any() | (q["label"][q["of"]] != labels[0])))
            for a in range(0, len(bands), 512):
                own = bands[a : a + 512]
                who, where = np.unique(q["of"][own], return_inverse=True)
                least, most = np.zeros((len(who), len(ids))), np.full((len(who), len(ids)), np.inf)
                for p in range(d.shape[1]):
                    np.maximum(least, np.abs(dq[who, p][:, None] - d[None, :, p]), out=least)
                    np.minimum(most, dq[who, p][:, None] + d[None, :, p], out=most)
                above = (both[who, None] - least**2) / 2 + slack[who, None]
                below = (both[who, None] - most**2) / 2 - slack[who, None]
                fits = ((q["label"][who, None] == labels[None, :]) == same)[where]
                if same:
                    fits &= q["anchor_id"][who][where][:, None] != ids[None, :]
                fits &= (above[where] >= hits.floor()[own, None]) & (below[where] <= hits.high[own, None])
                left = fits.any(1)
                if not left.any():
                    continue
                cols = fits.any(0)
                scores = (exact[who] @ x[cols].T).astype(np.int64)[where[left]]
                fits = fits[left][:, cols] & (scores >= hits.floor()[own[left], None]) & (scores <= hits.high[own[left], None])
                hits.add(own[left], scores, ids[cols], fits)
        real = hits.ids != np.iinfo(np.int64).max
        rows = np.column_stack([np.repeat(hits.anchors, real.sum(1)), hits.ids[real], hits.scores[real]])
        rows = np.unique(rows, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["anchor_id", "vec_id", "score"])

    return table.select("vec_id", "label", "x", "d").mapInArrow(run, _FOUND)


def mine(spark: SparkSession, vectors: DataFrame, is_anchor: Column, label: Column, scale: float = 256.0, positives: int = POSITIVES, negatives: int = NEGATIVES, part: int = PART) -> DataFrame:
    """For each anchor and each of its best ``positives`` of the same label: the best ``negatives`` of other labels in the band of its score."""
    scratch = Scratch(spark, "pivots")
    rows = scratch.table("rows", usable(vectors, label, scale))
    space, n = space_of(rows)
    anchors = rows.where(is_anchor)
    if space is None or not (count := anchors.count()):
        return spark.createDataFrame([], RESULT)
    table = pivot_table(rows, space, n, scratch)
    parts = -(-count // part)
    dealt = scratch.table("anchors", anchors.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts)).cast("int")), ["part"])
    edge, every = np.iinfo(np.int64), None
    for i in range(parts):
        own = dealt.where(F.col("part") == i).select("vec_id", "label", "x").orderBy("vec_id").toArrow()  # about ``part`` anchors
        if not own.num_rows:
            continue
        q = {"anchor_id": own.column(0).to_numpy(), "label": own.column(1).to_numpy(), "x": space.matrix(own.column(2)), "of": np.arange(own.num_rows)}
        q |= {"low": np.full(own.num_rows, edge.min), "high": np.full(own.num_rows, edge.max)}
        order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
        best = scan(table, space, q, True, positives).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= positives)
        best = scratch.table(f"positives-{i}", best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        bands = best.select("anchor_id", "positive_score").distinct().orderBy("anchor_id", "positive_score").toArrow()  # ``positives`` an anchor
        score = bands.column(1).to_numpy()
        q["of"] = np.searchsorted(q["anchor_id"], bands.column(0).to_numpy())
        q["low"], q["high"] = -((-LOW * score) // 100), HIGH * score // 100
        found = scan(table, space, q, False, negatives).join(best, "anchor_id").where(f"{LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score")
        order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        found = scratch.table(f"negatives-{i}", found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        every = found if every is None else every.unionByName(found)
    return every


def op13_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark, documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {"op13_pivot_negatives": op13_pivot_negatives}
SQL = {
    "op13_pivot_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_inner_product(a.e, x.e)::BIGINT AS score
      FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
}
