"""Ordinal quality classifier: a cumulative-link regression on hashed text (operator 1).

Ratings are grades 0 to K - 1. One vector of weights over hashed features of the text gives a score,
and K - 1 ascending thresholds cut it: P(grade > k) = sigmoid(score - threshold k). From these follow
the expected grade and the tail probability P(grade >= ``tail``) by which documents are selected.

Features are shares: of each hashed word and each hashed shape of a word (capitals, small letters,
digits, other characters) among the words of the text, and which bin of length, of distinct words and
of repeated lines it is in. The fit reads at most ``SAMPLE`` labelled rows of each grade (those with the
smallest hashes of their doc_id) and runs on the driver; scoring reads every text whole, in Arrow
batches of the executors.

Nulls: a null or empty text has no words, so only its bins count; it gets a score like any other. Rows
with a null doc_id are scored but never fitted on. Repeated rows are scored each. Labels without a
document, null labels and empty tables are allowed: with no label, or only one grade of them, the
score is 0 and everything is kept. Extra columns pass through ``score``; those of the names it adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspan.llm import _labelled
from knowspan.llm import _text as tx
from knowspan.llm._scratch import documents, others

SAMPLE = 4_000
DIM = 1 << 15
GRADES = 2
#: Documents with at least this probability of a grade of ``tail`` or more are kept.
KEEP = 0.5
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = ord("a")
_HALF = DIM // 2 - 64


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, feature, value) of the texts in a buffer; sums of values over equal pairs count."""
    n = len(offsets) - 1
    starts, ends, doc = tx.word_spans(raw, offsets)
    words = tx.span_hashes(tx.LOWER[raw], starts, ends)
    shapes = tx.span_hashes(_SHAPE[raw], starts, ends)
    count = np.bincount(doc, minlength=n).astype(np.float64)
    share = 1.0 / np.maximum(count, 1)[doc]
    half = np.uint64(_HALF)
    _, first = np.unique(words ^ tx.mix(doc.astype(np.uint64)), return_index=True)
    distinct = np.bincount(doc[first], minlength=n) / np.maximum(count, 1)
    breaks = np.flatnonzero(raw == 0x0A)
    lines = np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=n) + 1
    bins = [np.minimum(np.log2(count + 1), 15).astype(int), 16 + np.minimum(distinct * 10, 9).astype(int), 26 + np.minimum(np.log2(count / lines + 1), 11).astype(int)]
    rows = np.concatenate([doc, doc, *[np.arange(n)] * len(bins)])
    cols = np.concatenate([(words % half).astype(np.int64), (shapes % half).astype(np.int64) + _HALF, *(2 * _HALF + b for b in bins)])
    values = np.concatenate([share, share, *[np.full(n, 0.3)] * len(bins)])
    return rows, cols, values


@dataclass(frozen=True)
class Ordinal:
    """Weights over features and ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for k from 0 to K - 2, a column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, k: int = GRADES, steps: int = 150, rate: float = 0.15, l2: float = 2e-5) -> Ordinal:
    """Maximum likelihood with a ridge, by full-batch Adam; each grade weighs the same in total.

    The thresholds are the first and the logarithms of the gaps, so they stay in order."""
    n = len(grades)
    present = np.bincount(grades, minlength=k)
    if not n or (present > 0).sum() < 2:
        return Ordinal(np.zeros(DIM), np.full(k - 1, -40.0))
    weight = (1.0 / np.maximum(present, 1))[grades]
    weight /= weight.sum()
    theta = np.concatenate([np.zeros(DIM), np.linspace(-0.5, 0.5, k - 1)[:1], np.full(k - 2, np.log(0.5))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, steps + 1):
        w, gaps = theta[:DIM], np.exp(theta[DIM + 1 :])
        cuts = np.concatenate([[-np.inf], theta[DIM] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(rows, w[cols] * values, n)
        hi, lo = cuts[grades + 1], cuts[grades]  # P(y) = sig(hi - s) - sig(lo - s)
        a, b = sig(np.where(np.isinf(hi), 40, hi - score)), np.where(np.isinf(lo), 0.0, sig(np.where(np.isinf(lo), 0, lo - score)))
        a = np.where(np.isinf(hi), 1.0, a)
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        g_score = weight * (da - db)  # of the loss, -log p
        g_cut = np.zeros(k + 1)
        np.add.at(g_cut, grades + 1, -weight * da)
        np.add.at(g_cut, grades, weight * db)
        inner = g_cut[1:k]
        tail_sums = np.cumsum(inner[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, g_score[rows] * values, DIM) + l2 * w, tail_sums[:1], tail_sums[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Ordinal(theta[:DIM], theta[DIM] + np.concatenate([[0], np.cumsum(np.exp(theta[DIM + 1 :]))]))


def _condensed(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, cols, values = features(raw, offsets)
    key, at = np.unique(rows.astype(np.int64) * DIM + cols, return_inverse=True)
    return key // DIM, key % DIM, np.bincount(at, values, len(key))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", grades: int = GRADES, most: int = SAMPLE) -> Ordinal:
    """Fit on a bounded sample: features are made on the executors, at most ``grades * most`` rows of them reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tx.buffers(batch.column(1))
            for i, j, part, offs in tx.slices(raw, offsets):
                rows, cols, values = _condensed(part, offs)
                at = np.searchsorted(rows, np.arange(j - i + 1))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (cols.astype(np.int32), values.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), *lists], ["doc_id", "label", "cols", "values"])

    picked = _labelled.sample(docs, labels, label, most, list(range(grades)))
    found = picked.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, label int, cols array<int>, values array<float>").toArrow().sort_by("doc_id")
    size = pa.compute.list_value_length(found["cols"]).to_numpy()
    flat = lambda name: pa.compute.list_flatten(found[name]).to_numpy()
    return fit(np.repeat(np.arange(len(size)), size), flat("cols"), flat("values").astype(np.float64), found["label"].to_numpy(), grades)


def score(docs: DataFrame, model: Ordinal, tail: int = 1) -> DataFrame:
    """The columns of ``docs`` and score, expected_grade, tail_probability = P(grade >= tail)."""
    added = ["score", "expected_grade", "tail_probability"]
    names = others(docs, added)
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tx.buffers(batch.column(at))
            out = [np.zeros(0)]
            for i, j, part, offs in tx.slices(raw, offsets):
                rows, cols, values = features(part, offs)
                out.append(np.bincount(rows, model.weights[cols] * values, j - i))
            scores = np.concatenate(out)
            tails = model.tails(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(scores), pa.array(tails.sum(1)), pa.array(tails[:, tail - 1])], [*names, *added])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double, expected_grade double, tail_probability double"
    return docs.select(*(F.col(f"`{c}`") for c in names), F.col("text").cast("string").alias("_knowspan_text")).mapInArrow(run, schema)


def select(docs: DataFrame, labels: DataFrame, keep: float = KEEP, tail: int = 1) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    names = docs.columns
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("text"))
    return score(row, train(docs, labels), tail).where(F.col("tail_probability") >= keep).select(*(F.col(f"_row.`{c}`").alias(c) for c in names))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, train(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP).alias("kept"))


QUERIES = {"op1_ordinal_quality": op1_ordinal_quality}
SQL: dict[str, str] = {}  # a trained model; tests hold it against held-out labels
