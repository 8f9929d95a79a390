"""Toxicity by a convolutional text classifier trained in numpy inside tasks (operator 5).

A word (a run of letters and digits, A-Z lower-cased) is the sum of rows of an embedding table to which
the word and its beginnings of four and five bytes are hashed, so forms of a stem share what is learned
of it. Filters of widths 1, 2 and 3 slide over the words, each filter's largest value over the text goes through a
rectifier into a logistic output. Only that maximum has a gradient, so a step touches a few words of
each text.

Every labelled document takes part. Hashes of doc_id deal four fifths of them into blocks of at most
``BLOCK_ROWS`` texts, so a block is the same however Spark partitions the rows. In each of ``ROUNDS`` rounds
the tasks go on from the same model, by steps over each of their blocks, and the next model is the mean of
what the blocks made of it: of a row of the table, over the blocks that touched it. Only sums of the size of
a model reach the driver. The classes weigh equally in the fit. The last fifth calibrates: its scores are
counted by language, class and narrow bins of their logits, the bias is shifted so that a score of 0.5 makes the
fewest errors under the classes' true shares, and for each language a threshold is set: the one of the best F1
on that language's rows, drawn to that of all languages where a language has few rows; ``flagged`` uses it.
Where one of the two parts lacks a class, all rows fit and calibrate. Labels, language and source are no inputs of a score.

A filter's values at a word are sums over the word's rows, so for scoring all filters are multiplied
into the table once and texts are read whole by looking rows up.

Nulls: a null or empty text is one empty window and scores like any text without known words. A null
language uses the threshold of all languages. Rows with a null doc_id are scored, never fitted on.
Repeated rows are scored each. Without labels of both classes every score is the prior (0 without any).
Empty tables: no rows. Extra columns pass through ``score``; those of the names it adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspan.llm import _labelled
from knowspan.llm import _text as tx
from knowspan.llm._scratch import Scratch, documents, others

#: Texts and words of a block, the part of the rows that a model is fitted on before models are averaged; a longer text is a block of its own.
BLOCK_ROWS = 2_048
BLOCK_WORDS = 1 << 20
#: Averages of models; texts that all rounds go through at least, by more passes where few are labelled.
ROUNDS = 6
VISITS = 45_000
VOCABULARY = 1 << 15
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bytes of the beginnings of words that have rows of their own.
BEGINNINGS = (4, 5)
#: Bins of a logit, by which scores are counted where thresholds are set.
BINS = 64
#: Words scored at once.
_SLICE = 1 << 16
#: Rows of a language that its own threshold counts as much as that of all languages.
SHRINK = 50
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Even an empty text has a window of each width, and no window reaches into the next text.
_PAD = max(WIDTHS)


def word_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table, three for each word; first of each text): texts in turn, each followed by padding (row 0)."""
    inside = _WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < len(raw)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = tx.LOWER[raw]
    hashed = np.zeros((len(starts), 1 + len(BEGINNINGS)), np.int32)
    hashed[:, 0] = tx.span_hashes(low, starts, ends) % np.uint64(VOCABULARY - 1) + np.uint64(1)
    for k, size in enumerate(BEGINNINGS, 1):
        has = ends - starts > size
        cut = tx.span_hashes(low, starts[has], starts[has] + size, second=True) % np.uint64(VOCABULARY - 1)
        hashed[has, k] = cut + np.uint64(1)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    count = np.bincount(doc, minlength=len(offsets) - 1)
    begin = np.concatenate([[0], np.cumsum(count + _PAD)])
    out = np.zeros((begin[-1], hashed.shape[1]), np.int32)
    out[np.arange(len(hashed)) + _PAD * doc] = hashed
    return out, begin[:-1]


@dataclass
class TextCnn:
    """Embeddings, filters of each width (width * SIZE, FILTERS), output weights and bias."""

    table: np.ndarray
    filters: list[np.ndarray]
    out: np.ndarray
    bias: float
    _products: np.ndarray | None = None

    @classmethod
    def fresh(cls, seed: int = 7) -> "TextCnn":
        r = np.random.default_rng(seed)
        table = r.normal(0, 0.1, (VOCABULARY, SIZE)).astype(np.float32)
        table[0] = 0
        filters = [r.normal(0, (1 / (w * SIZE)) ** 0.5, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(table, filters, r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    def pooled(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The largest value of each filter over each text (texts, widths * FILTERS)."""
        if self._products is None:
            self._products = np.concatenate([self.table @ f[k * SIZE : (k + 1) * SIZE] for w, f in zip(WIDTHS, self.filters) for k in range(w)], 1)
        parts, column, best = self._products[ids[:, 0]], 0, []
        for k in range(1, ids.shape[1]):
            parts += self._products[ids[:, k]]
        for w in WIDTHS:
            n = len(ids) - w + 1
            z = parts[:n, column : column + FILTERS].copy()
            for k in range(1, w):
                z += parts[k : k + n, column + k * FILTERS : column + (k + 1) * FILTERS]
            column += w * FILTERS
            stops = np.append(begin[1:], len(ids)) - w + 1  # windows that would reach into the next text
            spans = np.empty(2 * len(begin), np.int64)
            spans[0::2], spans[1::2] = begin, stops
            spans = spans[: -1] if spans[-1] >= n else spans
            best.append(np.maximum.reduceat(z, spans)[0::2])
        return np.concatenate(best, 1)

    def logits(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(ids, begin), 0) @ self.out + self.bias if len(begin) else np.zeros(0)

    def scores(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(ids, begin))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


@dataclass
class Fit:
    """A model under way: second moments of the table's rows (as in Adagrad) and the state of Adam for filters, output and bias."""

    net: TextCnn
    moments: np.ndarray
    adam: np.ndarray
    steps: int = 0

    @classmethod
    def fresh(cls, seed: int = 7) -> "Fit":
        net = TextCnn.fresh(seed)
        return cls(net, np.zeros(VOCABULARY, np.float32), np.zeros((2, sum(f.size for f in net.filters) + net.out.size + 1), np.float32))

    def dense(self) -> np.ndarray:
        return np.concatenate([*(f.ravel() for f in self.net.filters), self.net.out, [self.net.bias]]).astype(np.float32)

    def set_dense(self, flat: np.ndarray) -> None:
        net, at = self.net, 0
        for x in (*net.filters, net.out):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        net.bias = float(flat[at])

    def values(self) -> np.ndarray:
        """All numbers as one matrix: a row of the table and its second moment, then everything else in rows as wide."""
        rest = np.concatenate([self.dense(), *self.adam])
        rest = np.concatenate([rest, np.zeros(-len(rest) % (SIZE + 1), np.float32)]).reshape(-1, SIZE + 1)
        return np.concatenate([np.column_stack([self.net.table, self.moments]), rest])

    @classmethod
    def of(cls, values: np.ndarray, steps: int) -> "Fit":
        fit = cls.fresh()
        fit.net.table, fit.moments, fit.steps = values[:VOCABULARY, :SIZE].astype(np.float32), values[:VOCABULARY, SIZE].astype(np.float32), steps
        n, rest = fit.adam.shape[1], values[VOCABULARY:].astype(np.float32).ravel()
        fit.set_dense(rest[:n])
        fit.adam = rest[n : 3 * n].reshape(2, n).copy()
        return fit

    def descend(self, ids: np.ndarray, begin: np.ndarray, labels: np.ndarray, weight: np.ndarray, passes: int, seed: int, batch: int = 64, rate: float = 0.01) -> np.ndarray:
        """Steps on the logistic loss over the texts, ``passes`` times; embeddings by their sparse gradients, each text through its maxima only. Returns which rows of the table moved."""
        net, r, moved = self.net, np.random.default_rng(seed), np.zeros(VOCABULARY, bool)
        net._products = None
        end = np.append(begin[1:], len(ids))
        dense = self.dense()
        for _ in range(passes):
            order = r.permutation(len(labels))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                self.steps += 1
                pooled = np.zeros((len(rows), len(net.out)), np.float32)
                where = np.zeros((len(rows), len(net.out)), np.int64)
                for i, d in enumerate(rows):
                    own = net.table[ids[begin[d] : end[d]]].sum(1)
                    for k, w in enumerate(WIDTHS):
                        n = len(own) - w + 1
                        z = np.concatenate([own[j : j + n] for j in range(w)], 1) @ net.filters[k]
                        best = z.argmax(0)
                        pooled[i, k * FILTERS : (k + 1) * FILTERS] = z[best, np.arange(FILTERS)]
                        where[i, k * FILTERS : (k + 1) * FILTERS] = begin[d] + best
                hidden = np.maximum(pooled, 0)
                g = ((_sigmoid(hidden @ net.out + net.bias) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                g_hidden = g[:, None] * net.out[None, :] * (pooled > 0)
                grads, rows_g, values_g = [], [], []
                for k, w in enumerate(WIDTHS):
                    part, pos = g_hidden[:, k * FILTERS : (k + 1) * FILTERS], where[:, k * FILTERS : (k + 1) * FILTERS]
                    g_filter = np.zeros_like(net.filters[k])
                    for j in range(w):
                        words = ids[pos + j]  # (texts, filters, rows of a word)
                        g_filter[j * SIZE : (j + 1) * SIZE] = np.einsum("df,dfs->sf", part, net.table[words].sum(2))
                        down = (part[:, :, None] * net.filters[k][j * SIZE : (j + 1) * SIZE].T[None]).reshape(-1, SIZE)
                        rows_g.append(words.ravel())
                        values_g.append(np.repeat(down, words.shape[2], axis=0))
                    grads.append((g_filter + 1e-4 * net.filters[k]).ravel())
                d = np.concatenate([*grads, hidden.T @ g + 1e-4 * net.out, [g.sum()]]).astype(np.float32)
                fix = (1 - 0.999**self.steps) ** 0.5 / (1 - 0.9**self.steps)
                self.adam[0] = 0.9 * self.adam[0] + 0.1 * d
                self.adam[1] = 0.999 * self.adam[1] + 0.001 * d * d
                dense -= (rate * fix * self.adam[0] / (np.sqrt(self.adam[1]) + 1e-8)).astype(np.float32)
                self.set_dense(dense)
                touched, back = np.unique(np.concatenate(rows_g), return_inverse=True)
                total = np.zeros((len(touched), SIZE), np.float32)
                np.add.at(total, back, np.concatenate(values_g))
                self.moments[touched] += (total**2).mean(1)
                net.table[touched] -= 0.1 * total / (np.sqrt(self.moments[touched])[:, None] + 1e-8)
                net.table[0] = 0
                moved[touched] = True
        return moved


def best_threshold(logits: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """The score halfway between two logits (ascending, with the rows of each class there), where F1 is best; 0.5 without both classes."""
    if not positive.sum() or not negative.sum():
        return 0.5
    z, hit = logits[::-1], np.cumsum(positive[::-1])
    k = int((2 * hit / (np.cumsum((positive + negative)[::-1]) + positive.sum())).argmax())
    return float(_sigmoid(np.array((z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 2)) / 2)))


def best_shift(logits: np.ndarray, positive: np.ndarray, negative: np.ndarray, prior: float) -> float:
    """The logit that splits the classes with the fewest errors when a share ``prior`` is positive; the middle of the widest such gap."""
    if not positive.sum() or not negative.sum():
        return -0.5 * float(np.log(prior / (1 - prior)))
    missed = prior * np.concatenate([[0], np.cumsum(positive)]) / positive.sum()  # below the split
    raised = (1 - prior) * (1 - np.concatenate([[0], np.cumsum(negative)]) / negative.sum())
    edges = np.concatenate([[logits[0] - 2], logits, [logits[-1] + 2]])
    gap = np.diff(edges)
    error = missed + raised
    best = np.flatnonzero(error <= error.min() + 1e-12)
    k = best[gap[best].argmax()]
    return float((edges[k] + edges[k + 1]) / 2)


@dataclass
class Model:
    net: TextCnn
    overall: float
    by_language: dict[str, float]


BLOCK = "shard int, block int, n int, positive int, begin array<int>, labels array<int>, langs array<string>, ids array<int>"


def blocks(docs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """The labelled documents in blocks; a shard below 0 is of the fifth that calibrates. ``rows``: how many are labelled."""
    shards = -(-rows // BLOCK_ROWS)
    key, order = F.col("doc_id"), F.xxhash64("doc_id", F.lit(17))
    shard = F.when(F.pmod(F.xxhash64(key, F.lit(23)), F.lit(5)) == 4, -1 - F.pmod(order, F.lit(-(-shards // 5)))).otherwise(F.pmod(order, F.lit(-(-4 * shards // 5)))).cast("int")
    texts = _labelled.texts(docs, known, rows).withColumn("shard", shard)
    texts = texts.repartition(shards, "shard").groupBy("shard", "doc_id", "label").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, words, number = [], None, 0, 0

        def told() -> pa.RecordBatch:
            begin = np.cumsum([0, *(len(x) for _, _, x in held)][:-1]).tolist()
            ids = np.concatenate([x for _, _, x in held]).ravel()
            labels = [y for y, _, _ in held]
            lists = [pa.array([begin], pa.list_(pa.int32())), pa.array([labels], pa.list_(pa.int32())), pa.array([[g for _, g, _ in held]], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))]
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (at, number, len(held), sum(labels))), *lists], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            raw, offsets = tx.buffers(batch.column(1))
            shard, label, lang = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for i, j, part, offs in tx.slices(raw, offsets):
                ids, begin = word_rows(part, offs)
                end = np.append(begin[1:], len(ids))
                for k in range(i, j):
                    own = ids[begin[k - i] : end[k - i]].copy()
                    if held and (shard[k] != at or len(held) == BLOCK_ROWS or words + len(own) > BLOCK_WORDS):
                        yield told()
                        held, words, number = [], 0, number + 1 if shard[k] == at else 0
                    at, words = shard[k], words + len(own)
                    held.append((label[k], lang[k], own))
        if held:
            yield told()

    return texts.sortWithinPartitions("shard", order, "doc_id").select("shard", "text", "label", "lang").mapInArrow(run, BLOCK)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list]]:
    """(shard, block, ids, begin, labels, languages) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            value = {c: batch.column(c)[k] for c in batch.schema.names}
            array = {c: value[c].values.to_numpy(zero_copy_only=False) for c in ("begin", "labels", "ids")}
            yield value["shard"].as_py(), value["block"].as_py(), array["ids"].reshape(-1, 1 + len(BEGINNINGS)), array["begin"], array["labels"], value["langs"].as_py()


def next_round(parts: DataFrame, fit: Fit, number: int, classes: tuple[int, int]) -> Fit:
    """The mean of what the blocks make of a model, by their rows. ``classes``: rows of classes 0 and 1 in all blocks."""
    before, steps, total = fit.values(), fit.steps, sum(classes)
    passes = min(20, -(-VISITS // (ROUNDS * total)))
    names = [f"v{k}" for k in range(SIZE + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows, most = np.zeros(before.shape), np.zeros(len(before)), 0
        for shard, block, ids, begin, labels, _ in _read(batches):
            own = Fit.of(before, steps)
            weight = np.where(labels == 1, 0.5 * total / classes[1], 0.5 * total / classes[0])
            moved = own.descend(ids, begin, labels, weight, passes, abs(hash((number, shard, block))))
            has = np.concatenate([moved, np.ones(len(before) - VOCABULARY, bool)])
            sums[has] += len(labels) * own.values()[has].astype(np.float64)
            rows[has] += len(labels)
            most = max(most, own.steps)
        has = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(np.full(len(has), most, np.int32)), pa.array(rows[has]), *(pa.array(sums[has, k]) for k in range(SIZE + 1))], ["row", "steps", "n", *names])

    made = parts.mapInArrow(run, "row int, steps int, n double, " + ", ".join(f"{c} double" for c in names))
    found = made.groupBy("row").agg(F.max("steps").alias("steps"), *((F.sum(c) / F.sum("n")).alias(c) for c in names)).toArrow()  # as many rows as a model has
    after = before.astype(np.float64)
    after[found["row"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in names])
    return Fit.of(after, int(found["steps"].to_numpy().max()))


def counted(parts: DataFrame, net: TextCnn) -> DataFrame:
    """lang, bin, label, n: the rows whose logit is in a bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, begin, labels, langs in _read(batches):
            end, i = np.append(begin[1:], len(ids)), 0
            while i < len(begin):
                j = max(i + 1, int(np.searchsorted(end, begin[i] + _SLICE, side="right")))
                z = net.logits(ids[begin[i] : end[j - 1]], begin[i:j] - begin[i])
                bins = np.floor(np.clip(z, -40, 40) * BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(langs[i:j], pa.string()), pa.array(bins), pa.array(labels[i:j].astype(np.int32))], ["lang", "bin", "label"])
                i = j

    return parts.mapInArrow(run, "lang string, bin int, label int").groupBy("lang", "bin", "label").agg(F.count("*").alias("n"))


def _histogram(bins: np.ndarray, labels: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, ascending; rows of class 1 and of class 0 there)."""
    at, back = np.unique(bins, return_inverse=True)
    return (at + 0.5) / BINS, *(np.bincount(back, n * (labels == y), len(at)) for y in (1, 0))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None) -> Model:
    """Fit on the labelled documents; a fifth of them calibrates thresholds and prior."""
    known = _labelled.known(labels, label, [0, 1], where)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    fit = Fit.fresh()
    constant = Model(fit.net, 0.5, {})
    if not counts.get(0) or not counts.get(1):
        fit.net.out[:], fit.net.bias = 0, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
        return constant
    scratch = Scratch(docs.sparkSession, "toxicity")
    parts = scratch.table("blocks", blocks(docs, known, sum(counts.values())))
    found = {r.held: (r.n - r.positive, r.positive) for r in parts.groupBy((F.col("shard") < 0).alias("held")).agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).collect()}
    fitted, held = parts.where("shard >= 0"), parts.where("shard < 0")
    classes = found.get(False, (0, 0))
    if min(*classes, *found.get(True, (0, 0))) == 0:  # too few rows to part them
        fitted = held = parts
        classes = tuple(int(sum(x)) for x in zip((0, 0), *found.values()))
    if min(classes) == 0:
        fit.net.out[:], fit.net.bias = 0, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
        scratch.drop()
        return constant
    for number in range(ROUNDS):
        fit = next_round(fitted, fit, number, classes)
    net = fit.net
    told = scratch.table("counted", counted(held, net))
    every = told.groupBy("bin", "label").agg(F.sum("n").alias("n")).toArrow()  # two rows a bin
    logits, positive, negative = _histogram(*(every[c].to_numpy() for c in ("bin", "label", "n")))
    shift = best_shift(logits, positive, negative, min(max(prior, 1e-6), 1 - 1e-6))
    net.bias -= shift
    overall = best_threshold(logits - shift, positive, negative)

    def of_language(rows: pa.Table) -> pa.Table:
        z, yes, no = _histogram(*(rows[c].to_numpy() for c in ("bin", "label", "n")))
        share = (yes.sum() + no.sum()) / (yes.sum() + no.sum() + SHRINK)
        return pa.table({"lang": rows["lang"][:1], "threshold": [share * best_threshold(z - shift, yes, no) + (1 - share) * overall]})

    own = told.where("lang <> ''").groupBy("lang").applyInArrow(of_language, "lang string, threshold double").orderBy("lang").collect()
    scratch.drop()
    return Model(net, overall, {r.lang: r.threshold for r in own})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` and score, predicted, threshold, flagged."""
    names, net = others(docs, ["score", "predicted", "threshold", "flagged"]), model.net
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tx.buffers(batch.column(at))
            out = [np.zeros(0)]
            for _, _, part, offs in tx.slices(raw, offsets):
                out.append(net.scores(*word_rows(part, offs)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(np.concatenate(out))], [*names, "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double"
    scored = docs.select(*(F.col(f"`{c}`") for c in names), F.col("text").cast("string").alias("_knowspan_text")).mapInArrow(run, schema)
    threshold = F.lit(model.overall)
    if "lang" in names and model.by_language:
        threshold = F.coalesce(F.get(F.array(*(F.lit(v) for v in model.by_language.values())), F.array_position(F.array(*(F.lit(k) for k in model.by_language)), F.col("lang")).cast("int") - 1), threshold)
    scored = scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("threshold", threshold)
    return scored.withColumn("flagged", F.col("score") >= F.col("threshold"))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    model = train(docs, documents(spark, sf_dir, "labels"), where=~held_out(F.col("doc_id")))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "threshold", "flagged")


QUERIES = {"op5_toxicity_cnn": op5_toxicity_cnn}
SQL: dict[str, str] = {}  # a trained model; tests hold it against held-out labels
