"""Exact n-gram Jaccard join in the metric space of shingle sets (operator 4).

The distance 1 - J is a metric, and two documents link when it is at most r = 1 - threshold. Between
unrelated texts it is 1 whatever the pivot, so documents as the first pivots would put every document into
every region. The first level's pivots are therefore sets of one shingle, in one order for all documents,
the rarest in the whole corpus first. A document's home is its first shingle; its window reaches over the
first n - ceil(t n) + 1. Documents that link share all but so many that the first shingle they share lies
in both windows. A shingle that two or more documents have in their windows is a region. At its place a
region says how much two documents can still share if none before was shared; what can't link by that or
by size isn't compared. Regions of the same documents are one: the first of them in the order.

The order comes from ``COUNTERS`` counters, to which every shingle of every document is hashed. Their number
is fixed, so they are no statistic that grows with the corpus; where unlike shingles share a counter the
order is less good, and the result is the same, as any order that all documents share is exact.

Inside a region distances are informative. Its pivot is the document that has the region's shingle first
(the one with the fewest shingles of its own: the most central of a family of copies). Documents within r
of it are linked through it, and nothing else is asked of a region that is one component then. In the
others, up to ``LEAF`` documents, those of different components meet, but not where their distances to the
pivot differ by more than r. Larger regions are divided again by ``PIVOTS`` of their documents, of different
components: a document's home is the region of its nearest pivot (Voronoi), and it is replicated to each
pivot at most 2 r farther than that, by the triangle inequality the only ones in whose regions a document
it links with can be at home. Documents meet in a region if one of them is at home there. A region is
divided until it is one component or a leaf, or until dividing no longer makes its work smaller: then its
documents are compared in blocks, rings by the distance to its pivot meeting only at most r away; large components have blocks of their own.

Pairs that are left are settled by their windows where these have too many shingles of only one of them,
and else by their whole sets. The links between different components are all found, so the components are
exact. A set is sent once for each block of pairs that has it as first.

Equal sets are one class from the start, represented by its smallest doc_id. Shingles are hashes of 56
bits (a 64-bit hash cut); equality of sets is by 128 bits and size.

Nulls: a null text, or one without words, has an empty set, links with nothing and is its own component.
A text with fewer words than a shingle has its whole sequence as the one shingle. Rows with a null doc_id
take no part. Rows that repeat a doc_id are one document that has the links of each of its texts, and the
largest of their sizes. Empty input: no rows. Extra columns are ignored (kept by ``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.llm import _text as tx
from knowspan.llm._components import components
from knowspan.llm._scratch import Scratch, documents

#: Regions with more documents are divided or joined in blocks of so many; smaller ones compare the pairs left.
LEAF = 256
#: Documents that a large region is divided by; the share of its work (the square of its size) its parts must stay below.
PIVOTS, SMALLER = 8, 0.75
#: Counters of shingles, and the pieces they are summed in.
COUNTERS, PIECES = 1 << 25, 64
#: Pairs with the same first document that are one group; with more, several.
BLOCK = 128
BROADCAST_ROWS = 1_000_000
#: Copies of one set above which its class is told to all tasks where classes are too many to broadcast.
COPIES = 10_000
_U = np.uint64


def sized(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string").alias("text")
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), text)


def _sets(batch: pa.RecordBatch, size: int):
    """(doc_ids, shingles, offsets) of at most 256 rows each."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    raw, offsets = tx.buffers(batch.column(1))
    for i, j, part, offs in tx.slices(raw, offsets, rows=256):
        yield ids[i:j], *tx.distinct_shingles(part, offs, size)


def ranks(docs: DataFrame, size: int) -> np.ndarray:
    """For each counter a byte, larger the more often its shingles occur in all documents."""
    place = _U(56 - (COUNTERS.bit_length() - 1))
    schema = "piece int, turn int, counts binary"
    tasks = docs.rdd.getNumPartitions()
    turns = -(-tasks // 256)  # a task of the last sum reads at most 256 rows of a piece

    def rows(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        data = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in sums.values()]
        keys = list(sums)
        columns = [pa.array([p for p, _ in keys], pa.int32()), pa.array([t for _, t in keys], pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], ["piece", "turn", "counts"])

    def unpack(data: bytes) -> np.ndarray:
        raw = pa.decompress(data, decompressed_size=4 * COUNTERS // PIECES, codec="zstd", asbytes=True)
        return np.frombuffer(raw, np.uint32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.uint8)  # up to 255 in a task: beyond that a shingle is common anyway
        for batch in batches:
            for _, shingles, _ in _sets(batch, size):
                at, times = np.unique((shingles >> place).astype(np.uint32), return_counts=True)
                held[at] = np.minimum(held[at] + times, 255)
        for piece, part in enumerate(held.reshape(PIECES, -1)):
            if part.any():
                yield rows({(piece, 0): part.astype(np.uint32)})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for piece, turn, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                part = unpack(data)
                sums[piece, turn] = sums[piece, turn] + part if (piece, turn) in sums else part
        for key, part in sums.items():
            yield rows({key: part})

    found = _texts(docs).mapInArrow(count, schema)
    if turns > 1:
        found = found.withColumn("turn", F.pmod(F.spark_partition_id(), F.lit(turns)).cast("int"))
        found = found.repartition("piece", "turn").mapInArrow(total, schema).withColumn("turn", F.lit(0))
    found = found.repartition(PIECES, "piece").mapInArrow(total, schema)
    summed = found.select("piece", "counts").toArrow()  # PIECES rows at most, COUNTERS numbers
    pieces = dict(zip(summed["piece"].to_pylist(), summed["counts"]))
    some = np.concatenate([unpack(x.as_py())[::64].copy() for x in pieces.values()]) if pieces else np.zeros(1, np.uint32)
    steps = np.unique(np.quantile(some, np.arange(1, 256) / 256, method="lower"))
    out = np.zeros((PIECES, COUNTERS // PIECES), np.uint8)
    for piece, data in pieces.items():
        out[piece] = np.searchsorted(steps, unpack(data.as_py()), side="left")
    return out.reshape(-1)


def windows(docs: DataFrame, threshold: tuple[int, int], size: int, rank: np.ndarray) -> DataFrame:
    """doc_id, n, h1, h2 and window: the first pivots of each document as their places in the order, ascending.

    A place is the byte of the shingle's counter and 48 bits of its hash. Should two shingles have one place
    they are one region, which adds candidates and loses none."""
    place = _U(56 - (COUNTERS.bit_length() - 1))
    num, den = threshold
    names = ["doc_id", "n", "h1", "h2", "window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, shingles, at in _sets(batch, size):
                n = np.diff(at)
                doc = np.repeat(np.arange(len(ids), dtype=_U), n)
                sums = np.zeros((2, len(shingles) + 1), _U)
                with np.errstate(over="ignore"):
                    np.cumsum(tx.mix(shingles), out=sums[0, 1:])
                    np.cumsum(tx.mix(shingles ^ _U(0xA5A5A5A5A5A5A5A5)), out=sums[1, 1:])
                    prints = (sums[:, at[1:]] - sums[:, at[:-1]]).view(np.int64)
                code = rank[(shingles >> place).astype(np.int64)].astype(_U)
                order = np.sort((doc << _U(56)) | (code << _U(48)) | (shingles >> _U(8)))  # stays in its document
                reach = np.where(n > 0, n - -(-n * num // den) + 1, 0)
                first = np.arange(len(order)) - np.repeat(at[:-1], n) < np.repeat(reach, n)
                ends = pa.array(np.concatenate([[0], np.cumsum(reach)]), pa.int32())
                seats = (order[first] & _U((1 << 56) - 1)).view(np.int64)
                lists = pa.ListArray.from_arrays(ends, pa.array(seats))
                columns = [pa.array(ids), pa.array(n.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), lists]
                yield pa.RecordBatch.from_arrays(columns, names)

    return _texts(docs).mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, window array<bigint>")


def sets_of(docs: DataFrame, ids: DataFrame, rows: int, size: int) -> DataFrame:
    """doc_id, shingles of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, shingles, at in _sets(batch, size):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(own), lists], ["doc_id", "shingles"])

    some = _texts(docs).join(sized(ids, rows), "doc_id", "left_semi")
    return some.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def intersections(one: list[np.ndarray], two: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other; only shingles of both count."""
    flat = [np.concatenate(sets).view(_U) if len(sets) else np.zeros(0, _U) for sets in (one, two)]
    shared = np.intersect1d(*flat)
    rows = [np.repeat(np.arange(len(sets)), [len(x) for x in sets]) for sets in (one, two)]
    out = np.zeros((len(one), len(two)), np.float32)
    for a in range(0, len(shared), columns):
        part, tables = shared[a : a + columns], []
        for values, row, sets in zip(flat, rows, (one, two)):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            table = np.zeros((len(sets), len(part)), np.float32)
            table[row[hit], at[hit]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


class Join:
    """The state of one join: what is known of pairs and components."""

    def __init__(self, spark: SparkSession, docs: DataFrame, threshold: tuple[int, int], size: int, leaf: int):
        self.scratch, self.docs, self.size, self.leaf = Scratch(spark, "jaccard"), docs, size, leaf
        self.num, self.den = threshold
        self.steps = 0
        self.windows: DataFrame | None = None
        self.fresh: DataFrame | None = None
        self.labels: DataFrame | None = None

    def links(self, inter: Column, a: Column, b: Column) -> Column:
        return inter * self.den >= (a + b - inter) * self.num

    def can_link(self, most: Column, small: Column, large: Column) -> Column:
        """Whether sets of these sizes can link if they share at most ``most``."""
        return (most * (self.num + self.den) >= (small + large) * self.num) & (small * self.den >= large * self.num)

    def radius(self) -> float:
        return (self.den - self.num) / self.den + 1e-9

    @staticmethod
    def beside(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
        """The pairs (a, b, block) with _a and _b, the ``value`` of each; that of a is sent once for each block."""
        of = lambda c: rows.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col(value).alias(f"_{c}"))
        heads = pairs.select("a", "block").distinct().join(of("a"), "a")
        return pairs.join(of("b"), "b").join(heads, ["a", "block"])

    def blocks(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs with the block that those of one first document are dealt to."""
        many = pairs.groupBy("a").agg(F.count("*").alias("_held")).where(F.col("_held") > BLOCK)
        many = self.scratch.table(f"many-{self.steps}", many)  # a row for more than BLOCK pairs
        turn = F.pmod(F.xxhash64("b", F.lit(3)), F.ceil(F.col("_held") / BLOCK)).cast("int")
        joined = pairs.join(sized(many, many.count()), "a", "left")
        return joined.select("a", "b", F.coalesce(turn, F.lit(0)).alias("block"))

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and windows leave open.

        Up to the nearer of two windows' ends, each shingle that only one of them holds is in only one set."""
        met = self.beside(pairs, self.windows.where("n > 0"), "window")
        met = met.where(self.can_link(F.least("n_a", "n_b"), F.least("n_a", "n_b"), F.greatest("n_a", "n_b")))
        end = F.least(F.element_at("_a", -1), F.element_at("_b", -1))
        held = lambda c: F.size(F.filter(c, lambda x: x <= F.col("_end")))
        odd = held("_a") + held("_b") - 2 * F.size(F.array_intersect("_a", "_b"))
        most = (F.col("n_a") + F.col("n_b")) * (self.den - self.num)
        met = met.withColumn("_end", end).where(odd * (self.den + self.num) <= most)
        return met.select("a", "b", "block").distinct()

    def verify(self, pairs: DataFrame) -> DataFrame:
        """a, b, n_a, n_b, inter of the plausible ones of the pairs (a, b); their links join the edges."""
        self.steps += 1
        at = lambda name: f"{name}-{self.steps}"
        asked = self.scratch.table(at("asked"), pairs.select("a", "b").distinct())
        if asked.isEmpty():
            return asked.select("a", "b", *(F.lit(0).cast("bigint").alias(c) for c in ("n_a", "n_b", "inter")))
        pairs = self.scratch.table(at("pairs"), self.plausible(self.blocks(asked)))
        self.scratch.drop(at("asked"))
        ids = self.scratch.table(at("ids"), pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        sets = sets_of(self.docs, ids, ids.count(), self.size).withColumn("n", F.size("shingles").cast("bigint"))
        sets = self.scratch.table(at("sets"), sets)
        inter = F.size(F.array_intersect("_a", "_b")).cast("bigint").alias("inter")
        done = self.scratch.table(at("verified"), self.beside(pairs, sets, "shingles").select("a", "b", "n_a", "n_b", inter))
        for name in ("sets", "pairs", "ids", "many"):
            self.scratch.drop(at(name))
        self.link(done.where(self.links(F.col("inter"), F.col("n_a"), F.col("n_b"))).select("a", "b"))
        return done

    def link(self, edges: DataFrame) -> None:
        """Add edges; known components stand for the edges they came from."""
        if self.fresh is not None:
            edges = self.fresh.unionByName(edges)
        self.fresh = edges

    def relabel(self) -> None:
        if self.labels is not None and (self.fresh is None or self.fresh.isEmpty()):
            return
        edges = self.fresh if self.labels is None else self.fresh.unionByName(self.labels.toDF("a", "b"))
        self.labels, self.fresh = components(edges, self.scratch, f"stars-{self.steps}"), None

    def labelled(self, members: DataFrame) -> DataFrame:
        joined = members.drop("component").join(self.labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        return joined.withColumn("component", F.coalesce("component", "doc_id"))

    def open_regions(self, members: DataFrame) -> DataFrame:
        """The members, with components and the number held, of the regions that aren't one component."""
        members = self.labelled(members)
        sizes = members.groupBy("region").agg(F.min("component").alias("_x"), F.max("component").alias("_y"), F.count("*").alias("held"))
        return members.join(sizes.where("_x <> _y").select("region", "held"), "region")

    def meet(self, members: DataFrame) -> None:
        """Compare the documents of small regions (region, doc_id, n, rest, component, d, home).

        Regions are taken many at a time from a partition sorted by them; what sizes, places, distances to the
        pivot and components leave open is handed on. ``rest``: how many shingles follow the region's own."""
        num, den, radius = self.num, self.den, self.radius()

        def pairs_of(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            region = rows["region"].to_numpy()
            end = np.searchsorted(region, region, side="right")
            after = end - np.arange(len(rows)) - 1
            ids, n, rest, comp, d, home = (rows[c].to_numpy() for c in ("doc_id", "n", "rest", "component", "d", "home"))
            d = d.astype(np.float64)  # null: not known, prunes nothing
            total, i = np.cumsum(after), 0
            while i < len(rows):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + 1_000_000)))
                one = np.repeat(np.arange(i, j), after[i:j])
                step = np.arange(len(one)) - np.repeat(np.cumsum(after[i:j]) - after[i:j], after[i:j])
                two = one + 1 + step
                ok = (comp[one] != comp[two]) & (home[one] | home[two])
                one, two = one[ok], two[ok]
                size = n[one] + n[two]
                ok = np.minimum(n[one], n[two]) * den >= np.maximum(n[one], n[two]) * num
                ok &= (1 + np.minimum(rest[one], rest[two])) * (num + den) >= size * num
                ok &= ~(np.abs(d[one] - d[two]) > radius)
                a, b = ids[one[ok]], ids[two[ok]]
                if len(a):
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
                i = j

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for frame in frames:
                held.append(frame)
                if sum(map(len, held)) < 20_000:
                    continue
                rows = pd.concat(held, ignore_index=True)
                whole = int(np.searchsorted(rows["region"].to_numpy(), rows["region"].iloc[-1]))  # the last goes on
                yield from pairs_of(rows.iloc[:whole])
                held = [rows.iloc[whole:]]
            if held:
                yield from pairs_of(pd.concat(held, ignore_index=True))

        columns = members.select("region", "doc_id", "n", "rest", "component", F.col("d").cast("double").alias("d"), "home")
        found = columns.repartition("region").sortWithinPartitions("region").mapInPandas(run, "a bigint, b bigint")
        self.verify(found)
        self.relabel()

    def divide(self, members: DataFrame) -> None:
        """Divide large regions (region, doc_id, n, component, held) by some of their documents, again and again."""
        self.steps += 1
        at = lambda name: f"{name}-{self.steps}"
        heads = members.groupBy("region", "component").agg(
            F.min_by("doc_id", F.xxhash64("doc_id", F.lit(self.steps))).alias("pivot"), F.count("*").alias("_w")
        )
        rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("_w"), "pivot"))
        heads = heads.withColumn("_r", rank).where(F.col("_r") <= PIVOTS).select("region", "pivot")
        heads = self.scratch.table(at("heads"), heads)
        block = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.ceil(F.col("held") / LEAF)).cast("int")
        rows = members.select("region", "doc_id", "n", "component", F.col("held").alias("whole"), block.alias("block"))
        rows = self.scratch.table(at("divided"), rows)
        ids = self.scratch.table(at("ids"), rows.select("doc_id").distinct())
        sets = self.scratch.table(at("sets"), sets_of(self.docs, ids, ids.count(), self.size))
        pivots = heads.join(sets.select(F.col("doc_id").alias("pivot"), F.col("shingles").alias("_p")), "pivot")
        pivots = rows.select("region", "block").distinct().join(pivots, "region")
        pivots = pivots.groupBy("region", "block").agg(F.collect_list(F.struct("pivot", "_p")).alias("_pivots"))
        met = rows.join(sets, "doc_id").join(pivots, ["region", "block"])

        def beside(p: Column) -> Column:
            inter = F.size(F.array_intersect(p["_p"], F.col("shingles"))).cast("bigint")
            a, b = F.size(p["_p"]).cast("bigint"), F.size("shingles").cast("bigint")
            linked = self.links(inter, a, b)
            return F.struct((1 - inter / (a + b - inter)).alias("d"), p["pivot"].alias("pivot"), linked.alias("linked"))

        met = met.withColumn("_all", F.transform("_pivots", beside)).drop("_pivots", "shingles")
        met = met.withColumn("_near", F.array_min("_all"))
        reached = F.filter("_all", lambda x: x["d"] <= F.col("_near.d") + 2 * self.radius())
        parts = met.withColumn("_s", F.explode(reached)).select(
            F.col("region").alias("parent"), F.xxhash64("region", "_s.pivot").alias("region"), "_s.pivot", "doc_id", "n", "component",
            "whole", "_s.d", "_s.linked", (F.col("_s.pivot") == F.col("_near.pivot")).alias("home"),
        )
        parts = self.scratch.table(at("parts"), parts)
        for name in ("sets", "ids", "divided"):
            self.scratch.drop(at(name))
        found = parts.where("linked and doc_id <> pivot and component <> pivot")
        self.link(found.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))
        self.relabel()
        parts = self.scratch.table(at("open"), self.open_regions(parts))
        work = parts.select("parent", "region", "held", "whole").distinct().groupBy("parent", "whole")
        work = work.agg(F.sum(F.col("held").cast("double") * F.col("held")).alias("_work"))
        stuck = work.where(F.col("_work") > F.col("whole").cast("double") * F.col("whole") * SMALLER).select("parent")
        stuck = self.scratch.table(at("stuck"), stuck)
        useful = parts.join(stuck, "parent", "left_anti")
        small, large = useful.where(F.col("held") <= self.leaf), useful.where(F.col("held") > self.leaf)
        if not small.isEmpty():
            self.meet(small.withColumn("rest", F.col("n")))  # places are of no use here
        if not stuck.isEmpty():  # the whole region at once, by the distance to one pivot of each
            one = heads.groupBy("region").agg(F.min("pivot").alias("pivot")).select(F.xxhash64("region", "pivot").alias("region"))
            far = parts.join(one, "region").select("parent", "doc_id", "d")
            rest = members.join(stuck.withColumnRenamed("parent", "region"), "region").select(F.col("region").alias("parent"), "doc_id")
            rest = self.labelled(rest.distinct().join(far, ["parent", "doc_id"], "left"))
            self.rings(rest.withColumnRenamed("parent", "region").withColumn("home", F.lit(True)))
        if not large.isEmpty():
            self.divide(large)

    def rings(self, members: DataFrame) -> None:
        """Compare the documents of large regions (region, doc_id, component, d, home) in blocks.

        Documents fall into rings by their distance to the pivot, half of r wide, and rings into blocks of about ``LEAF``
        documents, those of a large component apart; two blocks meet only if the triangle inequality lets their rings and they aren't of one component.
        Only links leave a task."""
        self.steps += 1
        at = lambda name: f"{name}-{self.steps}"
        width = self.radius() / 2
        docs = members.groupBy("region", "doc_id").agg(
            F.first("component").alias("component"), F.min("d").alias("d"), F.max("home").alias("home"), F.count("*").alias("_t")
        )
        ring = F.when(F.col("_t") == 1, F.coalesce(F.floor(F.col("d") / width).cast("int"), F.lit(-1))).otherwise(-1)
        docs = docs.withColumn("ring", ring)  # -1: how far isn't known, or differs between the texts of a repeated doc_id
        docs = self.scratch.table(at("rings"), docs)
        size = docs.groupBy("region", "ring", "component").agg(F.count("*").alias("held"))
        size = self.scratch.table(at("sizes"), size)
        mixed = size.where(F.col("held") < self.leaf).groupBy("region", "ring").agg(F.sum("held").alias("mixed"))
        deal = lambda c: F.pmod(F.xxhash64("doc_id", F.lit(5)), F.ceil(F.col(c) / self.leaf))
        block = F.when(F.col("held") < self.leaf, deal("mixed")).otherwise(F.xxhash64("component", deal("held")))
        docs = docs.join(size, ["region", "ring", "component"]).join(mixed, ["region", "ring"], "left").withColumn("block", block)
        docs = self.scratch.table(at("blocks"), docs.select("region", "doc_id", "component", "home", "ring", "block"))
        block = docs.groupBy("region", "ring", "block").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.max("home").alias("home")
        )
        x, y = block.alias("x"), block.alias("y")
        met = x.join(y, F.col("x.region") == F.col("y.region")).where("x.home or y.home")
        met = met.where("x.ring < y.ring or (x.ring = y.ring and x.block <= y.block)")
        met = met.where("x.ring = -1 or y.ring - x.ring <= 3").where("least(x.low, y.low) <> greatest(x.high, y.high)")
        meeting = F.xxhash64("x.region", "x.ring", "x.block", "y.ring", "y.block").alias("meeting")
        met = met.select("x.region", F.struct("x.ring", "x.block").alias("one"), F.struct("y.ring", "y.block").alias("two"), meeting)
        met = self.scratch.table(at("meetings"), met)
        ids = docs.select("doc_id").distinct()
        sets = self.scratch.table(at("sets"), sets_of(self.docs, ids, ids.count(), self.size))
        own = docs.select("region", F.struct("ring", "block").alias("at"), "doc_id", "component", "home").join(sets, "doc_id")

        def side(c: str) -> DataFrame:
            seated = own.join(met.select("region", F.col(c).alias("at"), "meeting"), ["region", "at"])
            names = ("meeting", "doc_id", "component", "home", "shingles")
            return seated.select(*(F.col(n).alias(n) for n in names)).groupBy("meeting")  # a new attribute each

        num, den = self.num, self.den

        def links(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
            if not len(one) or not len(two):
                return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
            inter = intersections(list(one["shingles"]), list(two["shingles"]))
            n, m = one["shingles"].map(len).to_numpy()[:, None], two["shingles"].map(len).to_numpy()[None, :]
            ok = (inter * den >= (n + m - inter) * num) & (one["component"].to_numpy()[:, None] != two["component"].to_numpy()[None, :])
            ok &= one["home"].to_numpy()[:, None] | two["home"].to_numpy()[None, :]
            i, j = np.nonzero(ok)
            return pd.DataFrame({"a": one["doc_id"].to_numpy()[i], "b": two["doc_id"].to_numpy()[j]})

        found = side("one").cogroup(side("two")).applyInPandas(links, "a bigint, b bigint")
        self.link(self.scratch.table(at("links"), found.distinct()))
        for name in ("sets", "rings", "blocks", "meetings"):
            self.scratch.drop(at(name))
        self.relabel()

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id of each document."""
        found = windows(self.docs, (self.num, self.den), self.size, ranks(self.docs, self.size))
        self.windows = self.scratch.table("windows", found)
        same = self.windows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("class"), F.count("*").alias("_held"))
        same = self.scratch.table("same", same.where("_held > 1"))
        homes = classed(self.windows, same)
        seats = homes.where("n > 0 and class = doc_id").select("doc_id", "n", F.posexplode("window").alias("pos", "region"))
        seats = seats.withColumn("rest", F.col("n") - F.col("pos") - 1)
        regions = seats.groupBy("region").agg(
            F.count("*").alias("held"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
            F.bit_xor(F.xxhash64("doc_id")).alias("print"), F.max("n").alias("_n"), F.sum("n").alias("_sum"), F.min("rest").alias("_rest"),
        )
        regions = self.scratch.table("regions", regions.where("held > 1 and low <> high"))
        two = regions.where("held = 2").where(self.can_link(F.col("_rest") + 1, F.col("_sum") - F.col("_n"), F.col("_n")))
        many = regions.where("held > 2").groupBy("held", "low", "high", "print").agg(F.min("region").alias("region"))
        many = self.scratch.table("many", many.select("region"))
        members = self.scratch.table("members", seats.drop("pos").join(sized(many, many.count()), "region"))
        first = (F.shiftleft(F.col("n") - F.col("rest"), 32)) + F.shiftrightunsigned(F.xxhash64("doc_id"), 32)
        pivot = members.groupBy("region").agg(F.min_by("doc_id", first).alias("pivot"))
        pivot = self.scratch.table("pivots", pivot)
        stars = members.join(pivot, "region").where("doc_id <> pivot")
        pairs = two.select(F.col("low").alias("a"), F.col("high").alias("b"))
        known = self.verify(pairs.unionByName(stars.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))))
        again = homes.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("_t"))
        again = self.scratch.table("again", again.where("_t > 1"))
        self.link(again.where("a <> b").select("a", "b"))  # of repeated doc_ids
        self.relabel()
        apart = 1 - F.try_divide("inter", F.col("n_a") + F.col("n_b") - F.col("inter"))
        known = known.select(F.col("a").alias("pivot"), F.col("b").alias("doc_id"), apart.alias("d"))
        repeated = again.select("doc_id", F.lit(True).alias("_r"))
        known = known.join(repeated, "doc_id", "left_anti").join(repeated.withColumnRenamed("doc_id", "pivot"), "pivot", "left_anti")
        placed = self.open_regions(members).join(pivot, "region").join(known, ["pivot", "doc_id"], "left")
        placed = placed.withColumn("d", F.when(F.col("doc_id") == F.col("pivot"), 0.0).otherwise(F.col("d")))
        open_ = self.scratch.table("open", placed.withColumn("home", F.lit(True)))
        for name in ("regions", "many", "members", "pivots"):
            self.scratch.drop(name)
        large = open_.where(F.col("held") > self.leaf)
        if not large.isEmpty():  # those with one pivot have most documents in common, and are divided as one
            large = large.groupBy(F.col("pivot").alias("region"), "doc_id", "n").agg(F.first("component").alias("component"))
            held = large.groupBy("region").agg(F.count("*").alias("held"))
            self.divide(self.scratch.table("large", large.join(held, "region")))
        self.meet(open_.where(F.col("held") <= self.leaf))
        last = self.labels.select(F.col("id").alias("class"), "component")
        joined = classed(self.windows.drop("window"), same).join(last, "class", "left")
        joined = joined.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("component", "class")).alias("component_id"))
        result = self.scratch.table("result", joined)
        self.scratch.keep("result")
        return result


def classed(rows: DataFrame, same: DataFrame) -> DataFrame:
    """The rows (doc_id, n, h1, h2, ...) with ``class``: the smallest doc_id of those with an equal set.

    ``same`` has a row for each set that several rows hold. Where these are too many to broadcast, only those
    with many rows are, so that no group of copies is one task."""
    key = ["n", "h1", "h2"]
    if same.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(same.drop("_held")), key, "left")
        return joined.withColumn("class", F.coalesce("class", "doc_id"))
    hot = same.where(F.col("_held") > COPIES).select(*key, F.col("class").alias("_hot"))
    joined = rows.join(sized(hot, hot.count()), key, "left")
    turn = F.when(F.col("_hot").isNotNull(), F.xxhash64("doc_id")).otherwise(0).alias("_turn")
    cold = same.where(F.col("_held") <= COPIES).select(*key, "class", F.lit(0).cast("bigint").alias("_turn"))
    joined = joined.withColumn("_turn", turn).join(cold, [*key, "_turn"], "left").drop("_turn")
    return joined.withColumn("class", F.coalesce("_hot", "class", "doc_id")).drop("_hot")


def join(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int] = (4, 5), size: int = 5, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id: documents are linked when J is at least ``threshold`` = (numerator, denominator)."""
    return Join(spark, docs, threshold, size, leaf).run()


def keep_one(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int] = (4, 5), size: int = 5) -> DataFrame:
    """The documents with the smallest doc_id of their component, and rows with a null doc_id."""
    lost = join(spark, docs, threshold, size).where("component_id <> doc_id").select("doc_id")
    return docs.join(sized(lost, lost.count()), "doc_id", "left_anti").select(*docs.columns)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, documents(spark, sf_dir), threshold=(90, 100), size=3)


QUERIES = {"op4_ngram_jaccard": op4_ngram_jaccard}
SQL = {
    "op4_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
  FROM words, LATERAL unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
}
