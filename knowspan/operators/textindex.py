"""A trigram index of documents: postings with positions, segments, deletes, compaction and stored totals.

Every position of a field begins a gram of three lower-cased code points; two blanks beyond the end make that true of
the last two as well, so shorter phrases are found too, as ranges of grams. The task that reads documents packs the postings
of a block of them: a row is (block, gram, field) with the documents' places in the block, counts and gaps of positions as
bytes, about two for each character; the row of gram ``_IDS`` holds the block's doc_ids. So a segment is written where
its documents are read, without a shuffle; each file is sorted by gram, and a search reads the row groups and pages that
can hold its grams. Texts are never read by a search for one phrase.

A change adds a segment: ``upsert`` one with postings, ``delete`` one without. Both write the ids that no older segment
may answer for any more. The log has one row for each finished change, written last, with its number of documents and
their length, less those it replaced; so a change that broke off has no effect, one that comes again under its name is
skipped, and the totals that BM25 needs are a sum over the log. ``compact`` writes all that is live as one segment of a
new generation; the packed rows meet the dead places of their block, no posting moves. An index needs one writer at a
time; readers see the log as it was when they opened it.

Scores are BM25 of a phrase as one unit, over the fields asked for together.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.config import Search

#: Characters of a block, about: what a Python worker sorts at once; its documents at most. Blocks whose dead places are broadcast at most.
CHARS, DOCS, FEW_BLOCKS = 1 << 21, 1 << 11, 1 << 18
_IDS = -1  # the gram of the row that holds a block's doc_ids
_SHIFT = 21  # bits of a code point
_PAD = 0  # stands for what is beyond the end
_LOG = "change int, name string, generation int, docs bigint, length bigint, gone bigint"
_PACKED = "block bigint, gram bigint, field int, docs int, owners binary, counts binary, gaps binary"
_POSTING = "change int, gram bigint, doc_id bigint, field int, positions array<int>"


def grams_of(phrase: str) -> list[int]:
    """The grams of a phrase of three code points or more, lower-cased."""
    c = [ord(x) for x in phrase.lower()]
    return [a << 2 * _SHIFT | b << _SHIFT | d for a, b, d in zip(c, c[1:], c[2:])]


def short_range(phrase: str) -> tuple[int, int]:
    """The grams, from and up to, that begin with one or two code points."""
    c = [ord(x) for x in phrase.lower()]
    low = c[0] << 2 * _SHIFT | (c[1] << _SHIFT if len(c) > 1 else 0)
    return low, low + (1 << (2 - len(c) + 1) * _SHIFT)


def _pack(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Numbers from 0 as bytes of seven bits, the low ones first; one value of bytes for each stretch between edges."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        more = values >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    end = np.cumsum(size)
    out, at = np.zeros(end[-1] if len(end) else 0, np.uint8), end - size
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[at[own] + k] = ((values[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[own] > k + 1).astype(np.uint8) << 7)
    offsets = np.append(0, end)[edges].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def _unpack(column: pa.Array) -> np.ndarray:
    """The numbers of all values in turn."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    first = np.append(0, np.flatnonzero(raw < 128)[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, first)


def _sums(gaps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each place of ``first``."""
    if not len(gaps):
        return gaps
    total = np.cumsum(gaps)
    return total - np.repeat(total[first] - gaps[first], np.diff(np.append(first, len(gaps))))


def _gaps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each value less the one before it; the value itself at each place of ``first``."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def _rows(block: int | np.ndarray, gram: np.ndarray, field: int | np.ndarray, pair: np.ndarray, owner: np.ndarray, start: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Packed rows. ``pair``: where each row's documents begin, and the end; ``start``: where each document's positions begin, and the end."""
    full = lambda x, kind: pa.array(np.broadcast_to(np.asarray(x), gram.shape).astype(kind))
    columns = [full(block, np.int64), pa.array(gram), full(field, np.int32), pa.array(np.diff(pair).astype(np.int32)), _pack(_gaps(owner, pair[:-1]), pair), _pack(np.diff(start), pair), _pack(_gaps(place, start[:-1]), start[pair])]
    return pa.RecordBatch.from_arrays(columns, ["block", "gram", "field", "docs", "owners", "counts", "gaps"])


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, owner and count of each document of packed rows, where its positions begin, all positions)."""
    docs = batch.column("docs").to_numpy().astype(np.int64)
    owner, count = _unpack(batch.column("owners")), _unpack(batch.column("counts"))
    start = np.cumsum(count) - count
    return np.repeat(np.arange(len(docs)), docs), _sums(owner, (np.cumsum(docs) - docs)[docs > 0]), count, start, _sums(_unpack(batch.column("gaps")), start)


def postings(docs: DataFrame, fields: list[str]) -> DataFrame:
    """Packed postings (``_PACKED``): positions from 0, field its place in ``fields``."""

    def block_of(ids: list[int], texts: list[list[str]]) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=ids.__getitem__)
        block = int.from_bytes(os.urandom(8), "little") >> 1
        held = np.array([ids[k] for k in order], np.int64).tobytes()
        empty = pa.array([b""], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_IDS]), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([held], pa.binary()), empty, empty], ["block", "gram", "field", "docs", "owners", "counts", "gaps"])
        for field in range(len(fields)):
            own = [texts[k][field] for k in order]
            size = np.array([len(t) for t in own], np.int64)
            if not size.sum():
                continue
            flat = np.frombuffer("".join(t + "\0\0" for t in own).encode("utf-32-le"), np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(own)), size)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            at = np.arange(len(owner)) + 2 * owner
            gram = flat[at] << 2 * _SHIFT | flat[at + 1] << _SHIFT | flat[at + 2]
            turn = np.argsort(gram, kind="stable")  # documents and positions stay in order
            gram, owner, place = gram[turn], owner[turn], place[turn]
            new = np.append(True, gram[1:] != gram[:-1])
            start = np.flatnonzero(new | np.append(True, owner[1:] != owner[:-1]))
            pair = np.append(np.flatnonzero(new[start]), len(start))
            yield _rows(block, gram[start[pair[:-1]]], field, pair, owner[start], np.append(start, len(gram)), place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for k in range(len(batch)):
                ids.append(batch.column(0)[k].as_py())
                texts.append([batch.column(f + 1)[k].as_py() or "" for f in range(len(fields))])
                size += sum(map(len, texts[-1]))
                if size >= CHARS or len(ids) == DOCS:
                    yield from block_of(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from block_of(ids, texts)

    texts = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"_{k}") for k, f in enumerate(fields)]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *texts).mapInArrow(run, _PACKED)


def unpacked(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """change, gram, doc_id, field, positions of packed rows; ``blocks`` (block, ids): the doc_ids of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                row, owner, count, start, place = _read(batch)
                held = batch.column("ids").to_pylist()
                first = np.cumsum([0] + [len(h) // 8 for h in held])
                ids = np.frombuffer(b"".join(held), np.int64)[first[row] + owner]
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(place)).astype(np.int32)), pa.array(place.astype(np.int32)))
                columns = [batch.column("change").take(pa.array(row)), batch.column("gram").take(pa.array(row)), pa.array(ids), batch.column("field").take(pa.array(row)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["change", "gram", "doc_id", "field", "positions"])

    return rows.join(blocks, "block").select("change", "gram", "field", "docs", "owners", "counts", "gaps", "ids").mapInArrow(run, _POSTING)


def without(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """Packed rows without the documents at the places that are dead (block, bits: a bit for each place); rows of doc_ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "gram", "field", "docs", "owners", "counts", "gaps"]
        for whole in batches:
            bits = whole.column("bits").is_valid()
            cut = pa.compute.and_(bits, pa.compute.not_equal(whole.column("gram"), _IDS))
            yield whole.select(names).filter(pa.compute.invert(cut))
            batch = whole.filter(cut)
            if not len(batch):
                continue
            row, owner, count, start, place = _read(batch)
            held = batch.column("bits").to_pylist()
            first = np.cumsum([0] + [len(h) for h in held])
            raw = np.frombuffer(b"".join(held), np.uint8)
            keep = (raw[first[row] + owner // 8] >> (7 - owner % 8) & 1) == 0
            place = place[np.repeat(keep, count)]
            row, owner, count = row[keep], owner[keep], count[keep]
            if len(row):
                left = np.unique(row)
                column = lambda name: batch.column(name).to_numpy()[left]
                yield _rows(column("block"), column("gram"), column("field"), np.append(np.searchsorted(row, left), len(row)), owner, np.append(0, np.cumsum(count)), place)

    return rows.join(dead, "block", "left").select("block", "gram", "field", "docs", "owners", "counts", "gaps", "bits").mapInArrow(run, _PACKED)


def bits(places: DataFrame) -> DataFrame:
    """block, bits of the places (block, places) of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found, n in zip(batch.column("places").to_pylist(), batch.column("n").to_pylist()):
                flags = np.zeros(n, bool)
                flags[found] = True
                out.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "bits"])

    return places.select("block", "places", "n").mapInArrow(run, "block bigint, bits binary")


class TextIndex:
    """An index in a shared folder. ``fields``: what is searched; ``measured``: those that count for the length and score; ``stored``: columns that hits carry.

    Documents need a doc_id; those without one aren't indexed, and of rows that repeat one within a change one counts."""

    def __init__(self, spark: SparkSession, folder: str, fields: list[str], measured: list[str] | None = None, stored: list[str] | None = None):
        self.spark, self.folder, self.fields = spark, folder, fields
        self.measured, self.stored = measured or fields, stored or []
        self.refresh()

    # --- state

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def refresh(self) -> None:
        """Read the log anew: one row a change."""
        path = f"{self.folder}/log"
        self.log = sorted(self.spark.read.schema(_LOG).parquet(path).collect()) if self._exists(path) else []
        self.generation = max((r.generation for r in self.log), default=0)
        self.own = [r for r in self.log if r.generation == self.generation]
        self._read: dict[str, DataFrame] = {}

    @property
    def totals(self) -> tuple[int, int]:
        """Live documents, and the trigrams in their measured fields."""
        return sum(r.docs for r in self.own), sum(r.length for r in self.own)

    def _part(self, kind: str, schema: str) -> DataFrame:
        """Rows of a kind of file of all finished changes, with change; files are listed once."""
        if kind not in self._read:
            at = f"{self.folder}/generation={self.generation}/{kind}"
            paths = [p for r in self.own if self._exists(p := f"{at}/change={r.change}")]
            self._read[kind] = self.spark.read.schema(schema).option("basePath", at).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return self._read[kind]

    def _live(self, rows: DataFrame) -> DataFrame:
        """Without what a later change took away."""
        if not any(r.gone for r in self.own):
            return rows
        last = self._part("gone", "doc_id bigint, change int").groupBy("doc_id").agg(F.max("change").alias("_gone"))  # of all changes since the last compaction
        return rows.join(last, "doc_id", "left").where("_gone is null or change >= _gone").drop("_gone")

    def documents(self) -> DataFrame:
        """doc_id, length and the stored columns of what is live."""
        path, kinds = f"{self.folder}/generation={self.generation}/documents", {}
        if self.stored and "documents" not in self._read and self._exists(path):
            kinds = dict(self.spark.read.option("basePath", path).parquet(path).dtypes)
        extra = "".join(f", `{c}` {kinds.get(c, 'string')}" for c in self.stored)
        return self._live(self._part("documents", f"doc_id bigint, length bigint{extra}, change int"))

    # --- changes

    def _single(self, docs: DataFrame) -> DataFrame:
        """One row for each doc_id, the smallest; only where ids repeat are texts grouped."""
        docs = docs.where("doc_id is not null").select("doc_id", *dict.fromkeys([*self.fields, *self.stored]))
        n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
        rest = [c for c in docs.columns if c != "doc_id"]
        return docs if n == ids else docs.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_r")).select("doc_id", "_r.*")

    def _log(self, name: str | None, number: int, generation: int, n: int, length: int, gone: int) -> bool:
        row = self.spark.createDataFrame([(number, name, generation, n, length, gone)], _LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")  # from here on the change counts
        self.refresh()
        return True

    def _next(self, name: str | None) -> int | None:
        self.refresh()
        return None if name is not None and any(r.name == name for r in self.log) else max((r.change for r in self.log), default=0) + 1

    def _apply(self, name: str | None, docs: DataFrame | None, ids: DataFrame) -> bool:
        if (number := self._next(name)) is None:
            return False
        at = f"{self.folder}/generation={self.generation}"
        n = length = gone = lost = 0
        if self.own:
            ids = ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
            self.documents().join(ids, "doc_id", "left_semi").select("doc_id", "length").write.mode("overwrite").parquet(f"{at}/gone/change={number}")
            gone, lost = self.spark.read.parquet(f"{at}/gone/change={number}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if docs is not None:
            n, length = self._write(at, number, docs)
        return self._log(name, number, self.generation, n - gone, length - lost, gone)

    def _write(self, at: str, number: int, docs: DataFrame, files: int = 0) -> tuple[int, int]:
        """Documents and postings of a segment, in at most ``files`` files of each where that is given."""
        docs = docs.coalesce(files) if files else docs
        size = sum((F.greatest(F.coalesce(F.length(F.col(f).cast("string")), F.lit(0)) - 2, F.lit(0)) for f in self.measured), F.lit(0)).cast("bigint")
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("length"), *self.stored).write.mode("overwrite").parquet(f"{at}/documents/change={number}")
        n, length = self.spark.read.parquet(f"{at}/documents/change={number}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        self._write_postings(postings(docs, self.fields), f"{at}/postings/change={number}")
        return n, length

    def _write_postings(self, rows: DataFrame, path: str) -> None:
        rows.sortWithinPartitions("gram").write.mode("overwrite").option("compression", "zstd").parquet(path)

    def upsert(self, docs: DataFrame, name: str | None = None) -> bool:
        """Index ``docs`` in place of what their ids had. False if a change of this name is there already."""
        docs = self._single(docs)
        return self._apply(name, docs, docs)

    def delete(self, ids: DataFrame, name: str | None = None) -> bool:
        return self._apply(name, None, ids)

    def prune(self, known: DataFrame, name: str | None = None) -> bool:
        """Delete what isn't among ``known`` (doc_id)."""
        return self.delete(self.documents().join(known.select("doc_id"), "doc_id", "left_anti"), name)

    def rebuild(self, docs: DataFrame, name: str | None = None) -> bool:
        """Start a new generation that holds ``docs`` alone."""
        docs = self._single(docs)
        return self._renew(lambda at, number: self._write(at, number, docs), name)

    def compact(self, name: str | None = None) -> bool:
        """Start a new generation with all that is live as one segment."""

        def merge(at: str, number: int) -> tuple[int, int]:
            n, length = self.totals
            self.documents().drop("change").write.mode("overwrite").parquet(f"{at}/documents/change={number}")
            self._write_postings(self._undead(self._packed().drop("change")), f"{at}/postings/change={number}")
            return n, length

        return self._renew(merge, name)

    def _undead(self, rows: DataFrame) -> DataFrame:
        if not any(r.gone for r in self.own):
            return rows
        last = self._part("gone", "doc_id bigint, change int").groupBy("doc_id").agg(F.max("change").alias("_gone"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    ids = np.frombuffer(batch.column("owners")[k].as_py(), np.int64)
                    full = lambda x, kind: pa.array(np.full(len(ids), x), kind)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([full(batch.column("change")[k].as_py(), pa.int32()), full(batch.column("block")[k].as_py(), pa.int64()), pa.array(np.arange(len(ids), dtype=np.int32)), full(len(ids), pa.int32()), pa.array(ids)], ["change", "block", "place", "n", "doc_id"])

        places = self._packed().where(F.col("gram") == _IDS).select("change", "block", "owners").mapInArrow(run, "change int, block bigint, place int, n int, doc_id bigint")
        dead = bits(places.join(last, "doc_id").where("change < _gone").groupBy("block").agg(F.collect_list("place").alias("places"), F.max("n").alias("n")))
        few = sum(max(r.length, 0) for r in self.own) // CHARS <= FEW_BLOCKS  # a block is a row of some hundred bytes
        return without(rows, F.broadcast(dead) if few else dead)

    def _renew(self, write, name: str | None) -> bool:
        if (number := self._next(name)) is None:
            return False
        n, length = write(f"{self.folder}/generation={self.generation + 1}", number)
        return self._log(name, number, self.generation + 1, n, length, 0)

    # --- search

    def _packed(self) -> DataFrame:
        return self._part("postings", f"{_PACKED}, change int")

    def _postings(self, rows: DataFrame) -> DataFrame:
        """gram, doc_id, field, positions of what is live of packed rows."""
        blocks = self._packed().where(F.col("gram") == _IDS).select("block", F.col("owners").alias("ids"))
        return self._live(unpacked(rows, blocks)).drop("change")

    def occurrences(self, phrase: str) -> DataFrame:
        """doc_id, field, n: how often the phrase begins in each field, whatever its case; occurrences may overlap.

        Only row groups and pages of its grams are read. The lists of a document, each shifted by its gram's place in the phrase, are intersected."""
        held = self._packed()
        if len(phrase) < 3:
            low, high = short_range(phrase) if phrase else (0, 0)
            found = self._postings(held.where((F.col("gram") >= low) & (F.col("gram") < high)))
            return found.groupBy("doc_id", "field").agg(F.sum(F.size("positions")).cast("bigint").alias("n"))
        places: dict[int, list[int]] = {}
        for k, g in enumerate(grams_of(phrase)):
            places.setdefault(g, []).append(k)
        held = self._postings(held.where(F.col("gram").isin(list(places))))
        if len(places) == 1 and len(phrase) == 3:
            return held.select("doc_id", "field", F.size("positions").cast("bigint").alias("n"))
        at = F.create_map(*(x for g, ks in places.items() for x in (F.lit(g), F.array(*map(F.lit, ks)))))
        return _together(held.withColumn("at", F.explode(F.element_at(at, F.col("gram")))), ["doc_id", "field"], F.lit(len(phrase) - 2))

    def many(self, queries: DataFrame) -> DataFrame:
        """query_id, doc_id, field, n as ``occurrences``, for many phrases (query_id, phrase) at once; query_ids don't repeat.

        Each phrase meets the postings of its rarest gram first; its other grams then meet those documents alone, by equality of
        gram, document and field, so a frequent gram isn't paired with every query that has it."""
        chars = F.transform(F.regexp_extract_all(F.lower("phrase"), F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("bigint"))
        asked = queries.where("phrase <> ''").select("query_id", chars.alias("c")).withColumn("size", F.size("c"))
        code = lambda i, n: sum((F.shiftleft(F.get("c", i + k), (n - 1 - k) * _SHIFT) for k in range(n)), F.lit(0))
        grams = asked.where("size >= 3").select("query_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("size") - 3), lambda i: code(i, 3))).alias("at", "gram"), (F.col("size") - 2).alias("need"))
        grams = grams.groupBy("query_id", "gram", "need").agg(F.collect_list("at").alias("ats"))
        packed = self._packed()
        packed = packed.join(grams.select("gram").distinct(), "gram", "left_semi")
        held, often = self._postings(packed), packed.groupBy("gram").agg(F.sum("docs").alias("_df"))
        rare = grams.join(often, "gram").groupBy("query_id").agg(F.min_by("gram", F.struct("_df", "gram")).alias("gram"))
        found = rare.join(held, "gram").select("query_id", "doc_id", "field")
        met = found.join(grams, "query_id").join(held, ["gram", "doc_id", "field"])
        hits = _together(met.withColumn("at", F.explode("ats")), ["query_id", "doc_id", "field"], F.col("need"))
        for n in (1, 2):
            heads = asked.where(F.col("size") == n).select("query_id", code(0, n).alias("head"))
            head = F.shiftright("gram", (3 - n) * _SHIFT).alias("head")
            part = self._postings(self._packed().where("gram >= 0").join(heads.select("head").distinct(), F.shiftright("gram", (3 - n) * _SHIFT) == F.col("head"), "left_semi")).select("*", head).join(heads, "head")
            hits = hits.unionByName(part.groupBy("query_id", "doc_id", "field").agg(F.sum(F.size("positions")).cast("bigint").alias("n")))
        return hits

    def scored(self, hits: DataFrame, by: list[str], settings: Search = Search()) -> DataFrame:
        """``by``, doc_id, score and the stored columns of hits in measured fields; ``hits`` also has short, whether its phrase has fewer than three code points.

        Short phrases have no rank of their own: hits in the first field come first, then the others in order."""
        places = [self.fields.index(f) for f in self.measured]
        hits = hits.where(F.col("field").isin(places)).groupBy(*by, "doc_id", "short").agg(F.sum("n").alias("_tf"), F.min("field").alias("_first")).withColumn("_all", F.lit(0))
        found = hits.groupBy(*by, "_all").agg(F.count("*").cast("double").alias("_found"))
        n, total = self.totals
        mean = F.lit(float(total / n if n and total else 1.0))
        rows = hits.join(found if by else F.broadcast(found), [*by, "_all"]).join(self.documents().select("doc_id", "length", *self.stored), "doc_id")
        idf = F.greatest(F.ln((F.lit(float(n)) - F.col("_found") + 0.5) / (F.col("_found") + 0.5)), F.lit(1e-6))
        tf = F.col("_tf") * (settings.k1 + 1) / (F.col("_tf") + settings.k1 * (1 - settings.b + settings.b * F.col("length") / mean))
        order = F.array(*(F.lit(p) for p in places))
        score = F.when(F.col("short"), (1 - F.array_position(order, F.col("_first"))).cast("double")).otherwise(F.round(idf * tf, 6))
        return rows.withColumn("score", score).select(*by, "doc_id", "score", *self.stored)

    def search(self, phrase: str, settings: Search = Search()) -> DataFrame:
        """doc_id, score and the stored columns of the documents that hold the phrase in a measured field."""
        return self.scored(self.occurrences(phrase).withColumn("short", F.lit(len(phrase) < 3)), [], settings)

    def containing(self, phrase: str, fields: list[str]) -> DataFrame:
        """doc_id and the stored columns of the documents that hold the phrase in one of ``fields``; all, for an empty one."""
        rows = self.documents().drop("length", "change")
        if not phrase:
            return rows
        hits = self.occurrences(phrase).where(F.col("field").isin([self.fields.index(f) for f in fields])).select("doc_id").distinct()
        return rows.join(hits, "doc_id", "left_semi")

    def best(self, queries: DataFrame, k: int, settings: Search = Search()) -> DataFrame:
        """query_id, rank, doc_id, score and the stored columns: the ``k`` best documents of each phrase (query_id, phrase)."""
        hits = self.many(queries).join(queries.select("query_id", (F.length("phrase") < 3).alias("short")), "query_id")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return self.scored(hits, ["query_id"], settings).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _together(rows: DataFrame, by: list[str], need: Column) -> DataFrame:
    """``by`` and n: starts of a phrase, from the positions of its grams at their places (at)."""
    shifted = F.when(F.col("at") == 0, F.col("positions")).otherwise(F.transform("positions", lambda p: p - F.col("at")))
    lists = rows.withColumn("_p", shifted).groupBy(*by).agg(F.collect_list("_p").alias("_lists"), F.count("*").alias("_have"), F.max(need).alias("_need"))
    both = F.aggregate(F.slice("_lists", 2, 1 << 20), F.get("_lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return lists.where("_have = _need").select(*by, F.size(both).cast("bigint").alias("n")).where("n > 0")
