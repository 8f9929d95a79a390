"""Line deduplication against levelled sorted runs (operator 9).

A line's key is the line stripped of white space at both ends, with A-Z lower-cased. A key of at
least ``min_chars`` code points that two or more documents hold loses its lines in all of them but
the one with the smallest doc_id. Documents come in batches by ascending doc_id. The keys seen so
far lie in sorted runs, disjoint in their keys: each batch is reduced to one row for each key, merge
joined with the runs, and what no run holds becomes a new run; ``FANOUT`` runs of a level are merged
into one of the next, so a key is rewritten once for each level only. A new batch of another day is
one more ``admit``.

Keys travel as 128-bit hashes. Rows of a key are reduced to its smallest doc_id before they are
shuffled, and the join that finds the lines to drop reads only keys held twice; adaptive execution
splits its hot keys.

Nulls: a null or empty text is one empty line, and its kept text is empty. A row with a null doc_id
loses every line that a document with an id holds; what only such rows hold stays in all of them. Repeated rows of one doc_id are one document to the
rule: none loses lines to the other. Lines shorter than ``min_chars`` always stay. Empty input: no
rows. Extra columns pass through ``dedup``; those named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspan.llm import _text as tx
from knowspan.llm._scratch import Scratch, documents, others

MIN_CHARS = 10
BATCHES = 4
#: Runs of a level that are merged into one of the next level.
FANOUT = 3
_STRIP = bytes([0x20, *range(0x09, 0x0E)])
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def line_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of all lines, before stripping; an empty text has one."""
    breaks = np.flatnonzero(raw == 0x0A)
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    n = len(offsets) - 1
    doc = np.concatenate([np.arange(n), owner])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, doc))
    doc, starts = doc[order], starts[order]
    last = np.append(doc[1:] != doc[:-1], True)
    ends = np.where(last, offsets[1:][doc], np.append(starts[1:] - 1, 0))
    return starts, ends, doc


def line_keys(raw: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, text index) of the lines whose keys have at least ``min_chars`` code points."""
    starts, ends, doc = line_spans(raw, offsets)
    visible = np.flatnonzero(~tx.SPACE[raw]) if len(raw) else np.zeros(0, np.int64)
    a, z = np.searchsorted(visible, starts), np.searchsorted(visible, ends)
    some = z > a
    doc, a, z = doc[some], visible[a[some]], visible[z[some] - 1] + 1
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    long = chars[z] - chars[a] >= min_chars
    doc, a, z = doc[long], a[long], z[long]
    low = tx.LOWER[raw]
    return tx.span_hashes(low, a, z), tx.span_hashes(low, a, z, second=True), doc


def keys_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, h1, h2: the distinct line keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            raw, offsets = tx.buffers(batch.column(1))
            for i, j, part, offs in tx.slices(raw, offsets):
                h1, h2, doc = line_keys(part, offs, min_chars)
                if len(h1):
                    rows = np.unique(np.rec.fromarrays([doc, h1, h2]))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows.f0 + i)), pa.array(rows.f1.view(np.int64)), pa.array(rows.f2.view(np.int64))], ["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, h1 bigint, h2 bigint")


class LineRuns:
    """The keys seen so far, as levels of sorted runs with the first document of each key."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT):
        self.scratch, self.fanout, self.count = scratch, fanout, 0
        self.levels: list[list[DataFrame]] = []

    def _add(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:  # compact
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.unionByName(other)
            self.count += 1
            merged = self.scratch.table(f"merged-{self.count}", merged.repartition("h1", "h2").sortWithinPartitions("h1", "h2"))
            self.levels[level] = []
            self._add(level + 1, merged)

    def admit(self, keys: DataFrame) -> DataFrame:
        """Join a batch (doc_id, h1, h2) with the runs and add its new keys as a run.

        Returns h1, h2, owner of the keys by which documents of this batch lose lines: all but ``owner``."""
        own = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.count("*").alias("holders"))
        runs = [run.select("h1", "h2", F.col("owner").alias("_first")) for level in self.levels for run in level]
        if runs:
            seen = runs[0]
            for run in runs[1:]:
                seen = seen.unionByName(run)
            own = own.join(seen, ["h1", "h2"], "left")
        else:
            own = own.withColumn("_first", F.lit(None).cast("bigint"))
        self.count += 1
        own = own.select("h1", "h2", F.coalesce("_first", "owner").alias("owner"), "holders", F.col("_first").isNull().alias("fresh"))
        batch = self.scratch.table(f"batch-{self.count}", own.sortWithinPartitions("h1", "h2"), ["fresh"])
        self._add(0, batch.where("fresh and owner is not null").select("h1", "h2", "owner"))
        return batch.where("owner is not null and (not fresh or holders > 1)").select("h1", "h2", "owner")


def drops(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, hashes: for each document that loses lines, their keys as pairs of hashes one after the other."""
    bounds = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    number = F.lit(0)
    for b in sorted({int(x) for x in bounds}):
        number = number + F.when(F.col("doc_id") >= b, 1).otherwise(0)
    number = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(number).cast("int")
    keys = scratch.table("keys", keys_of(docs, min_chars).withColumn("batch", number), ["batch"])
    runs, lost = LineRuns(scratch), None
    for k in sorted(r.batch for r in keys.select("batch").distinct().collect()):  # ``batches`` + 1 rows at most
        found = runs.admit(keys.where(F.col("batch") == k)).withColumn("batch", F.lit(k))
        lost = found if lost is None else lost.unionByName(found)
    if lost is None:
        return docs.select("doc_id", F.array().cast("array<bigint>").alias("hashes")).where("false")
    hit = keys.join(lost, ["batch", "h1", "h2"]).where("doc_id is null or doc_id <> owner")
    return scratch.table("drops", hit.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("h1", "h2"))).alias("hashes")))


def keep(text: bytes, hashes: np.ndarray, min_chars: int) -> tuple[bytes, int, int]:
    """(kept text, lines, lines dropped) of one text."""
    lines = text.split(b"\n")
    if not len(hashes):
        return text, len(lines), 0
    raw, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64)
    starts, ends, _ = line_spans(raw, offs)
    gone = {(int(a), int(b)) for a, b in hashes.reshape(-1, 2)}
    keys = [line.strip(_STRIP).translate(_FOLD) for line in lines]
    at = [k for k, key in enumerate(keys) if len(key.decode()) >= min_chars]
    joined = b"".join(keys[k] for k in at)
    z = np.cumsum([len(keys[k]) for k in at], dtype=np.int64)
    a = z - np.array([len(keys[k]) for k in at], np.int64)
    flat = np.frombuffer(joined, np.uint8)
    pairs = zip(tx.span_hashes(flat, a, z).view(np.int64).tolist(), tx.span_hashes(flat, a, z, second=True).view(np.int64).tolist())
    dropped = {k for k, pair in zip(at, pairs) if pair in gone}
    return b"\n".join(line for k, line in enumerate(lines) if k not in dropped), len(lines), len(dropped)


def dedup(spark: SparkSession, docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, digest: bool = False) -> DataFrame:
    """The columns of ``docs`` with text replaced by what stays, and n_lines, n_dropped.

    ``digest``: only doc_id, n_lines, n_dropped and kept_sha256."""
    lost = drops(docs, Scratch(spark, "lines"), batches, min_chars)
    names = ["doc_id"] if digest else others(docs, ["n_lines", "n_dropped"])
    joined = docs.alias("d").join(lost.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")), "left")
    joined = joined.select(*(F.col(f"d.`{c}`") for c in names), F.col("d.text").cast("string").alias("_knowspan_text"), F.col("l.hashes").alias("_knowspan_hashes"))
    at = len(names)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            raw, offsets = tx.buffers(batch.column(at))
            hashes = batch.column(at + 1)
            missing = hashes.is_valid().to_numpy(zero_copy_only=False)
            data = raw.tobytes()
            bounds = offsets.tolist()
            found = [keep(data[a:z], np.array(hashes[k].as_py(), np.int64) if missing[k] else np.zeros(0, np.int64), min_chars) for k, (a, z) in enumerate(zip(bounds, bounds[1:]))]
            more = [pa.array([n for _, n, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())]
            if digest:
                columns = [batch.column(0), *more, pa.array([hashlib.sha256(t).hexdigest() for t, _, _ in found])]
            else:
                texts = pa.array([t.decode() for t, _, _ in found], pa.string())
                columns = [texts if c == "text" else batch.column(k) for k, c in enumerate(names)] + more
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped", *["kept_sha256"] * digest])

    kinds = dict(docs.dtypes) | {"text": "string"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_lines bigint, n_dropped bigint" + ", kept_sha256 string" * digest
    return joined.mapInArrow(run, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, documents(spark, sf_dir), digest=True)


QUERIES = {"op9_line_dedup": op9_line_dedup}
SQL = {
    "op9_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, p AS pos, list_extract(l, p) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) t,
       LATERAL unnest(range(1, len(l) + 1)) AS u(p)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT keyed.doc_id, pos, line, owner IS NOT NULL AND owner <> keyed.doc_id AS gone
  FROM keyed LEFT JOIN owners ON keyed.k = owners.k AND length(keyed.k) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
