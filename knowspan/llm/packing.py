"""Best-fit packing of tokenised documents by minimum bin slack (operator 2).

Documents become pieces of at most ``capacity`` tokens. Pieces of one length are interchangeable, so
the packing is decided on the histogram of lengths, which has at most ``capacity`` rows whatever the
corpus: for each bin, a bitset subset-sum over the available lengths finds the fullest combination
that holds the longest piece left, and removes it. As long as that combination is available it stays
the fullest (what is available only shrinks), so it is taken as often as the counts allow at once.
Every piece then finds its place by its rank among the pieces of its length; ranks are counted in
salted groups, so a length that a third of all pieces have is no single group.

Nulls: a null text is the empty text (one piece, the end id). A row with a null doc_id is kept and
packed. Repeated rows are packed as often as they occur. Empty input: no rows. A very long text is
cut into many pieces. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.llm import _tokens
from knowspan.llm._scratch import Scratch, documents

CAPACITY = 1024
END_ID = 2
#: Groups that the pieces of one length are ranked in.
SALTS = 256


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths in ``counts``, the multiset with the largest sum of at most ``room``."""
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, bits))
            bits |= (bits << (take * length)) & mask
            left, k = left - take, k * 2
        if bits >> room & 1:
            break
    total, chosen = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:  # reached only with this step
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths in a bin, number of such bins) until no piece is left."""
    counts, bins = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = fullest(counts, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[x] // k for x, k in chosen.items())
        bins.append((chosen, times))
        for x, k in chosen.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
    return bins


def places(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a bin, offset in the bin), by length and rank."""
    rows, sequence, used = [], 0, {}
    for chosen, times in bins:
        offset = 0
        for length in sorted(chosen, reverse=True):
            rows.append((length, used.get(length, 0), sequence, chosen[length], offset))
            used[length] = used.get(length, 0) + chosen[length] * times
            offset += chosen[length] * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): whole texts cut only where they are too long; the first piece may be shorter."""
    import zlib

    path = tokenizer or _tokens.tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for row, ids in _tokens.encode_column(batch.column(1), path):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                first = len(ids) % capacity or capacity
                at = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, z) in enumerate(zip(at, at[1:])):
                    part = ids[a:z].tobytes()
                    out.append((keys[row], k, a, z - a, zlib.crc32(part), part if keep_ids else None))
                if len(out) >= 20_000 or keep_ids and len(out) >= 2_000:
                    yield _batch(out, keep_ids)
                    out = []
            if out:
                yield _batch(out, keep_ids)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def _batch(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    n = 6 if keep_ids else 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows))[:n], kinds)], names[:n])


def pack_pieces(parts: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length."""
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")
    parts = scratch.table("pieces", parts.withColumn("_salt", salt))
    counts = scratch.table("counts", parts.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    table = places(minimum_bin_slack(histogram, capacity))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    ranked = parts.withColumn("_rank", rank).join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_rank") - 1)
    names = [c for c in parts.columns if c != "_salt"]
    ranked = ranked.select(*names, "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            more = [pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + more, [*names, "sequence_id", "offset"])

    kinds = dict(parts.dtypes)
    return ranked.mapInArrow(place, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id bigint, offset bigint")


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``capacity`` tokens."""
    return pack_pieces(pieces(docs, capacity, end_id, tokenizer, keep_ids), Scratch(spark, "packing"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
SQL: dict[str, str] = {}  # DuckDB has no tokenizer
