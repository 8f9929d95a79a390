"""Exact deduplication by an exchange of Golomb-coded fingerprints (operator 12).

Texts are equal if they are identical after each run of white space is replaced by one space. A text's
fingerprint is the first ``bits`` bits of its SHA-256, so many that of N different texts about one in
``FALSE`` shares its fingerprint with another by chance.

1. Rows are dealt into blocks where they lie. Each row gets its fingerprint and its place among the
   block's distinct fingerprints, and the blocks are written as a table bucketed by block.
2. A block sorts its fingerprints and sends each owner, a range of fingerprints, the gaps of its part as a
   Golomb code with a power of two as divisor. These codes are all that moves for a text nobody shares.
3. An owner decodes what it got and answers each block with a bitmap: which fingerprints other blocks
   hold too. What repeats inside a block is known there already.
4. The bitmaps join the blocks by block; the table's buckets stay where they are. Rows whose bit is set or
   whose fingerprint repeats inside the block are suspects. Only they are shuffled, grouped by fingerprint and whole normalised
   text, byte for byte, so chance suspects come out as groups of one.

A text that a third of all rows hold is one fingerprint in each block, is combined inside each task before
the suspects are shuffled, and its rows meet their group in a join that adaptive execution splits.

Nulls: a null text counts as empty. Of equal texts the row with the smallest doc_id stays; rows without a
doc_id come last, and of rows that repeat a doc_id and a text one stays. Every row is in the result, with
keep_id null where no row of its group has a doc_id. Empty input: no rows. Extra columns pass through
``classes``; those named keep_id, group_size, kept or text_sha256 are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspan.llm import _text as tx
from knowspan.llm._scratch import Scratch, documents, others

#: A different text shares its fingerprint with another by chance once in so many.
FALSE = 64
#: A block ends at so many rows or bytes; a task holds one.
BLOCK_ROWS, BLOCK_BYTES = 65_536, 24 << 20
#: Fingerprints of an owner.
OWNER = 1 << 21
ADDED = ["keep_id", "group_size", "kept", "text_sha256"]
_OWN = ["_block", "_row", "_owner", "_at", "_print", "_again", "_sha"]
#: White space of the contract, for the JVM's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"


def normal(text: bytes) -> bytes:
    """Each run of \\x20 and \\x09-\\x0D as one space; ``bytes.split`` splits at exactly these."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return b" " * text[:1].isspace() + b" ".join(words) + b" " * text[-1:].isspace()


def golomb(gaps: np.ndarray) -> tuple[int, bytes]:
    """(k, code) of gaps of at least 0: the quotients by 2**k in unary, then the remainders in k bits each."""
    n = len(gaps)
    if not n:
        return 0, b""
    k = max(0, int(np.log2(max(float(gaps.mean()) * 0.6931, 1.0))))
    high, low = gaps >> k, gaps & ((1 << k) - 1)
    ends = np.cumsum(high + 1) - 1  # each quotient is so many zeros and a one
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = ((low[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    return k, np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def ungolomb(n: int, k: int, code: bytes) -> np.ndarray:
    """The ``n`` gaps of a code."""
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(code, np.uint8)
    tail = -(-n * k // 8)
    unary = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))
    high = np.diff(unary, prepend=-1) - 1
    rest = np.unpackbits(raw[len(raw) - tail :], count=n * k).reshape(n, k).astype(np.int64) if k else np.zeros((n, 0), np.int64)
    return (high.astype(np.int64) << k) | (rest << np.arange(k - 1, -1, -1)).sum(1)


def bounds(bits: int, owners: int) -> np.ndarray:
    """The first fingerprint of each owner."""
    return np.array([-(-(o << bits) // owners) for o in range(owners)], np.int64)


def printed(docs: DataFrame, bits: int, owners: int, names: list[str]) -> DataFrame:
    """The columns ``names``, text among them, with the row's block and number, its fingerprint's owner and place there, the fingerprint, whether the block repeats it, and the text's SHA-256."""
    at, first = names.index("text"), bounds(bits, owners)
    kinds = dict(docs.dtypes) | {"text": "string"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", _block bigint, _row bigint, _owner int, _at int, _print bigint, _again boolean, _sha string"

    def block(number: int, held: list[pa.RecordBatch], digests: list[bytes]) -> Iterator[pa.RecordBatch]:
        prints = (np.frombuffer(b"".join(d[:8] for d in digests), ">u8") >> np.uint64(64 - bits)).astype(np.int64)
        distinct, place, count = np.unique(prints, return_inverse=True, return_counts=True)
        owner = np.searchsorted(first, prints, side="right") - 1
        place = place - np.searchsorted(distinct, first[owner])
        columns = [np.full(len(prints), number), (number << 17) + np.arange(len(prints)), owner.astype(np.int32), place.astype(np.int32), prints, count[np.searchsorted(distinct, prints)] > 1]
        columns = [*map(pa.array, columns), pa.array([d.hex() for d in digests])]
        done = 0
        for batch in held:
            yield pa.RecordBatch.from_arrays([*batch.columns, *(c.slice(done, len(batch)) for c in columns)], [*names, *_OWN])
            done += len(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held, digests, size = [], [], 0
        for batch in batches:
            raw, offsets = tx.buffers(batch.column(at))
            data, cuts = memoryview(raw), offsets.tolist()
            held.append(batch)
            digests += [hashlib.sha256(normal(bytes(data[a:z]))).digest() for a, z in zip(cuts, cuts[1:])]
            size += len(raw)
            if len(digests) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                yield from block(number, held, digests)
                held, digests, size, number = [], [], 0, number + 1
        if digests:
            yield from block(number, held, digests)

    return docs.select(*(F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def sent(rows: DataFrame, bits: int, owners: int) -> DataFrame:
    """block, owner, n, k, code: what each block sends to each owner, also where it has nothing for it."""
    sets = rows.groupBy("_block").agg(F.sort_array(F.collect_set("_print")).alias("prints"))  # by block, as the table lies
    first = bounds(bits, owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, prints in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = prints.values.to_numpy()
                cut = np.append(np.searchsorted(mine, first), len(mine))
                codes = [golomb(np.diff(mine[a:z], prepend=low)) for a, z, low in zip(cut, cut[1:], first)]
                columns = [np.full(owners, block), np.arange(owners, dtype=np.int32), np.diff(cut).astype(np.int32), np.array([k for k, _ in codes], np.int32), [c for _, c in codes]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "owner", "n", "k", "code"])

    return sets.mapInArrow(run, "block bigint, owner int, n int, k int, code binary")


def answered(codes: DataFrame, bits: int, owners: int) -> DataFrame:
    """block, owner, words: the bitmap of the fingerprints that other blocks hold too, 64 bits a word."""
    first = bounds(bits, owners)

    def run(table: pa.Table) -> pa.Table:
        low, n = first[table.column("owner")[0].as_py()], table.column("n").to_numpy()
        lists = [low + np.cumsum(ungolomb(m, k, code)) for m, k, code in zip(n.tolist(), table.column("k").to_pylist(), table.column("code").to_pylist())]
        _, which, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        shared, at, words = count[which] > 1, np.concatenate([[0], np.cumsum(n)]), []
        for a, z in zip(at, at[1:]):
            room = np.zeros(-(-(z - a) // 64) * 64, np.uint8)
            room[: z - a] = shared[a:z]
            words.append(np.packbits(room, bitorder="little").view("<i8"))
        return pa.table({"block": table.column("block"), "owner": table.column("owner"), "words": pa.array(words, pa.list_(pa.int64()))})

    return codes.groupBy("owner").applyInArrow(run, "block bigint, owner int, words array<bigint>")


def classes(spark: SparkSession, docs: DataFrame, digest: bool = False, bits: int | None = None) -> DataFrame:
    """The columns of ``docs`` with keep_id, group_size, kept and text_sha256, one row for each row.

    ``digest``: of the columns of ``docs`` only doc_id. ``bits``: the length of fingerprints; few make many chance suspects and change no result."""
    scratch, name = Scratch(spark, "exact"), f"knowspan_exact_{uuid.uuid4().hex}"
    names = ["doc_id", "text"] if digest else others(docs, [*ADDED, *_OWN])
    out = [F.col(f"`{c}`") for c in names if c != "text" or not digest]
    n = docs.count()
    bits = bits or min(56, max(16, (n * FALSE).bit_length()))
    owners = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // OWNER)), 1 << min(bits, 16))
    printed(docs, bits, owners, names).write.bucketBy(owners, "_block").option("path", scratch.at("rows")).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    answers = answered(sent(rows, bits, owners), bits, owners).groupBy(F.col("block").alias("_block"))
    maps = scratch.table("maps", answers.agg(F.transform(F.sort_array(F.collect_list(F.struct("owner", "words"))), lambda m: m["words"]).alias("_maps")))
    word = F.get(F.get("_maps", F.col("_owner")), F.shiftright("_at", 6))
    met = rows.join(maps.hint("shuffle_hash"), "_block").withColumn("_suspect", F.col("_again") | (F.bit_get(word, F.col("_at").bitwiseAND(63)) == 1))
    alone = met.where("not _suspect").select(*out, F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    suspects = scratch.table("suspects", met.where("_suspect").select(*names, "_row", "_print", "_sha"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ").alias("_text")
    groups = suspects.groupBy("_print", "_sha", text).agg(F.min("doc_id").alias("_keep"), F.min_by("_row", "doc_id").alias("_first"), F.min("_row").alias("_least"), F.count("*").alias("_size"))
    groups = scratch.table("groups", groups.select("_print", "_sha", "_keep", F.coalesce("_first", "_least").alias("_first"), "_size"))
    if not groups.groupBy("_print", "_sha").count().where("count > 1").isEmpty():
        raise ValueError("two different texts have one SHA-256")
    group = suspects.join(groups, ["_print", "_sha"])
    group = group.select(*out, F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_row") == F.col("_first")).alias("kept"), F.col("_sha").alias("text_sha256"))
    return alone.unionByName(group)


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    kept = classes(spark, docs).where("kept")
    return kept.select(*(F.col(f"`{c}`") for c in others(docs, ADDED)))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, documents(spark, sf_dir), digest=True)


QUERIES = {"op12_exact_dedup": op12_exact_dedup}
SQL = {
    "op12_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
}
