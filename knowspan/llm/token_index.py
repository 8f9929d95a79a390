"""Token ids in binary shards, addressed through a minimal perfect hash (operator 7).

Documents are dealt by ranges of doc_id, so the shards in order hold them ascending. A shard file is

    magic | sizes | keys, ascending | first ids of rows | perfect hash | fingerprint and row of each slot | ids

with ids as raw little-endian uint16. The hash is a cascade of bit arrays: a key that is alone at its
place in a level has its bit set there, the others go to the next level; the rank of the bit is the
key's slot, from 0 to the number of keys less 1. A slot keeps a 32-bit fingerprint of its key, which
tells a key that the shard doesn't hold, and the key's row, so an access costs a few reads whatever
the size of the shard. Files are written under a name of their own attempt and then renamed, so a
task that runs again leaves the same file.

Nulls: a null text is the empty text (only the end id); rows with a null doc_id are stored before all
others, in an order of hashes of their texts, by which they are dealt too, as they may be many. They have
no key, so no lookup finds them; ``read`` returns them with a null doc_id. Rows that repeat a doc_id are
stored each, in the order of their texts; a lookup finds the first, the others follow it. Empty input: no
files, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.llm import _tokens
from knowspan.llm._scratch import Scratch, documents
from knowspan.llm._text import mix

END_ID = 0
MAGIC = b"KNOWTOK2"
#: Ids in a shard; a partition that holds more writes several.
SHARD_IDS = 8 << 20
_U = np.uint64


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    GAMMA, LEVELS, BLOCK = 2.0, 40, 512

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest  # bits of each level, all bits, keys beyond the last level
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        block = np.add.reduceat(np.bitwise_count(words).astype(np.int64), np.arange(0, len(words), self.BLOCK // 64)) if len(words) else np.zeros(0, np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(block)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys.astype(_U) + mix(np.array([level + 1], _U))) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        left, sizes, parts = keys.astype(np.int64), [], []
        while len(left) and len(sizes) < cls.LEVELS:
            size = max(64, -(-int(cls.GAMMA * len(left)) // 64) * 64)
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, "<u8"), np.sort(left))

    def _rank(self, bit: np.ndarray) -> np.ndarray:
        per = self.BLOCK // 64
        word, block = bit >> 6, bit // self.BLOCK
        rank = self.ranks[block].copy()
        for k in range(per):  # the words of the block before the bit's
            at = block * per + k
            before = at < word
            rank[before] += np.bitwise_count(self.words[at[before]])
        low = self.words[word] & ((_U(1) << (bit & 63).astype(_U)) - _U(1))
        return rank + np.bitwise_count(low)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for a key that wasn't there."""
        keys = keys.astype(np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = self.first[level] + self._place(keys[open_], level, int(size))
            hit = (self.words[bit >> 6] >> (bit & 63).astype(_U)) & _U(1) == 1
            out[open_[hit]] = self._rank(bit[hit])
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.ranks[-1] + at[hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.astype(_U) ^ _U(0x5851F42D4C957F2D)) >> _U(32)).astype("<u4")


def pack_shard(keys: np.ndarray, lengths: np.ndarray) -> bytes:
    """All of a shard but its ids. ``keys`` ascend and belong to the last rows, those before have none; a repeated key is addressed by its first row."""
    distinct, first = np.unique(keys, return_index=True)
    h = PerfectHash.build(distinct)
    slot = h.slots(distinct)
    prints, rows = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[slot], rows[slot] = fingerprints(distinct), first + len(lengths) - len(keys)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    sizes = np.array([len(lengths), len(keys), len(distinct), len(h.sizes), len(h.words), len(h.rest), starts[-1]], "<i8")
    return b"".join([MAGIC, *(x.tobytes() for x in (sizes, keys.astype("<i8"), starts, h.sizes.astype("<i8"), h.words.astype("<u8"), h.rest.astype("<i8"), prints, rows))])


class Shard:
    """A shard file, opened for keyed access."""

    def __init__(self, uri: str):
        self.file = _file_system(uri)[0].open_input_file(_file_system(uri)[1])
        head = self.file.read(8 + 56)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        n, keyed, distinct, levels, words, rest, self.n_ids = np.frombuffer(head[8:], "<i8").tolist()
        take = lambda count, kind: np.frombuffer(self.file.read(count * np.dtype(kind).itemsize), kind)
        self.keys, self.starts, self.nulls = take(keyed, "<i8"), take(n + 1, "<i8"), n - keyed
        self.hash = PerfectHash(take(levels, "<i8"), take(words, "<u8"), take(rest, "<i8"))
        self.prints, self.rows = take(distinct, "<u4"), take(distinct, "<u4")
        self.payload = self.file.tell()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 where the fingerprint tells that it isn't here."""
        slot = self.hash.slots(keys)
        known = (slot >= 0) & (slot < len(self.prints))
        known[known] = self.prints[slot[known]] == fingerprints(np.asarray(keys)[known])
        return np.where(known, self.rows[np.where(known, slot, 0)].astype(np.int64) if len(self.rows) else -1, -1)

    def ids(self, row: int, end: int | None = None) -> np.ndarray:
        """The ids of a row, or of the rows up to ``end``."""
        a, z = int(self.starts[row]), int(self.starts[row + 1 if end is None else end])
        self.file.seek(self.payload + 2 * a)
        return np.frombuffer(self.file.read(2 * (z - a)), "<u2")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(spark: SparkSession, docs: DataFrame, folder: str, end_id: int = END_ID, tokenizer: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards under ``folder``; returns, not yet run, a row for each: part, seq, path, n_docs, n_ids."""
    path = tokenizer or _tokens.tokenizer_path()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        lists: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal seq, keys, lists, held
            store, base = _file_system(folder)
            store.create_dir(base, recursive=True)
            name = f"{base}/shard-{part:06d}-{seq:04d}.tok"
            trial = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(trial) as out:
                out.write(pack_shard(np.array([k for k in keys if k is not None], np.int64), np.array([len(x) for x in lists], np.int64)))
                for x in lists:
                    out.write(x.tobytes())
            store.move(trial, name)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{folder}/shard-{part:06d}-{seq:04d}.tok"], "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([held], pa.int64())})
            seq, keys, lists, held = seq + 1, [], [], 0
            return row

        for batch in batches:
            own = batch.column(0).to_pylist()
            for row, ids in _tokens.encode_column(batch.column(1), path):
                if held >= shard_ids and (own[row] is None or own[row] != keys[-1]):
                    yield flush()
                keys.append(own[row])
                lists.append(np.append(ids, np.uint16(end_id)).astype("<u2"))
                held += len(lists[-1])
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", spread).sortWithinPartitions("doc_id", spread, "text")
    return dealt.mapInArrow(save, "part int, seq int, path string, n_docs bigint, n_ids bigint")


def read(shards: DataFrame) -> DataFrame:
    """A row for each stored document, from the files: doc_id, start, n_tokens, ids_crc32. ``shards`` has path and base."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(uri)
                first = shard.find(shard.keys)  # by the hash, each stored key
                fresh = np.append(True, shard.keys[1:] != shard.keys[:-1])[: len(first)]
                leader = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # the first of the rows with this key
                if (first != shard.nulls + leader).any():
                    raise ValueError(f"{uri}: the index doesn't lead to its documents")
                rows = np.concatenate([np.arange(shard.nulls), first + np.arange(len(first)) - leader])
                doc_ids = pa.array(np.concatenate([np.zeros(shard.nulls, np.int64), shard.keys]), mask=np.arange(len(rows)) < shard.nulls)
                crcs, a = np.zeros(len(rows), np.int64), 0
                while a < len(rows):  # a few MB of ids at once
                    z = max(a + 1, int(np.searchsorted(shard.starts, shard.starts[a] + (2 << 20), side="right")) - 1)
                    ids = shard.ids(a, z).astype("<u4")
                    for r in range(a, z):
                        crcs[r] = zlib.crc32(ids[shard.starts[r] - shard.starts[a] : shard.starts[r + 1] - shard.starts[a]].tobytes())
                    a = z
                yield pa.RecordBatch.from_pydict({"doc_id": doc_ids, "start": pa.array(base + shard.starts[rows]), "n_tokens": pa.array(shard.starts[rows + 1] - shard.starts[rows]), "ids_crc32": pa.array(crcs[rows])})

    return shards.select("path", "base").mapInArrow(load, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def with_bases(shards: DataFrame) -> DataFrame:
    """Adds base, the ids of all shards before. Sums are taken by part first, so no task sorts all shards."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.join(parts.select("part", "_before"), "part").withColumn("base", F.col("_before") + own)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    shards = scratch.table("shards", write(spark, documents(spark, sf_dir), scratch.at("ids")))
    located = scratch.table("located", with_bases(shards))
    return read(located.repartition(max(1, located.count())))


QUERIES = {"op7_token_shards": op7_token_shards}
SQL: dict[str, str] = {}  # DuckDB has no tokenizer
