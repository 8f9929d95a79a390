"""WARC archives and their Merkle fixity audit (operator 10).

``archive`` writes pages as WARC files, each record a gzip member of its own, and returns for each file
where its records lie and their SHA-256. A replica is read back by these ordered offset ranges. Leaves
hash the bytes of a record as found, with its range; ``FAN`` neighbours in order make a node, up to one
root for each replica. The digests of the writing make a tree of their own, so what is damaged alike in
all replicas differs too. The audit compares the roots, and from there on reads only the children of nodes
that differ, level by level, down to the records. The digests tell which replica is wrong.

A record's position is (task, file, number in the file) as one number, so a node's place is its position
without its last digits and no global order has to be counted. Files are bounded in records and bytes;
they are written under a name of their own attempt and then renamed.

Nulls: a null url gives a record without a target, a null html an empty payload; a null page_id is
archived and reported as null. Repeated rows are records each. A missing or short file makes the records
that can't be read damaged; bytes after the last record of a file make that one damaged. Files that the
archive didn't write aren't looked for. A very long page is a file of its own size and read whole by one
task. Empty input: no files, no rows. Extra columns are ignored, as only page_id, url and html are read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspan.llm._scratch import Scratch, documents

FAN_BITS, FILE_BITS, RECORD_BITS = 6, 12, 12
FILE_BYTES = 16 << 20
#: The tree of the digests and ranges of the writing, beside those of the replicas.
WRITTEN = ""
#: Records with these page_ids are damaged in the second replica of the drill.
DRILL = (997, 1)
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "base bigint, name string, page_ids array<bigint>, offsets array<bigint>, lengths array<bigint>, digests array<string>"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC 1.0 response record."""
    payload = (html or "").encode()
    name = uuid.UUID(bytes=hashlib.md5(f"{page_id}|{url}".encode()).digest())
    target = f"WARC-Target-URI: {url}\r\n" if url is not None else ""
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\n{target}WARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(folder: str, name: str, data: bytes) -> None:
    store, base = _file_system(folder)
    store.create_dir(base, recursive=True)
    trial = f"{base}/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(trial, compression=None) as out:
        out.write(data)
    store.move(trial, f"{base}/{name}")


def _get(folder: str, name: str) -> bytes:
    store, base = _file_system(folder)
    try:
        with store.open_input_stream(f"{base}/{name}", compression=None) as f:
            return f.read()
    except FileNotFoundError:
        return b""


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write the files under ``folder``; returns, not yet run, a row for each (see SCHEMA)."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            if seq >= 1 << FILE_BITS:
                raise ValueError("a task writes more files than a position can number; use smaller partitions")
            name, lengths = f"part-{part:06d}-{seq:04d}.warc.gz", [len(data) for _, data in held]
            _put(folder, name, b"".join(data for _, data in held))
            row = {"base": [(part << FILE_BITS | seq) << RECORD_BITS], "name": [name], "page_ids": [[k for k, _ in held]], "offsets": [[0, *np.cumsum(lengths).tolist()[:-1]]], "lengths": [lengths], "digests": [[hashlib.sha256(data).hexdigest() for _, data in held]]}
            held, size, seq = [], 0, seq + 1
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(row.values(), kinds)], list(row))

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((page_id, gzip.compress(record(page_id, url, html), 6, mtime=0)))
                size += len(held[-1][1])
                if size >= FILE_BYTES or len(held) == 1 << RECORD_BITS:
                    yield flush()
        if held:
            yield flush()

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(save, SCHEMA)


def replicate(files: DataFrame, source: str, target: str, damage: Callable[[int | None], bool] | None = None) -> DataFrame:
    """Copy the files; ``damage`` picks records of which a bit is flipped on the way, as a drill. Returns the names, not yet run."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                data = bytearray(_get(source, name))
                for k, a, n in zip(ids, offsets, lengths):
                    if damage and damage(k):
                        data[a + n // 2] ^= 1
                _put(target, name, bytes(data))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    return files.select("name", "page_ids", "offsets", "lengths").mapInArrow(copy, "name string")


def leaves(files: DataFrame, replicas: dict[str, str]) -> DataFrame:
    """replica, pos, node: the hash of each record as it lies in each replica, with its range; ``WRITTEN`` has those of the digests.

    The last record of a file reaches to the file's end as found, so bytes after it are in the tree too."""
    if WRITTEN in replicas:
        raise ValueError("a replica needs a name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, name, offsets, lengths, digests in zip(*(c.to_pylist() for c in batch.columns)):
                ends = [a + n for a, n in zip(offsets[:-1], lengths)] + [None]
                for replica, folder in [(WRITTEN, None), *replicas.items()]:
                    data = memoryview(_get(folder, name) if folder else b"")
                    found = [hashlib.sha256(data[a:z]).hexdigest() for a, z in zip(offsets, ends)] if folder else digests
                    nodes = [hashlib.sha256(f"{a}-{n}|{x}".encode()).hexdigest() for a, n, x in zip(offsets, lengths, found)]
                    yield pa.RecordBatch.from_pydict({"replica": [replica] * len(nodes), "pos": pa.array(base + np.arange(len(nodes))), "node": nodes})

    return files.select("base", "name", "offsets", "lengths", "digests").mapInArrow(run, "replica string, pos bigint, node string")


def trees(found: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The levels of all replicas' trees, leaves first, roots last; each written once."""
    levels = [scratch.table("level-0", found)]
    while (levels[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        children = F.array_sort(F.collect_list(F.struct("pos", "node")))  # FAN children at most
        joined = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["pos"].cast("string"), c["node"])), "|")
        up = levels[-1].groupBy("replica", F.shiftright("pos", FAN_BITS).alias("up")).agg(F.sha2(joined, 256).alias("node"))
        levels.append(scratch.table(f"level-{len(levels)}", up.select("replica", F.col("up").alias("pos"), "node")))
    return levels


def mismatches(levels: list[DataFrame], replicas: int, scratch: Scratch) -> DataFrame:
    """The positions of records that differ between replicas, found from the roots down."""
    odd = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        if odd is not None:
            level = level.withColumn("up", F.shiftright("pos", FAN_BITS)).join(odd.withColumnRenamed("pos", "up"), "up", "left_semi")
        differ = level.groupBy("pos").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"))
        odd = scratch.table(f"odd-{k}", differ.where(f"a <> b or n <> {replicas}").select("pos"))
        if odd.isEmpty():
            return odd
    return odd


def audit(files: DataFrame, replicas: dict[str, str], scratch: Scratch) -> DataFrame:
    """page_id, file, offset, length, digest of each record and the replicas in which it is damaged."""
    levels = trees(leaves(files, replicas), scratch)
    odd = mismatches(levels, len(replicas) + 1, scratch)  # and the tree of what was written
    rows = files.select("base", "name", F.posexplode(F.arrays_zip("page_ids", "offsets", "lengths", "digests")).alias("k", "r"))
    rows = rows.select((F.col("base") + F.col("k")).alias("pos"), F.col("r.page_ids").alias("page_id"), F.col("name").alias("file"), F.col("r.offsets").alias("offset"), F.col("r.lengths").alias("length"), F.col("r.digests").alias("digest"))
    seen = levels[0].join(odd, "pos", "left_semi").groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("replica", "node"))).alias("nodes"))
    expected = F.sha2(F.concat(F.concat_ws("-", "offset", "length"), F.lit("|"), F.col("digest")), 256)
    names = F.array(*(F.lit(r) for r in sorted(replicas)))
    rows = rows.join(seen, "pos", "left").withColumn("_expected", expected)
    wrong = F.filter(names, lambda r: F.coalesce(F.element_at("nodes", r) != F.col("_expected"), F.lit(True)))
    damaged = F.when(F.col("nodes").isNull(), F.array().cast("array<string>")).otherwise(wrong)
    return rows.select("page_id", "file", "offset", "length", "digest", damaged.alias("damaged_in"))


def op10_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, copy the archive with the drill's damage, audit the two replicas."""
    scratch = Scratch(spark, "warc")
    first, second = scratch.at("replica-a"), scratch.at("replica-b")
    files = scratch.table("files", archive(documents(spark, sf_dir, "pages"), first))
    files = files.repartition(max(1, files.count()))
    scratch.table("copied", replicate(files, first, second, lambda k: k is not None and k % DRILL[0] == DRILL[1]))
    return audit(files, {"a": first, "b": second}, scratch)


QUERIES = {"op10_merkle_fixity": op10_merkle_fixity}
SQL: dict[str, str] = {}  # archives are files; tests hold the audit against a plain comparison of all records
