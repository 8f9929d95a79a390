r"""How the sources of a language differ in the words they use (operator 11).

Terms are the maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A numpy lookup table
over the concatenated UTF-8 bytes of a batch finds their boundaries, so a text is never cut into Python
strings. xxhash groups the slices; each slice is compared byte for byte with the first of its group, and what
differs gets a group of its own. The batch is then a matrix of documents by terms in compressed rows, from
which come the counts and the numbers of documents by (lang, source). A task adds up its batches and hands on
one row for each (lang, source, term); Spark adds those.

A language keeps the terms that at least ``min_docs`` of its documents hold. With count the occurrences in a
group or in the whole language, N their sum over the V kept terms,

    p = 1 + floor(10^9 (count + 5) / (N + 5 V))

in whole numbers. The kept terms of a language are dealt into chunks. A chunk's matrix of sources by terms, in
compressed rows, gives the sums of |p - q| of its pairs of sources: ``numpy.add.reduceat`` over the rows adds
what differs from the p of a count of 0. Sources meet in blocks of ``SOURCES`` against all of the language.
Sums over chunks are the divergences, so nothing depends on how terms are dealt.

Nulls in text, lang or source count as ''. Every row counts as a document, also where doc_ids repeat. A group
without terms is compared like any other. A language without kept terms has pairs with value 0 and no term rows;
one with a single source has no pairs. Ties: items in the order of their UTF-8 bytes. Empty input: no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.llm import _text as tx
from knowspan.llm._scratch import Scratch, documents

MIN_DOCS, TOP = 30, 50
#: p of nothing, and what p is measured in.
EXTRA, UNIT = 5, 1_000_000_000
#: (source, term) cells of a chunk, about; sources of a block; (lang, source, term) rows that a task holds at most before it hands them on.
CELLS, SOURCES, HELD = 200_000, 256, 400_000
#: A table of languages or groups of at most so many rows is broadcast.
SMALL = 20_000
#: So many bytes of all slices are compared at once, the rest of longer ones slice by slice.
SHORT = 16
#: Bytes of terms: letters, and all bytes of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def slices(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of the terms of each text; a term never crosses two texts."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = TERM[raw]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    first[edge] |= inside[1:-1][edge]
    last[edge - 1] |= inside[1:-1][edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def grouped(data: bytes, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group): equal bytes, equal group."""
    keys = np.fromiter((digest(data[a:z]) for a, z in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, head, group = np.unique(keys, return_index=True, return_inverse=True)
    size, model = ends - starts, head[group]
    same = size == size[model]
    raw = np.frombuffer(data, np.uint8)
    for step in range(int(min(size.max(initial=0), SHORT))):  # byte ``step`` of all slices that have one
        at = np.flatnonzero(same & (size > step))
        same[at] = raw[starts[at] + step] == raw[starts[model[at]] + step]
    for i in np.flatnonzero(same & (size > SHORT)).tolist():
        same[i] = data[starts[i] : ends[i]] == data[starts[model[i]] : ends[model[i]]]
    odd: dict[bytes, int] = {}
    heads = head.tolist()
    for i in np.flatnonzero(~same).tolist():  # one hash, other bytes
        term = data[starts[i] : ends[i]]
        if term not in odd:
            odd[term] = len(heads)
            heads.append(i)
        group[i] = odd[term]
    return group, np.array(heads, np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs; each task's own sums. Every (lang, source) also has a row without a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        terms: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
            key, where = np.unique(rows[:, 0] << 40 | rows[:, 1], return_inverse=True)
            n, d = (np.bincount(where, rows[:, k], len(key)).astype(np.int64) for k in (2, 3))
            both, words = list(names), pa.array([t.decode() for t in terms], pa.string())
            lang, source = (pa.array([x[k] for x in both], pa.string()) for k in (0, 1))
            for a in range(0, len(key), 50_000):
                g, t = pa.array(key[a : a + 50_000] >> 40), pa.array(key[a : a + 50_000] & ((1 << 40) - 1))
                yield pa.RecordBatch.from_arrays([lang.take(g), source.take(g), words.take(t), pa.array(n[a : a + 50_000]), pa.array(d[a : a + 50_000])], ["lang", "source", "term", "n", "docs"])
            zero = pa.array(np.zeros(len(both), np.int64))
            yield pa.RecordBatch.from_arrays([lang, source, pa.array([None] * len(both), pa.string()), zero, zero], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            owners = np.array([names.setdefault(x, len(names)) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], np.int64)
            raw, offsets = tx.buffers(batch.column(0))
            for i, j, part, offs in tx.slices(raw, offsets, 4 << 20):
                low = tx.LOWER[part]
                starts, ends, doc = slices(low, offs)
                data = low.tobytes()
                group, heads = grouped(data, starts, ends)
                own = np.array([terms.setdefault(data[starts[h] : ends[h]], len(terms)) for h in heads.tolist()], np.int64)
                # compressed rows: for each document its terms and how often it has them
                cell, n = np.unique(doc * max(len(heads), 1) + group, return_counts=True)
                who, what = np.divmod(cell, max(len(heads), 1))
                order = np.lexsort((what, owners[i + who]))
                g, t, n = owners[i + who][order], what[order], n[order]
                first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (t[1:] != t[:-1]))) if len(g) else np.zeros(0, np.int64)
                if len(first):
                    parts.append(np.column_stack([g[first], own[t[first]], np.add.reduceat(n, first), np.add.reduceat(np.ones(len(n), np.int64), first)]))
                    held += len(first)
                if held > HELD:
                    rows = np.concatenate(parts)
                    key, where = np.unique(rows[:, 0] << 40 | rows[:, 1], return_inverse=True)
                    sums = [np.bincount(where, rows[:, k], len(key)).astype(np.int64) for k in (2, 3)]
                    parts, held = [np.column_stack([key >> 40, key & ((1 << 40) - 1), *sums])], len(key)
                    if held > HELD // 2:
                        yield from out()
                        names_now = list(names)
                        names, terms, parts, held = {}, {}, [], 0
                        owners = np.array([names.setdefault(names_now[o], len(names)) for o in owners.tolist()], np.int64)
        yield from out()

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return texts.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """p of counts, digit by digit so that no product leaves 64 bits."""
    whole = np.asarray(total + EXTRA * kept, np.int64)
    out, rest = np.divmod(np.asarray(count, np.int64) + EXTRA, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def pair_sums(ptr: np.ndarray, cols: np.ndarray, data: np.ndarray, blank: np.ndarray, kept: int, mine: np.ndarray) -> np.ndarray:
    """Sums of |p - q| over ``kept`` terms, of the rows ``mine`` with all rows.

    (ptr, cols, data) are the sources by terms in compressed rows, with p of the counts over 0; ``blank`` has each source's p of 0."""
    full, out = np.flatnonzero(np.diff(ptr)), np.zeros((len(mine), len(blank)), np.int64)
    base = np.repeat(blank, np.diff(ptr))  # of each cell, its source's p of 0
    for k, i in enumerate(mine.tolist()):
        row, own, at = np.full(kept, blank[i], np.int64), data[ptr[i] : ptr[i + 1]], cols[ptr[i] : ptr[i + 1]]
        row[at] = own
        out[k] = np.abs(own[None, :] - blank[:, None]).sum(1) + (kept - len(at)) * np.abs(blank - blank[i])  # as if all others had no counts
        if len(full):
            more = np.abs(data - row[cols]) - np.abs(base - row[cols])
            out[k, full] += np.add.reduceat(more, ptr[full])
    return out


def audit(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank: how far each source is from the others, and the terms it has more of than its language."""
    scratch = Scratch(spark, "divergence")
    counts = scratch.table("counts", counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    words = counts.where("term is not null")
    kept = words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= min_docs)
    cells = scratch.table("cells", words.select("lang", "source", "term", "n").join(kept.select("lang", "term", "all_n"), ["lang", "term"]))
    groups = counts.where("term is null").select("lang", "source").join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells")), ["lang", "source"], "left").na.fill(0)
    groups = scratch.table("groups", groups)
    each = groups.groupBy("lang").agg(F.sum("total").alias("all_total"), F.sum("cells").alias("cells"), F.count("*").alias("sources"))
    each = each.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").na.fill(0)
    each = scratch.table("langs", each.select("lang", "all_total", "kept", F.ceil(F.greatest("cells", F.lit(1)) / CELLS).cast("int").alias("chunks"), F.ceil(F.col("sources") / SOURCES).cast("int").alias("blocks")))
    each = F.broadcast(each) if each.count() <= SMALL else each
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    left = cells.join(each.select("lang", "chunks", "blocks"), "lang").select("lang", "source", "term", "n", "all_n", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"), blocks)
    right = groups.join(each, "lang").select("lang", "source", "total", "all_total", "kept", "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = right.select("lang", "source", "total", "all_total", "kept", "own", "chunk", blocks)

    def met(table: pa.Table, sources: pa.Table) -> pa.Table:
        empty = {"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "part": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())}
        if not sources.num_rows:
            return pa.table(empty)
        names = sources.column("source").to_pylist()
        place = {s: k for k, s in enumerate(names)}
        block, lang, kept_n = sources.column("block")[0].as_py(), sources.column("lang")[0].as_py(), sources.column("kept")[0].as_py()
        total, all_total = sources.column("total").to_numpy(), sources.column("all_total")[0].as_py()
        mine = np.flatnonzero(sources.column("own").to_numpy() == block)
        blank = share(np.zeros(len(names), np.int64), total, kept_n) if kept_n else np.zeros(len(names), np.int64)
        row = np.array([place[s] for s in table.column("source").to_pylist()], np.int64)
        coded = table.column("term").combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
        col, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        n, all_n = (table.column(c).to_numpy() for c in ("n", "all_n"))
        order = np.lexsort((col, row))
        row, col, n, all_n = row[order], col[order], n[order], all_n[order]
        ptr = np.searchsorted(row, np.arange(len(names) + 1))
        p = share(n, total[row], kept_n) if len(row) else np.zeros(0, np.int64)
        sums = pair_sums(ptr, col, p, blank, len(terms), mine)
        a, b = np.nonzero(mine[:, None] != np.arange(len(names))[None, :])
        found = [(names[mine[x]], "pair", names[y], v) for x, y, v in zip(a.tolist(), b.tolist(), sums[a, b].tolist())]
        if len(row):
            more = p - share(all_n, all_total, kept_n)
            by_bytes = np.empty(len(terms), np.int64)
            by_bytes[sorted(range(len(terms)), key=lambda t: terms[t].encode())] = np.arange(len(terms))
            for i in mine.tolist():
                at = np.arange(ptr[i], ptr[i + 1])[more[ptr[i] : ptr[i + 1]] > 0]
                best = at[np.lexsort((by_bytes[col[at]], -more[at]))][:top]
                found += [(names[i], "term", terms[col[x]], int(more[x])) for x in best.tolist()]
        if not found:
            return pa.table(empty)
        source, part, item, value = zip(*found)
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "source": pa.array(source, pa.string()), "part": part, "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    keys = ["lang", "chunk", "block"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, "lang string, source string, part string, item string, value bigint")
    sums = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return sums.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, documents(spark, sf_dir))


QUERIES = {"op11_source_divergence": op11_source_divergence}
SQL = {
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS all_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(all_n)::HUGEINT AS all_total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN t USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (total + 5 * v) AS p FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - (1 + 1000000000::HUGEINT * (all_n + 5) // (all_total + 5 * v)) AS value FROM p JOIN k USING (lang, term) JOIN v ON v.lang = p.lang WHERE n > 0),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms WHERE value > 0)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM u QUALIFY part = 'pair' OR rank <= 50
"""
}
