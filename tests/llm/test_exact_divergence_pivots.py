"""Source divergence, exact deduplication and hard negatives against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from compare import rows, sql_rows
from pyspark.sql import functions as F

pytest.importorskip("knowspan.llm")

from knowspan.llm import divergence, exact_dedup, pivot_negatives  # noqa: E402

D = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string"


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_exact_dedup", "op13_pivot_negatives"])
def test_against_sql(name, spark, duck):
    from knowspan.plans import catalog

    queries, sql = catalog.gather("knowspan.llm")
    assert rows(queries[name](spark, D)) == sql_rows(duck, sql[name])


# --- exact deduplication


def test_golomb_round_trip():
    r = np.random.default_rng(1)
    for size, top in ((0, 1), (1, 1 << 40), (1000, 3), (1000, 1 << 50), (7, 1)):
        gaps = r.integers(0, top, size)
        k, code = exact_dedup.golomb(gaps)
        assert exact_dedup.ungolomb(len(gaps), k, code).tolist() == gaps.tolist()
    # sorted fingerprints of 20 bits beyond their number cost about 21.5 bits each, not 64
    prints = np.sort(r.integers(0, 1 << 36, 1 << 16))
    assert len(exact_dedup.golomb(np.diff(prints, prepend=0))[1]) * 8 < 22.5 * len(prints)


def test_normal_is_the_regular_expression():
    r = random.Random(2)
    for _ in range(500):
        t = "".join(r.choice(["a", "é", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", " "]) for _ in range(r.randint(0, 12)))
        assert exact_dedup.normal(t.encode()).decode() == re.sub(r"[\x20\x09-\x0d]+", " ", t)


def expected(given):
    """(doc_id, keep_id, group_size, sha) counted, and one kept row for each text."""
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t, *_ in given]
    ids, size = collections.defaultdict(list), collections.Counter(norm)
    for (i, *_), t in zip(given, norm):
        ids[t].append(i)
    least = {t: min((i for i in v if i is not None), default=None) for t, v in ids.items()}
    return collections.Counter((i, least[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for (i, *_), t in zip(given, norm))


@pytest.mark.parametrize("bits", [None, 3])
def test_exact_groups(spark, bits):
    r = random.Random(4)
    texts = ["", None, " ", "  ", "a b", "a\tb", " a b", "A b", "x " * 40_000, "x\n" * 40_000, "é", "é"] + [f"text {k}" for k in range(150)]
    given = [(k, r.choice(texts), "en", "s") for k in range(400)] + [(None, "a b", "en", "s"), (None, "only null", "en", "s"), (None, "only null", "en", "s"), (5, "a b", "en", "s"), (5, "a b", "en", "s"), (5, "other", "en", "s")]
    given += [(1000 + k, "copy of a third", "en", "s") for k in range(200)]
    docs = spark.createDataFrame(given, DOCS).repartition(7).withColumn("Kept", F.lit("mine")).withColumn("_row", F.lit(1))
    found = exact_dedup.classes(spark, docs, bits=bits)
    assert [c.lower() for c in found.columns] == ["doc_id", "text", "lang", "source", "keep_id", "group_size", "kept", "text_sha256"]
    got = found.collect()
    assert collections.Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got) == expected(given)
    kept = [x for x in got if x.kept]
    assert len(kept) == len({x.text_sha256 for x in got}) and all(x.doc_id == x.keep_id for x in kept)


def test_exact_empty_and_dedup(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.classes(spark, none).collect() == [] and exact_dedup.dedup(spark, none).columns == none.columns
    docs = spark.createDataFrame([(3, "a  b", "en", "s"), (2, "a b", "de", "t"), (4, "c", None, None)], DOCS)
    assert sorted(tuple(x) for x in exact_dedup.dedup(spark, docs).collect()) == [(2, "a b", "de", "t"), (4, "c", None, None)]


# --- source divergence


def brute_audit(given, min_docs, top):
    docs = collections.defaultdict(lambda: collections.defaultdict(list))
    for _, text, lang, source in given:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        docs[lang or ""][source or ""].append(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
    out = []
    for lang, by in docs.items():
        held = collections.Counter(t for lists in by.values() for terms in lists for t in set(terms))
        kept = [t for t, n in held.items() if n >= min_docs]
        counts = {s: collections.Counter(t for terms in lists for t in terms) for s, lists in by.items()}
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        own, all_p = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), collections.Counter()))
        for s in by:
            pairs = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in by if o != s]
            more = [(own[s][t] - all_p[t], t) for t in kept if counts[s][t] and own[s][t] > all_p[t]]
            for part, items, most in (("pair", pairs, None), ("term", more, top)):
                for k, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, v, k + 1))
    return sorted(out)


def audited(spark, given, **more):
    return sorted((x.lang, x.source, x.part, x.item, x.value, x.rank) for x in divergence.audit(spark, spark.createDataFrame(given, DOCS).repartition(5), **more).collect())


def test_divergence_by_hand(spark, monkeypatch):
    r = random.Random(5)
    words = ["The", "the", "naïve", "日本", "日本語", "x1y", "a_b", "😀x", "Ä", "ä", "tail"] + [chr(97 + k) * 3 for k in range(20)]
    text = lambda: r.choice([" ", "-", "\n"]).join(r.choices(words, k=r.randint(0, 60)))
    given = [(k, text(), r.choice(["en", "en", "de", None]), r.choice(["a", "b", "c", None, "", "é"])) for k in range(300)]
    given += [(None, None, "en", "none"), (1, "", "fr", "lone"), (1, "", "xx", "p"), (1, None, "xx", "q"), (2, "the " * 50_000, "en", "a")]
    for chunk, block, held in ((200_000, 256, 400_000), (7, 2, 10)):
        monkeypatch.setattr(divergence, "CELLS", chunk)
        monkeypatch.setattr(divergence, "SOURCES", block)
        monkeypatch.setattr(divergence, "HELD", held)
        assert audited(spark, given, min_docs=3, top=4) == brute_audit(given, 3, 4)
    assert audited(spark, given[:50], min_docs=1000) == brute_audit(given[:50], 1000, 50)
    assert divergence.audit(spark, spark.createDataFrame([], DOCS)).collect() == []


def test_slices_with_one_hash():
    data = "aa bb aa cc bbbbbbbbbbbbbbbbbbbbb bbbbbbbbbbbbbbbbbbbbc dd".encode()
    starts, ends, _ = divergence.slices(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    group, heads = divergence.grouped(data, starts, ends, digest=lambda b: len(b))
    terms = [data[a:z] for a, z in zip(starts, ends)]
    assert len(heads) == len(set(terms)) and [terms[heads[g]] for g in group] == terms


def test_share_is_exact():
    r = random.Random(6)
    for _ in range(300):
        total, kept = r.randint(0, 10**14), r.randint(1, 10**7)
        count = r.randint(0, total)
        assert divergence.share(np.array([count]), np.array([total]), kept)[0] == 1 + 10**9 * (count + 5) // (total + 5 * kept)


# --- hard negatives


def brute_negatives(given, scale, k, n, every):
    v = {}
    for i, x, label in sorted(given, key=lambda r: (r[0] is None, r[0], r[2] is None, r[2], r[1] is None, [y is None or y for y in r[1] or []])):
        if None in (i, x, label) or any(y is None or not np.isfinite(y) for y in x) or i in v:
            continue
        v[i] = (label, [int(np.floor(y * scale)) for y in x])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, x) in v.items():
        if a % every:
            continue
        scored = sorted((-dot(x, y), i, other) for i, (other, y) in v.items() if i != a)
        for s, i, _ in [t for t in scored if t[2] == label][:k]:
            fits = [(t[1], -t[0]) for t in scored if t[2] != label and 30 * -s <= 100 * -t[0] <= 90 * -s][:n]
            out += [(a, i, r + 1, j, -s, q) for r, (j, q) in enumerate(fits)]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<double>, label int"


def mined(spark, given, part=8192, **more):
    df = spark.createDataFrame(given, VECTORS).withColumn("rank", F.lit(9))
    found = pivot_negatives.mine(spark, df, F.col("vec_id") % 4 == 0, F.col("label"), positives=3, negatives=4, part=part, **more)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


@pytest.mark.parametrize("kind", ["random", "clusters", "ties", "large"])
def test_negatives(spark, kind):
    r = np.random.default_rng(8)
    if kind == "random":
        x = r.normal(size=(160, 6))
    elif kind == "clusters":
        x = r.normal(size=(5, 6))[r.integers(0, 5, 160)] * 3 + r.normal(size=(160, 6)) / 50
    elif kind == "ties":
        x = r.integers(0, 2, size=(160, 4)).astype(float)
    else:
        x = r.normal(size=(160, 3)) * 50_000
    given = [(k, row.tolist(), int(r.integers(0, 3))) for k, row in enumerate(x)]
    given += [(200, None, 1), (204, [1.0, None], 1), (208, [float("nan"), 1.0], 1), (212, [1.0, 2.0], None), (None, [1.0, 1.0], 1), (216, [0.0] * 4, 1), (220, [], 2), (224, [1.0], 1), (8, [9.0, 9.0], 0)]
    want = brute_negatives(given, 256, 3, 4, 4)
    assert want and mined(spark, given) == want and mined(spark, given, part=9) == want


def test_negatives_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(4, [1.0], 1)]) == []
    with pytest.raises(ValueError):
        mined(spark, [(4, [1e7], 1), (5, [1e7], 1)])
