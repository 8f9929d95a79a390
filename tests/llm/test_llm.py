"""The corpus operators against brute force, exact round trips and held-out labels."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import rows, sql_rows
from pyspark.sql import functions as F

pytest.importorskip("knowspan.llm")

from knowspan.llm import _text as tx  # noqa: E402
from knowspan.llm import _labelled, _tokens, ann, decontaminate, jaccard, line_dedup, packing, pii, quality, token_index, toxicity, warc  # noqa: E402
from knowspan.llm._components import components  # noqa: E402
from knowspan.llm._scratch import Scratch  # noqa: E402

D = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = ["", None, "a", "a b", "x " * 3000, "same line here\nsame line here", "Same line here ", "一二三四五六七八九十\n" * 3, " \t\n\r", "tail\n"]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    return lambda texts: [e.ids for e in Tokenizer.from_file(_tokens.tokenizer_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["op3_rotated_codes", "op4_ngram_jaccard", "op8_benchmark_decontamination", "op9_line_dedup"])
def test_against_sql(name, spark, duck):
    from knowspan.plans import catalog

    queries, sql = catalog.gather("knowspan.llm")
    assert rows(queries[name](spark, D)) == sql_rows(duck, sql[name])


# --- tokens, packing, index


def test_ids_of_chunks_are_ids_of_texts(encode):
    pieces = [" ", "  ", "\n", "'s", "'", ".", ",", "a", "Bc", "é", "1", "23", " ", "　", "日", "😀", "\t", "\r\n", "…", "’", "_", "<|endoftext|>"]
    r = random.Random(3)
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ODD
    got = [ids.tolist() for _, ids in _tokens.encode_column(pa.array(texts, pa.string()), _tokens.tokenizer_path())]
    assert got == encode(texts)


def test_packing(spark, encode):
    texts = [r.text for r in spark.read.parquet(f"{D}/documents.parquet").orderBy("doc_id").collect()] + ODD
    found = packing.pack(spark, frame(spark, texts)).collect()
    expected = []
    for k, ids in enumerate(encode(texts)):
        ids = ids + [2]
        at = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        expected += [(k, p, a, z - a, crc(ids[a:z])) for p, (a, z) in enumerate(zip(at, at[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        ends = [o + n for o, n in sorted(held)]
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(bins) <= 1.03 * sum(r.length for r in found) / 1024 + 1
    assert packing.pack(spark, frame(spark, []).where("false")).count() == 0


def test_fullest_is_the_fullest():
    r = random.Random(5)
    for _ in range(100):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}
        room = r.randint(1, 60)
        items = [x for x, n in counts.items() for _ in range(n)]
        best = max((sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room), default=0)
        chosen = packing.fullest(counts, room)
        assert sum(x * n for x, n in chosen.items()) == best and all(n <= counts[x] for x, n in chosen.items())


def test_token_shards(spark, encode):
    texts = ["b", *ODD, "longer text, " * 50]
    docs = frame(spark, texts).unionByName(frame(spark, ["zz"], 3)).unionByName(spark.createDataFrame([(None, t, "en", "s", 4) for t in ("no id", None, "nor this " * 90)], DOCS))
    scratch = Scratch(spark, "test")
    shards = scratch.table("shards", token_index.write(spark, docs, scratch.at("ids"), shard_ids=200))
    assert shards.count() > 1
    got = sorted((tuple(r) for r in token_index.read(token_index.with_bases(shards)).collect()), key=lambda r: r[1])
    expected, start = [], 0
    for text in sorted(["no id", None, "nor this " * 90], key=lambda t: (got[0][2], got[1][2], got[2][2]).index(len(encode([t])[0]) + 1)):  # any order, before all others
        ids = encode([text])[0] + [0]
        expected.append((None, start, len(ids), crc(ids)))
        start += len(ids)
    for k, t in sorted([*enumerate(texts), (3, "zz")], key=lambda x: (x[0], x[1] or "")):
        ids = encode([t])[0] + [0]
        expected.append((k, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == expected
    none = docs.where("false")
    assert token_index.write(spark, none, scratch.at("none")).count() == 0
    for row in shards.collect():
        own = token_index.Shard(row.path)
        assert all(own.ids(r)[-1] == 0 and own.keys[r - own.nulls] == k for k, r in zip(own.keys, own.find(own.keys)))
    shard = token_index.Shard(shards.orderBy("part", "seq").first().path)
    assert (shard.find(np.array([10**9, -5])) == -1).all()


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    h = token_index.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert token_index.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


# --- lines, near duplicates, benchmarks


def test_lines_of_rows_without_an_id(spark):
    rows = [(None, "only rows without id\nheld by document one"), (None, "only rows without id\nheld by document one"), (1, "held by document one"), (2, "held by document one\nof document two only")]
    got = line_dedup.dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in got) == [(0, "only rows without id", 2, 1)] * 2 + [(1, "held by document one", 1, 0), (2, "of document two only", 2, 1)]
    runs = line_dedup.LineRuns(Scratch(spark, "runs"))
    found = [runs.admit(spark.createDataFrame([(d, h, 0) for d, h in batch], "doc_id bigint, h1 bigint, h2 bigint")).collect() for batch in ([(None, 5), (None, 5)], [(7, 5)], [(8, 5)])]
    assert [[(r.h1, r.owner) for r in f] for f in found] == [[], [], [(5, 7)]]


def test_line_dedup_of_odd_texts(spark):
    texts = [*ODD, "SAME LINE HERE\nother line here", "short\nsame line here\t", None]
    got = {r.doc_id: r for r in line_dedup.dedup(spark, frame(spark, texts).withColumn("N_Dropped", F.lit(1))).collect()}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    first = {}
    for k, t in enumerate(texts):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), k)
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == k]
        assert (got[k].text, got[k].n_lines, got[k].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_line_runs_across_batches(spark):
    runs = line_dedup.LineRuns(Scratch(spark, "runs"), fanout=2)
    lost = []
    for batch in ([(1, 5), (1, 6)], [(2, 5), (2, 7)], [(3, 7), (4, 8), (5, 8)], [(6, 6), (6, 9)]):
        keys = spark.createDataFrame([(d, h, 0) for d, h in batch], "doc_id bigint, h1 bigint, h2 bigint")
        lost.append(sorted((r.h1, r.owner) for r in runs.admit(keys).collect()))
    assert lost == [[], [(5, 1)], [(7, 2), (8, 4)], [(6, 1)]]
    assert sum(map(len, runs.levels)) < 4  # compacted


def brute_components(texts, num, den, size):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        k = len(sets[a] & sets[b])
        if k and k * den >= (len(sets[a]) + len(sets[b]) - k) * num:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return [(k, len(s), root(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize("threshold, size, leaf", [((4, 5), 5, 256), ((90, 100), 3, 8)])
def test_jaccard(spark, threshold, size, leaf):
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(r.choices(words, k=r.randint(3, 80))) for _ in range(25)]
    common = " ".join(r.choices(words, k=30))
    texts = list(ODD)
    for k in range(260):
        w = base[0 if k < 120 else k % 25].split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w) + (" " + common if k % 3 == 0 else ""))
    texts += [texts[-1].upper(), "Two words", "two  WORDS", "two"]
    got = jaccard.join(spark, frame(spark, texts), threshold, size, leaf)
    assert sorted(tuple(x) for x in got.collect()) == brute_components(texts, *threshold, size)


def test_jaccard_of_repeated_and_null_ids(spark):
    docs = frame(spark, ["a b c d e f", "p q r s t u"]).unionByName(frame(spark, ["p q r s t u"], 0)).unionByName(spark.createDataFrame([(None, "a b c d e f", "en", "s", 1)], DOCS))
    assert sorted(tuple(x) for x in jaccard.join(spark, docs).collect()) == [(0, 2, 0), (1, 2, 0)]
    assert jaccard.join(spark, docs.where("false")).count() == 0
    kept = [r.doc_id for r in jaccard.keep_one(spark, docs).collect()]
    assert sorted(-1 if k is None else k for k in kept) == [-1, 0, 0]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint"), Scratch(spark, "cc")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_labelled_sample_is_bounded(spark):
    docs = frame(spark, ["b", "c"]).unionByName(frame(spark, ["a", "d"]))  # each doc_id with two texts
    labels = spark.createDataFrame([(0, 1), (0, 0), (0, 1), (1, 0), (None, 1), (7, None)], "doc_id bigint, quality int")
    got = _labelled.sample(docs, labels, "quality", 1, [0, 1])
    assert sorted((r.doc_id, r.label, r.text) for r in got.collect()) == [(0, 1, "a"), (1, 0, "c")]


def test_tokens_need_sixteen_bits_and_distinct_keys(monkeypatch, encode):
    path = _tokens.tokenizer_path()
    texts = ["one two three", "two one", "", "three"]
    monkeypatch.setattr(_tokens.tx, "span_hashes", lambda raw, a, z, second=False: (z - a).astype(np.uint64) * np.uint64(1 + second) + np.where(second, raw[a], 0).astype(np.uint64))
    clashing = _tokens.Encoder(path)
    raw, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    ids, at = clashing.encode(raw, offsets)
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == encode(texts)


def test_leaks_of_odd_tables(spark):
    item = "one two three four five six seven eight nine ten"
    docs = frame(spark, ["x " * 500 + item.upper() + " y" * 500, item.replace("five", "5"), "one two", None, item[:30]])
    bench = spark.createDataFrame([(1, item), (2, "one  TWO"), (3, None), (None, item)], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.shared, r.n_shingles) for r in decontaminate.leaks(spark, docs, bench).collect())
    assert got == [(0, 1, 6, 6), (2, 2, 1, 1)]
    assert sorted(r.doc_id for r in decontaminate.clean(spark, docs, bench).collect()) == [1, 3, 4]
    assert decontaminate.leaks(spark, docs, bench.where("false")).count() == 0


# --- vectors


def test_ann_over_several_blocks_and_huge_values(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 90)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    r = np.random.default_rng(5)
    v = r.normal(size=(400, 24))
    for scale, k in ((1.0, 20), (1e160, 20), (1e-200, 5)):
        held = v * scale
        df = spark.createDataFrame([(i, [float(x) for x in row], "x") for i, row in enumerate(held)], "vec_id bigint, embedding array<double>, score string")
        got = collections.defaultdict(list)
        for x in sorted(ann.search(spark, df, F.col("vec_id") % 20 == 0, k).collect(), key=lambda x: (x.query_id, x.rank)):
            got[x.query_id].append(x.vec_id)
        assert sorted(got) == list(range(0, 400, 20)) and all(len(x) == k for x in got.values())
        if scale == 1.0:
            for q, ids in got.items():
                near = v @ v[q]
                near[q] = -np.inf
                assert ids == np.argsort(-near, kind="stable")[:k].tolist()


def test_ann_with_odd_vectors(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 16))
    v[50:120] = v[40]
    data = [(k, [float(x) for x in row]) for k, row in enumerate(v)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [1.0]), (None, [1.0] * 16), (40, [float(x) for x in v[40]])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for x in sorted(ann.search(spark, df, F.col("vec_id") % 20 == 0).collect()):
        got[x.query_id].append(x.vec_id)
    hits = total = 0
    for q in range(0, 300, 20):
        s = v @ v[q]
        best = [k for k in sorted(range(300), key=lambda k: (-s[k], k)) if k != q][:20]
        hits, total = hits + len(set(best) & set(got[q])), total + 20
    assert len(got) == 15 and hits / total >= 0.98
    assert ann.search(spark, df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# --- classifiers


def test_ordinal_grades():
    r = np.random.default_rng(4)
    texts, grades = [], []
    for _ in range(600):
        g = int(r.integers(0, 4))
        texts.append(" ".join(r.choice(["bad", "good", "mid"], size=40, p=[0.8 - 0.2 * g, 0.1 + 0.2 * g, 0.1])))
        grades.append(g)
    raw, offs = tx.buffers(pa.array(texts))
    f = quality._condensed(raw, offs)
    train = f[0] < 400
    model = quality.fit(*(x[train] for x in f), np.array(grades[:400]), 4)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.bincount(f[0], model.weights[f[1]] * f[2], len(texts)))
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(tails.sum(1)[400:], grades[400:])[0, 1] > 0.8
    assert quality.fit(f[0], f[1], f[2], np.ones(600, int)).tails(np.zeros(1))[0, 0] > 0.99  # one grade only: all is kept


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    held = quality.score(docs.withColumn("Score", F.lit(1)), model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = [r for r in held if r.quality == 1], [r for r in held if r.quality == 0]
    assert np.mean([r.tail_probability >= 0.5 for r in good]) > 0.97 and np.mean([r.tail_probability < 0.5 for r in bad]) > 0.9
    odd = quality.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.tail_probability <= 1 for r in odd)
    assert quality.select(frame(spark, ODD), labels.where("false")).count() == len(ODD)


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels, where=~toxicity.held_out(F.col("doc_id")))
    held = labels.where(toxicity.held_out(F.col("doc_id")))
    held = toxicity.score(docs, model).join(held, "doc_id").select("predicted", "toxic", "score", "flagged", "lang").collect()
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    toxic = [r for r in held if r.toxic == 1]
    assert np.mean([r.predicted for r in toxic]) > 0.8
    for lang in {r.lang for r in held}:  # the threshold of a language decides ``flagged``
        own = [r for r in held if r.lang == lang]
        yes, no = [r.score for r in own if r.flagged], [r.score for r in own if not r.flagged]
        assert not yes or not no or min(yes) > max(no)
        assert np.mean([bool(r.flagged) == bool(r.toxic) for r in own]) > 0.9
    odd = toxicity.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.score(frame(spark, ODD), toxicity.train(docs, labels.where("false"))).collect()
    assert all(r.score < 0.01 and r.predicted == 0 for r in none)


def test_toxicity_learns_from_every_label(spark):
    """What only labels beyond the first 1,500 hashes tell is learned; partitions don't matter."""
    rows = spark.range(6000).withColumn("rank", F.expr("row_number() over (partition by id % 2 order by xxhash64(id, 17), id)"))
    word = F.when(F.col("id") % 2 == 0, "calm").when(F.col("rank") <= 1500, "poison").otherwise("venom")
    docs = rows.select(F.col("id").alias("doc_id"), F.concat(F.lit("some "), word, F.lit(" words "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    first, second = toxicity.train(docs.repartition(3), labels), toxicity.train(docs.repartition(7), labels)
    asked = frame(spark, ["some venom words 7", "some poison words 7", "some calm words 7"])
    assert [r.predicted for r in toxicity.score(asked, first).orderBy("doc_id").collect()] == [1, 1, 0]
    assert np.allclose(first.net.table, second.net.table, atol=1e-5) and abs(first.net.bias - second.net.bias) < 1e-5
    few = [(k, "bad thing" if k % 3 == 0 else "good thing", "en", "s", 9) for k in range(6)]
    model = toxicity.train(spark.createDataFrame(few, DOCS), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(6)], "doc_id bigint, toxic int"))
    assert [r.predicted for r in toxicity.score(spark.createDataFrame(few, DOCS), model).orderBy("doc_id").collect()] == [1, 0, 0, 1, 0, 0]


# --- personal data


def python_feistel(text, radix, key, tweak):
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"

    def show(v, n):
        out = ""
        for _ in range(n):
            v, d = divmod(v, radix)
            out = digits[d] + out
        return out

    done = ""
    for i in range(0, max(len(text), 1), 20):
        own = text[i : i + 20]
        u = len(own) // 2
        a, b = int(own[:u] or "0", radix), int(own[u:] or "0", radix)
        for t in range(10):
            f = int(hashlib.sha256(f"{key}|{tweak}|{len(own)}|{i // 20}|{t}|{b}".encode()).hexdigest()[:15], 16)
            m = radix ** (u if t % 2 == 0 else len(own) - u)
            a, b = b, (a + f % m) % m
        done += show(a, u) + show(b, len(own) - u)
    return done


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def test_pseudonyms(spark):
    texts = [
        "card 4041894974608795 and 4041 8949 7460 8795, not 4041894974608796", None, "", "12", "mail Bob.42@mail8.example.com again bob.42@mail8.example.com",
        "born 1984-02-29, 31.12.1999, 12/31/2001 not 1984-02-30", "ip 42.144.35.254. not 300.1.1.1", "+1 (988) 555-2485, 123-45-6789", "DE89370400440532013000 but DE88370400440532013000", "x" * 20_000 + "@",
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts).withColumn("N_pii", F.lit(9)), pii.DRILL_KEY).collect()}
    card = python_feistel("404189497460879", 10, pii.DRILL_KEY, "card")
    card += str(-luhn(card + "0") % 10)
    assert got[0].text == f"card {card} and {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}, not 4041894974608796" and got[0].pii_kinds == ["card", "card"] and luhn(card) == 0
    assert got[1].text is None and got[2].text == "" and got[3].text == "12" and got[9].text == texts[9]
    name = python_feistel("bob42", 36, pii.DRILL_KEY, "email")
    assert got[4].text.lower() == f"mail {name[:3]}.{name[3:]}@mail8.example.com again {name[:3]}.{name[3:]}@mail8.example.com"
    dates = re.fullmatch(r"born (\d{4}-\d\d-\d\d), (\d\d\.\d\d\.\d{4}), (\d\d/\d\d/\d{4}) not 1984-02-30", got[5].text)
    assert dates and got[5].pii_kinds == ["date"] * 3 and dates[1] != "1984-02-29"
    assert re.fullmatch(r"ip (\d{1,3}\.){3}\d{1,3}\. not 300\.1\.1\.1", got[6].text) and got[6].text != texts[6]
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}, (?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", got[7].text)
    iban = re.fullmatch(r"DE(\d{20}) but DE88370400440532013000", got[8].text)
    assert iban and int(iban[1][2:] + "1314" + iban[1][:2]) % 97 == 1 and iban[1] != "89370400440532013000"


def test_pseudonyms_beside_other_numbers(spark):
    def iban_ok(code):
        code = code.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1

    texts = [
        "card 4111 1111 1111 1111 12/27", "4111111111111111 123", "2024 01 4111 1111 1111 1111 12 27 2028", "4111 1111 1111 1111 12/31/2001", "AB12 4111 1111 1111 1111 and 4041 8949 7460 8795 4111111111111111",
        "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32 THEN", "NL91ABNA0417164300, FR1420041010050500013M02606", "GB83WEST12345698765432", "BE68 5390 0754 7034 4111 1111 1111 1111",
        "token=" + "aB3" * 3000, "_bob@mail.com -bob@mail.com " + "-" * 90 + "bob@mail.com", "AKIA" + "ABCDEFGH" * 2, "7 " * 15_000, "4111 1111 1111 1111 12bob@mail.com", "988-555-2485 4111 1111 1111 1111 123-45-6789",
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts), pii.DRILL_KEY).collect()}
    body = python_feistel("411111111111111", 10, pii.DRILL_KEY, "card")
    card = body + str(-luhn(body + "0") % 10)
    spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    assert got[0].text == f"card {spaced} 12/27" and got[1].text == f"{card} 123" and got[2].text == f"2024 01 {spaced} 12 27 2028"
    assert got[3].pii_kinds == ["card", "date"] and got[3].text.startswith(spaced) and "12/31/2001" not in got[3].text
    assert got[4].text.startswith(f"AB12 {spaced} and ") and got[4].text.endswith(f" {card}") and got[4].pii_kinds == ["card"] * 3
    assert re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", got[5].text) and iban_ok(got[5].text) and got[5].text != texts[5]
    assert got[6].text.replace(" ", "") == got[5].text + "THEN" and [len(w) for w in got[6].text.split()] == [4, 4, 4, 4, 4, 2, 4]
    assert got[7].pii_kinds == ["iban"] * 2 and all(iban_ok(x) and x not in texts[7] for x in got[7].text.split(", "))
    assert got[8].text == texts[8] and got[9].pii_kinds == ["iban", "card"] and got[9].text.endswith(spaced) and iban_ok(got[9].text[:19])
    value = python_feistel("ab3" * 3000, 36, pii.DRILL_KEY, "secret")
    assert got[10].text == "token=" + "".join(c.upper() if k % 3 == 1 else c for k, c in enumerate(value))
    name = python_feistel("bob", 36, pii.DRILL_KEY, "email")
    assert got[11].text == f"_{name}@mail.com -{name}@mail.com {'-' * 90}{name}@mail.com"
    assert got[12].pii_kinds == ["secret"] and got[12].text != texts[12]
    assert got[13].n_pii < 15_000 and re.fullmatch(r"(\d )*", got[13].text) and len(got[13].text) == 30_000
    assert got[14].text.startswith(spaced) and got[14].pii_kinds == ["card", "email"]
    assert got[15].pii_kinds == ["phone", "card", "ssn"] and got[15].text[13:32] == spaced


def test_pseudonyms_are_a_permutation(spark):
    days = spark.sql("SELECT explode(sequence(date'1990-01-01', date'1999-12-31')) AS d").select(F.date_format("d", "yyyy-MM-dd").alias("m"))
    new = days.select(pii.pseudonym(F.col("m"), pii.DRILL_KEY).alias("p"))
    assert new.distinct().count() == days.count() and new.where("try_to_timestamp(p, 'yyyy-MM-dd') is null").count() == 0
    two = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("t")).select(pii.feistel(F.col("t"), 10, "k", F.lit("x")).alias("p"))
    assert two.distinct().count() == 100


# --- archives


def test_fixity(spark):
    pages = [(k, None if k == 3 else f"http://e/{k}", None if k == 5 else "<p>" + "x" * (k * 37 % 900)) for k in range(150)] + [(7, "http://e/7", "again"), (None, "u", "h")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    scratch = Scratch(spark, "warc-test")
    files = scratch.table("files", warc.archive(df, scratch.at("a")))
    scratch.table("copy", warc.replicate(files, scratch.at("a"), scratch.at("b"), lambda k: k in (11, 77)))
    name = files.where(F.array_contains("page_ids", 20)).first().name
    store, base = warc._file_system(scratch.at("a"))
    found = warc.audit(files, {"a": scratch.at("a"), "b": scratch.at("b")}, scratch).collect()
    assert sorted(r.page_id for r in found if r.damaged_in) == [11, 77] and {tuple(r.damaged_in) for r in found} == {(), ("b",)}
    assert len(found) == len(pages)
    import gzip

    one = next(r for r in found if r.page_id == 42)
    data = warc._get(scratch.at("a"), one.file)[one.offset : one.offset + one.length]
    head, body = warc.parse(gzip.decompress(data))
    assert hashlib.sha256(data).hexdigest() == one.digest and head["WARC-Target-URI"] == "http://e/42" and body.decode() == pages[42][2]
    store.delete_file(f"{warc._file_system(scratch.at('b'))[1]}/{name}")  # a lost file
    lost = warc.audit(files, {"a": scratch.at("a"), "b": scratch.at("b")}, Scratch(spark, "warc-lost")).collect()
    assert {r.file for r in lost if r.damaged_in} >= {name} and all(r.damaged_in == ["b"] for r in lost if r.file == name)
    ends = {r.file: r for r in sorted(found, key=lambda r: r.offset)}
    other = next(f for f in sorted(ends) if f != name)
    for folder in ("a", "b"):  # the same damage in all replicas, and bytes after the last record in one
        data = bytearray(warc._get(scratch.at(folder), other))
        data[1] ^= 1
        warc._put(scratch.at(folder), other, bytes(data) + b"tail" * (folder == "a"))
    alike = [r for r in warc.audit(files, {"a": scratch.at("a"), "b": scratch.at("b")}, Scratch(spark, "warc-alike")).collect() if r.file == other]
    assert {tuple(r.damaged_in) for r in alike if r.offset == 0} == {("a", "b")}
    assert "a" in next(r for r in alike if r.offset == ends[other].offset).damaged_in
    assert warc.audit(files.where("false"), {"a": scratch.at("a")}, Scratch(spark, "warc-none")).count() == 0


# --- the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    scratch = Scratch(spark, "pipeline-test")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(scratch.table(name, stage(spark, tables[-1], D)))
    counts = [t.count() for t in tables]
    assert all(t.columns == docs.columns for t in tables[:-1]) and counts[0] >= counts[1] >= counts[2] >= counts[3] >= counts[4] > 0
    lines = collections.Counter(line for r in tables[2].collect() for line in {x.strip(" \t\n\x0b\x0c\r").lower() for x in r.text.split("\n")} if len(line) >= 10 and line.isascii())
    assert not [x for x, n in lines.items() if n > 1]
    texts = [r.text for r in tables[3].orderBy("doc_id").collect()]
    assert all(k == root for k, _, root in brute_components(texts, 4, 5, 5))
    assert decontaminate.leaks(spark, tables[4], spark.read.parquet(f"{D}/benchmark.parquet")).count() == 0
    assert tables[5].select("doc_id").distinct().count() == counts[4]
    assert corpus_pipeline.run(spark, D).count() == counts[5]


def test_dates_stay_apart(spark):
    """Every date of twenty years in all four forms: valid pseudonyms of the same form, different for different strings, and whichever way a string can be read only within its own set."""
    import datetime

    days = [datetime.date(1990, 1, 1) + datetime.timedelta(k) for k in range(7305)]
    given = sorted({d.strftime(f) for d in days for f in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y")})
    found = {r.m: r.p for r in spark.createDataFrame([(g,) for g in given], "m string").select("m", pii.pseudonym(F.col("m"), "k").alias("p")).collect()}
    assert len(set(found.values())) == len(given)

    def ways(t):
        out = set()
        for f in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"):
            try:
                datetime.datetime.strptime(t, f)
                out.add(f)
            except ValueError:
                pass
        return out

    assert all(ways(m) == ways(p) for m, p in found.items())
