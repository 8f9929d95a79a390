"""The text index against plain scans of the texts."""

import random

from pyspark.sql import functions as F

from knowspan.operators.textindex import TextIndex, postings
from knowspan.session import shared_folder

DOC = "doc_id bigint, title string, text string, lang string"
WORDS = ["aaaa", "aaa", "Straße", "日本語", "ab", "a", "😀😀😀", "Naïve", "%_x", "tail"]


def documents(seed, ids):
    r = random.Random(seed)
    text = lambda n: r.choice(["", " ", ""]).join(r.choices(WORDS, k=r.randint(0, n)))
    return [(k, r.choice([None, text(3)]), text(12), r.choice(["en", "de"])) for k in ids]


def count(text, phrase):
    text, phrase = (text or "").lower(), phrase.lower()
    return sum(text.startswith(phrase, i) for i in range(len(text)))


PHRASES = ["aaa", "aaaa", "aa", "a", "日本", "語", "😀😀", "😀😀😀", "naïve", "ïve日", "%_x", "tail", "il", "nothing", "straße"]


def check(spark, index, docs):
    for phrase in PHRASES[:6:2]:
        got = {(r.doc_id, r.field): r.n for r in index.occurrences(phrase).collect()}
        assert got == {(d[0], f): n for d in docs for f in (0, 1) if (n := count(d[1 + f], phrase))}, phrase
    asked = spark.createDataFrame([(k, p) for k, p in enumerate(PHRASES + ["", "aaa"])], "query_id bigint, phrase string")
    many = {(r.query_id, r.doc_id, r.field): r.n for r in index.many(asked).collect()}
    assert many == {(k, d[0], f): n for k, p in enumerate(PHRASES + ["", "aaa"]) if p for d in docs for f in (0, 1) if (n := count(d[1 + f], p))}
    size = sum(max(len(d[1] or "") - 2, 0) + max(len(d[2]) - 2, 0) for d in docs)
    assert index.totals == (len(docs), size)
    best = {(r.query_id, r.doc_id): r.score for r in index.best(asked, 3).collect()}
    for k, p in enumerate(PHRASES[:2]):
        alone = index.search(p).orderBy(F.desc("score"), "doc_id").limit(3).collect()
        assert {d: s for (q, d), s in best.items() if q == k} == {r.doc_id: r.score for r in alone}


def test_upkeep(spark):
    index = TextIndex(spark, shared_folder(spark, "index"), ["title", "text"], stored=["lang"])
    assert index.search("aaa").collect() == [] and index.totals == (0, 0)
    state = {d[0]: d for d in documents(1, range(60))}
    frame = lambda rows: spark.createDataFrame(list(rows), DOC).withColumn("extra", F.lit(1))
    assert index.upsert(frame(state.values()), "one")
    check(spark, index, list(state.values()))
    again = {d[0]: d for d in documents(2, range(50, 80))}
    assert index.upsert(frame(again.values()), "two") and not index.upsert(frame(state.values()), "two")
    state |= again
    assert index.delete(spark.createDataFrame([(k,) for k in (3, 55, 999, None)], "doc_id bigint"))
    state.pop(3), state.pop(55)
    assert index.upsert(frame([d := documents(3, [55])[0]]))  # comes back
    state[55] = d
    known = [k for k in state if k % 4]
    assert index.prune(spark.createDataFrame([(k,) for k in known], "doc_id bigint"))
    state = {k: state[k] for k in known}
    check(spark, index, list(state.values()))
    assert index.compact() and index.own[0].gone == 0
    check(spark, TextIndex(spark, index.folder, index.fields, stored=["lang"]), list(state.values()))
    assert {r.doc_id: r.lang for r in index.containing("a", ["text"]).collect()} == {k: d[3] for k, d in state.items() if count(d[2], "a")}
    assert index.upsert(frame(documents(4, [700]))) and index.totals[0] == len(state) + 1
    assert index.rebuild(frame(again.values()))
    check(spark, index, list(again.values()))


def test_one_row_an_id(spark):
    index = TextIndex(spark, shared_folder(spark, "index"), ["title", "text"])
    rows = [(1, "b", "second", "en"), (1, "a", "first", "en"), (None, "x", "nobody", "en"), (2, None, "", None)]
    index.upsert(spark.createDataFrame(rows, DOC))
    assert index.totals == (2, 3) and [r.doc_id for r in index.search("first").collect()] == [1]
    assert index.search("second").collect() == [] and index.search("nobody").collect() == [] and index.search("").collect() == []


def test_a_broken_change_has_no_effect(spark):
    index = TextIndex(spark, shared_folder(spark, "index"), ["title", "text"])
    index.upsert(spark.createDataFrame([(1, "a", "first", "en")], DOC))
    index._write(f"{index.folder}/generation=0", 2, spark.createDataFrame([(2, "a", "first two", "en")], DOC), 1)  # no row in the log
    index.refresh()
    assert [r.doc_id for r in index.search("first").collect()] == [1]
    index.upsert(spark.createDataFrame([(3, "a", "first three", "en")], DOC))
    assert sorted(r.doc_id for r in index.search("first").collect()) == [1, 3]


def test_postings_are_packed_where_documents_are_read(spark):
    """A segment costs a few bytes a character and no shuffle; deletes reach into its blocks when it is compacted."""
    import os

    r, folder = random.Random(5), shared_folder(spark, "index")
    rows = [(k, "", " ".join(r.choices(WORDS, k=300)), "en") for k in range(400)]
    index = TextIndex(spark, folder, ["title", "text"])
    docs = spark.createDataFrame(rows, DOC)
    assert "Exchange" not in postings(docs, index.fields)._jdf.queryExecution().executedPlan().toString()
    index.upsert(docs)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder.removeprefix("file://")) if "/postings" in d for f in names)
    assert size < 4 * sum(len(x[2]) for x in rows)
    index.delete(docs.where("doc_id % 3 = 0").select("doc_id"))
    index.compact()
    assert index._packed().agg(F.sum("docs")).first()[0] == index._postings(index._packed().where("gram >= 0")).count()
    check(spark, index, [x for x in rows if x[0] % 3])
