"""Entries, lists and repairs: stated expectations on small fixtures."""

import pytest
from pyspark.sql import functions as F

from knowspan.functions import entries as E
from knowspan.operators import library, relations, search
from knowspan.plans.query import parse


def values(spark, given, make):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x string")
    return [r.v for r in rows.select("k", make(F.col("x")).alias("v")).orderBy("k").collect()]


def test_alias(spark):
    texts = ["---\n# yaml\n---\n## The *real* one ##\ntext", "no heading", "# &lt;b&gt; and `code`", "#\n", "---\nopen\n# After"]
    got = values(spark, texts, lambda x: E.alias(F.lit(".md"), x, F.lit("?")))
    assert got == ["The real one", "?", "<b> and code", "?", "After"]
    pages = ["<html><TITLE a='1'>One &amp;\n two</TITLE>", "<h1>H <i>x</i></h1>", "<p>", "<title></title><h1>no</h1>"]
    assert values(spark, pages, lambda x: E.alias(F.lit(".html"), x, F.lit("?"))) == ["One & two", "H x", "?", "?"]


def test_key_points_and_scores(spark):
    md = "# T\n## 关键要点\n1. one\n- two\n\n* three\n## Next\n- four"
    assert values(spark, [md, "# T", ""], E.key_points) == [["one", "two", "three"], [], []]
    answers = ['{"quality_score": 7.26}', 'x {"score": "12"} y', '{"score": -3}', "none", '{"a": 1}', "{broken"]
    assert values(spark, answers, E.quality_score) == [7.3, 10.0, 0.0, None, None, None]


def test_local_images(spark):
    text = '![a](img/a.png) <img class="x" src="/kb/b%20c.JPG#top"> ![r](https://x/y.png) ![up](../../etc/p.png) ![t](t.txt) ![d](./d+e.webp) ![f](f.gif)'
    assert values(spark, [text, ""], lambda x: E.local_images(x, F.lit("/kb/docs"), ["/kb/"])) == [["/kb/docs/img/a.png", "/kb/b c.JPG", "/kb/docs/d+e.webp"], []]


def test_entry_fields(spark):
    md = "# The entry\n**来源**: a/b.md\n**置信度**: high\n**标签**: `#x` #y\n\n---\nFirst line\nsecond line\n\nthird\n## More\nno\n\n最后更新：2024-05-01"
    lists = "# L\n- **one**\n- two"
    got = [r.asDict() for r in values(spark, [md, lists, ""], E.entry_fields)]
    assert got[0] == {"title": "The entry", "source": "a/b.md", "confidence": "high", "tags": ["x", "y"], "updated": "2024-05-01", "summary": "First line second line  third"}
    assert got[1]["summary"] == "one two" and got[2] == {"title": "", "source": "", "confidence": "", "tags": [], "updated": "", "summary": ""}


def test_images_and_models(spark):
    drop = lambda x: E.image_dropped(x, F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(30.0), ["avatar"])
    assert values(spark, ["a.png"], drop) == [True]
    wide = lambda x: E.image_dropped(x, F.lit("ok"), F.lit(500.0), F.lit(100.0), ["avatar"])
    none = lambda x: E.image_dropped(x, F.lit("ok"), F.lit(None).cast("double"), F.lit(None).cast("double"), ["avatar"])
    assert values(spark, ["a.png"], wide) == [True] and values(spark, ["a.png", "u/Avatar.png"], none) == [False, True]
    assert values(spark, ["qwen-vl-7b", "gpt", "bge-m3"], E.sees) == [True, False, False]
    assert values(spark, ["bge-m3", "gpt"], E.model_type) == ["embedding", "chat"]
    assert values(spark, ["HTTP 503", "bad json", "Timed out"], E.failover) == [True, False, True]


def test_context_cuts_the_first_line(spark):
    rows = spark.createDataFrame([("d", 1, "word " * 50, "", 5, 1), ("d", 2, "b", "s", None, 1)], "g string, doc_id int, title string, summary string, quality int, rule int")
    got = library.context(rows, "g", budget=10).first()
    assert (got.entries, got.lines, got.truncated) == (2, 1, True) and got.tokens <= 10
    whole = library.context(rows, "g", budget=500).first()
    assert (whole.lines, whole.truncated) == (2, False) and whole.text.endswith("- b: s")


def test_descendants_have_no_row_limit(spark):
    tree = spark.range(600_000).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.lit(0)).cast("bigint").alias("p"))
    assert relations.descendants(spark, tree, "k", "p").count() == 1_199_999
    deep = spark.createDataFrame([(k, k - 1 if k else None) for k in range(12)] + [(50, 51), (51, 50), (52, 51)], "k int, p int")
    pairs = {(r.ancestor, r.descendant) for r in relations.descendants(spark, deep, "k", "p").collect()}
    assert len([x for x in pairs if x[0] < 12]) == 78 and {(50, 50), (50, 51), (51, 50), (51, 52), (50, 52)} <= pairs


def test_tags_are_never_ignored(spark):
    docs = search._docs(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError):
        search.hybrid(docs, docs, parse("the tag:x"), None, use_vectors=False)


def test_first_source_that_has_rows(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "q string, place int")
    got = library.first_given([rows.where("false"), rows, rows.where("q = 'b'")], "q", "place")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("b", 2)]
    assert library.progress(5, 2, 3) == {"pending": 0, "finished": True}


def test_budget_edges(spark):
    """Sums by buckets and a plain running sum choose the same rows, with frequent values, nulls, ties and empty groups."""
    import random

    from knowspan.operators import windows

    r = random.Random(9)
    given = [(r.choice(["a", "a", "b", None]), r.choice([1, 1, 1, 5, None, r.randint(0, 900)]), k, r.choice([0, 1, 7, None])) for k in range(1500)]
    given += [("whole", 3, 9000, 1), ("none", 3, 9001, 500)]
    df = spark.createDataFrame(given, "g string, w int, id int, cost bigint")
    for order, key in ((["-w", "id"], lambda x: (x[1] is None, -(x[1] or 0), x[2])), (["w", "-id"], lambda x: (x[1] is not None, x[1] or 0, -x[2]))):
        want = []
        for g in {x[0] for x in given}:
            used = 0
            for x in sorted((x for x in given if x[0] == g), key=key):
                used += x[3] or 0
                if used <= 400:
                    want.append((x[2], used))
        assert sorted((x.id, x.used) for x in windows.within_budget(df, ["g"], order, "cost", 400).collect()) == sorted(want)
    assert windows.within_budget(df.where("false"), ["g"], ["w"], "cost", 5).collect() == []


def test_picks_beyond_the_pool(spark):
    from knowspan.operators import curation

    pool = spark.createDataFrame([(k, 1, k) for k in range(4)], "doc_id bigint, score int, id bigint")
    outside = spark.createDataFrame([(k, None if k % 2 else 5, k, 10 + k) for k in range(9)], "doc_id bigint, quality int, rule int, size int")
    assert sorted((x.doc_id, x.out_of_pool) for x in curation.daily_picks(pool, outside, 1).collect()) == [(3, False), (6, True), (8, True)]
