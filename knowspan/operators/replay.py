"""Logged searches evaluated anew, and why nobody followed them up.

Every distinct phrase of a log is answered once and all of them in one pass over the texts (``phrases.best``); the log
meets the answers by phrase. An index of the texts would be larger than they are, and the phrases of a log read most of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.config import Sessions
from knowspan.functions import expressions as X
from knowspan.operators import phrases as many
from knowspan.operators import search, sessions
from knowspan.operators.textindex import TextIndex
from knowspan.session import shared_folder, table

CLASSES = ["followed", "args_null", "weak_match", "needs_review"]


def answers(phrases: DataFrame, docs: DataFrame, fields: list[str], title: str, most: int = 3) -> DataFrame:
    """query, titles: those of the ``most`` best documents of each distinct phrase (query), best first; no row where nothing is found."""
    asked = phrases.select("query").where("query is not null").distinct().withColumn("query_id", F.xxhash64("query"))
    if asked.count() != asked.select("query_id").distinct().count():
        raise ValueError("two phrases have one hash")
    best = many.best(docs, fields, asked.select("query_id", F.col("query").alias("phrase")), most, [title])
    lists = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", title))), lambda x: x[title]).alias("titles"))
    return asked.join(lists, "query_id").select("query", "titles")


def attributed(searches: DataFrame, docs: DataFrame, fields: list[str], title: str, settings: Sessions = Sessions()) -> DataFrame:
    """Searches (query, followed) with titles, overlap and class.

    Those followed by a read are done; those without a query can't be judged; of the others the terms of the query are looked for in the
    titles that the search finds today. A query without terms needs a review."""
    found = searches.join(answers(searches.where("not followed"), docs, fields, title), "query", "left")
    found = found.withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    found = found.withColumn("overlap", F.when(~F.col("followed") & F.col("query").isNotNull(), X.overlap_ratio(X.query_terms("query"), F.array_join("titles", " "))))
    kind = F.when(F.col("followed"), "followed").when(F.col("query").isNull(), "args_null").when(F.col("overlap") < settings.weak_overlap, "weak_match")
    return found.withColumn("class", kind.otherwise("needs_review"))


def class_counts(judged: DataFrame) -> DataFrame:
    """class, n: all four classes, 0 where there is none."""
    counts = judged.groupBy("class").agg(F.count("*").alias("n"))
    every = judged.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    return every.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def samples(judged: DataFrame, order: list[str], most: int = 10, cut: int = 24) -> DataFrame:
    """The first ``most`` searches in order that weren't followed, with the beginnings of the titles found."""
    open_ = judged.where("class <> 'followed'").orderBy(*order).limit(most)
    numbered = open_.withColumn("n", F.row_number().over(Window.orderBy(*order)))
    return numbered.withColumn("titles", F.transform("titles", lambda t: F.substring(t, 1, cut)))


# --- queries over the driver's tables: views are searches for two words of the document they name ---


_FIELDS = ["title", "summary", "text"]


def _searches(spark, d) -> DataFrame:
    """Views with followed and query: the fifth and sixth word of document k of their arguments; every seventh has lost its arguments."""
    asked = sessions.followed(sessions._events(spark, d), "user_id", "ts", "event_type", "view", "click")
    named = asked.select("event_id", "ts", "followed", F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"))
    words = F.split("text", " ")
    phrases = table(spark, d, "documents").select("doc_id", F.trim(F.concat_ws(" ", F.get(words, F.lit(4)), F.get(words, F.lit(5)))).alias("query"))
    query = F.when((F.col("event_id") % 7 != 0) & (F.col("query") != ""), F.col("query"))
    return named.join(phrases, "doc_id", "left").withColumn("query", query)


def q_counts(spark, d):
    return class_counts(attributed(_searches(spark, d), search._docs(spark, d), _FIELDS, "title"))


def q_samples(spark, d):
    found = samples(attributed(_searches(spark, d), search._docs(spark, d), _FIELDS, "title"), ["ts", "event_id"])
    return found.select("n", "event_id", "query", F.round("overlap", 6).alias("overlap"), F.array_join("titles", "|").alias("titles"))


def q_replayed(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 9).alias("phrase"))
    return many.best(search._docs(spark, d), _FIELDS, items, 3, [])


def q_upkeep(spark, d):
    """An index after an upsert, deletes and a pruning, before and after compaction: both answer as one built anew would."""
    docs = search._docs(spark, d)
    index = TextIndex(spark, shared_folder(spark, "upkeep"), ["title", "summary", "text"])
    index.upsert(docs, "first")
    changed = docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("With it "), "text")).withColumn("title", F.lit("changed with care"))
    index.upsert(changed, "second")
    index.upsert(changed.where("false"), "second")  # comes again: skipped
    index.delete(docs.where("doc_id % 7 = 3"), "third")
    index.prune(docs.where("n_chars > 200"))
    before = index.search("with").select(F.lit("segments").alias("state"), "doc_id", "score")
    after = TextIndex(spark, index.folder, index.fields)
    after.compact()
    return before.unionByName(after.search("with").select(F.lit("compacted").alias("state"), "doc_id", "score"))


QUERIES = {"g12_replayed_counts": q_counts, "g12_replayed_samples": q_samples, "q17_replayed_search": q_replayed, "m20_index_upkeep": q_upkeep}


def _tf(phrase: str, fields: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN contains(lower({f}), {phrase}) THEN len(list_filter(range(1, length({f}) + 1), lambda i: substring(lower({f}), i, length({phrase})) = {phrase})) ELSE 0 END" for f in fields)


_LEN = " + ".join(f"greatest(length({f}) - 2, 0)" for f in ("title", "summary", "text"))
_IDF = "round(greatest(ln((n - k + 0.5) / (k + 0.5)), 1e-6) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6)"
_BEST = f"""h AS (SELECT query, doc_id, title, len, {_tf('query', ('title', 'summary', 'text'))} AS tf FROM q JOIN m ON contains(lower(text), query)),
b AS (SELECT h.*, {_IDF} AS score FROM (SELECT *, count(*) OVER (PARTITION BY query)::DOUBLE AS k FROM h WHERE tf > 0) h, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b QUALIFY rank <= 3)"""
_DOCS = f"{search._D}, m AS (SELECT *, {_LEN} AS len FROM d), c AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM m)"
_JUDGED = f"""{sessions._S}, {sessions._F}, {_DOCS},
p AS (SELECT doc_id, trim(array_to_string(list_slice(string_split(text, ' '), 5, 6), ' ')) AS query FROM d),
s2 AS (SELECT f.event_id, e.ts, followed, CASE WHEN f.event_id % 7 <> 0 AND query <> '' THEN query END AS asked FROM f JOIN events e USING (event_id) LEFT JOIN p ON p.doc_id = CAST(json_extract(f.props, '$.k') AS BIGINT)),
q AS (SELECT DISTINCT lower(asked) AS query FROM s2 WHERE NOT followed AND asked IS NOT NULL), {_BEST},
t AS (SELECT query, list(title ORDER BY rank) AS titles FROM r GROUP BY 1),
o AS (SELECT s2.*, coalesce(titles, []) AS titles, list_transform(regexp_extract_all(asked, '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda x: lower(x)) AS terms FROM s2 LEFT JOIN t ON t.query = lower(asked)),
w AS (SELECT *, CASE WHEN NOT followed AND len(terms) > 0 THEN len(list_filter(terms, lambda x: contains(lower(array_to_string(titles, ' ')), x))) / len(terms) END AS overlap FROM o),
j AS (SELECT *, CASE WHEN followed THEN 'followed' WHEN asked IS NULL THEN 'args_null' WHEN overlap < 0.2 THEN 'weak_match' ELSE 'needs_review' END AS class FROM w)"""
SQL = {
    "g12_replayed_counts": f"WITH {_JUDGED} SELECT c.class, count(j.class) AS n FROM (VALUES ('followed'), ('args_null'), ('weak_match'), ('needs_review')) c(class) LEFT JOIN j USING (class) GROUP BY 1",
    "g12_replayed_samples": f"""WITH {_JUDGED}, z AS (SELECT * FROM j WHERE class <> 'followed' ORDER BY ts, event_id LIMIT 10)
SELECT row_number() OVER (ORDER BY ts, event_id)::INTEGER AS n, event_id, asked AS query, round(overlap, 6) AS overlap, array_to_string(list_transform(titles, lambda x: substring(x, 1, 24)), '|') AS titles FROM z""",
    "q17_replayed_search": f"""WITH {_DOCS}, i AS (SELECT item_id, lower(substring(text, 1, 9)) AS query FROM benchmark), q AS (SELECT DISTINCT query FROM i), {_BEST}
SELECT item_id AS query_id, rank, doc_id, score FROM i JOIN r USING (query)""",
    "m20_index_upkeep": f"""WITH x AS (SELECT doc_id, text, n_chars FROM documents WHERE doc_id % 7 <> 3 AND n_chars > 200),
d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'changed with care' ELSE substring(text, 1, 80) END AS title, substring(text, 81, 120) AS summary, CASE WHEN doc_id % 5 = 0 THEN 'With it ' ELSE '' END || text AS text FROM x),
m AS (SELECT *, {_LEN} AS len FROM d), c AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM m), h AS (SELECT doc_id, len, {_tf("'with'", ('title', 'summary', 'text'))} AS tf FROM m),
b AS (SELECT doc_id, {_IDF} AS score FROM (SELECT *, count(*) OVER ()::DOUBLE AS k FROM h WHERE tf > 0) h, c)
SELECT state, doc_id, score FROM b, (VALUES ('segments'), ('compacted')) s(state)""",
}
