"""Keyword, full-text and vector routes and their fusion by reciprocal rank.

A route is limited to its best rows before it is ranked, so a rank never sorts the corpus in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.config import Search
from knowspan.functions import expressions as X
from knowspan.operators import gates, relations
from knowspan.operators.textindex import TextIndex
from knowspan.plans.query import Query, parse
from knowspan.session import shared_folder, table


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The best ``most`` rows with rank from 1."""
    best = rows.orderBy(*order).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def keyword_route(docs: DataFrame, fields: list[str], word: str, recency: str, most: int, **equal) -> DataFrame:
    return ranked(gates.keyword_filter(docs, fields, word, **equal), [F.desc(recency), F.desc("doc_id")], most)


def occurrences(text: Column, phrase: str) -> Column:
    """How often the phrase begins in the text, whatever its case; occurrences may overlap."""
    return F.regexp_count(F.lower(text), F.lit(f"(?={re.escape(phrase.lower())})")).cast("bigint")


def full_text(docs: DataFrame, fields: list[str], phrase: str, settings: Search = Search()) -> DataFrame:
    """Adds score to the documents that hold the phrase: BM25 over trigrams, the phrase one unit over all fields.

    Phrases shorter than a trigram have no rank of their own: title hits come first, then the other fields in order."""
    if len(phrase) < 3:
        hit = F.lit(None).cast("int")
        for k, f in reversed(list(enumerate(fields))):
            hit = F.when(F.contains(F.lower(F.col(f)), F.lit(phrase.lower())), k).otherwise(hit)
        return docs.withColumn("_at", hit).where("_at is not null").withColumn("score", -F.col("_at").cast("double")).drop("_at")
    size = lambda f: F.greatest(F.coalesce(F.length(f), F.lit(0)) - 2, F.lit(0))
    measured = docs.withColumn("_len", sum((size(f) for f in fields), F.lit(0)).cast("bigint")).withColumn("_tf", sum((F.coalesce(occurrences(F.col(f), phrase), F.lit(0)) for f in fields), F.lit(0)))
    n, found, mean = measured.agg(F.count("*"), F.count_if(F.col("_tf") > 0), F.avg("_len")).first()  # three numbers
    idf = F.greatest(F.ln((F.lit(float(n)) - found + 0.5) / (F.lit(float(found)) + 0.5)), F.lit(1e-6))
    tf = F.col("_tf") * (settings.k1 + 1) / (F.col("_tf") + settings.k1 * (1 - settings.b + settings.b * F.col("_len") / F.lit(float(mean or 1.0))))
    return measured.where("_tf > 0").withColumn("score", F.round(idf * tf, 6)).drop("_len", "_tf")


def best_chunks(vectors: DataFrame, queries: DataFrame, entry: str) -> DataFrame:
    """For each query and entry the most similar chunk, if its cosine is over 0. ``queries`` (query_id, query) are few and stated."""
    normed = vectors.withColumn("_norm", X.norm("embedding")).where("_norm > 0")
    asked = queries.withColumn("_qnorm", X.norm("query")).where("_qnorm > 0")
    met = normed.join(F.broadcast(asked), F.size("embedding") == F.size("query"))
    scored = met.withColumn("score", F.round(X.dot("embedding", "query") / (F.col("_norm") * F.col("_qnorm")), 6)).where("score > 0")
    return scored.groupBy("query_id", entry).agg(F.max(F.struct("score", (-F.col("vec_id")).alias("v"))).alias("_b")).select("query_id", entry, F.col("_b.score").alias("score"), (-F.col("_b.v")).alias("chunk"))


def fuse(routes: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Sum of reciprocal ranks over routes (key, rank)."""
    every = None
    for route in routes:
        part = route.select(key, X.rrf("rank", k).alias("_r"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.sum("_r").alias("base"), F.count("*").alias("routes"))


def hybrid(
    docs: DataFrame, vectors: DataFrame, query: Query, query_vector: DataFrame | None, settings: Search = Search(), use_vectors: bool = True,
    tags: DataFrame | None = None, index: TextIndex | None = None, **equal,
) -> DataFrame:
    """The fused result over documents (doc_id, title, summary, text, n_chars, quality, rule): filters apply to rows after ranks are given.

    ``tags`` (doc_id, tag) is needed where the query asks for tags; a document carries one of those asked for. With an ``index`` of
    title, summary, text and source that stores n_chars and the columns of ``equal``, no route reads texts."""
    if query.tags and tags is None:
        raise ValueError("the query asks for tags: hand in the table of tags")
    most = settings.limit * settings.oversample * settings.oversample
    named = ["title", "summary", "source"]
    if index is None:
        routes = [keyword_route(docs, named, query.recall, "n_chars", most, **equal)]
    else:
        held = gates.keyword_filter(index.containing(query.recall, named), [], None, **equal)
        routes = [ranked(held, [F.desc("n_chars"), F.desc("doc_id")], most)]
    if query.recall:
        found = full_text(docs, ["title", "summary", "text"], query.recall, settings) if index is None else index.search(query.recall, settings)
        routes.append(ranked(found, [F.desc("score"), F.asc("doc_id")], most))
    if use_vectors and query_vector is not None:
        near = best_chunks(vectors.withColumnRenamed("entry", "doc_id"), query_vector, "doc_id")
        routes.append(ranked(near.select("doc_id", "score"), [F.desc("score"), F.asc("doc_id")], most))
    fused = fuse(routes, "doc_id", settings.rrf_k)
    best = fused.collect()  # at most ``most`` rows a route; their ids prune the scan of documents
    rows = gates.keyword_filter(docs.where(F.col("doc_id").isin([r.doc_id for r in best])), [], None, **equal)
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(best, fused.schema)), "doc_id")
    if query.tags:
        rows = relations.any_tag(rows, "doc_id", tags, "tag", query.tags)
    rows = gates.title_filter(rows, "title", query.title, query.exclude, ["title", "summary", "source"])
    rows = rows.withColumn("score", F.round(F.col("base") * (1 + X.prior("quality", "rule")), 9))
    return rows.orderBy(F.desc("score"), F.desc("n_chars"), F.desc("doc_id")).limit(settings.limit)


def replay(docs: DataFrame, queries: DataFrame, most: int = 3) -> DataFrame:
    """For each stated query (query_id, terms): the documents that share most of its terms, the best ``most``.

    Terms meet by equality: those of the queries are broadcast against the distinct words of each document."""
    words = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿß]{3,}"), F.lit(0)), lambda w: w))).alias("term"))
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    hits = words.join(F.broadcast(asked), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def relaxed(docs: DataFrame, text: str, fields: list[str], most: int = 3) -> DataFrame:
    """Any of the first three distinct words or CJK runs of the text, newest first."""
    tokens = list(dict.fromkeys(re.findall(r"[A-Za-z]{2,}|[一-鿿]+", text)))[:3]
    test = F.lit(False)
    for t in tokens:
        for f in fields:
            test = test | F.contains(F.lower(F.col(f)), F.lit(t.lower()))
    return docs.where(test).orderBy(F.desc("doc_id")).limit(most)


# --- queries over the driver's tables -------------------------------------------------------------


def _docs(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", (F.col("quality") * 10).alias("quality")), "doc_id", "left")
    return docs.select("doc_id", "source", "lang", "n_chars", F.substring("text", 1, 80).alias("title"), F.substring("text", 81, 120).alias("summary"), "text", "quality", F.pmod("doc_id", F.lit(11)).alias("rule"))


_INDEXES: dict[tuple, TextIndex] = {}


def _index(spark, d) -> TextIndex:
    """The index of the documents of a folder, built when it is first asked for and again when the files have changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    key = (spark.sparkContext.applicationId, d, *((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files))
    if key not in _INDEXES:
        index = TextIndex(spark, shared_folder(spark, "index"), ["title", "summary", "text", "source"], ["title", "summary", "text"], ["title", "n_chars", "lang"])
        index.upsert(_docs(spark, d))
        _INDEXES[key] = index
    return _INDEXES[key]


def _asked(spark, d, ids=(7,)) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id").isin(list(ids))).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def q_fts_substring(spark, d):
    return _index(spark, d).search("ea").select("doc_id", "score")


def q_fts_bm25(spark, d):
    return _index(spark, d).search("with").select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(50)


def q_vector_topk(spark, d):
    near = best_chunks(table(spark, d, "embeddings").withColumn("entry", F.col("label")), _asked(spark, d, (7, 20, 33)), "entry")
    return near.select("query_id", "entry", "chunk", F.round("score", 4).alias("score"))


def q_rrf(spark, d):
    a = ranked(table(spark, d, "documents").where("lang = 'en'"), [F.desc("n_chars"), F.asc("doc_id")], 30)
    b = ranked(table(spark, d, "documents").where("source in ('src1', 'src2', 'src3')"), [F.desc("n_chars"), F.asc("doc_id")], 30)
    return fuse([a, b], "doc_id").select("doc_id", "routes", F.round("base", 9).alias("base"))


def q_hybrid(spark, d):
    found = hybrid(_docs(spark, d), table(spark, d, "embeddings").withColumn("entry", F.col("vec_id")), parse('the -zzz'), _asked(spark, d), index=_index(spark, d))
    return found.select("doc_id", "score", "routes", "n_chars")


def q_hybrid_filtered(spark, d):
    found = hybrid(_docs(spark, d), table(spark, d, "embeddings").withColumn("entry", F.col("vec_id")), parse("title:ing gh", {"gh": "-qqq"}), _asked(spark, d), index=_index(spark, d), lang="en")
    return found.select("doc_id", "score", "routes", "n_chars")


def q_tagged(spark, d):
    tags = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("t"), F.col("l_linenumber")).alias("tag"))
    found = hybrid(_docs(spark, d), table(spark, d, "embeddings").withColumn("entry", F.col("vec_id")), parse("the tag:t5 tag:t6"), _asked(spark, d), tags=tags, index=_index(spark, d))
    return found.select("doc_id", "score", "routes", "n_chars")


def q_replay(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(F.filter(F.transform(F.split("text", " "), lambda w: F.lower(w)), lambda w: w.rlike("^[a-z]{6,}$")), 1, 5).alias("terms"))
    return replay(table(spark, d, "documents"), queries).select("query_id", "rank", "doc_id", "hits")


def q_query_terms(spark, d):
    e = table(spark, d, "benchmark")
    terms = X.query_terms(F.concat(F.col("text"), F.lit(" 知识 图谱检索 文")))
    return e.select("item_id", F.array_join(terms, " ").alias("terms"), F.round(X.overlap_ratio(F.array(F.lit("the"), F.lit("zzz"), F.lit("and")), "text"), 6).alias("overlap"), X.tokens_by_script("text").cast("bigint").alias("tokens"), X.tokens_by_length("text").cast("bigint").alias("length_tokens"))


def q_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet("text", F.lit("with")).alias("snippet"), X.clean_summary("text").alias("summary"))


def q_relaxed(spark, d):
    return relaxed(table(spark, d, "documents"), "zz with qqq the", ["text"]).select("doc_id", "lang")


QUERIES = {
    "t13_fts_short": q_fts_substring, "t13_fts_bm25": q_fts_bm25, "q03_vector_topk": q_vector_topk, "t17_rrf_fusion": q_rrf, "q02_hybrid_search": q_hybrid, "q01_search_knowledge": q_hybrid_filtered, "p13_tagged_search": q_tagged,
    "q17_baseline_replay": q_replay, "t06_query_terms": q_query_terms, "t15_snippet": q_snippet, "t40_relaxed_search": q_relaxed,
}
_D = "d AS (SELECT documents.doc_id, source, lang, n_chars, substring(text, 1, 80) AS title, substring(text, 81, 120) AS summary, text, quality * 10 AS quality, documents.doc_id % 11 AS rule FROM documents LEFT JOIN labels USING (doc_id))"


def _bm25(phrase: str) -> str:
    tf = " + ".join(f"len(list_filter(range(1, length({f}) + 1), lambda i: substring(lower({f}), i, {len(phrase)}) = '{phrase}'))" for f in ("title", "summary", "text"))
    size = " + ".join(f"greatest(length({f}) - 2, 0)" for f in ("title", "summary", "text"))
    return f"m AS (SELECT *, {tf} AS tf, {size} AS len FROM d), c AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (WHERE tf > 0))::DOUBLE AS k, avg(len) AS mean FROM m), t AS (SELECT m.*, round(greatest(ln((n - k + 0.5) / (k + 0.5)), 1e-6) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score FROM m, c WHERE tf > 0)"


_V = "v AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings)"


def _hybrid(phrase: str, where: str, after: str) -> str:
    return f"""WITH {_D}, {_bm25(phrase)}, {_V},
a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS r FROM d WHERE {where} AND (contains(lower(title), '{phrase}') OR contains(lower(summary), '{phrase}') OR contains(lower(source), '{phrase}')) QUALIFY r <= 180),
b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM t QUALIFY r <= 180),
e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM v WHERE score > 0 QUALIFY r <= 180),
f AS (SELECT doc_id, sum(1.0::DOUBLE / (r + 60)) AS base, count(*) AS routes FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e) u GROUP BY 1)
SELECT doc_id, round(base * (1 + (coalesce(quality, 0) * 3 + coalesce(rule, 0)) / 40), 9) AS score, routes, n_chars FROM d JOIN f USING (doc_id) WHERE {where} {after} ORDER BY score DESC, n_chars DESC, doc_id DESC LIMIT 20"""


SQL = {
    "t13_fts_short": f"WITH {_D} SELECT doc_id, CASE WHEN contains(lower(title), 'ea') THEN 0.0 WHEN contains(lower(summary), 'ea') THEN -1.0 ELSE -2.0 END::DOUBLE AS score FROM d WHERE contains(lower(title), 'ea') OR contains(lower(summary), 'ea') OR contains(lower(text), 'ea')",
    "t13_fts_bm25": f"WITH {_D}, {_bm25('with')} SELECT doc_id, score FROM t ORDER BY score DESC, doc_id LIMIT 50",
    "q03_vector_topk": "WITH s AS (SELECT q.vec_id AS query_id, x.label AS entry, x.vec_id AS chunk, round(list_cosine_similarity(x.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings x, embeddings q WHERE q.vec_id IN (7, 20, 33)) SELECT query_id, entry, chunk, round(score, 4) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, entry ORDER BY score DESC, chunk) = 1",
    "t17_rrf_fusion": """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE lang = 'en' QUALIFY r <= 30), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE source IN ('src1', 'src2', 'src3') QUALIFY r <= 30)
SELECT doc_id, count(*) AS routes, round(sum(1.0::DOUBLE / (60 + r)), 9) AS base FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY 1""",
    "q02_hybrid_search": _hybrid("the", "true", "AND NOT contains(lower(title || ' ' || summary || ' ' || source), 'zzz')"),
    "q01_search_knowledge": _hybrid("ing", "lang = 'en'", "AND contains(lower(title), 'ing') AND NOT contains(lower(title || ' ' || summary || ' ' || source), 'qqq')"),
    "p13_tagged_search": _hybrid("the", "true", "AND doc_id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (5, 6))"),
    "q17_baseline_replay": """WITH q AS (SELECT item_id AS query_id, list_slice(list_filter(list_transform(string_split(text, ' '), lambda w: lower(w)), lambda w: regexp_matches(w, '^[a-z]{6,}$')), 1, 5) AS terms FROM benchmark),
t AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM q), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿß]{3,}')) AS term FROM documents),
h AS (SELECT query_id, doc_id, count(*) AS hits FROM t JOIN w USING (term) GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id)::INTEGER AS rank, doc_id, hits FROM h QUALIFY rank <= 3""",
    "t06_query_terms": r"""SELECT item_id, '知识 图谱 谱检 检索 文' || CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, ' ') ELSE '' END AS terms,
round((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'zzz') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'and') THEN 1 ELSE 0 END) / 3.0::DOUBLE, 6) AS overlap,
ceil(length(text) / 4)::BIGINT AS tokens, ceil(length(text) / 2.2::DOUBLE)::BIGINT AS length_tokens
FROM (SELECT *, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{2,}'), lambda x: lower(x)) AS w FROM benchmark) t""",
    "t15_snippet": r"""SELECT doc_id, CASE WHEN strpos(lower(text), 'with') > 0 THEN substring(text, greatest(strpos(lower(text), 'with') - 40, 1), 120) ELSE substring(text, 1, 120) END AS snippet,
CASE WHEN length(c) > 80 THEN substring(c, 1, 80) || '…' ELSE c END AS summary FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents) t""",
    "t40_relaxed_search": "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'zz') OR contains(lower(text), 'with') OR contains(lower(text), 'qqq') ORDER BY doc_id DESC LIMIT 3",
}
