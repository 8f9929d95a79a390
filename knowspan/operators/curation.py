"""Recommendations, governance of tags and trees, profiles and periodic reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.functions import expressions as X
from knowspan.operators import relations, sessions, windows
from knowspan.session import table


def daily_picks(pool: DataFrame, outside: DataFrame, epoch_day: int, size: int = 3) -> DataFrame:
    """The day's slice of the pool (doc_id, score, id); filled up to ``size`` from outside it by quality, rule score and size."""
    picked = windows.rotation(pool, [F.desc("score"), F.asc("id")], epoch_day, size).select("doc_id", F.lit(False).alias("out_of_pool"))
    lack = size - picked.count()
    more = relations.missing(outside, "doc_id", pool).orderBy(F.col("quality").isNotNull().desc(), F.desc(F.coalesce("quality", F.lit(0)) * 3 + F.col("rule")), F.desc("size"), "doc_id").limit(lack)
    return picked.unionByName(more.select("doc_id", F.lit(True).alias("out_of_pool")))


def suggestions(branches: list[DataFrame], most: int = 3) -> DataFrame:
    """Up to ``most`` documents (doc_id, why, pos) of the branches in order, each once."""
    first = relations.keep_first([b.orderBy("pos").limit(most * (k + 1)) for k, b in enumerate(branches)], "doc_id")
    return first.orderBy("_list", "pos").limit(most)


def related(docs: DataFrame, opened: DataFrame, group: str, most: int = 5) -> DataFrame:
    """of, n (from 1), doc_id, opens: for each document the ``most`` opened ones of its group, those with the most opens first.

    A group is reduced to its best ``most`` + 1, one of which may be the document itself, and each document meets that one row."""
    order = Window.partitionBy(group).orderBy(F.desc("opens"), "doc_id")
    best = opened.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most + 1)
    lists = best.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "doc_id", "opens"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["opens"].alias("opens"))).alias("_best"))
    others = F.slice(F.filter("_best", lambda x: x["doc_id"] != F.col("of")), 1, most)
    met = docs.select(F.col("doc_id").alias("of"), group).join(lists, group).select("of", F.posexplode(others).alias("n", "_x"))
    return met.select("of", (F.col("n") + 1).alias("n"), "_x.doc_id", "_x.opens")


def merge_tags(bridge: DataFrame, item: str, tag: str, canonical: DataFrame) -> DataFrame:
    """The bridge with tags moved to their canonical ones (tag, to); a pair that then repeats stays once."""
    moved = bridge.join(canonical.select(F.col("tag").alias(tag), "to"), tag, "left")
    return moved.select(item, F.coalesce("to", tag).alias(tag)).distinct()


def keepers(names: DataFrame, name: str, ident: str, weight: str) -> DataFrame:
    """For each name that repeats: every id and the one that stays, with the largest weight, then the smallest id."""
    best = names.groupBy(name).agg(F.max_by(ident, F.struct(F.col(weight), (-F.col(ident)).alias("_i"))).alias("keeper"), F.count("*").alias("_n"))
    return names.join(best.where("_n > 1"), name).select(ident, "keeper")


def accept(proposals: DataFrame, most: int = 12) -> DataFrame:
    """Members of the proposals (id, canonical, members) that are small enough, as (tag, to); the first proposal of a tag counts."""
    spread = proposals.where(F.size("members") <= most).select("id", "canonical", F.explode("members").alias("tag")).where("tag <> canonical")
    return spread.groupBy("tag").agg(F.min_by("canonical", "id").alias("to"))


def profile(reads: DataFrame, domains: DataFrame, labels: DataFrame, least: int = 5, top: int = 5) -> DataFrame:
    """By domain: reads, mean rating, weighted tags (weights 1, 0.6, 0.3 by kind) of domains with enough signals."""
    joined = reads.join(domains, "doc_id").join(labels, "doc_id", "left")
    base = joined.groupBy("domain").agg(F.count("*").alias("reads"), F.countDistinct("doc_id").alias("docs"), F.round(F.avg("rating"), 1).alias("rating"))
    weight = F.when(F.col("kind") == "purchase", 1.0).when(F.col("kind") == "click", 0.6).otherwise(0.3)
    tags = joined.groupBy("domain", "tag").agg(F.round(F.sum(weight), 4).alias("w"))
    ranked = tags.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("w"), "tag"))).where(F.col("_n") <= top)
    best = ranked.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "tag"))), lambda x: x["tag"]), ",").alias("tags"))
    return base.join(best, "domain", "left").withColumn("enough", F.col("reads") >= least)


def evict(claims: DataFrame, by: str, cost: str, budget: float) -> DataFrame:
    """Claims that stay within a budget: those with the fewest evidence go first, later ones before earlier."""
    return windows.within_budget(claims, [by], ["-evidence", "id"], cost, budget)


def checks(rows: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """One row (check, found, ok) for each named table of faults and how many it may have."""
    parts = [f.agg(F.count("*").alias("found")).select(F.lit(n).alias("check"), "found", (F.col("found") <= most).alias("ok")) for n, f, most in rows]
    return reduce(DataFrame.unionByName, parts)


# --- queries over the driver's tables -------------------------------------------------------------


def _files(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select("doc_id", "lang", "source", F.col("n_chars").alias("size"), "quality", F.pmod("doc_id", F.lit(11)).alias("rule"))


def _pool(spark, d) -> DataFrame:
    return _files(spark, d).where("quality = 1").select("doc_id", F.col("rule").alias("score"), F.col("doc_id").alias("id"))


def q_daily_picks(spark, d):
    return daily_picks(_pool(spark, d), _files(spark, d), 19754)


def q_preview(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count_if(F.col("event_type") == "click").alias("opens"), F.count_if(F.col("event_type") == "purchase").alias("done"))
    rows = _files(spark, d).where("lang in ('en', 'de')").join(e, "doc_id", "left")
    score = F.coalesce(F.col("quality"), F.lit(0)) * 3 + F.col("rule") + F.coalesce("opens", F.lit(0)) * 1.2 + F.coalesce("done", F.lit(0)) * 1.5
    return rows.withColumn("score", F.round(score, 4)).orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", "score", "lang")


def q_suggestions(spark, d):
    e = table(spark, d, "events")
    number = lambda df, *o: df.withColumn("pos", F.row_number().over(Window.orderBy(*o)))
    due = number(e.where("event_type = 'error' and ts < '2024-01-01 03:00:00'").groupBy(F.col("user_id").alias("doc_id")).agg(F.min("ts").alias("at")).orderBy("at", "doc_id").limit(1), "at", "doc_id")
    hot = number(e.where("event_type = 'click' and ts >= '2024-01-24'").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "doc_id").limit(9), F.desc("n"), "doc_id")
    gap = number(_files(spark, d).orderBy(F.desc("rule"), "doc_id").limit(9), F.desc("rule"), "doc_id")
    branches = [b.select("doc_id", F.lit(w).alias("why"), "pos") for b, w in ((due, "due"), (hot, "hot"), (gap, "goal"))]
    return suggestions(branches).select("doc_id", "why")


def q_related(spark, d):
    e = table(spark, d, "events").where("event_type = 'click' and ts >= '2024-01-01'").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("opens"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    return related(docs, docs.join(e, "doc_id"), "source").select("of", "n", "doc_id", "opens")


def q_tag_merge(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("tag"), F.lower(F.substring("p_name", 1, 6)).alias("k"))
    best = parts.groupBy("k").agg(F.min("tag").alias("to"))
    canon = parts.join(best, "k").where("tag <> to").select("tag", "to")
    merged = merge_tags(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", canon)
    return merged.groupBy("l_partkey").agg(F.count("*").alias("n"))


def q_proposals(spark, d):
    parts = table(spark, d, "part")
    asked = parts.groupBy("p_brand", "p_size").agg(F.sort_array(F.collect_list("p_partkey")).alias("members"), F.min("p_partkey").alias("canonical"))
    asked = asked.select(F.concat("p_brand", F.lit(":"), F.format_string("%03d", "p_size")).alias("id"), "members", "canonical")
    return accept(asked, 3).select("tag", "to")


def q_subtree_delete(spark, d):
    gone = relations.descendants(spark, relations._tree(spark, d), "node", "up").where("ancestor in ('r1', 'n3')").select(F.col("descendant").alias("node")).distinct()
    customers = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey")).alias("node"))
    kept = customers.join(gone.withColumn("gone", F.lit(True)), "node", "left").select("c_custkey", F.when(F.col("gone").isNull(), F.col("node")).alias("node"))
    return kept.groupBy("node").agg(F.count("*").alias("n"))


def q_keeper(spark, d):
    names = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"), F.round("c_acctbal", 0).alias("w"))
    named = names.withColumn("name", F.concat("name", F.lit("-"), (F.col("c_custkey") % 50).cast("string")))
    return keepers(named, "name", "c_custkey", "w")


def q_tag_list(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("tag"), F.col("p_brand").alias("brand"), (F.col("p_size") <= 10).alias("top"))
    mounts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("tag")).agg(F.countDistinct("l_orderkey").alias("n"))
    through = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("tag")).groupBy("brand").agg(F.countDistinct("l_orderkey").alias("members"))
    rows = parts.join(mounts, "tag", "left").join(through, "brand", "left")
    return rows.select("tag", "top", F.when(F.col("top"), F.coalesce("members", F.lit(0))).otherwise(F.coalesce("n", F.lit(0))).alias("file_count"))


def q_profile(spark, d):
    reads = table(spark, d, "events").where("event_type in ('view', 'click', 'purchase')").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("kind"), (F.col("event_id") % 5 + 1).alias("rating"))
    domains = table(spark, d, "documents").select("doc_id", F.col("lang").alias("domain"))
    tags = table(spark, d, "documents").select("doc_id", F.col("source").alias("tag"))
    return profile(reads, domains, tags)


def q_claim_budget(spark, d):
    claims = table(spark, d, "documents").select("lang", F.col("doc_id").alias("id"), F.pmod("doc_id", F.lit(7)).alias("evidence"), F.length(F.substring("text", 1, 90)).cast("bigint").alias("cost"))
    return evict(claims, "lang", "cost", 1200).select("lang", "id", "used")


def q_doctor(spark, d):
    docs, labels, vectors = table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return checks([("unlabelled", relations.missing(docs, "doc_id", labels), 0), ("orphan labels", relations.missing(labels, "doc_id", docs), 0), ("without vector", relations.missing(docs, "doc_id", vectors), 600), ("short", docs.where("n_chars < 300"), 100)])


def q_weekly_clusters(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    week = F.date_trunc("week", "o_orderdate")
    inside = F.to_date("o_orderdate") < F.date_add(F.to_date(week), 6)  # to Sunday, 00:00
    return o.where(inside).groupBy(X.iso_week("o_orderdate").alias("week"), F.col("o_orderpriority").alias("domain")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


def q_week_card(spark, d):
    e = table(spark, d, "events").where("ts >= '2024-01-24' and ts < '2024-01-31'")
    star = (F.col("event_id") % 5 + 1).cast("int")
    return e.agg(F.count("*").alias("opened"), F.countDistinct("user_id").alias("docs"), F.count_if(F.col("event_type") == "purchase").alias("done"), *(F.count_if((F.col("event_type") == "click") & (star == s)).alias(f"star{s}") for s in range(1, 6)), F.round(F.avg(F.when(F.col("event_type") == "click", star)), 2).alias("mean_star"))


def q_daily_report(spark, d):
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("distilled"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    return o.where("day >= date'1998-06-01'")


def q_triage(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.ceil(F.least(F.octet_length("text"), F.lit(4096)) / 2).cast("bigint").alias("tokens"), "n_chars")
    chosen = windows.within_budget(files, [], ["-n_chars", "doc_id"], "tokens", 100_000)
    return chosen.select("doc_id", "tokens", "used")


def q_manifest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


QUERIES = {
    "q06_daily_picks": q_daily_picks, "q07_recommend_preview": q_preview, "q09_suggestions": q_suggestions, "q10_related_reading": q_related, "m11_tag_merge": q_tag_merge, "m13_proposals": q_proposals,
    "m15_subtree_delete": q_subtree_delete, "g27_keeper": q_keeper, "g17_tag_list": q_tag_list, "g16_profile_bundle": q_profile, "m19_claim_budget": q_claim_budget, "g20_doctor_checks": q_doctor,
    "g24_weekly_clusters": q_weekly_clusters, "g15_week_card": q_week_card, "g23_daily_report": q_daily_report, "q25_triage_selection": q_triage, "k04_export_manifest": q_manifest,
}
_FILES = "f AS (SELECT documents.doc_id, lang, source, n_chars AS size, quality, documents.doc_id % 11 AS rule FROM documents LEFT JOIN labels USING (doc_id))"
SQL = {
    "q06_daily_picks": f"""WITH {_FILES}, p AS (SELECT doc_id, row_number() OVER (ORDER BY rule DESC, doc_id) - 1 AS i, count(*) OVER () AS n FROM f WHERE quality = 1), s AS (SELECT doc_id FROM p WHERE i // 3 = 19754 % ((n + 2) // 3)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY quality IS NOT NULL DESC, coalesce(quality, 0) * 3 + rule DESC, size DESC, doc_id) AS r FROM f WHERE doc_id NOT IN (SELECT doc_id FROM p))
SELECT doc_id, false AS out_of_pool FROM s UNION ALL SELECT doc_id, true FROM o WHERE r <= 3 - (SELECT count(*) FROM s)""",
    "q07_recommend_preview": f"""WITH {_FILES}, e AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS opens, count(*) FILTER (WHERE event_type = 'purchase') AS done FROM events GROUP BY 1)
SELECT doc_id, round(coalesce(quality, 0) * 3 + rule + coalesce(opens, 0) * 1.2::DOUBLE + coalesce(done, 0) * 1.5::DOUBLE, 4) AS score, lang FROM f LEFT JOIN e ON user_id = doc_id WHERE lang IN ('en', 'de') ORDER BY score DESC, doc_id LIMIT 50""",
    "q09_suggestions": """WITH a AS (SELECT user_id AS doc_id, 0 AS l, row_number() OVER (ORDER BY min(ts), user_id) AS pos FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-01 03:00:00' GROUP BY 1 ORDER BY pos LIMIT 1),
b AS (SELECT user_id AS doc_id, 1 AS l, row_number() OVER (ORDER BY count(*) DESC, user_id) AS pos FROM events WHERE event_type = 'click' AND ts >= DATE '2024-01-24' GROUP BY 1 HAVING count(*) >= 2 ORDER BY pos LIMIT 9),
c AS (SELECT doc_id, 2 AS l, row_number() OVER (ORDER BY doc_id % 11 DESC, doc_id) AS pos FROM documents ORDER BY pos LIMIT 9),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l, pos) = 1)
SELECT doc_id, CASE l WHEN 0 THEN 'due' WHEN 1 THEN 'hot' ELSE 'goal' END AS why FROM k ORDER BY l, pos LIMIT 3""",
    "q10_related_reading": "WITH e AS (SELECT user_id, count(*) AS opens FROM events WHERE event_type = 'click' AND ts >= DATE '2024-01-01' GROUP BY 1) SELECT a.doc_id AS \"of\", row_number() OVER (PARTITION BY a.doc_id ORDER BY opens DESC, b.doc_id)::INTEGER AS n, b.doc_id, opens FROM documents a JOIN documents b ON a.source = b.source AND a.doc_id <> b.doc_id JOIN e ON user_id = b.doc_id QUALIFY n <= 5",
    "m11_tag_merge": "WITH k AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(substring(p_name, 1, 6))) AS c FROM part) SELECT c AS l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN k ON p_partkey = l_partkey GROUP BY 1",
    "m13_proposals": "WITH g AS (SELECT p_partkey, p_brand, min(p_partkey) OVER w AS c, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand, p_size)) SELECT p_partkey AS tag, c AS \"to\" FROM g WHERE n <= 3 AND p_partkey <> c",
    "m15_subtree_delete": "SELECT node, count(*) AS n FROM (SELECT CASE WHEN n_regionkey = 1 OR n_nationkey = 3 THEN NULL ELSE 'n' || n_nationkey END AS node FROM customer JOIN nation ON n_nationkey = c_nationkey) t GROUP BY 1",
    "g27_keeper": "WITH n AS (SELECT c_custkey, c_mktsegment || '-' || c_custkey % 50 AS name, round(c_acctbal, 0) AS w FROM customer) SELECT c_custkey, first_value(c_custkey) OVER (PARTITION BY name ORDER BY w DESC, c_custkey) AS keeper FROM n QUALIFY count(*) OVER (PARTITION BY name) > 1",
    "g17_tag_list": "SELECT p_partkey AS tag, p_size <= 10 AS top, CASE WHEN p_size <= 10 THEN (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN part q ON q.p_partkey = l_partkey WHERE q.p_brand = p.p_brand) ELSE (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey = p.p_partkey) END AS file_count FROM part p",
    "g16_profile_bundle": """WITH j AS (SELECT lang AS domain, source AS tag, doc_id, event_id % 5 + 1 AS rating, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.6 ELSE 0.3 END::DOUBLE AS w FROM events JOIN documents ON doc_id = user_id WHERE event_type IN ('view', 'click', 'purchase')),
t AS (SELECT domain, tag, round(sum(w), 4) AS w FROM j GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY round(sum(w), 4) DESC, tag) <= 5), g AS (SELECT domain, string_agg(tag, ',' ORDER BY w DESC, tag) AS tags FROM t GROUP BY 1)
SELECT domain, count(*) AS reads, count(DISTINCT doc_id) AS docs, round(avg(rating), 1)::DOUBLE AS rating, any_value(tags) AS tags, count(*) >= 5 AS enough FROM j JOIN g USING (domain) GROUP BY 1""",
    "m19_claim_budget": "SELECT lang, id, used FROM (SELECT lang, doc_id AS id, (sum(least(length(text), 90)) OVER (PARTITION BY lang ORDER BY doc_id % 7 DESC, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM documents) t WHERE used <= 1200",
    "g20_doctor_checks": """SELECT 'unlabelled' AS "check", count(*) AS found, count(*) <= 0 AS ok FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'orphan labels', count(*), count(*) <= 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'without vector', count(*), count(*) <= 600 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'short', count(*), count(*) <= 100 FROM documents WHERE n_chars < 300""",
    "g24_weekly_clusters": "SELECT strftime(o_orderdate, '%G-W%V') AS week, o_orderpriority AS domain, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders WHERE o_orderstatus <> 'P' AND isodow(o_orderdate) < 7 GROUP BY 1, 2",
    "g15_week_card": "WITH e AS (SELECT *, event_id % 5 + 1 AS star FROM events WHERE ts >= DATE '2024-01-24' AND ts < DATE '2024-01-31') SELECT count(*) AS opened, count(DISTINCT user_id) AS docs, count(*) FILTER (WHERE event_type = 'purchase') AS done, " + ", ".join(f"count(*) FILTER (WHERE event_type = 'click' AND star = {s}) AS star{s}" for s in range(1, 6)) + ", round(avg(star) FILTER (WHERE event_type = 'click'), 2)::DOUBLE AS mean_star FROM e",
    "g23_daily_report": "SELECT o_orderdate::DATE AS day, count(*) AS distilled, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders WHERE o_orderdate >= DATE '1998-06-01' GROUP BY 1",
    "q25_triage_selection": "SELECT doc_id, tokens, used FROM (SELECT doc_id, tokens, (sum(tokens) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM (SELECT doc_id, n_chars, ceil(least(strlen(text), 4096) / 2)::BIGINT AS tokens FROM documents) a) t WHERE used <= 100000",
    "k04_export_manifest": "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents",
}
