"""Counts, rates, costs and calendars over logs and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.functions import expressions as X
from knowspan.session import table

#: The driver's events are of January 2024.
AS_OF = "2024-01-31"


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """A share in percent; 0 where there is nothing."""
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), digits)


def members(classified: DataFrame, anchored: DataFrame, attached: DataFrame) -> DataFrame:
    """Distinct (group, item) of three ways to belong; each has these two columns."""
    return classified.union(anchored).union(attached).where("group is not null").distinct()


def costs(calls: DataFrame, prices: DataFrame, key: str, tokens_in: str, tokens_out: str, by: list[str]) -> DataFrame:
    """Cost to four digits a group and model, then summed; null where nothing has a price, and whether something hadn't."""
    per = calls.groupBy(*by, key).agg(F.sum(tokens_in).alias("_in"), F.sum(tokens_out).alias("_out"), F.count("*").alias("_n"))
    per = per.join(F.broadcast(prices), key, "left").withColumn("_cost", F.round((F.col("_in") * F.col("price_in") + F.col("_out") * F.col("price_out")) / 1e6, 4))
    return per.groupBy(*by).agg(F.sum("_n").alias("calls"), F.round(F.sum("_cost"), 4).alias("cost"), F.bool_or(F.col("_cost").isNull()).alias("unpriced"))


def calendar(spark: SparkSession, until: str, days: int) -> DataFrame:
    """A row for each of the last days, the last one included."""
    return spark.sql(f"SELECT explode(sequence(date_sub(date'{until}', {days - 1}), date'{until}')) AS day")


def dense(spark: SparkSession, facts: DataFrame, day: str, key: str, until: str, days: int) -> DataFrame:
    """A count for each day and key, 0 where there is none; keys are those of the facts within the days."""
    frame = calendar(spark, until, days)
    counted = facts.groupBy(F.to_date(day).alias("day"), key).agg(F.count("*").alias("n")).where(F.col("day").between(F.date_sub(F.lit(until).cast("date"), days - 1), F.lit(until).cast("date")))
    grid = counted.select(key).distinct().withColumn("day", F.explode(F.sequence(F.date_sub(F.lit(until).cast("date"), days - 1), F.lit(until).cast("date"))))
    return grid.join(counted, ["day", key], "left").withColumn("n", F.coalesce("n", F.lit(0))).join(F.broadcast(frame), "day", "left_semi")


def top_segments(rows: DataFrame, group: str, path: Column, most: int) -> DataFrame:
    """The most frequent first path segments of each group."""
    counted = rows.withColumn("segment", X.first_segment(path)).groupBy(group, "segment").agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), "segment")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def canonical(names: DataFrame, key: Column, weight: str, name: str, ident: str) -> DataFrame:
    """Groups of names with one key and two members or more; the canonical one has the largest weight, then the shortest name, then the smallest id."""
    keyed = names.withColumn("_key", key)
    order = Window.partitionBy("_key").orderBy(F.desc(weight), F.length(name), ident)
    best = keyed.withColumn("canonical", F.first(ident).over(order)).withColumn("_n", F.count("*").over(Window.partitionBy("_key")))
    return best.where("_n > 1").select("_key", ident, "canonical")


# --- queries over the driver's tables -------------------------------------------------------------


def q_member_counts(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    classified = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("item"))
    anchored = docs.where("source in ('src1', 'src2')").select(F.lit("en").alias("group"), F.col("doc_id").alias("item"))
    attached = labels.where("toxic = 1").select(F.lit("fr").alias("group"), F.col("doc_id").alias("item"))
    active = docs.where("n_chars >= 512").select(F.col("doc_id").alias("item"))
    return members(classified, anchored, attached).join(active, "item", "left_semi").groupBy("group").agg(F.count("*").alias("members"))


def q_status_counts(spark, d):
    orders = table(spark, d, "orders")
    return orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def q_conditional_counts(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in ("view", "click", "purchase", "error")), percent(F.count_if(F.col("event_type") == "error"), F.count("*")).alias("error_pct"))


def q_daily_usage(spark, d):
    e = table(spark, d, "events").where(F.col("ts") >= F.date_sub(F.lit(AS_OF).cast("date"), 30))
    return e.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


def _prices(spark):
    return spark.createDataFrame([("view", 3.0, 15.0), ("click", 0.25, 1.25), ("purchase", 15.0, 75.0)], "event_type string, price_in double, price_out double")


def q_cost_by_day(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    e = e.withColumn("tokens_in", F.col("event_id") % 1000).withColumn("tokens_out", F.col("user_id") * 10)
    return costs(e, _prices(spark), "event_type", "tokens_in", "tokens_out", ["day"])


def q_dense_calendar(spark, d):
    return dense(spark, table(spark, d, "events"), "ts", "event_type", "2024-02-02", 15)


def q_calendar_pivot(spark, d):
    days = dense(spark, table(spark, d, "events"), "ts", "event_type", "2024-01-30", 15)
    return days.groupBy("day").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.sum("n"))


def q_monthly_rollup(spark, d):
    e = table(spark, d, "events").where(F.col("ts") >= F.date_sub(F.lit(AS_OF).cast("date"), 30))
    return e.agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("total"), percent(F.count_if(F.col("event_type") != "error"), F.count("*")).alias("success_pct"))


def q_segment_topk(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id")))
    return top_segments(docs, "lang", F.col("path"), 12).select("lang", "segment", "n", "rank")


def q_domain_share(spark, d):
    docs = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return docs.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def q_tool_stats(spark, d):
    e = table(spark, d, "events")
    week = F.col("ts") >= F.date_sub(F.lit(AS_OF).cast("date"), 7)
    return e.groupBy(F.col("event_type").alias("tool")).agg(F.count_if(week).alias("week"), F.count("*").alias("total"), F.max("ts").alias("last"), F.countDistinct(F.to_date("ts")).alias("days"))


def q_tag_trend(spark, d):
    first = table(spark, d, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("first"))
    bucket = F.floor(F.datediff(F.lit(AS_OF).cast("date"), "first") / 15)
    return first.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("new_tags"))


def q_canonical_names(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    key = F.regexp_replace(F.lower(F.substring("p_name", 1, 12)), r"\s+", "")
    return canonical(parts, key, "p_size", "p_name", "p_partkey").select("p_partkey", "canonical")


def q_having_between(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n"))
    return lines.where(F.col("n").between(20, 30))


def q_session_rollup(spark, d):
    said = table(spark, d, "conversations")
    rolled = said.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"))
    return rolled.orderBy(F.desc("messages"), "conv_id").limit(20)


def q_dedup_keep_min(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    kept = docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return kept.where("copies > 1").select("doc_id", "copies")


def q_fingerprint(spark, d):
    return table(spark, d, "documents").where("n_chars >= 512").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


def q_progress(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("lang").agg(F.count("*").alias("total"), F.count("quality").alias("done"), percent(F.count("quality"), F.count("*")).alias("pct"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"))


def q_hot_prompts(spark, d):
    e = table(spark, d, "events").where(F.col("ts") >= F.date_sub(F.lit(AS_OF).cast("date"), 30))
    per = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("opens"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return per.orderBy(F.desc("opens"), "user_id").limit(10)


def q_freshness(spark, d):
    as_of = table(spark, d, "orders").agg(F.to_date(F.max("o_orderdate"))).first()[0]
    age = F.datediff(F.lit(as_of), F.to_date("o_orderdate"))
    bucket = F.when(age <= 30, "fresh").when(age <= 180, "recent").when(age <= 730, "old").otherwise("stale")
    return table(spark, d, "orders").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


QUERIES = {
    "g01_member_counts": q_member_counts, "g02_status_counts": q_status_counts, "g03_conditional_counts": q_conditional_counts, "g04_daily_usage": q_daily_usage,
    "g05_cost_by_day": q_cost_by_day, "g06_dense_calendar": q_dense_calendar, "g06_calendar_pivot": q_calendar_pivot, "g07_monthly_rollup": q_monthly_rollup,
    "g09_segment_topk": q_segment_topk, "g09_domain_share": q_domain_share, "g10_tool_stats": q_tool_stats, "g18_tag_trend": q_tag_trend,
    "g26_canonical_names": q_canonical_names, "g28_having_between": q_having_between, "g30_session_rollup": q_session_rollup, "g35_dedup_keep_min": q_dedup_keep_min,
    "g22_fingerprint": q_fingerprint, "g34_progress": q_progress, "g33_hot_prompts": q_hot_prompts, "g20_freshness": q_freshness,
}
_DENSE = "WITH k AS (SELECT DISTINCT event_type FROM events WHERE {w} AND ts::DATE BETWEEN DATE '{a}' AND DATE '{b}'), c AS (SELECT unnest(generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY))::DATE AS day) SELECT c.day, k.event_type, (SELECT count(*) FROM events e WHERE e.event_type = k.event_type AND e.ts::DATE = c.day AND {w}) AS n FROM c, k"
SQL = {
    "g01_member_counts": """SELECT "group", count(*) AS members FROM (SELECT lang AS "group", doc_id FROM documents UNION SELECT 'en', doc_id FROM documents WHERE source IN ('src1', 'src2') UNION SELECT 'fr', doc_id FROM labels WHERE toxic = 1) t
WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars >= 512) GROUP BY 1""",
    "g02_status_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2",
    "g03_conditional_counts": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("view", "click", "purchase", "error")) + ", round(100.0 * count(*) FILTER (WHERE event_type = 'error') / greatest(count(*), 1), 1)::DOUBLE AS error_pct FROM events GROUP BY 1",
    "g04_daily_usage": "SELECT ts::DATE AS day, event_type AS model, count(*) AS calls, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events WHERE ts >= DATE '2024-01-01' GROUP BY 1, 2",
    "g05_cost_by_day": """WITH p(event_type, i, o) AS (VALUES ('view', 3.0::DOUBLE, 15.0::DOUBLE), ('click', 0.25, 1.25), ('purchase', 15.0, 75.0)),
g AS (SELECT ts::DATE AS day, event_type, count(*) AS n, sum(event_id % 1000)::DOUBLE AS ti, sum(user_id * 10)::DOUBLE AS tout FROM events GROUP BY 1, 2),
c AS (SELECT g.*, round((ti * i + tout * o) / 1e6, 4) AS cost FROM g LEFT JOIN p USING (event_type))
SELECT day, sum(n)::BIGINT AS calls, round(sum(cost), 4) AS cost, bool_or(cost IS NULL) AS unpriced FROM c GROUP BY 1""",
    "g06_dense_calendar": _DENSE.format(w="true", a="2024-01-19", b="2024-02-02"),
    "g06_calendar_pivot": "SELECT ts::DATE AS day, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events WHERE ts::DATE BETWEEN DATE '2024-01-16' AND DATE '2024-01-30' GROUP BY 1",
    "g07_monthly_rollup": "SELECT count(*) AS calls, round(sum(value), 2) AS total, round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / greatest(count(*), 1), 1)::DOUBLE AS success_pct FROM events WHERE ts >= DATE '2024-01-01'",
    "g09_segment_topk": "SELECT lang, source AS segment, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source)::INTEGER AS rank FROM documents GROUP BY 1, 2 QUALIFY rank <= 12",
    "g09_domain_share": "SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM documents GROUP BY 1",
    "g10_tool_stats": "SELECT event_type AS tool, count(*) FILTER (WHERE ts >= DATE '2024-01-24') AS week, count(*) AS total, max(ts) AS last, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1",
    "g18_tag_trend": "SELECT (date_diff('day', f, DATE '2024-01-31') // 15)::INTEGER AS bucket, count(*) AS new_tags FROM (SELECT user_id, min(ts)::DATE AS f FROM events GROUP BY 1) t GROUP BY 1",
    "g26_canonical_names": r"""WITH k AS (SELECT *, regexp_replace(lower(substring(p_name, 1, 12)), '\s+', '', 'g') AS key FROM part)
SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY key ORDER BY p_size DESC, length(p_name), p_partkey) AS canonical FROM k QUALIFY count(*) OVER (PARTITION BY key) > 1""",
    "g28_having_between": "SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 HAVING n BETWEEN 20 AND 30",
    "g30_session_rollup": "SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS asked, sum(length(text))::BIGINT AS chars, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "g35_dedup_keep_min": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1",
    "g22_fingerprint": "SELECT count(*) AS n, max(doc_id) AS last FROM documents WHERE n_chars >= 512",
    "g34_progress": "SELECT lang, count(*) AS total, count(quality) AS done, round(100.0 * count(quality) / greatest(count(*), 1), 1)::DOUBLE AS pct, coalesce(sum(quality), 0)::BIGINT AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "g33_hot_prompts": "SELECT user_id, count(*) AS opens, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events WHERE ts >= DATE '2024-01-01' AND event_type = 'click' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "g20_freshness": "SELECT CASE WHEN age <= 30 THEN 'fresh' WHEN age <= 180 THEN 'recent' WHEN age <= 730 THEN 'old' ELSE 'stale' END AS bucket, count(*) AS n FROM (SELECT date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) AS age FROM orders) t GROUP BY 1",
}
