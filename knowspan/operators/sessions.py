"""Sessions of a log, what follows a search in them, and the funnels over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.config import Sessions
from knowspan.functions import expressions as X
from knowspan.session import table


def sessions(events: DataFrame, key: str, time: str, ident: str, gap_minutes: int = 30) -> DataFrame:
    """Adds session (by key, from 1): a new one begins after a gap of more than ``gap_minutes``. Rows without a time are left out."""
    order = Window.partitionBy(key).orderBy(time, ident)
    begins = F.when(F.col(time) - F.lag(time).over(order) > F.expr(f"INTERVAL '{gap_minutes}' MINUTE"), 1).otherwise(0)
    marked = events.where(F.col(time).isNotNull()).withColumn("_new", begins)
    return marked.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_new")


def global_sessions(events: DataFrame, time: str, ident: str, gap_minutes: int = 30) -> DataFrame:
    """``sessions`` of one stream without a key, hour by hour: only one row for each hour with events meets in one task."""
    gap = F.expr(f"INTERVAL '{gap_minutes}' MINUTE")
    hour = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 3_600_000_000)
    order = Window.partitionBy("_hour").orderBy(time, ident)
    begins = F.when(F.col(time) - F.lag(time).over(order) > gap, 1).otherwise(0)
    marked = events.where(F.col(time).isNotNull()).withColumn("_hour", hour).withColumn("_new", begins)
    hours = marked.groupBy("_hour").agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.sum("_new").alias("_n"))
    line = Window.orderBy("_hour")
    hours = hours.withColumn("_begins", F.when(F.col("_first") - F.lag("_last").over(line) > gap, 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("_n") + F.col("_begins")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_begins")
    known = hours.select("_hour", before.alias("_before"))
    own = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_own", own).join(known, "_hour").withColumn("session", F.col("_own") + F.col("_before") + 1).drop("_hour", "_new", "_own", "_before")


def followed(events: DataFrame, key: str, time: str, kind: str, first: str, then: str, minutes: int = 30) -> DataFrame:
    """The rows of kind ``first`` with followed: whether a row of kind ``then`` comes strictly later in the session and within ``minutes``.

    The nearest later row decides, so one window does what an interval join would."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.where(F.col(kind).isin(first, then)).withColumn("_t", micros)
    later = Window.partitionBy(key, "session").orderBy("_t").rangeBetween(1, Window.unboundedFollowing)
    nearest = F.min(F.when(F.col(kind) == then, F.col("_t"))).over(later)
    return rows.withColumn("followed", F.coalesce(nearest - F.col("_t") <= minutes * 60_000_000, F.lit(False))).where(F.col(kind) == first).drop("_t")


def funnel(events: DataFrame, key: str, time: str, ident: str, kind: str, steps: tuple[str, str, str], minutes: int = 30) -> DataFrame:
    """One row: sessions, those with a first and with a second step, those in which a second follows a first within
    ``minutes`` (level 1) and a third a second (level 2), and the rates over sessions with the step that begins them."""
    first, second, third = steps
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    after = Window.partitionBy(key, "session").orderBy(time, ident).rowsBetween(1, Window.unboundedFollowing)
    rows = events.where(F.col(kind).isin(*steps)).withColumn("_t", micros)
    soon = lambda k: F.min(F.when(F.col(kind) == k, F.col("_t"))).over(after) - F.col("_t") <= minutes * 60_000_000
    rows = rows.withColumn("_one", F.coalesce(soon(second), F.lit(False))).withColumn("_two", F.coalesce(soon(third), F.lit(False)))
    per = rows.groupBy(key, "session").agg(
        F.max(F.col(kind) == first).alias("a"), F.max(F.col(kind) == second).alias("b"),
        F.max((F.col(kind) == first) & F.col("_one")).alias("one"), F.max((F.col(kind) == second) & F.col("_two")).alias("two"),
    )
    n = per.agg(*(F.count_if(c).alias(name) for c, name in (("a", "with_first"), ("b", "with_second"), ("one", "level1"), ("two", "level2"))))
    every = events.select(key, "session").distinct().agg(F.count("*").alias("sessions"))
    rate = lambda x, y: F.round(F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0), 4)
    n = every.join(F.broadcast(n))  # one row each
    return n.withColumn("level1_rate", rate("level1", "with_first")).withColumn("level2_rate", rate("level2", "with_second"))


def attribute(searches: DataFrame, documents: DataFrame, text: str, settings: Sessions = Sessions()) -> DataFrame:
    """Searches (query, followed, doc_id found for it) classed as followed, args_null, weak_match or needs_review."""
    terms = X.query_terms(F.col("query"))
    weak = X.overlap_ratio(terms, F.coalesce(F.col(text), F.lit("")))
    return searches.join(documents, "doc_id", "left").withColumn("overlap", weak).withColumn("class", F.when(F.col("followed"), "followed").when(F.col("query").isNull(), "args_null").when(F.coalesce(F.col("overlap"), F.lit(0.0)) < settings.weak_overlap, "weak_match").otherwise("needs_review"))


def labelled_clusters(events: DataFrame, key: str, domain: str, time: str, ident: str) -> DataFrame:
    """For each session: its primary domains (two or more rows; by count, then first seen), all domains as first seen, distinct items."""
    seen = events.withColumn("_d", F.coalesce(F.col(domain), F.lit("unclassified")))
    per = seen.groupBy(key, "session", "_d").agg(F.count("*").alias("n"), F.min(F.struct(time, ident)).alias("at"), F.collect_set(ident).alias("items"))
    main = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") >= 2, F.struct((-F.col("n")).alias("n"), "at", "_d")))), lambda x: x["_d"])
    order = F.transform(F.array_sort(F.collect_list(F.struct("at", "_d"))), lambda x: x["_d"])
    done = per.groupBy(key, "session").agg(F.sum("n").alias("rows"), main.alias("primary"), order.alias("sequence"), F.count("*").alias("domains"))
    return done.withColumn("crosses", F.col("domains") > 1)


# --- queries over the driver's tables: views are searches, clicks reads, purchases sources opened ---


def _events(spark, d) -> DataFrame:
    return sessions(table(spark, d, "events"), "user_id", "ts", "event_id")


def q_sessions(spark, d):
    return _events(spark, d).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("begin"), F.max("ts").alias("end"))


def q_session_window(spark, d):
    events = table(spark, d, "events")
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def q_global_sessions(spark, d):
    return global_sessions(table(spark, d, "events"), "ts", "event_id").groupBy("session").agg(F.count("*").alias("n"), F.min("ts").alias("begin"))


def q_followed(spark, d):
    return followed(_events(spark, d), "user_id", "ts", "event_type", "view", "click").select("event_id", "followed")


def q_funnel(spark, d):
    return funnel(_events(spark, d), "user_id", "ts", "event_id", "event_type", ("view", "click", "purchase"))


def q_attribution(spark, d):
    rows = followed(_events(spark, d), "user_id", "ts", "event_type", "view", "click").withColumn("query", X.query_of(F.regexp_replace(F.regexp_replace("props", '"k"', '"query"'), r": (\d+)", ': "the $1"')))
    asked = rows.select("event_id", "followed", F.when(F.col("event_id") % 5 != 0, F.col("query")).alias("query"), F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"))
    return attribute(asked, table(spark, d, "documents").select("doc_id", "text"), "text").groupBy("class").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def q_click_rate(spark, d):
    e = table(spark, d, "events").where("event_type in ('view', 'click')")
    days = e.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("searches"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return days.where("day > date'2024-01-23'").withColumn("rate", F.round(F.col("clicks") / F.greatest("searches", F.lit(1)), 3))


def q_top_queries(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'").groupBy(F.get_json_object("props", "$.k").alias("query")).agg(F.count("*").alias("n"))
    return e.orderBy(F.desc("n"), "query").limit(5)


def q_cluster_labels(spark, d):
    tagged = _events(spark, d).withColumn("domain", F.when(F.col("event_type") != "signup", F.col("event_type")))
    done = labelled_clusters(tagged, "user_id", "domain", "ts", "event_id")
    return done.select("user_id", "session", "rows", F.array_join("primary", ",").alias("primary"), F.array_join("sequence", ",").alias("sequence"), "crosses")


QUERIES = {
    "w01_sessions": q_sessions, "w01_session_window": q_session_window, "w01_global_sessions": q_global_sessions, "j13_followed_within": q_followed, "g11_funnel_metrics": q_funnel,
    "g12_search_attribution": q_attribution, "g13_click_rate": q_click_rate, "g13_top_queries": q_top_queries, "g14_cluster_labels": q_cluster_labels,
}
_S = "s AS (SELECT *, 1 + sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE AS gap FROM events) g)"
_F = "f AS (SELECT event_id, user_id, props, EXISTS (SELECT 1 FROM s y WHERE y.user_id = x.user_id AND y.session = x.session AND y.event_type = 'click' AND y.ts > x.ts AND y.ts <= x.ts + INTERVAL 30 MINUTE) AS followed FROM s x WHERE event_type = 'view')"
SQL = {
    "w01_sessions": f"WITH {_S} SELECT user_id, session, count(*) AS n, min(ts) AS begin, max(ts) AS \"end\" FROM s GROUP BY 1, 2",
    "w01_session_window": f"WITH {_S} SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, session, count(*) AS n FROM s GROUP BY 1, 2) t GROUP BY 1",
    "w01_global_sessions": "WITH e AS (SELECT * FROM events), s AS (SELECT ts, 1 + sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, ts - lag(ts) OVER (ORDER BY ts, event_id) > INTERVAL 30 MINUTE AS gap FROM e) g) SELECT session, count(*) AS n, min(ts) AS begin FROM s GROUP BY 1",
    "j13_followed_within": f"WITH {_S}, {_F} SELECT event_id, followed FROM f",
    "g11_funnel_metrics": f"""WITH {_S}, m AS (SELECT *, event_type AS k,
EXISTS (SELECT 1 FROM s y WHERE y.user_id = x.user_id AND y.session = x.session AND y.event_type = 'click' AND (y.ts, y.event_id) > (x.ts, x.event_id) AND y.ts <= x.ts + INTERVAL 30 MINUTE) AS one,
EXISTS (SELECT 1 FROM s y WHERE y.user_id = x.user_id AND y.session = x.session AND y.event_type = 'purchase' AND (y.ts, y.event_id) > (x.ts, x.event_id) AND y.ts <= x.ts + INTERVAL 30 MINUTE) AS two FROM s x),
p AS (SELECT bool_or(k = 'view') AS a, bool_or(k = 'click') AS b, bool_or(k = 'view' AND one) AS one, bool_or(k = 'click' AND two) AS two FROM m GROUP BY user_id, session),
n AS (SELECT count(*) AS sessions, count(*) FILTER (WHERE a) AS with_first, count(*) FILTER (WHERE b) AS with_second, count(*) FILTER (WHERE one) AS level1, count(*) FILTER (WHERE two) AS level2 FROM p)
SELECT *, round(CASE WHEN with_first > 0 THEN level1 / with_first ELSE 0 END, 4)::DOUBLE AS level1_rate, round(CASE WHEN with_second > 0 THEN level2 / with_second ELSE 0 END, 4)::DOUBLE AS level2_rate FROM n""",
    "g12_search_attribution": f"""WITH {_S}, {_F}, q AS (SELECT event_id, followed, event_id % 5 <> 0 AS has, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM f),
o AS (SELECT q.*, CASE WHEN contains(lower(coalesce(text, '')), 'the') THEN 1.0 ELSE 0.0 END AS overlap FROM q LEFT JOIN documents ON doc_id = k)
SELECT CASE WHEN followed THEN 'followed' WHEN NOT has THEN 'args_null' WHEN overlap < 0.2 THEN 'weak_match' ELSE 'needs_review' END AS class, count(*) AS n, min(event_id) AS first FROM o GROUP BY 1""",
    "g13_click_rate": "SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type = 'view') AS searches, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(clicks / greatest(searches, 1), 3)::DOUBLE AS rate FROM events WHERE ts::DATE > DATE '2024-01-23' GROUP BY 1",
    "g13_top_queries": "SELECT json_extract_string(props, '$.k') AS query, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "g14_cluster_labels": f"""WITH {_S}, g AS (SELECT user_id, session, CASE WHEN event_type = 'signup' THEN 'unclassified' ELSE event_type END AS d, count(*) AS n, min(row(ts, event_id)) AS seen FROM s GROUP BY 1, 2, 3)
SELECT user_id, session, sum(n)::BIGINT AS "rows", coalesce(string_agg(d, ',' ORDER BY n DESC, seen) FILTER (WHERE n >= 2), '') AS "primary", string_agg(d, ',' ORDER BY seen) AS sequence, count(*) > 1 AS crosses FROM g GROUP BY 1, 2""",
}
