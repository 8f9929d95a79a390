"""Ranks, latest rows, budgets, rotations and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.functions import expressions as X
from knowspan.operators import statistics
from knowspan.session import table


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by aggregation instead of a sort of each group."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


#: Buckets of an order, about; groups whose edges are broadcast at most.
BUCKETS, EDGES = 256, 100_000


def _place(df: DataFrame, name: str, falls: bool) -> Column:
    """A number that doesn't fall along the order of ``name``; even where a bucket is one frequent value.

    Bounds are quantiles of the whole table and may be off: they decide how much is in a bucket, never what is chosen.
    Columns that aren't numbers have one bucket."""
    kind = dict(df.dtypes)[name]
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kind.startswith("decimal"):
        return F.lit(0)
    cuts = sorted(set(df.approxQuantile(name, [k / BUCKETS for k in range(BUCKETS + 1)], 0.5 / BUCKETS)))
    bounds = F.array_distinct(F.array(*(F.lit(c).cast(kind) for c in cuts))) if cuts else F.array().cast(f"array<{kind}>")
    value = F.col(name)
    place = 2 * F.size(F.filter(bounds, lambda c: c < value)) + F.when(F.array_contains(bounds, value), 0).otherwise(-1)
    place = F.coalesce(place, F.lit(-2 if not falls else -(2 * BUCKETS + 4)))  # nulls are the smallest
    return F.when(F.isnan(value), 2 * BUCKETS + 4).otherwise(place) * (-1 if falls else 1) if kind in ("float", "double") else place * (-1 if falls else 1)


def _named(order: str | Column) -> tuple[str, bool]:
    """(name, whether it falls) of "name", "-name" or of a column's plain ``asc`` or ``desc``."""
    if isinstance(order, str):
        return order.lstrip("-"), order.startswith("-")
    name, _, rest = str(order).removeprefix("Column<'").removesuffix("'>").partition(" ")
    if rest not in ("", "ASC NULLS FIRST", "DESC NULLS LAST"):
        raise ValueError(f"give the order by names instead of {order}")
    return name, rest.startswith("DESC")


def within_budget(rows: DataFrame, by: list[str], order: list[str | Column], cost: str, budget: float) -> DataFrame:
    """The rows of each group in ``order`` (names, "-name" descending), up to the first whose cost goes over the budget.

    Costs aren't negative; null costs count as 0. Costs are first added up by buckets of the order, so each group's edge, the bucket in which its budget
    ends, is known from sums alone; rows after it are dropped, and rows are sorted within their bucket only. A value of the first column
    so frequent that it is a bucket of its own is divided by the second. ``used`` has the running sum."""
    names = [_named(o) for o in order]
    first = _place(rows, *names[0])
    rows = rows.withColumn("_b1", first)
    second = F.when(F.col("_b1") % 2 == 0, _place(rows, *names[1])).otherwise(0) if len(names) > 1 else F.lit(0)
    rows = rows.withColumn("_b2", second).withColumn("_all", F.lit(0))
    keys = [*by, "_all"]
    sums = rows.groupBy(*keys, "_b1", "_b2").agg(F.coalesce(F.sum(cost), F.lit(0)).alias("_sum"))
    run = Window.partitionBy(*keys).orderBy("_b1", "_b2")
    before = F.sum("_sum").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")
    sums = sums.withColumn("_before", before).where(F.col("_before") <= budget).drop("_sum")
    sums = F.broadcast(sums) if sums.count() <= EDGES else sums  # a row for each bucket before an edge
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_b1", "_b2"]]
    kept = rows.alias("r").join(sums.alias("s"), on).select("r.*", "s._before")
    inside = Window.partitionBy(*keys, "_b1", "_b2").orderBy(*(F.desc(n) if falls else F.asc(n) for n, falls in names)).rowsBetween(Window.unboundedPreceding, 0)
    used = F.coalesce(F.sum(cost).over(inside), F.lit(0)) + F.col("_before")
    return kept.withColumn("used", used).where(F.col("used") <= budget).drop("_b1", "_b2", "_all", "_before")


def shared_place(rows: DataFrame, weight: str) -> DataFrame:
    """place: how many have at least this weight, so ties share the worst one. Counted on the distinct weights."""
    counted = rows.groupBy(weight).agg(F.count("*").alias("_n"))
    placed = counted.withColumn("place", F.sum("_n").over(Window.orderBy(F.desc(weight))))
    return rows.join(placed.drop("_n"), weight)


def rotation(rows: DataFrame, order: list[Column], epoch_day: int, size: int = 3) -> DataFrame:
    """``size`` rows from a place that moves on by one slice a day, and starts anew after the last."""
    n = rows.count()
    start = epoch_day % max(1, -(-n // size)) * size
    return rows.orderBy(*order).offset(start).limit(size)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page and next_offset, null on the last."""
    found = rows.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = found.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("_more", F.max("_n").over(Window.partitionBy(F.lit(1))))
    return numbered.where(F.col("_n") <= limit).withColumn("next_offset", F.when(F.col("_more") > limit, offset + limit)).drop("_n", "_more")


def asked_before(said: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """For each answer the user's last message before it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return said.withColumn("question", F.last(F.when(F.col(role) == "user", F.col(text)), ignorenulls=True).over(before)).where(F.col(role) == "assistant")


def islands(rows: DataFrame, by: str, order: str, bad: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` bad rows without a good one between them: first, last, length."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_bad", bad).withColumn("_run", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w))
    return marked.where("_bad").groupBy(by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_run")


# --- queries over the driver's tables -------------------------------------------------------------


def q_latest_row(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return latest(orders, "o_custkey", "o_orderkey")


def q_budget_prefix(spark, d):
    docs = table(spark, d, "documents").withColumn("tokens", X.tokens_by_script("text").cast("bigint"))
    return within_budget(docs, ["source"], ["-n_chars", "doc_id"], "tokens", 6000).select("source", "doc_id", "used")


def q_rank_primaries(spark, d):
    mounts = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("mounts"))
    return shared_place(mounts, "mounts").select("l_partkey", "mounts", "place")


def q_daily_rotation(spark, d):
    pool = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return rotation(pool, [F.asc("doc_id")], 19753)


def q_page_window(spark, d):
    return page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100, 50)


def q_last_page(spark, d):
    return page(table(spark, d, "nation").select("n_nationkey", "n_name"), [F.asc("n_nationkey")], 20, 10)


def q_asked_before(spark, d):
    said = asked_before(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return said.select("conv_id", "turn", F.substring("question", 1, 50).alias("question"))


def q_failure_runs(spark, d):
    return islands(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") != "view", 12)


def q_composite_order(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("rule", F.pmod("doc_id", F.lit(11)))
    opens = table(spark, d, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("opens"))
    score = F.coalesce(F.col("quality"), F.lit(0)) * 30 + F.col("rule") + F.coalesce(F.col("opens"), F.lit(0)) * 1.2
    return docs.join(opens, "doc_id", "left").withColumn("score", F.round(score, 4)).orderBy(F.col("quality").isNotNull().desc(), F.desc("score"), F.desc("n_chars"), "doc_id").limit(60).select("doc_id", "score")


def q_merge_recent(spark, d):
    a = table(spark, d, "events").where("event_type = 'click'").select("ts", F.lit("read").alias("kind"), F.col("event_id").alias("id"))
    b = table(spark, d, "events").where("event_type = 'signup'").select("ts", F.lit("new").alias("kind"), F.col("event_id").alias("id"))
    return a.unionByName(b).orderBy(F.desc("ts"), F.desc("id")).limit(10)


def q_consumption_first(spark, d):
    reads = table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("ts").alias("last_read"))
    docs = table(spark, d, "documents").join(reads, "doc_id", "left")
    return docs.orderBy(F.col("last_read").isNotNull().desc(), F.desc_nulls_last("last_read"), "doc_id").limit(200).select("doc_id", "last_read")


def q_evidence_rows(spark, d):
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").withColumn("n", F.row_number().over(w)).where("n <= 4").select("lang", "n", "doc_id")


QUERIES = {
    "w06_latest_row": q_latest_row, "w08_budget_prefix": q_budget_prefix, "w05_rank_primaries": q_rank_primaries, "w10_daily_rotation": q_daily_rotation, "o03_page_window": q_page_window, "o03_last_page": q_last_page,
    "w12_asked_before": q_asked_before, "r06_failure_runs": q_failure_runs, "o06_composite_order": q_composite_order, "o11_merge_recent": q_merge_recent, "o09_consumption_first": q_consumption_first, "q15_evidence_rows": q_evidence_rows,
}
SQL = {
    "w06_latest_row": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
    "w08_budget_prefix": "SELECT source, doc_id, used FROM (SELECT source, doc_id, (sum(ceil(length(text) / 4)) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM documents) t WHERE used <= 6000",
    "w05_rank_primaries": "SELECT l_partkey, mounts, (SELECT count(*) FROM (SELECT count(*) AS m FROM lineitem GROUP BY l_partkey) y WHERE y.m >= x.mounts) AS place FROM (SELECT l_partkey, count(*) AS mounts FROM lineitem GROUP BY 1) x",
    "w10_daily_rotation": "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels WHERE quality = 1) SELECT doc_id FROM p WHERE i // 3 = 19753 % ((n + 2) // 3)",
    "o03_page_window": "SELECT o_orderkey, o_totalprice, CASE WHEN (SELECT count(*) FROM orders) > 150 THEN 150 END AS next_offset FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100",
    "o03_last_page": "SELECT n_nationkey, n_name, NULL::INTEGER AS next_offset FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 20",
    "w12_asked_before": "SELECT conv_id, turn, substring(q, 1, 50) AS question FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations) t WHERE role = 'assistant'",
    "r06_failure_runs": "SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events) t WHERE event_type <> 'view' GROUP BY user_id, run HAVING count(*) >= 12",
    "o06_composite_order": "WITH o AS (SELECT user_id AS doc_id, count(*) AS opens FROM events WHERE event_type = 'click' GROUP BY 1) SELECT doc_id, round(coalesce(quality, 0) * 30 + doc_id % 11 + coalesce(opens, 0) * 1.2::DOUBLE, 4) AS score FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN o USING (doc_id) ORDER BY quality IS NOT NULL DESC, score DESC, n_chars DESC, doc_id LIMIT 60",
    "o11_merge_recent": "SELECT ts, CASE event_type WHEN 'click' THEN 'read' ELSE 'new' END AS kind, event_id AS id FROM events WHERE event_type IN ('click', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 10",
    "o09_consumption_first": "SELECT doc_id, last_read FROM documents LEFT JOIN (SELECT user_id, max(ts) AS last_read FROM events GROUP BY 1) r ON user_id = doc_id ORDER BY last_read DESC NULLS LAST, doc_id LIMIT 200",
    "q15_evidence_rows": "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INTEGER AS n, doc_id FROM documents QUALIFY n <= 4",
}
