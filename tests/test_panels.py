"""The dashboard, the card of the week, lists of entries and the weekly digest: edges that the driver's tables don't have."""

import datetime
import json

from pyspark.sql import functions as F

from knowspan.operators import panels as P
from knowspan.sources import outputs

FILES = "doc_id bigint, status string, state string, domain string, agent string, created date, modified date"


def test_dashboard_of_nothing(spark):
    made = spark.createDataFrame([], "doc_id bigint, at date")
    calls = spark.createDataFrame([], "id bigint, at timestamp, model string, tokens bigint, status string")
    rows = P.dashboard(spark.createDataFrame([], FILES), made, calls, spark.createDataFrame([], "domain string, parent string"), "2024-01-30").collect()
    assert {r.panel for r in rows} == {"files", "queue", "calls"} and not any(r.value for r in rows)


def test_dashboard_counts_children_and_nulls(spark):
    day = datetime.date(2024, 1, 30)
    files = spark.createDataFrame([(1, "active", "done", "a", None, day, None), (2, "active", None, "b", "x", day, day), (3, "deleted", "done", "b", "y", None, day), (4, "active", "done", None, "x", None, day)], FILES)
    made = spark.createDataFrame([(1, day), (2, None)], "doc_id bigint, at date")
    calls = spark.createDataFrame([(7, datetime.datetime(2024, 1, 30), None, None, None)], "id bigint, at timestamp, model string, tokens bigint, status string")
    domains = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a")], "domain string, parent string")
    found = {(r.panel, r.name): r.value for r in P.dashboard(files, made, calls, domains, "2024-01-30").collect()}
    assert found["files", "all"] == 4 and found["files", "deleted"] == 1 and found["files", "new_in_week"] == 2 and found["files", "agents"] == 1
    assert found["domains", "total a"] == 2 and found["domains", "c"] == 0 and ("domains", "total b") not in found
    assert found["sources", "x"] == 2 and ("sources", "y") not in found and found["queue", "done"] == 2
    assert ("events", "entry 1") in found and ("events", "call 7 ") in found and found["calls", "tokens"] == 0


def test_card_of_nothing(spark):
    card = P.week_card(
        spark.createDataFrame([], "doc_id bigint, at timestamp"), spark.createDataFrame([], "doc_id bigint, domain string, stars int, digest string, at timestamp"),
        spark.createDataFrame([], "doc_id bigint, domain string, status string, due_at date, done_at date"), spark.createDataFrame([], "doc_id bigint, status string, progress int, moved_at date"), "2024-01-30",
    )
    found = {r.name: r.value for r in card.collect()}
    assert found.pop("goal") == 5 and found.pop("mean_stars") is None and set(found.values()) == {0.0}


def test_entries(spark):
    distilled = spark.createDataFrame([(10, 1, "", 5, "2024-01-02"), (11, 2, "Own", 5, None), (12, 3, "gone", 5, "2024-01-03"), (13, 1234, None, 5, "2024-01-02")], "meta_id bigint, doc_id bigint, title string, conf int, at string")
    files = spark.createDataFrame([(1, "active", None, "", "a.md", "s", "x", "d"), (2, "active", "t", None, "b.md", None, "x", None), (3, "deleted", "t", None, "c", "s", "x", "d"), (1234, "active", "T", "al", "n", "s", None, "d")], "doc_id bigint, status string, title string, alias string, name string, summary string, agent string, domain string")
    mounted = spark.createDataFrame([(7, "Far", None, 3, "2024-01-05")], "meta_id bigint, title string, summary string, conf int, at string")
    bridge = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (3, "z")], "doc_id bigint, tag string")
    rows, total = P.entry_page(P.entries(distilled, mounted, files), bridge, 1, 3)
    assert [(r.no, r.title, r.tags) for r in sorted(rows.collect(), key=lambda r: r.meta_id)] == [("M007", "Far", []), ("001", "a.md", ["a", "b"]), ("1234", "T", [])]
    assert total.first().total == 4
    assert [r.meta_id for r in P.entries(distilled, mounted, files, "OWN").collect()] == [11]
    assert sorted(r.meta_id for r in P.entries(distilled, mounted, files, domain="d").collect()) == [10, 13]


def test_digest(spark):
    hooks = [(1, "a", '{"action":"keep","text":"x <1>"}', "2024-01-01 00:00:00"), (2, "a", '{"action":"ignore"}', "2024-01-06 23:59:59"), (3, None, "{bad", "2024-01-03 00:00:00"), (4, "a", None, "2024-01-07 00:00:00"), (5, "z", '{"action":"ignore"}', "2024-01-08 00:00:00"), (6, "z", None, None)]
    rows = {r.week: r for r in outputs.weekly_digest(spark.createDataFrame(hooks, "id bigint, domain string, hook string, at string").withColumn("at", F.to_timestamp("at"))).collect()}
    assert set(rows) == {"2024-W01", "2024-W02"}
    assert rows["2024-W01"].markdown == "# Weekly digest 2024-W01\n\n## a (1)\n\na: 1 new this week, such as x <1>\n\n## no domain (1)\n\nno domain: 1 new this week\n\nleft out: 1\n"
    assert [c["domain"] for c in json.loads(rows["2024-W01"].clusters)] == ["a", "no domain"]
    assert "nothing new" in rows["2024-W02"].markdown and rows["2024-W02"].clusters == "[]" and rows["2024-W02"].skipped == 1
