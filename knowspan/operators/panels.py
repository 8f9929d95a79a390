"""What an overview shows at once: lists of entries with their files, the dashboard and the card of the week.

Each table is aggregated in one pass for all figures of a panel; lists are cut to their rows before anything is joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.operators import library, statistics
from knowspan.operators.statistics import percent
from knowspan.session import table

_NAMED = "panel string, pos int, name string, value double"


def label(number: Column, mark: str = "") -> Column:
    """A number of at least three digits behind a mark; longer ones stay whole."""
    text = number.cast("string")
    return F.concat(F.lit(mark), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def entries(distilled: DataFrame, mounted: DataFrame, files: DataFrame, word: str | None = None, domain: str | None = None) -> DataFrame:
    """One list of distilled entries (meta_id, doc_id, title, conf, at), with what their active file (doc_id, status, title, alias, name,
    summary, agent, domain) gives, and of mounted ones (meta_id, title, summary, conf, at), which belong to no file and no domain.

    ``word`` is looked for in titles and summaries, as a piece of text; with ``domain`` mounted entries stay away. An entry shows its
    own title, else the file's title, alias or name; empty texts count as missing."""
    own = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))
    holds = lambda *names: F.lit(False) if word is None else F.array_contains(F.array(*(F.coalesce(F.contains(F.lower(n), F.lit(word.lower())), F.lit(False)) for n in names)), True)
    shown = files.where("status = 'active'").select("doc_id", F.col("title").alias("_title"), "alias", "name", "summary", "agent", "domain")
    llm = distilled.join(shown, "doc_id")
    llm = llm.where(holds("title", "_title", "summary")) if word is not None else llm
    llm = llm.where(F.col("domain") == domain) if domain is not None else llm
    out = llm.select("meta_id", "doc_id", label(F.col("doc_id")).alias("no"), F.lit("llm").alias("kind"), own("title", "_title", "alias", "name").alias("title"), "summary", "agent", "domain", "conf", "at")
    if domain is not None:
        return out
    rest = mounted.where(holds("title", "summary")) if word is not None else mounted
    return out.union(rest.select("meta_id", F.lit(None).cast("bigint"), label(F.col("meta_id"), "M"), F.lit("imported"), "title", "summary", F.lit("mounted"), F.lit("mounted"), "conf", "at"))


def entry_page(listed: DataFrame, bridge: DataFrame, number: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page of ``entries``, the newest first, with tags, and the total. Only the page's tags are read."""
    rows, total = library.page(listed, [F.desc_nulls_last("at"), F.col("meta_id")], number, size)
    return library.with_tags(rows, bridge), total


def named(panel: str, rows: DataFrame, *order: Column) -> DataFrame:
    """(panel, pos, name, value) of rows (name, value) of a bounded number."""
    return rows.select(F.lit(panel).alias("panel"), F.row_number().over(Window.orderBy(*order)).alias("pos"), F.col("name").cast("string").alias("name"), F.col("value").cast("double").alias("value"))


def _figures(panel: str, one: DataFrame) -> DataFrame:
    """The columns of a single row as (panel, pos, name, value)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in one.columns))
    return one.select(F.posexplode(pairs).alias("pos", "p")).select(F.lit(panel).alias("panel"), (F.col("pos") + 1).alias("pos"), "p.name", "p.value")


def dashboard(files: DataFrame, made: DataFrame, calls: DataFrame, domains: DataFrame, until: str, sources: int = 12, recent: int = 5, events: int = 10, days: int = 15) -> DataFrame:
    """(panel, pos, name, value): the panels ``files``, ``queue``, ``domains``, ``sources``, ``recent``, ``events``, ``trend`` and ``calls``.

    ``files`` (doc_id, status, state, domain, agent, created, modified), ``made`` entries (doc_id, at), ``calls`` (id, at, model,
    tokens, status), ``domains`` (domain, parent). A domain's value is its active files, its total (``total``, for those without
    parent) counts its children too. ``until`` is the day shown last, whole; a week has seven days, that day the last of them.
    Events are the newest entries and calls, ties to entries, then smaller ids; the value is seconds since 1970."""
    end = F.date_add(F.lit(until).cast("date"), 1)
    since = lambda at, n: (F.to_date(at) >= F.date_sub(end, n)) & (F.to_date(at) < end)
    active = F.col("status") == "active"
    of_files = files.agg(
        F.count("*").alias("all"), F.count_if(active).alias("active"), F.count_if(F.col("status") == "deleted").alias("deleted"), F.count_if(since("created", 7)).alias("new_in_week"),
        F.count_distinct(F.when(active, F.col("agent"))).alias("agents"), *(F.count_if(active & (F.col("state") == s)).alias(s) for s in ("pending", "running", "done", "failed", "skipped")),
    )
    queue = ["pending", "running", "done", "failed", "skipped"]
    per_domain = files.where(active).groupBy("domain").agg(F.count("*").alias("n"))
    counted = domains.join(per_domain, "domain", "left").select("domain", "parent", F.coalesce("n", F.lit(0)).alias("n"))
    below = counted.where("parent is not null").groupBy(F.col("parent").alias("domain")).agg(F.sum("n").alias("below"))
    totals = counted.where("parent is null").join(below, "domain", "left").select(F.concat(F.lit("total "), "domain").alias("name"), (F.col("n") + F.coalesce("below", F.lit(0))).alias("value"))
    by_source = files.where(active & F.col("agent").isNotNull()).groupBy(F.col("agent").alias("name")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "name").limit(sources)
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    newest = files.where(active).orderBy(F.desc_nulls_last("modified"), "doc_id").limit(recent).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("name"), seconds("modified").alias("value"))
    entered = made.where("at is not null").orderBy(F.desc("at"), "doc_id").limit(events).select(F.lit(0).alias("kind"), F.col("doc_id").alias("id"), F.concat(F.lit("entry "), "doc_id").alias("name"), seconds("at").alias("value"))
    called = calls.where("at is not null").orderBy(F.desc("at"), "id").limit(events).select(F.lit(1).alias("kind"), "id", F.concat(F.lit("call "), "id", F.lit(" "), F.coalesce("status", F.lit(""))).alias("name"), seconds("at").alias("value"))
    latest = entered.union(called).orderBy(F.desc("value"), "kind", "id").limit(events)
    dense = statistics.dense(files.sparkSession, calls, "at", "model", until, days).select(F.concat_ws(" ", "model", F.date_format("day", "MM-dd")).alias("name"), F.col("n").alias("value"))
    month = calls.where(since("at", 30)).agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), percent(F.count_if(F.col("status") == "success"), F.count("*")).alias("success"))
    parts = [
        _figures("files", of_files.drop(*queue)), _figures("queue", of_files.select(*queue)), named("domains", counted.select(F.col("domain").alias("name"), F.col("n").alias("value")).union(totals), F.col("name")),
        named("sources", by_source, F.desc("value"), F.col("name")), named("recent", newest, F.desc_nulls_last("value"), F.col("id")), named("events", latest, F.desc("value"), F.col("kind"), F.col("id")),
        named("trend", dense, F.col("name")), _figures("calls", month),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def week_card(opened: DataFrame, rated: DataFrame, due: DataFrame, pool: DataFrame, until: str, goal: int = 5, most: int = 3) -> DataFrame:
    """(panel, pos, name, value) of the seven days that end with ``until``.

    ``opened`` (doc_id, at), ``rated`` (doc_id, domain, stars, digest, at), ``due`` (doc_id, domain, status, due_at, done_at), ``pool`` (doc_id, status,
    progress, moved_at). Panels: ``card`` with its single figures, ``stars``, ``weak`` domains (two stars at most, and pending for more than a
    week, added), the longest ``overdue`` and ``stalled`` (begun, not ended, unmoved for 14 days), ``most`` rows each, ties to smaller names and ids."""
    end = F.date_add(F.lit(until).cast("date"), 1)
    week = lambda at: (F.col(at) >= F.date_sub(end, 7)) & (F.col(at) < end)
    late = (F.col("status") == "pending") & (F.col("due_at") < F.date_sub(end, 7))
    still = (F.col("status") != "archived") & F.col("progress").between(1, 99) & (F.col("moved_at") < F.date_sub(end, 14))
    stars = rated.where(week("at")).groupBy("stars").agg(F.count("*").alias("n"), F.count("digest").alias("digests"), F.sum("stars").alias("s"))
    marks = stars.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rated"), F.coalesce(F.sum("digests"), F.lit(0)).alias("digested"), F.round(F.sum("s") / F.sum(F.when(F.col("stars").isNotNull(), F.col("n"))), 1).alias("mean_stars"))
    card = [
        opened.where(week("at")).agg(F.count("*").alias("opened"), F.count_distinct("doc_id").alias("opened_docs")), marks, rated.where(week("at")).agg(F.count_distinct("doc_id").alias("rated_docs")),
        due.agg(F.count_if((F.col("status") == "done") & week("done_at")).alias("done"), F.count_if(late).alias("overdue")),
        pool.agg(F.count("*").alias("pool"), F.count_if(F.col("status") == "unread").alias("unread"), F.count_if(still).alias("stalled"), F.lit(goal).alias("goal")),
    ]
    out = None
    for one in card:
        figures = _figures("card", one).withColumn("pos", F.lit(1))
        out = figures if out is None else out.union(figures)
    domain = F.coalesce("domain", F.lit("no domain")).alias("name")
    weak = rated.where(week("at") & (F.col("stars") <= 2)).select(domain).union(due.where(late).select(domain)).groupBy("name").agg(F.count("*").alias("value")).orderBy(F.desc("value"), "name").limit(most)
    longest = lambda rows, at: rows.orderBy(at, "doc_id").limit(most).select("doc_id", F.col("doc_id").alias("name"), F.unix_timestamp(F.col(at).cast("timestamp")).alias("value"))
    return (
        out.union(named("stars", stars.where("stars is not null").select(F.col("stars").alias("name"), F.col("n").alias("value")), F.col("name")))
        .union(named("weak", weak, F.desc("value"), F.col("name")))
        .union(named("overdue", longest(due.where(late), "due_at"), F.col("value"), F.col("doc_id")))
        .union(named("stalled", longest(pool.where(still), "moved_at"), F.col("value"), F.col("doc_id")))
    )


# --- queries over the driver's tables -------------------------------------------------------------


def _day(c: str, n: int) -> Column:
    return F.date_sub(F.lit("2024-01-31").cast("date"), F.pmod(F.col(c), F.lit(n)).cast("int"))


def _files(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", "left")
    state = F.when(F.col("toxic").isNull(), "pending").when(F.col("toxic") == 1, "failed").otherwise("done")
    return docs.select("doc_id", F.when(F.col("n_chars") < 512, "deleted").otherwise("active").alias("status"), state.alias("state"), F.col("lang").alias("domain"), F.col("source").alias("agent"), _day("doc_id", 60).alias("created"), _day("doc_id", 37).alias("modified"), "toxic")


def q_dashboard(spark, d):
    files = _files(spark, d)
    calls = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tokens"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))
    domains = files.select("domain").distinct().withColumn("parent", F.when(F.col("domain") != "en", "en"))
    return dashboard(files, files.where("toxic is not null").select("doc_id", _day("doc_id", 40).alias("at")), calls, domains, "2024-01-30")


def q_week_card(spark, d):
    e = table(spark, d, "events").withColumn("doc_id", F.col("user_id"))
    docs = table(spark, d, "documents")
    rated = e.where("event_type = 'click'").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id", "left").select("doc_id", "domain", (F.col("event_id") % 5 + 1).alias("stars"), F.when(F.col("event_id") % 3 == 0, "note").alias("digest"), F.col("ts").alias("at"))
    due = docs.select("doc_id", F.col("lang").alias("domain"), F.when(F.col("n_chars") % 3 == 0, "done").otherwise("pending").alias("status"), _day("doc_id", 30).alias("due_at"), _day("n_chars", 20).alias("done_at"))
    pool = docs.select("doc_id", F.when(F.col("n_chars") % 4 == 0, "archived").when(F.col("n_chars") % 4 == 1, "unread").otherwise("reading").alias("status"), F.pmod("n_chars", F.lit(101)).alias("progress"), _day("doc_id", 45).alias("moved_at"))
    return week_card(e.select("doc_id", F.col("ts").alias("at")), rated, due, pool, "2024-01-30")


def q_entries(spark, d):
    """The second page of twenty, and a row with the total."""
    docs = table(spark, d, "documents")
    files = docs.select("doc_id", F.when(F.col("n_chars") < 512, "deleted").otherwise("active").alias("status"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.substring("text", 1, 30)).alias("title"), F.lit(None).cast("string").alias("alias"), F.concat("source", F.lit("-"), "doc_id").alias("name"), F.substring("text", 1, 80).alias("summary"), F.col("source").alias("agent"), F.col("lang").alias("domain"))
    distilled = table(spark, d, "labels").select((F.col("doc_id") + 1000000).alias("meta_id"), "doc_id", F.lit(None).cast("string").alias("title"), F.col("quality").alias("conf"), _day("doc_id", 40).alias("at"))
    mounted = table(spark, d, "pages").select(F.col("page_id").alias("meta_id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.col("url").alias("summary"), F.lit(None).cast("int").alias("conf"), _day("page_id", 50).alias("at"))
    bridge = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("tag"))
    rows, total = entry_page(entries(distilled, mounted, files, "e"), bridge, 2, 20)
    shown = rows.select("meta_id", "no", "kind", "title", "agent", "domain", "conf", F.array_join("tags", ",").alias("tags"))
    return shown.unionByName(total.select(F.col("total").alias("meta_id"), F.lit("total").alias("kind")), allowMissingColumns=True)


QUERIES = {"q14_dashboard": q_dashboard, "g15_reading_card": q_week_card, "q19_entry_list": q_entries}
_D = "(DATE '2024-01-31' - ({} % {})::INTEGER)"
_F = f"l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1), f AS (SELECT doc_id, CASE WHEN n_chars < 512 THEN 'deleted' ELSE 'active' END AS status, CASE WHEN toxic IS NULL THEN 'pending' WHEN toxic = 1 THEN 'failed' ELSE 'done' END AS state, lang AS domain, source AS agent, {_D.format('doc_id', 60)} AS created, {_D.format('doc_id', 37)} AS modified, toxic FROM documents LEFT JOIN l USING (doc_id))"


def _sql(panel: str, rows: str, order: str) -> str:
    return f"SELECT '{panel}' AS panel, row_number() OVER (ORDER BY {order})::INTEGER AS pos, name::VARCHAR AS name, value::DOUBLE AS value FROM ({rows}) t"


def _one(panel: str, source: str, pos: str = "{}", **figures: str) -> str:
    return " UNION ALL ".join(f"SELECT '{panel}' AS panel, {pos.format(i)} AS pos, '{n}' AS name, ({x})::DOUBLE AS value FROM {source}" for i, (n, x) in enumerate(figures.items(), 1))


_A = "count(*) FILTER (WHERE status = 'active'"
_W = "t_at >= DATE '2024-01-24' AND t_at < DATE '2024-01-31'"
SQL = {
    "q14_dashboard": f"WITH {_F}, c AS (SELECT * FROM f WHERE status = 'active'), n AS (SELECT d.domain, count(c.doc_id) AS n FROM (SELECT DISTINCT domain FROM f) d LEFT JOIN c ON c.domain = d.domain GROUP BY 1), w AS (SELECT *, event_id AS id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS s FROM events),\n"
    f"g AS (SELECT m.event_type, d::DATE AS day FROM (SELECT DISTINCT event_type FROM events WHERE ts >= DATE '2024-01-16' AND ts < DATE '2024-01-31') m, range(DATE '2024-01-16', DATE '2024-01-31', INTERVAL 1 DAY) r(d)),\n"
    f"e AS ((SELECT 0 AS kind, doc_id AS id, 'entry ' || doc_id AS name, epoch({_D.format('doc_id', 40)})::BIGINT AS value FROM f WHERE toxic IS NOT NULL ORDER BY {_D.format('doc_id', 40)} DESC, doc_id LIMIT 10) UNION ALL (SELECT 1, id, 'call ' || id || ' ' || s, floor(epoch(ts))::BIGINT FROM w ORDER BY ts DESC, id LIMIT 10))\n"
    + " UNION ALL ".join([
        _one("files", "f", **{"all": "count(*)", "active": _A + ")", "deleted": "count(*) FILTER (WHERE status = 'deleted')", "new_in_week": "count(*) FILTER (WHERE created >= DATE '2024-01-24' AND created < DATE '2024-01-31')", "agents": "count(DISTINCT agent) FILTER (WHERE status = 'active')"}),
        _one("queue", "f", **{s: f"{_A} AND state = '{s}')" for s in ("pending", "running", "done", "failed", "skipped")}),
        _sql("domains", "SELECT domain AS name, n AS value FROM n UNION ALL SELECT 'total en', sum(n) FROM n", "name"),
        _sql("sources", "SELECT agent AS name, count(*) AS value FROM c WHERE agent IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12", "value DESC, name"),
        _sql("recent", "SELECT doc_id AS name, epoch(modified)::BIGINT AS value FROM c ORDER BY modified DESC, doc_id LIMIT 5", "value DESC, name"),
        _sql("events", "SELECT * FROM e ORDER BY value DESC, kind, id LIMIT 10", "value DESC, kind, id"),
        _sql("trend", "SELECT g.event_type || ' ' || strftime(g.day, '%m-%d') AS name, count(v.event_id) AS value FROM g LEFT JOIN events v ON v.event_type = g.event_type AND v.ts::DATE = g.day GROUP BY 1", "name"),
        _one("calls", "(SELECT * FROM w WHERE ts >= DATE '2024-01-01' AND ts < DATE '2024-01-31') t", calls="count(*)", tokens="coalesce(sum(id % 1000), 0)", success="round(100.0 * count(*) FILTER (WHERE s = 'success') / greatest(count(*), 1), 1)"),
    ]),
    "g15_reading_card": "WITH e AS (SELECT *, ts AS t_at FROM events), r AS (SELECT user_id AS doc_id, lang AS domain, event_id % 5 + 1 AS stars, event_id % 3 = 0 AS note FROM e LEFT JOIN (SELECT DISTINCT doc_id, lang FROM documents) d ON d.doc_id = e.user_id WHERE event_type = 'click' AND " + _W + f"), q AS (SELECT doc_id, lang AS domain, n_chars % 3 = 0 AS done, {_D.format('doc_id', 30)} AS due_at, {_D.format('n_chars', 20)} AS t_at FROM documents), p AS (SELECT doc_id, n_chars % 4 AS k, n_chars % 101 AS progress, {_D.format('doc_id', 45)} AS moved_at FROM documents)\n"
    + " UNION ALL ".join([
        _one("card", f"(SELECT * FROM e WHERE {_W}) t", "1", opened="count(*)", opened_docs="count(DISTINCT user_id)"), _one("card", "r", "1", rated="count(*)", digested="count(*) FILTER (WHERE note)", mean_stars="round(avg(stars), 1)", rated_docs="count(DISTINCT doc_id)"),
        _one("card", "q", "1", done=f"count(*) FILTER (WHERE done AND {_W})", overdue="count(*) FILTER (WHERE NOT done AND due_at < DATE '2024-01-24')"),
        _one("card", "p", "1", pool="count(*)", unread="count(*) FILTER (WHERE k = 1)", stalled="count(*) FILTER (WHERE k <> 0 AND progress BETWEEN 1 AND 99 AND moved_at < DATE '2024-01-17')", goal="max(5)"),
        _sql("stars", "SELECT stars AS name, count(*) AS value FROM r GROUP BY 1", "name"),
        _sql("weak", "SELECT coalesce(domain, 'no domain') AS name, count(*) AS value FROM (SELECT domain FROM r WHERE stars <= 2 UNION ALL SELECT domain FROM q WHERE NOT done AND due_at < DATE '2024-01-24') t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", "value DESC, name"),
        _sql("overdue", "SELECT doc_id AS name, epoch(due_at)::BIGINT AS value FROM q WHERE NOT done AND due_at < DATE '2024-01-24' ORDER BY due_at, doc_id LIMIT 3", "value, name"),
        _sql("stalled", "SELECT doc_id AS name, epoch(moved_at)::BIGINT AS value FROM p WHERE k <> 0 AND progress BETWEEN 1 AND 99 AND moved_at < DATE '2024-01-17' ORDER BY moved_at, doc_id LIMIT 3", "value, name"),
    ]),
    "q19_entry_list": f"""WITH x AS (SELECT l.doc_id + 1000000 AS meta_id, l.doc_id, lpad(l.doc_id::VARCHAR, greatest(3, length(l.doc_id::VARCHAR))::INTEGER, '0') AS no, 'llm' AS kind, CASE WHEN l.doc_id % 3 = 0 OR text = '' THEN source || '-' || l.doc_id ELSE substring(text, 1, 30) END AS title, source AS agent, lang AS domain, quality AS conf, {_D.format('l.doc_id', 40)} AS t_at
FROM labels l JOIN documents d USING (doc_id) WHERE n_chars >= 512 AND (contains(lower(substring(text, 1, 80)), 'e')) UNION ALL SELECT page_id, NULL, 'M' || lpad(page_id::VARCHAR, greatest(3, length(page_id::VARCHAR))::INTEGER, '0'), 'imported', regexp_extract(html, '<title>(.*?)</title>', 1), 'mounted', 'mounted', NULL, {_D.format('page_id', 50)} FROM pages WHERE contains(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), 'e') OR contains(lower(url), 'e')),
t AS (SELECT user_id AS doc_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM events GROUP BY 1)
SELECT meta_id, no, kind, title, agent, domain, conf, coalesce(tags, '') AS tags FROM (SELECT * FROM x ORDER BY t_at DESC, meta_id LIMIT 20 OFFSET 20) y LEFT JOIN t USING (doc_id) UNION ALL SELECT count(*), NULL, 'total', NULL, NULL, NULL, NULL, NULL FROM x""",
}
