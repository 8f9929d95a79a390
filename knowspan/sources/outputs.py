"""Outputs that a second run doesn't write again: folders named by the digest of their rows, a ledger of runs, re-hashing; daily reports."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspan.session import shared_folder, table

LEDGER = "run string, name string, digest string, rows bigint, written boolean, at timestamp"


def digest(rows: DataFrame) -> tuple[str, int]:
    """A digest of the rows as a bag, and their number: equal rows in any order and partitioning give the same one.

    Each row is hashed as JSON with its nulls; the hashes are summed in four parts, which partial aggregation does before
    any shuffle. It finds damage and changes; it isn't meant against forgers."""
    names = sorted(rows.columns)
    hashed = rows.select(F.sha2(F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)), {"ignoreNullFields": "false"}), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    types = ",".join(f"{n} {t}" for n, t in sorted(rows.dtypes))
    found = hashed.agg(F.sha2(F.concat_ws("/", F.lit(types), F.count("*"), *parts), 256).alias("d"), F.count("*").alias("n")).first()
    return found.d, found.n


def _path(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def there(spark: SparkSession, place: str) -> bool:
    files, path = _path(spark, place)
    return files.exists(path)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row (run, name, digest, rows, written, at) for each output of each run; empty before the first."""
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger") if there(spark, f"{root}/ledger") else spark.createDataFrame([], LEDGER)


def publish(rows: DataFrame, root: str, name: str, run: str, at: str) -> tuple[str, bool]:
    """The rows as ``root/name/<digest>`` in Parquet; gives the folder and whether it was written now.

    Rows that are published already aren't written. New ones go to a hidden folder, are read back and hashed, and then
    renamed, so a reader sees all of them or none and a lost run leaves nothing that counts; of two writers of the same
    rows the second finds them there. ``run`` has one line for ``name`` in the ledger, however often it is repeated.
    Raises if the rows read back aren't those that were hashed, as with rows that differ at each computation."""
    spark = rows.sparkSession
    key, number = digest(rows)
    folder, written = f"{root}/{name}/{key}", False
    if not there(spark, folder):
        stage = f"{root}/{name}/.stage-{uuid.uuid4().hex}"
        rows.write.parquet(stage)
        files, source = _path(spark, stage)
        if digest(spark.read.parquet(stage)) != (key, number):
            files.delete(source, True)
            raise ValueError(f"the rows of {name} differ each time they are computed, or were damaged on their way")
        written = not there(spark, folder) and files.rename(source, _path(spark, folder)[1])
        if not written:
            files.delete(source, True)
    if ledger(spark, root).where((F.col("run") == run) & (F.col("name") == name)).isEmpty():
        line = spark.range(1).select(F.lit(run).alias("run"), F.lit(name).alias("name"), F.lit(key).alias("digest"), F.lit(number).cast("bigint").alias("rows"), F.lit(written).alias("written"), F.lit(at).cast("timestamp").alias("at"))
        line.coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return folder, written


def verify(spark: SparkSession, root: str) -> DataFrame:
    """name, digest, rows, ok: every output of the ledger once, hashed again; what is missing or can't be read isn't ok."""
    found = []
    for name, key, number in sorted(tuple(r) for r in ledger(spark, root).select("name", "digest", "rows").distinct().collect()):
        try:
            ok = digest(spark.read.parquet(f"{root}/{name}/{key}")) == (key, number)
        except (PySparkException, Py4JJavaError):
            ok = False
        found.append((name, key, number, ok))
    return spark.createDataFrame(found, "name string, digest string, rows bigint, ok boolean")


def escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def daily_report(days: DataFrame, picks: DataFrame, title: str = "Daily report") -> DataFrame:
    """day, markdown, html for each day (day, entries, quality): its figures, then its picks (day, pos, title, path, domain,
    quality, out_of_pool, reason) in order of pos.

    Picks are few a day by the operator that makes them. Null parts are left out; a day without picks says so."""
    bits = lambda esc: F.concat_ws(
        " · ",
        esc(F.coalesce("domain", F.lit("no domain"))),
        F.when(F.col("out_of_pool"), "from outside the pool"),
        F.concat(F.lit("score "), F.format_number("quality", 1)),
    )
    kept = lambda c: c
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(" ("), bits(kept), F.lit(")\n  - path: "), F.coalesce("path", F.lit("")), F.coalesce(F.concat(F.lit("\n  - "), "reason"), F.lit("")))
    item = F.concat(F.lit("<li><b>"), escaped(F.coalesce("title", F.lit(""))), F.lit("</b> <i>"), bits(escaped), F.lit("</i> <code>"), escaped(F.coalesce("path", F.lit(""))), F.lit("</code>"), F.coalesce(F.concat(F.lit(" "), escaped(F.col("reason"))), F.lit("")), F.lit("</li>"))
    listed = picks.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), item.alias("item")))).alias("p"))
    mean = F.coalesce(F.concat(F.lit(" (mean quality "), F.format_number("quality", 1), F.lit(")")), F.lit(""))
    head = F.concat(F.lit(f"{title} "), F.date_format("day", "yyyy-MM-dd"))
    lines = F.coalesce(F.array_join(F.transform("p", lambda x: x["line"]), "\n"), F.lit("- no picks today"))
    shown = F.coalesce(F.array_join(F.transform("p", lambda x: x["item"]), "\n"), F.lit("<li>no picks today</li>"))
    figures = F.concat(F.lit("new entries: "), F.col("entries"), mean)
    markdown = F.concat(F.lit("# "), head, F.lit("\n\n- "), figures, F.lit("\n\n## Worth reading\n"), lines, F.lit("\n"))
    html = F.concat(F.lit('<!doctype html>\n<meta charset="utf-8">\n<title>'), escaped(head), F.lit("</title>\n<h1>"), escaped(head), F.lit("</h1>\n<p>"), figures, F.lit("</p>\n<ol>\n"), shown, F.lit("\n</ol>\n"))
    return days.join(listed, "day", "left").select("day", markdown.alias("markdown"), html.alias("html"))


def weekly_digest(entries: DataFrame, title: str = "Weekly digest") -> DataFrame:
    """week, markdown, clusters, skipped for each ISO week of entries (id, domain, hook, at) between its Monday and its Sunday, both at 00:00.

    ``hook`` is JSON; an entry whose ``action`` is ``ignore`` is only counted as skipped, any other or unreadable one is kept. A cluster is
    a domain with its number and the ``text`` of its first hook by time, then id; the largest come first, then by name. ``clusters`` is
    their JSON. Each domain is one row before a week gathers its own; rows without a time or on a Sunday belong to no week."""
    monday = F.to_date(F.date_trunc("week", "at"))
    kept = entries.where(F.to_date("at") < F.date_add(monday, 6)).select(
        monday.alias("_monday"), F.coalesce("domain", F.lit("no domain")).alias("domain"), (F.coalesce(F.get_json_object("hook", "$.action"), F.lit("")) == "ignore").alias("_out"),
        F.struct("at", "id").alias("_order"), F.get_json_object("hook", "$.text").alias("text"),
    )
    first = F.min_by(F.when(~F.col("_out"), F.coalesce("text", F.lit(""))), F.when(~F.col("_out"), F.col("_order"))).alias("text")
    domains = kept.groupBy("_monday", "domain").agg(F.count_if(~F.col("_out")).alias("n"), F.count_if("_out").alias("out"), first)
    order = F.struct((-F.col("n")).alias("_k"), "domain", F.col("n").alias("count"), F.nullif("text", F.lit("")).alias("text"))
    weeks = domains.groupBy("_monday").agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, order))).alias("c"), F.sum("out").alias("skipped"))
    said = lambda c: F.concat(c["domain"], F.lit(": "), c["count"], F.lit(" new this week"), F.coalesce(F.concat(F.lit(", such as "), c["text"]), F.lit("")))
    shown = F.transform("c", lambda c: F.concat(F.lit("## "), c["domain"], F.lit(" ("), c["count"], F.lit(")\n\n"), said(c), F.lit("\n\n")))
    name = F.concat(F.extract(F.lit("YEAROFWEEK"), "_monday"), F.lit("-W"), F.lpad(F.weekofyear("_monday").cast("string"), 2, "0"))
    body = F.when(F.size("c") == 0, "nothing new this week\n\n").otherwise(F.array_join(shown, ""))
    markdown = F.concat(F.lit(f"# {title} "), name, F.lit("\n\n"), body, F.lit("left out: "), F.col("skipped"), F.lit("\n"))
    clusters = F.to_json(F.transform("c", lambda c: F.struct(c["domain"].alias("domain"), c["count"].alias("count"), said(c).alias("paragraph"))))
    return weeks.select(name.alias("week"), markdown.alias("markdown"), clusters.alias("clusters"), "skipped")


# --- queries over the driver's tables -------------------------------------------------------------


def q_daily_report(spark, d):
    """Orders as entries of their day; its three dearest are the picks."""
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    days = orders.groupBy("day").agg(F.count("*").alias("entries"), F.floor(F.avg(cents) / 1_000_000).cast("double").alias("quality"))
    best = orders.groupBy("day").agg(F.slice(F.sort_array(F.collect_list(F.struct(cents.alias("cents"), (-F.col("o_orderkey")).alias("k"), "o_orderpriority", "o_orderstatus")), False), 1, 3).alias("b"))
    picks = best.select("day", F.posexplode("b")).select(
        "day", "pos", F.concat(F.lit("order <"), -F.col("col.k"), F.lit(">")).alias("title"), F.concat(F.lit("/o/"), -F.col("col.k")).alias("path"), F.col("col.o_orderpriority").alias("domain"),
        F.lit(None).cast("double").alias("quality"), (F.col("col.o_orderstatus") == "P").alias("out_of_pool"), F.when(F.col("col.o_orderstatus") == "F", F.lit("a & b")).alias("reason"),
    )
    return daily_report(days, picks)


def q_weekly_digest(spark, d):
    """Orders as entries of their week; some of their hooks tell to ignore them, some aren't JSON."""
    hook = F.when(F.col("o_orderstatus") == "O", F.lit("{broken")).otherwise(F.to_json(F.struct(F.when(F.col("o_orderstatus") == "P", "ignore").otherwise("keep").alias("action"), F.concat(F.lit("order "), "o_orderkey").alias("text"))))
    return weekly_digest(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"), hook.alias("hook"), F.col("o_orderdate").alias("at"))).drop("clusters")


def q_verify(spark, d):
    """Documents and pages published twice and verified: rows, lines of the ledger and folders written."""
    root = shared_folder(spark, "outputs")
    for run in ("first", "second"):
        for name in ("documents", "pages"):
            publish(table(spark, d, name), root, name, run, "2024-01-31 00:00:00")
    runs = ledger(spark, root).groupBy("name").agg(F.count("*").alias("runs"), F.count_if("written").alias("written"))
    return verify(spark, root).join(runs, "name").select("name", "rows", "ok", "runs", "written")


QUERIES = {"k02_daily_report": q_daily_report, "k03_weekly_digest": q_weekly_digest, "q27_export_verify": q_verify}
SQL = {
    "k03_weekly_digest": """WITH o AS (SELECT *, strftime(o_orderdate, '%G-W%V') AS week, o_orderpriority AS domain FROM orders WHERE isodow(o_orderdate) < 7),
d AS (SELECT week, domain, count(*) AS n, min_by(CASE WHEN o_orderstatus = 'F' THEN 'order ' || o_orderkey ELSE '' END, (o_orderdate, o_orderkey)) AS t FROM o WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
m AS (SELECT week, string_agg('## ' || domain || ' (' || n || ')' || chr(10) || chr(10) || domain || ': ' || n || ' new this week' || CASE WHEN t <> '' THEN ', such as ' || t ELSE '' END || chr(10) || chr(10), '' ORDER BY n DESC, domain) AS body FROM d GROUP BY 1),
s AS (SELECT week, count(*) FILTER (WHERE o_orderstatus = 'P') AS skipped FROM o GROUP BY 1)
SELECT week, '# Weekly digest ' || week || chr(10) || chr(10) || coalesce(body, 'nothing new this week' || chr(10) || chr(10)) || 'left out: ' || skipped || chr(10) AS markdown, skipped FROM s LEFT JOIN m USING (week)""",
    "k02_daily_report": """WITH o AS (SELECT *, o_orderdate::DATE AS day, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY cents DESC, o_orderkey) AS pos FROM o),
b AS (SELECT *, o_orderpriority || CASE WHEN o_orderstatus = 'P' THEN ' · from outside the pool' ELSE '' END AS bits FROM r WHERE pos <= 3),
p AS (SELECT day, string_agg('- order <' || o_orderkey || '> (' || bits || ')' || chr(10) || '  - path: /o/' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN chr(10) || '  - a & b' ELSE '' END, chr(10) ORDER BY pos) AS lines,
 string_agg('<li><b>order &lt;' || o_orderkey || '&gt;</b> <i>' || bits || '</i> <code>/o/' || o_orderkey || '</code>' || CASE WHEN o_orderstatus = 'F' THEN ' a &amp; b' ELSE '' END || '</li>', chr(10) ORDER BY pos) AS items FROM b GROUP BY 1),
n AS (SELECT day, 'new entries: ' || count(*) || ' (mean quality ' || floor(avg(cents) / 1000000)::BIGINT || '.0)' AS figures, 'Daily report ' || strftime(day, '%Y-%m-%d') AS head FROM o GROUP BY 1)
SELECT day, '# ' || head || chr(10) || chr(10) || '- ' || figures || chr(10) || chr(10) || '## Worth reading' || chr(10) || lines || chr(10) AS markdown,
'<!doctype html>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>' || head || '</title>' || chr(10) || '<h1>' || head || '</h1>' || chr(10) || '<p>' || figures || '</p>' || chr(10) || '<ol>' || chr(10) || items || chr(10) || '</ol>' || chr(10) AS html FROM n JOIN p USING (day)""",
    "q27_export_verify": "SELECT 'documents' AS name, count(*) AS rows, true AS ok, 2::BIGINT AS runs, 1::BIGINT AS written FROM documents UNION ALL SELECT 'pages', count(*), true, 2, 1 FROM pages",
}
