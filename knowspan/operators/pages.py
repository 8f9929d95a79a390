"""Pages for readers, and the records of clipped pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowspan.functions import reader as R
from knowspan.session import table

CLIP = "id bigint, url string, status string, title string, error string, attempts int, file string, at timestamp"


def cleaned(pages: DataFrame, html: str = "html", assets: Column | None = None) -> DataFrame:
    """``pages`` with ``clean`` (HTML that may be shown) and ``toc``; null stays null. One pass over each page, no shuffle."""
    return pages.withColumn("_page", R.anchored(R.sanitized(html, assets))).select(*(F.col(f"`{c}`") for c in pages.columns if c not in ("clean", "toc")), F.col("_page.html").alias("clean"), F.col("_page.toc").alias("toc"))


def address(url: Column) -> Column:
    """An address by which clips of one page are found: without fragment and blanks around it, scheme and host in lower case,
    no slash at the end of an otherwise empty path. Null where it isn't of http or https."""
    trimmed = F.regexp_replace(F.trim(url), r"#.*$", "")
    head, rest = F.regexp_extract(trimmed, r"(?i)^(https?://[^/?]+)", 1), F.regexp_replace(trimmed, r"(?i)^https?://[^/?]+", "")
    return F.when(head != "", F.concat(F.lower(head), F.when(rest == "/", "").otherwise(rest)))


def clip(records: DataFrame, asked: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(records with the new ones, refused): asked clips (id, url), each page once.

    A request for an address that has a record already, or that a smaller id of the same batch asks for, is refused as
    ``exists`` with the record it repeats; one that is no web address as ``invalid``. Nothing is fetched here: new records
    are ``pending``. Records are reduced to one id an address before they meet the requests."""
    known = records.groupBy(address(F.col("url")).alias("_address")).agg(F.min("id").alias("of")).where("_address is not null")
    wanted = asked.select("id", "url", address(F.col("url")).alias("_address"))
    valid = wanted.where("_address is not null")
    first = valid.groupBy("_address").agg(F.min_by(F.struct("id", "url"), "id").alias("f")).join(known, "_address", "left")
    fresh = first.where("of is null").select(
        F.col("f.id").alias("id"), F.col("f.url").alias("url"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("file"), at.cast("timestamp").alias("at"),
    )
    again = valid.join(first.select("_address", F.coalesce("of", "f.id").alias("of"), F.col("of").isNull().alias("_new")), "_address").where("not (_new and id = of)")
    refused = again.select("id", "url", F.lit("exists").alias("why"), "of").union(wanted.where("_address is null").select("id", "url", F.lit("invalid"), F.lit(None).cast("bigint")))
    return records.select(*fresh.columns).union(fresh), refused


def settle(records: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Records after the fetched pages (id, title, file, error): ``done`` with title and file, or ``failed`` with its error, one attempt more.

    Only pending records take a result; of several for one id the one without an error wins, then the smallest file."""
    best = results.groupBy("id").agg(F.min(F.struct(F.col("error").isNotNull().alias("bad"), F.coalesce("file", F.lit("")).alias("f"), "title", "file", "error")).alias("r"))
    got = F.col("r").isNotNull() & (F.col("status") == "pending")
    take = lambda name: F.when(got, F.col(f"r.{name}")).otherwise(F.col(name)).alias(name)
    status = F.when(~got, F.col("status")).when(F.col("r.bad"), "failed").otherwise("done").alias("status")
    kept_title = F.when(got & F.col("r.bad"), F.col("title")).when(got, F.col("r.title")).otherwise(F.col("title")).alias("title")
    kept_file = F.when(got & F.col("r.bad"), F.col("file")).when(got, F.col("r.file")).otherwise(F.col("file")).alias("file")
    return records.join(best, "id", "left").select("id", "url", status, kept_title, take("error"), (F.col("attempts") + got.cast("int")).alias("attempts"), kept_file, F.when(got, at.cast("timestamp")).otherwise(F.col("at")).alias("at"))


def change(records: DataFrame, orders: DataFrame, at: Column) -> DataFrame:
    """Records after orders (id, what): ``retry`` makes a failed one pending again, ``reclip`` a done or failed one, whose title and file stay
    until the next result; ``delete`` takes a record away, and wins over the others for its id. Orders that don't fit change nothing."""
    told = orders.groupBy("id").agg(F.bool_or(F.col("what") == "delete").alias("_gone"), F.bool_or(F.col("what") == "retry").alias("_retry"), F.bool_or(F.col("what") == "reclip").alias("_reclip"))
    again = (F.col("_retry") & (F.col("status") == "failed")) | (F.col("_reclip") & F.col("status").isin("done", "failed"))
    again = F.coalesce(again, F.lit(False))
    return records.join(told, "id", "left").where("not coalesce(_gone, false)").select(
        "id", "url", F.when(again, "pending").otherwise(F.col("status")).alias("status"), "title", F.when(again, F.lit(None)).otherwise(F.col("error")).alias("error"), "attempts", "file",
        F.when(again, at.cast("timestamp")).otherwise(F.col("at")).alias("at"),
    )


# --- queries over the driver's tables -------------------------------------------------------------


def q_reader(spark, d):
    """What is left of every page: tags, links, text and the number of headings, and whether each element is closed."""
    clean = cleaned(table(spark, d, "pages"))
    void = "(?:" + "|".join(R.VOID) + ")"
    opened = F.regexp_count("clean", F.lit(rf"<(?!{void}[ >])[a-z]"))
    return clean.select(
        "page_id", F.regexp_count("clean", F.lit("<[a-z]")).alias("tags"), F.regexp_count("clean", F.lit(' href="')).alias("links"), F.sha2(R.text_of(F.col("clean")), 256).alias("text_sha256"),
        F.size("toc").alias("headings"), (opened == F.regexp_count("clean", F.lit("</[a-z]"))).alias("closed"),
    )


def q_toc(spark, d):
    return cleaned(table(spark, d, "pages")).select("page_id", F.posexplode("toc").alias("pos", "t")).select("page_id", "pos", "t.level", "t.text", "t.id")


def q_clips(spark, d):
    """Every page is asked for as a clip, after those of odd number are known; results, then orders, come by rule."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    at = F.lit("2024-01-31 00:00:00")
    records, refused = clip(spark.createDataFrame([], CLIP), pages.where("id % 2 = 1"), at)
    records, repeated = clip(records, pages, at)
    results = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.concat(F.lit("/clip/"), "page_id").alias("file"), F.when(F.length("html") % 5 == 0, "timeout").alias("error"))
    records = settle(records, results, at)
    orders = pages.select("id", F.when(F.col("id") % 7 == 0, "delete").when(F.col("id") % 3 == 0, "retry").otherwise("none").alias("what"))
    left = change(records, orders, at).groupBy("status").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.sum("attempts").alias("attempts"))
    known = refused.union(repeated).groupBy(F.concat(F.lit("refused: "), "why").alias("status")).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.sum("of").alias("attempts"))
    return left.union(known)


QUERIES = {"t23_reader": q_reader, "t23_toc": q_toc, "m24_clips": q_clips}
_BARE = r"regexp_replace(html, '<script>.*?</script>|<!--.*?-->|<![^>]*>', '', 'gs')"
_READ = "regexp_replace(regexp_replace({}, '<style>.*?</style>', '', 'gs'), '<[^>]*>', '', 'g')"
for _name, _sign in (*R.NAMED.items(), ("amp", "&")):
    _READ = "replace(" + _READ + f", '&{_name};', " + ("chr(9)" if _sign == "\t" else "chr(10)" if _sign == "\n" else f"'{_sign.replace(chr(39), chr(39) * 2)}'") + ")"
SQL = {
    "t23_reader": f"""SELECT page_id, len(regexp_extract_all(b, '<[a-z]'))::INTEGER AS tags, len(regexp_extract_all(b, ' href="'))::INTEGER AS links, sha256({_READ.format('b')}) AS text_sha256,
len(list_filter(regexp_extract_all(b, '<h[1-3]>.*?</h[1-3]>'), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')) <> ''))::INTEGER AS headings, true AS closed FROM (SELECT page_id, {_BARE} AS b FROM pages) t""",
    "t23_toc": f"""WITH h AS (SELECT page_id, regexp_extract_all({_BARE}, '<h[1-3]>.*?</h[1-3]>') AS h FROM pages), u AS (SELECT page_id, unnest(h) AS x, unnest(range(len(h))) AS i FROM h),
t AS (SELECT page_id, i, x[3]::INTEGER AS level, substring(trim({_READ.format('x')}), 1, 80) AS text FROM u)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS pos, level, text, 'rh-' || i AS id FROM t WHERE text <> ''""",
    "m24_clips": """WITH a AS (SELECT page_id AS id, length(html) AS n, CASE WHEN regexp_matches(trim(url), '^(?i)https?://[^/?]+') THEN regexp_replace(lower(regexp_extract(regexp_replace(trim(url), '#.*$', ''), '^(?i)https?://[^/?]+')) || regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)https?://[^/?]+', ''), '^(https?://[^/?]+)/$', '\\1') END AS k FROM pages),
o AS (SELECT k, min(id) AS id FROM a WHERE id % 2 = 1 AND k IS NOT NULL GROUP BY k), f AS (SELECT k, id FROM o UNION ALL SELECT k, min(id) FROM a WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM o) GROUP BY k),
s AS (SELECT f.id, CASE WHEN n % 5 <> 0 THEN 'done' WHEN f.id % 3 = 0 THEN 'pending' ELSE 'failed' END AS status FROM f JOIN a USING (id) WHERE f.id % 7 <> 0),
r AS (SELECT 'exists' AS why, a.id, f.id AS "of" FROM a JOIN f USING (k) WHERE a.id % 2 = 1 AND a.id <> f.id UNION ALL SELECT 'exists', a.id, f.id FROM a JOIN f USING (k) WHERE f.id % 2 = 1 OR a.id <> f.id
UNION ALL SELECT 'invalid', id, NULL FROM a WHERE k IS NULL UNION ALL SELECT 'invalid', id, NULL FROM a WHERE k IS NULL AND id % 2 = 1)
SELECT status, count(*) AS n, min(id) AS first, max(id) AS last, count(*) AS attempts FROM s GROUP BY 1 UNION ALL SELECT 'refused: ' || why, count(*), min(id), max(id), sum("of")::BIGINT FROM r GROUP BY 1""",
}
