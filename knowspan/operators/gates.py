"""Gates, path predicates and row filters over collections of documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspan.config import Gate
from knowspan.functions import expressions as X
from knowspan.session import table

_LICENCE = r"(?i)^(changelog|license|notice)(\..*)?$"


def excluded(path: Column, root: str, gate: Gate) -> Column:
    """A directory segment below the root is excluded, or the file is a skill, a licence or a log; the whitelist comes first."""
    relative = F.regexp_replace(path, f"^{re.escape(root.rstrip('/'))}/", "")
    segments = F.slice(F.split(relative, "/"), F.lit(1), F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0)))
    name = X.base_name(path)
    bad = F.arrays_overlap(segments, F.array(*(F.lit(d) for d in gate.exclude_dirs))) | F.arrays_overlap(F.transform(segments, lambda s: F.lower(s)), F.array(F.lit("skills"), F.lit("skill")))
    return ~X.whitelisted(path, list(gate.path_whitelist)) & (bad | name.rlike(r"(?i)^skills?\.md$") | name.rlike(_LICENCE) | path.rlike(r"(?i)\.log$"))


def blacklist_hit(path: Column, entries: list[str]) -> Column:
    """The first entry that matches: /regex/, a glob, an .extension or a substring; null without one."""
    hits = []
    for entry in entries:
        if len(entry) > 2 and entry[0] == entry[-1] == "/":
            try:
                re.compile(entry[1:-1])
            except re.error:
                continue
            test = path.rlike(f"(?i){entry[1:-1]}")
        elif "*" in entry or "?" in entry:
            pattern = "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in entry) + "$"
            test = X.base_name(path).rlike(f"(?i){pattern}") | path.rlike(f"(?i){pattern}")
        elif entry.startswith("."):
            test = F.lower(path).endswith(entry.lower())
        else:
            test = F.contains(path, F.lit(entry))
        hits.append(F.when(test, F.lit(entry)))
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def decide(path: Column, size: Column, text: Column, gate: Gate = Gate(), sampled: bool = False) -> Column:
    """struct(passed, rule, metric): the first rule that decides. ``sampled``: only the head is known, so no code ratio."""

    def verdict(passed: bool, rule: str | None, metric: Column) -> Column:
        return F.struct(F.lit(passed).alias("passed"), F.lit(rule).cast("string").alias("rule"), metric.cast("string").alias("metric"))

    ok, name = verdict(True, None, F.lit(None)), F.lower(X.base_name(path))
    if not gate.enabled:
        return ok
    hit = blacklist_hit(path, list(gate.blacklist))
    named = name.isin([n.lower() for n in gate.name_whitelist])
    for word in gate.keywords:
        named = named | F.contains(name, F.lit(word.lower()))
    out = F.when(X.whitelisted(path, list(gate.path_whitelist)), ok).when(hit.isNotNull(), verdict(False, "blacklist", hit)).when(named, ok)
    if gate.min_size is not None:
        out = out.when(size < gate.min_size, verdict(False, "minSize", size))
    if gate.min_chars is not None:
        chars = X.effective_chars(text)
        out = out.when(chars < gate.min_chars, verdict(False, "minChars", chars))
    if gate.code_ratio is not None and not sampled:
        ratio = X.code_ratio(text)
        out = out.when(ratio > gate.code_ratio, verdict(False, "codeRatio", ratio))
    return out.otherwise(ok)


def streamed_code_ratio(text: Column) -> Column:
    """The code ratio line by line, as of a file too large to hold: a line that opens a fence counts, one that closes it doesn't."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("code"), F.lit(0).alias("lines"))

    def step(s: Column, line: Column) -> Column:
        fence = line.rlike(r"^\s*```")
        inside = F.when(fence, ~s["inside"]).otherwise(s["inside"])
        return F.struct(inside.alias("inside"), (s["code"] + F.when(inside, 1).otherwise(0)).alias("code"), (s["lines"] + 1).alias("lines"))

    return F.aggregate(F.split(text, "\n", -1), start, step, lambda s: s["code"] / s["lines"])


def keyword_filter(df: DataFrame, fields: list[str], word: str | None, **equal: object) -> DataFrame:
    """Rows of which a field contains the word whatever its case, and with the given values."""
    if word:
        test = F.lit(False)
        for f in fields:
            test = test | F.contains(F.lower(F.col(f)), F.lit(word.lower()))
        df = df.where(test)
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def time_filter(df: DataFrame, column: str, since: str | None, until: str | None) -> DataFrame:
    """Rows within bounds; a bound that is no time is ignored."""
    for bound, low in ((since, True), (until, False)):
        if bound is not None:
            at = F.coalesce(X.parse_time(F.lit(bound)), F.try_to_timestamp(F.lit(bound), F.lit("yyyy-MM-dd")))
            test = F.col(column) >= at if low else F.col(column) <= at
            df = df.where(at.isNull() | test)
    return df


def title_filter(df: DataFrame, title: str, words: list[str], exclude: list[str], fields: list[str]) -> DataFrame:
    """All words in the title, none of the excluded ones in any field."""
    hay = F.lower(F.concat_ws(" ", *(F.col(f) for f in fields)))
    for w in words:
        df = df.where(F.contains(F.lower(F.col(title)), F.lit(w.lower())))
    for w in exclude:
        df = df.where(~F.contains(hay, F.lit(w.lower())))
    return df


def match_class(path: Column, names: Column, title: Column) -> Column:
    """matched, standalone or already: how an imported entry meets what is there."""
    return F.when(title.isNotNull(), "already").when(names.isNotNull(), "matched").otherwise("standalone")


def private_host(url: Column) -> Column:
    """The URL isn't http(s), has no host, or its host is local or of a private range."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    private = host.rlike(r"^(localhost|.*\.local|0\..*|127\..*|10\..*|169\.254\..*|192\.168\..*|172\.(1[6-9]|2\d|3[01])\..*|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\..*|\[?::1\]?|\[?f[cd][0-9a-f]{2}:.*|\[?fe80:.*)$")
    return F.coalesce(~F.lower(url).rlike("^https?://") | host.isNull() | private, F.lit(True))


# --- queries over the driver's tables -------------------------------------------------------------


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _path() -> Column:
    return F.concat(F.lit("/kb/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".html").otherwise(".md"))


PATH_SQL = "'/kb/' || source || '/' || lang || '/doc' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.html' ELSE '.md' END"


def q_legacy_search(spark, d):
    found = keyword_filter(_docs(spark, d), ["text"], "the", lang="en", source="src3")
    return found.orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id", "n_chars", "source")


def q_gate_decision(spark, d):
    gate = Gate(blacklist=("/src9.*fr/", "*77.md", ".htm", "src4/es"), path_whitelist=("/kb/src5",))
    v = decide(_path(), F.octet_length("text"), F.col("text"), gate)
    return _docs(spark, d).select("doc_id", v.alias("v")).select("doc_id", "v.passed", "v.rule", "v.metric")


_CHARS_SQL = r"length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '(?s)^---\n.*?\n---\n', ''), '(?m)^#+\s+.+$', '', 'g'), '[#*_`~>\-|]', '', 'g'), '[\s\x0B\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g'))"
_GATE_SQL = rf"""
WITH p AS (SELECT doc_id, text, {PATH_SQL} AS path, strlen(text) AS size, {_CHARS_SQL} AS chars,
  length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
  length(regexp_replace(text, '(?s)```.*?```', '', 'g')) - length(replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), chr(10), '')) + 1 AS n_kept FROM documents),
b AS (SELECT *, CASE WHEN regexp_matches(path, '(?i)src9.*fr') THEN '/src9.*fr/' WHEN regexp_matches(path, '(?i)77\.md$') THEN '*77.md'
  WHEN path ILIKE '%.htm' THEN '.htm' WHEN contains(path, 'src4/es') THEN 'src4/es' END AS hit FROM p)
SELECT doc_id, rule IS NULL AS passed, rule, CASE rule WHEN 'blacklist' THEN hit WHEN 'minSize' THEN size::VARCHAR WHEN 'minChars' THEN chars::VARCHAR END AS metric
FROM (SELECT *, CASE WHEN starts_with(path, '/kb/src5/') THEN NULL WHEN hit IS NOT NULL THEN 'blacklist' WHEN size < 512 THEN 'minSize'
  WHEN chars < 300 THEN 'minChars' WHEN (n_lines - n_kept) / n_lines > 0.6 THEN 'codeRatio' END AS rule FROM b) t
"""


def q_gate_rule_counts(spark, d):
    v = decide(_path(), F.octet_length("text"), F.col("text"), Gate())
    return _docs(spark, d).select(F.coalesce(v["rule"], F.lit("passed")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def q_effective_chars(spark, d):
    return _docs(spark, d).select("doc_id", X.effective_chars("text").cast("bigint").alias("chars"), X.line_count("text").cast("bigint").alias("lines"), F.round(X.code_ratio("text"), 6).alias("code_ratio"))


def q_path_predicates(spark, d):
    gate = Gate(exclude_dirs=("fr", "build"), path_whitelist=("/kb/src3/fr",))
    return _docs(spark, d).select("doc_id", excluded(_path(), "/kb", gate).alias("excluded"), X.whitelisted(_path(), ["/kb/src1/", "/kb/src2/en/doc2.md"]).alias("listed"), blacklist_hit(_path(), ["*7.md", "/SRC1/", ".html"]).alias("hit"))


def q_title_exclude_filter(spark, d):
    named = _docs(spark, d).withColumn("title", F.substring("text", 1, 80))
    return title_filter(named, "title", ["the", "an"], ["zzz", "src7"], ["title", "source"]).select("doc_id", "title")


def q_redact_secrets(spark, d):
    return _docs(spark, d).where(X.looks_secret("text")).select("doc_id", F.sha2(X.redact("text"), 256).alias("redacted"), (X.redact("text") != F.col("text")).alias("changed"))


def q_time_bounds(spark, d):
    events = table(spark, d, "events")
    return time_filter(time_filter(events, "ts", "2024-01-10", "not a time"), "ts", None, "2024-01-12 12:00:00").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def q_private_urls(spark, d):
    return table(spark, d, "pages").select("page_id", private_host(F.col("url")).alias("blocked"), F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))).alias("host"))


def q_log_filter(spark, d):
    events = table(spark, d, "events")
    hit = keyword_filter(events, ["event_type", "props"], "ERROR").where(F.col("value") > 0)
    return hit.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def q_import_match(spark, d):
    docs = _docs(spark, d).select("doc_id", F.lower(F.substring("text", 1, 40)).alias("head"))
    known = table(spark, d, "pages").select(F.lower(F.regexp_extract("html", "<p>([^<]{1,40})", 1)).alias("head")).groupBy("head").agg(F.count("*").alias("keeper"))
    imported = docs.join(known, "head", "left").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    kind = match_class(F.col("head"), F.col("keeper"), F.col("quality"))
    return imported.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


QUERIES = {
    "p11_legacy_search": q_legacy_search,
    "p05_gate_decision": q_gate_decision,
    "p05_gate_rule_counts": q_gate_rule_counts,
    "p06_effective_chars": q_effective_chars,
    "p01_path_predicates": q_path_predicates,
    "p14_title_exclude_filter": q_title_exclude_filter,
    "p24_redact_secrets": q_redact_secrets,
    "p12_time_bounds": q_time_bounds,
    "p23_private_urls": q_private_urls,
    "p18_log_filter": q_log_filter,
    "p21_import_match": q_import_match,
}
_RE = r"regexp_replace({t}, '{p}', '[REDACTED]', 'gi')"
_REDACT = _RE.format(t=_RE.format(t=_RE.format(t=_RE.format(t="text", p=r"\b(?:sk|api_key|apikey|token|secret|password|pwd|passwd)\b\s*[:=]\s*[^\s\"'',;\])]+"), p=r"https?://[^@\n]+@[^\s]+"), p=r"Bearer\s+[^\s\"'',;]+"), p=r"\b(?:access_key|accessKey|client_secret|clientSecret)\b\s*[:=]\s*[^\s\"'',;]+")
SQL = {
    "p11_legacy_search": "SELECT doc_id, n_chars, source FROM documents WHERE contains(lower(text), 'the') AND lang = 'en' AND source = 'src3' ORDER BY n_chars DESC, doc_id LIMIT 20",
    "p05_gate_decision": _GATE_SQL,
    "p05_gate_rule_counts": rf"SELECT CASE WHEN strlen(text) < 512 THEN 'minSize' WHEN {_CHARS_SQL} < 300 THEN 'minChars' ELSE 'passed' END AS rule, count(*) AS n FROM documents GROUP BY 1",
    "p06_effective_chars": rf"SELECT doc_id, {_CHARS_SQL} AS chars, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, 0.0::DOUBLE AS code_ratio FROM documents",
    "p01_path_predicates": f"""SELECT doc_id, NOT starts_with(path, '/kb/src3/fr/') AND lang = 'fr' AS excluded,
  starts_with(path, '/kb/src1/') OR path = '/kb/src2/en/doc2.md' AS listed,
  CASE WHEN path LIKE '%7.md' THEN '*7.md' WHEN path LIKE '%src1%' THEN '/SRC1/' WHEN path LIKE '%.html' THEN '.html' END AS hit
  FROM (SELECT *, {PATH_SQL} AS path FROM documents) t""",
    "p14_title_exclude_filter": "SELECT doc_id, substring(text, 1, 80) AS title FROM documents WHERE contains(lower(substring(text, 1, 80)), 'the') AND contains(lower(substring(text, 1, 80)), 'an') AND NOT contains(lower(substring(text, 1, 80) || ' ' || source), 'zzz') AND NOT contains(lower(substring(text, 1, 80) || ' ' || source), 'src7')",
    "p24_redact_secrets": rf"SELECT doc_id, sha256({_REDACT}) AS redacted, {_REDACT} <> text AS changed FROM documents WHERE regexp_matches(text, '(?i)sk|api_key|apikey|token|secret|password|pwd|passwd|Bearer|client_?secret|access_?key')",
    "p12_time_bounds": "SELECT event_type, count(*) AS n, min(event_id) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12 12:00:00' GROUP BY 1",
    "p23_private_urls": r"SELECT page_id, false AS blocked, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages",
    "p18_log_filter": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE (contains(lower(event_type), 'error') OR contains(lower(props), 'error')) AND value > 0 GROUP BY 1",
    "p21_import_match": """WITH d AS (SELECT doc_id, lower(substring(text, 1, 40)) AS head FROM documents), k AS (SELECT lower(regexp_extract(html, '<p>([^<]{1,40})', 1)) AS head, count(*) AS keeper FROM pages GROUP BY 1)
SELECT CASE WHEN quality IS NOT NULL THEN 'already' WHEN keeper IS NOT NULL THEN 'matched' ELSE 'standalone' END AS kind, count(*) AS n, min(d.doc_id) AS first
FROM d LEFT JOIN k USING (head) LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""",
}
