"""Claims of profiles as nested state, and the answers of models that they and the entries are read from.

A profile is one row: key, role_pattern, portrait and claims, an array of (claim, status, evidence, confidence). In one
profile a claim's text stands once. All steps but ``edit`` and ``revert`` are column functions, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowspan.functions import answers as A
from knowspan.session import table

GLOBAL_BUDGET, DOMAIN_BUDGET = 20, 10


def edit(profiles: DataFrame, key: str, edits: DataFrame) -> DataFrame:
    """Profiles after the edits (key, at, id, action, claim) of their users, in any order of rows; ``id`` is unique.

    Each claim follows the last edit that names it: ``veto`` makes it vetoed, if it is there; ``add`` makes it the user's
    own, at the end with no evidence and confidence 1 if it is new. Edits are reduced to the last of each claim before
    they meet a profile; a key that has edits but no profile gets one if a claim is added."""
    last = edits.where(A.filled(F.col("claim"))).groupBy(key, "claim").agg(F.max(F.struct("at", "id", "action")).alias("_e"))
    state = F.struct(F.col("_e.at").alias("at"), F.col("_e.id").alias("id"), "claim", F.col("_e.action").alias("action"))
    by_key = last.groupBy(key).agg(F.array_sort(F.collect_list(state)).alias("_edits"))
    met = profiles.join(by_key, key, "full")
    held = F.coalesce("claims", F.array().cast(f"array<{A.CLAIM}>"))
    asked = F.coalesce("_edits", F.array().cast(by_key.schema["_edits"].dataType))
    actions = F.map_from_entries(F.transform(asked, lambda e: F.struct(e["claim"], e["action"])))

    def decided(c: Column) -> Column:
        action = F.try_element_at("_actions", c["claim"])
        status = F.when(action == "veto", "vetoed").when(action == "add", "user_added").otherwise(c["status"])
        return F.struct(c["claim"].alias("claim"), status.alias("status"), c["evidence"].alias("evidence"), c["confidence"].alias("confidence"))

    texts = F.transform("_held", lambda c: c["claim"])
    new = F.filter(asked, lambda e: (e["action"] == "add") & ~F.array_contains("_texts", e["claim"]))
    own = F.transform(new, lambda e: F.struct(e["claim"].alias("claim"), F.lit("user_added").alias("status"), F.array().cast("array<string>").alias("evidence"), F.lit(1.0).alias("confidence")))
    met = met.withColumn("_held", held).withColumn("_actions", actions).withColumn("_texts", texts)
    met = met.withColumn("_next", F.concat(F.transform("_held", decided), own)).where(F.col("claims").isNotNull() | (F.size("_next") > 0))
    return met.withColumn("claims", F.col("_next")).withColumn("role_pattern", F.coalesce("role_pattern", F.lit(""))).select(profiles.columns)


def enforced(claims: Column, budget: int) -> tuple[Column, Column]:
    """The claims that stay within a budget of active ones, and the texts of those that go: the fewest evidence first, then the earliest."""
    ranked = F.filter(F.transform(claims, lambda c, i: F.struct(F.size(c["evidence"]).alias("n"), i.alias("i"), (c["status"] == "active").alias("a"))), lambda r: r["a"])
    gone = F.transform(F.slice(F.array_sort(ranked), F.lit(1), F.greatest(F.size(ranked) - budget, F.lit(0))), lambda r: r["i"])
    return F.filter(claims, lambda c, i: ~F.array_contains(gone, i)), F.transform(F.filter(claims, lambda c, i: F.array_contains(gone, i)), lambda c: c["claim"])


def committed(fresh: Column, held: Column) -> Column:
    """Claims of the next version: the fresh ones, then what the user added or vetoed in the one before (null: none)."""
    return F.concat(fresh, F.coalesce(F.filter(held, lambda c: c["status"] != "active"), F.array().cast(f"array<{A.CLAIM}>")))


def shown(claims: Column) -> Column:
    """What leaves the store: no vetoed claim ever does."""
    return F.filter(claims, lambda c: c["status"] != "vetoed")


def revert(versions: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """Versions (key, id, active) after requests (at, id) to go back: the last request of a key names its active version.

    Requests for unknown versions change nothing."""
    wanted = asked.join(versions.select(key, "id"), "id").groupBy(key).agg(F.max_by("id", F.struct("at", "id")).alias("_wanted"))
    met = versions.join(wanted, key, "left")
    return met.withColumn("active", F.when(F.col("_wanted").isNotNull(), F.col("id") == F.col("_wanted")).otherwise(F.col("active"))).select(versions.columns)


# --- queries over the driver's tables -------------------------------------------------------------


def _profiles(spark, d) -> DataFrame:
    """A profile for each customer with orders: a claim for each order, its lines as evidence."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.concat(F.lit("lines:"), F.col("l_linenumber").cast("string")))).alias("evidence"))
    orders = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "vetoed").otherwise("user_added")
    claim = F.struct(F.concat(F.lit("o"), "o_orderkey").alias("claim"), status.alias("status"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), (F.col("o_orderkey") % 100 / 100).alias("confidence"))
    held = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", claim.alias("c")))).alias("c"))
    return held.select("o_custkey", F.lit("").alias("role_pattern"), F.transform("c", lambda x: x["c"]).cast(f"array<{A.CLAIM}>").alias("claims"))


def q_claims(spark, d):
    """Edits by events, then the budget: claims by place."""
    e = table(spark, d, "events").where("event_type in ('click', 'error')")
    edits = e.select(F.col("user_id").alias("o_custkey"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "add").otherwise("veto").alias("action"), F.concat(F.lit("o"), F.col("user_id") * 7 % 50 + F.col("event_id") % 3).alias("claim"))
    stay, gone = enforced(F.col("claims"), 5)
    after = edit(_profiles(spark, d), "o_custkey", edits).select("o_custkey", shown(stay).alias("c"), F.size(gone).alias("evicted"))
    return after.select("o_custkey", "evicted", F.size("c").alias("shown"), F.posexplode_outer("c")).select("o_custkey", "evicted", "shown", "pos", F.col("col.claim").alias("claim"), F.col("col.status").alias("status"))


def _told(spark, d) -> DataFrame:
    """Documents as a model would tell of them: JSON, whole or damaged in one of five ways."""
    k = F.pmod("doc_id", F.lit(5))
    head = F.substring("text", 1, 60)
    whole = F.to_json(F.struct(head.alias("title"), F.col("text").alias("summary"), F.array("lang", "source").alias("points"), F.array("source", "lang").alias("tags"), F.concat("source", F.lit("!")).alias("importance")))
    told = (
        F.when(k == 0, whole)
        .when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```")))
        .when(k == 2, F.regexp_replace(whole, r'","points":.*$', ""))
        .when(k == 3, F.concat(F.lit('{"title":"'), "lang", F.lit('","summary":" '), "source", F.lit('","points":["a","b')))
        .otherwise("no answer")
    )
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("told", told)


def q_entries(spark, d):
    read = _told(spark, d).select("doc_id", A.entry(F.col("told")).alias("e"))
    return read.select("doc_id", F.sha2("e.title", 256).alias("title"), F.sha2("e.summary", 256).alias("summary"), F.concat_ws(",", "e.points").alias("points"), F.concat_ws(",", "e.tags").alias("tags"), "e.importance")


def q_located(spark, d):
    """Bare quotes round a word in a reason, with words before the object."""
    docs = table(spark, d, "documents")
    told = F.concat(F.lit("So: {\"groups\":[{\"canonical\":\""), "lang", F.lit("\",\"reason\":\"as \""), "source", F.lit("\" is\"},{\"canonical\":\""), "source", F.lit("\",\"reason\":\"of \""), "lang", F.lit("\"\"}]}"), F.when(F.pmod("doc_id", F.lit(4)) == 0, " cut [").otherwise(""))
    groups = docs.select("doc_id", A.located(told).alias("v")).select("doc_id", F.posexplode_outer(A.items(F.col("v"), "$.groups")))
    return groups.select("doc_id", "pos", A.string(F.col("col"), "$.canonical").alias("canonical"), A.string(F.col("col"), "$.reason").alias("reason"))


def q_profiles_read(spark, d):
    """Stored profiles, some with one part that isn't valid."""
    k = F.pmod("o_custkey", F.lit(6))
    held = _profiles(spark, d)
    version = F.when(k == 1, "2").otherwise("1")
    spoilt = F.transform("claims", lambda c, i: F.when((k == 2) & (i == 0), c.withField("confidence", F.lit(1.5))).when((k == 3) & (i == 0), c.withField("evidence", F.array(F.lit("Lines 1")))).otherwise(c))
    content = F.to_json(F.struct(version.alias("schema_version"), F.lit("r").alias("role_pattern"), spoilt.alias("claims")))
    cut = F.when(k == 4, F.expr("substring(content, 1, length(content) - 1)")).otherwise(F.col("content"))
    read = held.select("o_custkey", content.alias("content")).select("o_custkey", A.profile(cut).alias("p"))
    return read.select("o_custkey", F.size("p.claims").alias("claims"), F.aggregate("p.claims", F.lit(0), lambda n, c: n + F.size(c["evidence"])).alias("evidence"))


def q_quiz(spark, d):
    """A quiz of each conversation's turns; turns of other roles than user and assistant aren't whole questions."""
    t = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "short").when(F.col("role") == "assistant", "judge").otherwise("essay")
    question = F.struct(kind.alias("type"), F.concat(F.lit(" q"), "turn").alias("question"), F.concat("role", F.col("turn").cast("string")).alias("answer"), F.array(F.col("turn"), F.lit(0)).alias("sources"))
    made = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", question.alias("q")))).alias("q"))
    told = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.transform("q", lambda x: x["q"]).alias("questions"))), F.lit("\n```"))
    read = made.select("conv_id", F.posexplode(A.quiz(told)))
    return read.select("conv_id", "pos", "col.type", "col.question", "col.answer", F.size("col.sources").alias("sources"))


QUERIES = {"m19_claims": q_claims, "t26_entries": q_entries, "t27_located": q_located, "t29_profiles": q_profiles_read, "t32_quiz": q_quiz}
_HELD = """h AS (SELECT o_custkey, o_orderkey, 'o' || o_orderkey AS claim, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'vetoed' ELSE 'user_added' END AS status,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)"""
SQL = {
    "m19_claims": f"""WITH {_HELD},
e AS (SELECT user_id AS o_custkey, 'o' || (user_id * 7 % 50 + event_id % 3) AS claim, arg_max(event_type, (ts, event_id)) AS action, max((ts, event_id)) AS last_at FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2),
a AS (SELECT h.o_custkey, h.claim, CASE action WHEN 'click' THEN 'user_added' WHEN 'error' THEN 'vetoed' ELSE status END AS status, n, 0 AS late, o_orderkey AS ord, NULL AS last_at FROM h LEFT JOIN e ON e.o_custkey = h.o_custkey AND e.claim = h.claim
  UNION ALL SELECT o_custkey, claim, 'user_added', 0, 1, 0, last_at FROM e WHERE action = 'click' AND (o_custkey, claim) NOT IN (SELECT o_custkey, claim FROM h)),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, status ORDER BY n, late, ord, last_at) AS k, count(*) OVER (PARTITION BY o_custkey, status) AS m FROM a),
g AS (SELECT *, status = 'active' AND k <= m - 5 AS gone FROM r),
s AS (SELECT o_custkey, (count(*) FILTER (WHERE gone))::INTEGER AS evicted, (count(*) FILTER (WHERE NOT gone AND status <> 'vetoed'))::INTEGER AS shown FROM g GROUP BY 1)
SELECT s.o_custkey, evicted, shown, (CASE WHEN claim IS NOT NULL THEN row_number() OVER (PARTITION BY s.o_custkey ORDER BY late, ord, last_at) - 1 END)::INTEGER AS pos, claim, status
FROM s LEFT JOIN (SELECT * FROM g WHERE NOT gone AND status <> 'vetoed') v ON v.o_custkey = s.o_custkey""",
    "t26_entries": r"""WITH t AS (SELECT doc_id, doc_id % 5 AS k, lang, source, coalesce(text, '') AS text FROM documents),
c AS (SELECT *, regexp_replace(substring(text, 1, 60), '^\s+|\s+$', '', 'g') AS head, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM t)
SELECT doc_id, sha256(CASE WHEN k < 3 THEN head WHEN k = 3 THEN lang ELSE '' END) AS title, sha256(CASE WHEN k < 3 THEN body WHEN k = 3 THEN source ELSE '' END) AS summary,
CASE WHEN k < 2 THEN lang || ',' || source ELSE '' END AS points, CASE WHEN k < 2 THEN source || ',' || lang ELSE '' END AS tags, 'useful' AS importance FROM c""",
    "t27_located": """SELECT doc_id, 0 AS pos, lang AS canonical, 'as "' || source || '" is' AS reason FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 1, source, 'of "' || lang || '"' FROM documents WHERE doc_id % 4 <> 0
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE doc_id % 4 = 0""",
    "t29_profiles": f"WITH {_HELD} SELECT o_custkey, CASE WHEN o_custkey % 6 IN (0, 5) THEN count(*)::INTEGER ELSE NULL END AS claims, CASE WHEN o_custkey % 6 IN (0, 5) THEN sum(n)::INTEGER END AS evidence FROM h GROUP BY 1",
    "t32_quiz": """WITH q AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, pos::INTEGER AS pos, CASE role WHEN 'user' THEN 'short' ELSE 'judge' END AS type, 'q' || turn AS question, role || turn AS answer, CASE WHEN turn > 0 THEN 1 ELSE 0 END AS sources FROM q WHERE pos < 8""",
}
