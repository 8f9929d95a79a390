"""Lists and details of files and entries, what a worker takes next, and repairs of the library's state.

Every change returns the next state of a table; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.config import Gate
from knowspan.functions import entries as E
from knowspan.functions import expressions as X
from knowspan.operators import gates, relations
from knowspan.session import table


def files(rows: DataFrame, word: str | None = None, fields: tuple[str, ...] = ("title", "path", "name"), members: DataFrame | None = None, tagged: DataFrame | None = None, suffix: str | None = None, **equal) -> DataFrame:
    """The rows that meet every condition given; ``members`` and ``tagged`` hold ids (doc_id)."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == F.lit(value))
    if word:
        hit = F.lit(False)
        for field in fields:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(field), F.lit(""))), F.lit(word.lower()))
        rows = rows.where(hit)
    if suffix:
        rows = rows.where(F.col("suffix") == "." + suffix.lstrip("."))
    for ids in (members, tagged):
        if ids is not None:
            rows = rows.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """One page (from 1) and a row with the total."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), rows.agg(F.count("*").alias("total"))


def with_tags(rows: DataFrame, bridge: DataFrame, tag: str = "tag") -> DataFrame:
    """Adds tags, sorted. Only bridges of the rows are read."""
    held = bridge.join(rows.select("doc_id"), "doc_id", "left_semi").select("doc_id", tag).distinct()
    tags = held.groupBy("doc_id").agg(F.array_sort(F.collect_list(tag)).alias("tags"))
    return rows.join(tags, "doc_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def context(entries: DataFrame, group: str, most: int = 20, budget: int = 800, cut: int = 100) -> DataFrame:
    """For each group: how many entries it has, and as many lines of its best as the budget of tokens lets, with their cost.

    ``entries`` has ``group``, doc_id, title, summary, quality, rule. A line that doesn't fit ends the text; if not even the
    first one fits, that one is cut. The best ``most`` of a group are chosen before anything is summed."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    rows = entries.where("title is not null and title <> ''").withColumn("title", flat("title")).withColumn("summary", flat("summary"))
    prior = F.coalesce(F.col("quality") * 3, F.lit(0)) + F.coalesce("rule", F.lit(0))
    order = [F.col("quality").isNotNull().desc(), prior.desc(), F.col("doc_id")]
    best = rows.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_at") <= most)
    line = F.concat(F.lit("- "), "title", F.when(F.col("summary") != "", F.concat(F.lit(": "), F.substring("summary", 1, cut))).otherwise(""))
    best = best.withColumn("_line", line).withColumn("_cost", X.tokens_by_script("_line").cast("bigint"))
    counts = rows.groupBy(group).agg(F.count("*").alias("entries"))
    head = F.concat(F.col(group).cast("string"), F.lit(": "), F.col("entries").cast("string"))
    upto = Window.partitionBy(group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = best.join(counts, group).withColumn("_head", head).withColumn("_used", X.tokens_by_script("_head") + F.sum("_cost").over(upto))
    room = F.greatest(F.lit(budget) - X.tokens_by_script("_head"), F.lit(0)).cast("int")
    fits = F.col("_used") <= budget
    shown = summed.groupBy(group, "entries", "_head").agg(
        F.array_sort(F.collect_list(F.when(fits, F.struct("_at", "_line")))).alias("_lines"),
        F.sum(F.when(fits, F.col("_cost")).otherwise(0)).alias("_sum"),
        F.count_if(~fits).alias("_over"),
        F.min_by("_line", "_at").alias("_first"),
    )
    cut_line = F.when((F.size("_lines") == 0) & (room > 0), F.array(F.substr(F.col("_first"), F.lit(1), room))).otherwise(F.array().cast("array<string>"))
    shown = shown.withColumn("_cut", cut_line).withColumn("_text", F.concat(F.transform("_lines", lambda x: x["_line"]), "_cut"))
    cost = X.tokens_by_script("_head") + F.col("_sum") + X.tokens_by_script(F.coalesce(F.get("_cut", F.lit(0)), F.lit("")))
    return shown.select(
        group, "entries", F.size("_text").alias("lines"), cost.cast("bigint").alias("tokens"), (F.col("_over") > 0).alias("truncated"),
        F.concat_ws("\n", F.col("_head"), F.col("_text")).alias("text"),
    )


def next_work(state: DataFrame, reads: DataFrame, cooling: DataFrame, duplicates: DataFrame, most: int = 16) -> DataFrame:
    """The pending active rows to work on next: of the first ``most`` by last read and oldest change, those that aren't cooling
    or duplicates of others. (A bound of one round: the rows left out come in the next.)"""
    last = reads.groupBy("doc_id").agg(F.max("read_at").alias("last_read"))
    waiting = state.where("llm_state = 'pending' and status = 'active'").join(last, "doc_id", "left")
    order = [F.col("last_read").isNotNull().desc(), F.col("last_read").desc(), F.col("updated_at"), F.col("doc_id")]
    batch = waiting.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    for ids in (cooling, duplicates):
        batch = batch.join(ids.select("doc_id"), "doc_id", "left_anti")
    return batch


def mark_duplicates(state: DataFrame, duplicates: DataFrame, as_of: Column) -> DataFrame:
    """Duplicates become cold and are skipped."""
    hit = state.join(duplicates.select("doc_id", F.lit(True).alias("_d")).distinct(), "doc_id", "left")
    found = F.coalesce(F.col("_d"), F.lit(False))
    changed = {"lifecycle": F.lit("cold"), "llm_state": F.lit("skipped"), "updated_at": as_of}
    for column, value in changed.items():
        hit = hit.withColumn(column, F.when(found, value).otherwise(F.col(column)))
    return hit.drop("_d")


def requeue(state: DataFrame, entries: DataFrame, cap: int = 500) -> DataFrame:
    """Adds next_state: failed and skipped active rows wait again, and of the rows that are done without an entry the ``cap``
    last changed (bounded, as each costs a call)."""
    active = state.where("status = 'active'")
    hollow = active.where("llm_state = 'done'").join(entries.select("doc_id"), "doc_id", "left_anti")
    hollow = hollow.orderBy(F.desc("updated_at"), "doc_id").limit(cap).select("doc_id", F.lit(True).alias("_again"))
    again = F.coalesce("_again", F.col("llm_state").isin("failed", "skipped") & (F.col("status") == "active"))
    return state.join(hollow, "doc_id", "left").withColumn("next_state", F.when(again, "pending").otherwise(F.col("llm_state"))).drop("_again")


def purge(tables: dict[str, DataFrame], gone: DataFrame, also: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables without the rows of the ids gone (doc_id), and without rows that point at them by the columns in ``also``."""
    out = {}
    for name, rows in tables.items():
        rows = rows.join(gone.select("doc_id"), "doc_id", "left_anti")
        if also and name in also:
            rows = rows.join(gone.select(F.col("doc_id").alias(also[name])), also[name], "left_anti")
        out[name] = rows
    return out


def orphans(rows: DataFrame, owners: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(owners.select(key), key, "left_anti")


def backfill(entries: DataFrame, state: DataFrame, most: int = 200) -> DataFrame:
    """Done active entries without a score, those with the best rule score first, ``most`` in a round."""
    open_ = entries.where("quality is null").join(state.where("status = 'active' and llm_state = 'done'"), "doc_id")
    return open_.orderBy(F.col("rule").desc_nulls_last(), "doc_id").limit(most)


def progress(total: int, done: int, failed: int) -> dict[str, int | bool]:
    return {"pending": max(0, total - done - failed), "finished": total > 0 and done + failed >= total}


def replace_by_path(rows: DataFrame, incoming: DataFrame, key: str = "path") -> DataFrame:
    """The rows with those of the same path replaced; of incoming rows with one path, the last by ``seen_at`` counts."""
    last = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seen_at")))).where("_n = 1").drop("_n")
    return rows.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def stale_chunks(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk, hash) to write and to delete: only those of documents in ``fresh``, and only what changed."""
    same = held.select("doc_id", "chunk", "hash", F.lit(True).alias("_same"))
    write = fresh.join(same, ["doc_id", "chunk", "hash"], "left_anti").select("doc_id", "chunk", F.lit("write").alias("action"))
    own = held.join(fresh.select("doc_id").distinct(), "doc_id", "left_semi")
    delete = own.join(fresh.select("doc_id", "chunk"), ["doc_id", "chunk"], "left_anti").select("doc_id", "chunk", F.lit("delete").alias("action"))
    return write.unionByName(delete)


def agents(rows: DataFrame, path: str, roots: DataFrame, stated: str = "agent") -> DataFrame:
    """Adds inferred: the agent stated, else that of the root above (root, root_agent), else the first folder below the root."""
    placed = relations.by_prefix(rows.select(path).distinct(), path, roots.select("root"), "root")
    placed = placed.join(roots, "root", "left")
    below = F.expr(f"substring({path}, length(rtrim('/', root)) + 2)")
    folder = F.when(F.contains(below, F.lit("/")), F.nullif(F.substring_index(below, "/", 1), F.lit("")))
    placed = placed.select(path, F.coalesce("root_agent", folder).alias("_found"))
    return rows.join(placed, path, "left").withColumn("inferred", F.coalesce(F.col(stated), F.col("_found"))).drop("_found")


def chat_sessions(messages: DataFrame, sessions: DataFrame, archived: bool = False, word: str | None = None, most: int = 20) -> DataFrame:
    """The last sessions: first user message, count, last time. A word may be in the session's fields or in any message."""
    like = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit((word or "").strip().lower()))
    said = messages.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("_f"), F.count("*").alias("messages"),
        F.max("turn").alias("last_turn"), F.max(like(F.col("text"))).alias("_said"),
    )
    rows = said.join(sessions, "conv_id", "left").where(F.coalesce("archived", F.lit(False)) == archived)
    if (word or "").strip():
        rows = rows.where(F.col("_said") | like(F.col("title")) | like(F.col("tags")))
    rows = rows.withColumn("preview", F.col("_f.text")).drop("_f", "_said")
    return rows.orderBy(F.desc("last_turn"), F.desc("conv_id")).limit(most)


def budget_state(calls: DataFrame, budget: Column) -> DataFrame:
    """Cost of the successful calls by day, and whether the day is over its budget; a budget that isn't positive is none."""
    spent = calls.where("status = 'success'").groupBy("day").agg(F.round(F.sum("cost"), 4).alias("cost"))
    spent = spent.withColumn("budget", F.when(budget > 0, budget))
    before = F.lag("tripped").over(Window.orderBy("day"))  # a row a day
    spent = spent.withColumn("tripped", F.coalesce(F.col("cost") > F.col("budget"), F.lit(False)))
    return spent.withColumn("resumed", F.coalesce(before, F.lit(False)) & ~F.col("tripped"))


def rescan_due(jobs: DataFrame, as_of: Column, threshold_seconds: int) -> DataFrame:
    """One row: whether the last job ended longer ago than the threshold; due without a job or a readable time."""
    last = jobs.agg(F.max_by(F.struct("started_at", "seconds"), "job_id").alias("_j"))
    end = F.unix_timestamp(F.expr("try_cast(_j.started_at as timestamp)")) + F.coalesce("_j.seconds", F.lit(0))
    down = F.unix_timestamp(as_of) - end
    return last.select(down.cast("bigint").alias("down_seconds"), F.coalesce(down > threshold_seconds, F.lit(True)).alias("due"))


def gate_agreement(samples: DataFrame) -> DataFrame:
    """Of samples (expected, actual): how many, how many agree, and the rate (0 without any)."""
    agreed = F.count_if(F.col("expected") == F.col("actual"))
    return samples.agg(F.count("*").alias("total"), agreed.alias("agreed"), F.coalesce(F.try_divide(agreed, F.count("*")), F.lit(0.0)).alias("rate"))


def keyword_coverage(samples: DataFrame) -> DataFrame:
    """Of samples (title, summary, words): the share of words kept in either after they were cleaned and cut."""
    kept = F.size(F.filter("words", lambda w: F.contains(F.col("title"), w) | F.contains(F.col("summary"), w)))
    return samples.agg(F.sum(F.size("words")).alias("words"), F.sum(kept).alias("kept")).withColumn("rate", F.coalesce(F.try_divide("kept", "words"), F.lit(0.0)))


def first_given(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """The first source that has rows, each key where it comes first."""
    for rows in sources:
        if not rows.isEmpty():
            return rows.groupBy(key).agg(F.min(order).alias(order))
    return sources[-1].groupBy(key).agg(F.min(order).alias(order))


def colours(domains: DataFrame, colour_count: int = 12) -> DataFrame:
    """Adds colour, by the place of a domain among all in the order of the tree (root, then id). Domains are few."""
    order = Window.orderBy("root", "id")
    return domains.withColumn("colour", F.pmod(F.row_number().over(order) - 1, F.lit(colour_count)))


def rebuild_refs(messages: DataFrame, known: DataFrame) -> DataFrame:
    """(conv_id, turn, ref) of the marks ``[n]`` in messages that name a known id, each once."""
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(\d{1,9})\]"), F.lit(1)))
    found = messages.select("conv_id", "turn", F.explode(marks.cast("array<bigint>")).alias("ref"))
    return found.join(known.select(F.col("id").alias("ref")), "ref", "left_semi")


def repair_members(files_: DataFrame, domains: DataFrame) -> DataFrame:
    """Adds next_domain: the file's domain if it is there, its live ancestor if merged, else none."""
    end = relations.chase(domains, "domain", "merged_into")
    alive = domains.where("merged_into is null").select(F.col("domain").alias("target"), F.lit(True).alias("_alive"))
    end = end.join(alive, "target", "left").where("_alive").select("domain", F.col("target").alias("next_domain"))
    return files_.join(end, "domain", "left")


# --- queries over the driver's tables -------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    state = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "done").otherwise("failed")
    return docs.select(
        "doc_id", "lang", "source", "n_chars", "text", "quality", F.substring("text", 1, 40).alias("title"), name.alias("name"),
        F.concat(F.lit("/kb/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"),
        F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".html").alias("suffix"),
        F.when(F.col("doc_id") % 7 == 0, "deleted").otherwise("active").alias("status"), state.alias("llm_state"),
        F.lit("hot").alias("lifecycle"), (F.col("n_chars") % 97).alias("updated_at"), F.pmod("doc_id", F.lit(11)).alias("rule"),
    )


def _bridge(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("t"), F.col("l_linenumber")).alias("tag"))


def _reads(spark, d) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'view'").select(F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"), F.col("ts").alias("read_at"))


def q_files(spark, d):
    tagged = _bridge(spark, d).where("tag = 't2'")
    members = table(spark, d, "labels").where("toxic = 0")
    found = files(_files(spark, d), "d1", members=members, tagged=tagged, suffix="md", status="active")
    return found.select("doc_id", "path", "llm_state")


def q_files_with_tags(spark, d):
    rows, total = page(files(_files(spark, d), status="active"), [F.desc("n_chars"), F.asc("doc_id")], 2, 30)
    rows = with_tags(rows.select("doc_id", "name", "n_chars"), _bridge(spark, d))
    return rows.join(F.broadcast(total)).withColumn("tags", F.array_join("tags", ","))  # one row


def q_context(spark, d):
    entries = _files(spark, d).select(F.col("source").alias("domain"), "doc_id", "title", F.substring("text", 41, 80).alias("summary"), "quality", "rule")
    return context(entries, "domain", 20, 300, 60).select("domain", "entries", "lines", "truncated")


def q_next_work(spark, d):
    state = _files(spark, d)
    cooling = state.where("n_chars % 5 = 0")
    return next_work(state, _reads(spark, d), cooling, state.where("rule = 3")).select("doc_id", "place", "updated_at")


def q_mark(spark, d):
    docs = _files(spark, d)
    same = docs.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("first"))
    copies = docs.withColumn("h", F.md5(F.col("text").cast("binary"))).join(same, "h").where("doc_id <> first")
    done = mark_duplicates(docs, copies, F.lit(1000).cast("bigint"))
    return done.groupBy("lifecycle", "llm_state", "status").agg(F.count("*").alias("n"), F.max("updated_at").alias("latest"))


def q_requeue(spark, d):
    entries = table(spark, d, "labels").where("toxic = 0")
    return requeue(_files(spark, d), entries).groupBy("llm_state", "next_state", "status").agg(F.count("*").alias("n"))


def q_purge(spark, d):
    state = _files(spark, d)
    left = purge({"bridge": _bridge(spark, d), "labels": table(spark, d, "labels")}, state.where("status = 'deleted'"))
    lost = orphans(_bridge(spark, d), state)
    rows = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, df in (*left.items(), ("orphans", lost))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def q_backfill(spark, d):
    state = _files(spark, d)
    entries = state.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("quality")).alias("quality"), "rule")
    return backfill(entries, state.select("doc_id", "status", "llm_state")).select("doc_id", "rule")


def q_mount(spark, d):
    held = table(spark, d, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("seen_at"), F.lit("held").alias("origin"))
    fresh = table(spark, d, "documents").select(F.concat(F.lit("/kb/"), "source", F.lit("/"), F.col("doc_id") % 50).alias("path"), F.col("doc_id").alias("seen_at"), F.lit("new").alias("origin"))
    return replace_by_path(replace_by_path(held.limit(0), held), fresh).groupBy("origin").agg(F.count("*").alias("n"), F.sum("seen_at").alias("sum"))


def q_stale_chunks(spark, d):
    cut = lambda rows, n: rows.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / n).cast("int")), lambda k: F.md5(F.substr(F.col("text"), k * n + 1, F.lit(n)).cast("binary")))).alias("chunk", "hash"))
    docs = table(spark, d, "documents").where("length(text) > 0")
    held = cut(docs, 500)
    fresh = cut(docs.withColumn("text", F.concat(F.expr("substring(text, 1, length(text) div 2 + 1)"), F.col("doc_id").cast("string"))), 500)
    return stale_chunks(held, fresh).groupBy("action").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.sum("chunk").alias("chunks"))


def q_agents(spark, d):
    rows = _files(spark, d).select("doc_id", "path", F.when(F.col("doc_id") % 10 == 0, "stated").alias("agent"))
    roots = spark.createDataFrame([("/kb", None), ("/kb/src1", "one"), ("/kb/src2/", None)], "root string, root_agent string")
    return agents(rows, "path", roots).groupBy("inferred").agg(F.count("*").alias("n"))


def q_chat(spark, d):
    sessions = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 4 == 0).alias("archived"), F.concat(F.lit("talk "), "conv_id").alias("title"), F.lit("x").alias("tags"))
    found = chat_sessions(table(spark, d, "conversations"), sessions, word="the")
    return found.select("conv_id", "messages", "last_turn", F.md5(F.col("preview").cast("binary")).alias("preview"))


def q_budget(spark, d):
    calls = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("event_type") == "purchase", "success").otherwise("failed").alias("status"), F.coalesce("value", F.lit(0.0)).alias("cost"))
    return budget_state(calls, F.lit(500.0)).select("day", "cost", "tripped", "resumed")


def q_rescan(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.lit(90).alias("seconds"))
    return rescan_due(jobs, F.lit("1999-01-01 00:00:00").cast("timestamp"), 7200)


def q_agreement(spark, d):
    rows = _files(spark, d).where("quality is not null")
    judged = gates.decide(F.col("path"), F.octet_length("text"), F.col("text"), Gate())
    actual = F.when(judged["passed"], "pass").otherwise("skip")
    return gate_agreement(rows.select(F.when(F.col("quality") == 1, "pass").otherwise("skip").alias("expected"), actual.alias("actual")))


def q_coverage(spark, d):
    words = F.slice(F.filter(F.split("text", " "), lambda w: w.rlike("^[a-z]{4,}$")), 1, 12)
    return keyword_coverage(_files(spark, d).select("title", X.clean_summary("text").alias("summary"), words.alias("words")))


def q_query_set(spark, d):
    asked = table(spark, d, "benchmark")
    logs = asked.select(F.lower(F.split("text", " ")[0]).alias("query"), F.col("item_id").alias("place"))
    return first_given([logs.where("false"), logs], "query", "place")


def q_colours(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("root"))
    return colours(nations).select("id", "colour")


def q_refs(spark, d):
    said = table(spark, d, "conversations").withColumn("text", F.concat("text", F.lit(" ["), F.col("turn"), F.lit("] [900] ["), F.col("turn"), F.lit("]")))
    known = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return rebuild_refs(said, known).groupBy("ref").agg(F.count("*").alias("n"))


def q_repair(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("domain"), F.when(F.col("p_partkey") % 5 == 1, F.col("p_partkey") + 1).alias("merged_into"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("domain"), "l_quantity")
    return repair_members(lines, parts).groupBy("next_domain").agg(F.count("*").alias("n"))


def q_reasons(spark, d):
    rows = _files(spark, d)
    return rows.select("doc_id", E.reason(F.when(F.col("doc_id") % 3 != 0, F.col("source")), F.col("suffix"), F.col("n_chars"), F.col("rule") * 0.9).alias("reason"))


def q_alias(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("---\n# no\n---\n\n## The *title* of "), "source", F.lit(" ##\n"), "text").alias("text"))
    md = docs.select("doc_id", F.lit("md").alias("kind"), E.alias(F.lit(".md"), F.col("text"), F.lit("?")).alias("alias"))
    html = pages.select(F.col("page_id").alias("doc_id"), F.lit("html").alias("kind"), E.alias(F.lit(".html"), F.col("html"), F.col("url")).alias("alias"))
    return md.unionByName(html)


def q_models(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_size", F.concat_ws("-", "p_brand", F.element_at(F.array(*map(F.lit, ("bge", "vl", "chat", "image", "gpt", "embed-2"))), (F.col("p_partkey") % 6 + 1).cast("int")), "p_size").alias("name"))
    return parts.groupBy(E.model_type(F.col("name")).alias("kind"), E.sees(F.col("name")).alias("sees"), E.failover(F.concat("name", F.when(F.col("p_size") > 25, " TimeOut").otherwise(" bad"))).alias("failover")).agg(F.count("*").alias("n"))


def q_import_stats(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    kind = F.when(F.col("quality").isNull(), "standalone").when(F.col("quality") == 1, "matched").otherwise("already")
    return docs.groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"))


def q_scores(spark, d):
    answer = F.concat(F.lit('So: {"quality_score": '), (F.col("n_chars") % 1300 / 100).cast("string"), F.lit(', "why": "x"} .'))
    return table(spark, d, "documents").select("doc_id", E.quality_score(answer).alias("score"))


QUERIES = {
    "p15_files": q_files, "q20_files_with_tags": q_files_with_tags, "q08_domain_context": q_context, "q29_next_work": q_next_work,
    "m09_mark_duplicates": q_mark, "m22_requeue": q_requeue, "m21_purge": q_purge, "q26_backfill": q_backfill,
    "m26_replace_by_path": q_mount, "u06_stale_chunks": q_stale_chunks, "t20_inferred_agents": q_agents, "p19_chat_sessions": q_chat,
    "g31_budget_state": q_budget, "p25_rescan_due": q_rescan, "g32_gate_agreement": q_agreement, "g32_keyword_coverage": q_coverage,
    "s14_query_set": q_query_set, "w13_colours": q_colours, "m25_refs": q_refs, "m14_repair_members": q_repair,
    "t19_reasons": q_reasons, "s05_aliases": q_alias, "t39_model_kinds": q_models, "g25_import_stats": q_import_stats,
    "t28_quality_scores": q_scores,
}
_F = """f AS (SELECT d.doc_id, lang, source, n_chars, text, quality, toxic, substring(text, 1, 40) AS title, 'd' || d.doc_id AS name,
'/kb/' || source || '/' || lang || '/d' || d.doc_id AS path, CASE WHEN d.doc_id % 2 = 0 THEN '.md' ELSE '.html' END AS suffix,
CASE WHEN d.doc_id % 7 = 0 THEN 'deleted' ELSE 'active' END AS status,
CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'done' ELSE 'failed' END AS llm_state,
n_chars % 97 AS updated_at, d.doc_id % 11 AS rule FROM documents d LEFT JOIN labels USING (doc_id))"""
_B = "b AS (SELECT l_orderkey AS doc_id, 't' || l_linenumber AS tag FROM lineitem)"
_CHUNKS = """SELECT doc_id, k AS chunk, md5(substring(t, k * 500 + 1, 500)) AS hash
FROM (SELECT doc_id, {text} AS t FROM documents WHERE length(text) > 0) x, LATERAL unnest(range(0, (length(t) - 1) // 500 + 1)) AS u(k)"""
SQL = {
    "p15_files": f"""WITH {_F}, {_B} SELECT doc_id, path, llm_state FROM f WHERE status = 'active' AND toxic = 0 AND suffix = '.md'
AND (contains(lower(title), 'd1') OR contains(path, 'd1') OR contains(name, 'd1')) AND doc_id IN (SELECT doc_id FROM b WHERE tag = 't2')""",
    "q20_files_with_tags": f"""WITH {_F}, {_B}, p AS (SELECT doc_id, name, n_chars FROM f WHERE status = 'active' ORDER BY n_chars DESC, doc_id LIMIT 30 OFFSET 30)
SELECT p.*, coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM b WHERE b.doc_id = p.doc_id), '') AS tags,
(SELECT count(*) FROM f WHERE status = 'active') AS total FROM p""",
    "q08_domain_context": f"""WITH {_F}, e AS (SELECT source AS domain, doc_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title,
trim(regexp_replace(substring(text, 41, 80), '\\s+', ' ', 'g')) AS summary, quality, rule FROM f WHERE title <> ''),
r AS (SELECT *, count(*) OVER (PARTITION BY domain) AS entries, row_number() OVER (PARTITION BY domain ORDER BY (quality IS NOT NULL) DESC, coalesce(quality * 3, 0) + rule DESC, doc_id) AS pos,
'- ' || title || CASE WHEN summary <> '' THEN ': ' || substring(summary, 1, 60) ELSE '' END AS line FROM e),
c AS (SELECT *, len(regexp_extract_all(line, '[\\x{{4e00}}-\\x{{9fff}}]')) AS cjk FROM r WHERE pos <= 20),
u AS (SELECT *, ceil(length(domain || ': ' || entries) / 4) + sum(cjk + ceil((length(line) - cjk) / 4)) OVER (PARTITION BY domain ORDER BY pos) AS used FROM c)
SELECT domain, entries, greatest(count(*) FILTER (WHERE used <= 300), 1)::INTEGER AS lines, bool_or(used > 300) AS truncated FROM u GROUP BY 1, 2""",
    "q29_next_work": f"""WITH {_F}, v AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS doc_id, max(ts) AS last_read FROM events WHERE event_type = 'view' GROUP BY 1),
w AS (SELECT f.*, row_number() OVER (ORDER BY (last_read IS NOT NULL) DESC, last_read DESC NULLS LAST, updated_at, doc_id) AS place FROM f LEFT JOIN v USING (doc_id) WHERE llm_state = 'pending' AND status = 'active')
SELECT doc_id, place::INTEGER AS place, updated_at FROM w WHERE place <= 16 AND n_chars % 5 <> 0 AND rule <> 3""",
    "m09_mark_duplicates": f"""WITH {_F}, m AS (SELECT *, doc_id <> min(doc_id) OVER (PARTITION BY text) AS copy FROM f)
SELECT CASE WHEN copy THEN 'cold' ELSE 'hot' END AS lifecycle, CASE WHEN copy THEN 'skipped' ELSE llm_state END AS llm_state, status, count(*) AS n,
max(CASE WHEN copy THEN 1000 ELSE updated_at END) AS latest FROM m GROUP BY 1, 2, 3""",
    "m22_requeue": f"""WITH {_F}, h AS (SELECT doc_id FROM f WHERE status = 'active' AND llm_state = 'done' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0) ORDER BY updated_at DESC, doc_id LIMIT 500)
SELECT llm_state, CASE WHEN doc_id IN (SELECT doc_id FROM h) OR (status = 'active' AND llm_state = 'failed') THEN 'pending' ELSE llm_state END AS next_state, status, count(*) AS n FROM f GROUP BY 1, 2, 3""",
    "m21_purge": f"""WITH {_F}, {_B}, g AS (SELECT doc_id FROM f WHERE status = 'deleted')
SELECT 'bridge' AS name, count(*) AS rows FROM b WHERE doc_id NOT IN (SELECT doc_id FROM g)
UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM g)
UNION ALL SELECT 'orphans', count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM f)""",
    "q26_backfill": f"""WITH {_F} SELECT doc_id, rule FROM f WHERE (doc_id % 3 <> 0 OR quality IS NULL) AND status = 'active' AND llm_state = 'done' ORDER BY rule DESC, doc_id LIMIT 200""",
    "m26_replace_by_path": """WITH n AS (SELECT '/kb/' || source || '/' || (doc_id % 50) AS path, max(doc_id) AS seen_at FROM documents GROUP BY 1),
h AS (SELECT url AS path, max(page_id) AS seen_at FROM pages GROUP BY 1)
SELECT 'new' AS origin, count(*) AS n, sum(seen_at)::BIGINT AS sum FROM n UNION ALL SELECT 'held', count(*), sum(seen_at)::BIGINT FROM h WHERE path NOT IN (SELECT path FROM n)""",
    "u06_stale_chunks": f"""WITH a AS ({_CHUNKS.format(text="text")}), b AS ({_CHUNKS.format(text="substring(text, 1, length(text) // 2 + 1) || doc_id")})
SELECT 'write' AS action, count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(chunk)::BIGINT AS chunks FROM (SELECT doc_id, chunk FROM b ANTI JOIN a USING (doc_id, chunk, hash)) x
UNION ALL SELECT 'delete', count(*), sum(doc_id)::BIGINT, sum(chunk)::BIGINT FROM (SELECT doc_id, chunk FROM a ANTI JOIN b USING (doc_id, chunk)) y""",
    "t20_inferred_agents": f"""WITH {_F} SELECT CASE WHEN doc_id % 10 = 0 THEN 'stated' WHEN source = 'src1' THEN 'one' WHEN source = 'src2' THEN lang ELSE source END AS inferred, count(*) AS n FROM f GROUP BY 1""",
    "p19_chat_sessions": """WITH s AS (SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, md5(arg_min(text, turn) FILTER (WHERE role = 'user')) AS preview, bool_or(contains(lower(text), 'the')) AS said FROM conversations GROUP BY 1)
SELECT conv_id, messages, last_turn, preview FROM s WHERE said AND conv_id % 4 <> 0 ORDER BY last_turn DESC, conv_id DESC LIMIT 20""",
    "g31_budget_state": """WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(coalesce(value, 0)), 4) AS cost FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT day, cost, cost > 500 AS tripped, coalesce(lag(cost > 500) OVER (ORDER BY day), false) AND NOT cost > 500 AS resumed FROM c""",
    "p25_rescan_due": """SELECT (epoch(TIMESTAMP '1999-01-01 00:00:00') - epoch(arg_max(o_orderdate, o_orderkey)::TIMESTAMP) - 90)::BIGINT AS down_seconds,
epoch(TIMESTAMP '1999-01-01 00:00:00') - epoch(arg_max(o_orderdate, o_orderkey)::TIMESTAMP) - 90 > 7200 AS due FROM orders""",
    "g32_gate_agreement": rf"""WITH g AS (SELECT quality = 1 AS wanted, strlen(text) >= 512 AND {gates._CHARS_SQL} >= 300 AS passed FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS total, count(*) FILTER (WHERE wanted = passed) AS agreed, avg(CASE WHEN wanted = passed THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM g""",
    "g32_keyword_coverage": f"""WITH {_F}, c AS (SELECT title, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, list_slice(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[a-z]{{4,}}$')), 1, 12) AS words FROM f),
k AS (SELECT len(words) AS n, len(list_filter(words, lambda w: contains(title, w) OR contains(CASE WHEN length(t) > 80 THEN substring(t, 1, 80) || '…' ELSE t END, w))) AS kept FROM c)
SELECT sum(n)::BIGINT AS words, sum(kept)::BIGINT AS kept, sum(kept)::DOUBLE / sum(n)::DOUBLE AS rate FROM k""",
    "s14_query_set": "SELECT lower(string_split(text, ' ')[1]) AS query, min(item_id) AS place FROM benchmark GROUP BY 1",
    "w13_colours": "SELECT n_nationkey AS id, ((row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1) % 12)::INTEGER AS colour FROM nation",
    "m25_refs": "SELECT turn AS ref, count(*) AS n FROM conversations WHERE turn IN (SELECT n_nationkey FROM nation) GROUP BY 1",
    "m14_repair_members": """WITH RECURSIVE p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 1 THEN p_partkey + 1 END AS t FROM part),
e AS (SELECT k, coalesce(t, k) AS target FROM p)
SELECT CASE WHEN target IN (SELECT k FROM p WHERE t IS NULL) THEN target END AS next_domain, count(*) AS n FROM lineitem LEFT JOIN e ON k = l_partkey GROUP BY 1""",
    "t19_reasons": f"""WITH {_F} SELECT doc_id, concat_ws(' · ', CASE WHEN doc_id % 3 <> 0 THEN source ELSE '未分类' END, substring(suffix, 2), CASE WHEN n_chars > 0 THEN greatest(1, floor(n_chars / 1024 + 0.5)::BIGINT) || 'KB' END,
CASE WHEN rule <> 0 THEN 'AI 评分 ' || printf('%.1f', rule * 0.9::DOUBLE) END) AS reason FROM f""",
    "s05_aliases": r"""SELECT doc_id, 'md' AS kind, 'The title of ' || source AS alias FROM documents
UNION ALL SELECT page_id, 'html', coalesce(nullif(trim(substring(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '[*_`]', '', 'g'), '\s+', ' ', 'g')), 1, 200)), ''), url)
FROM (SELECT page_id, url, coalesce(CASE WHEN regexp_matches(h, '(?is)<title[^>]*>(.*?)</title>') THEN regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1) END, CASE WHEN regexp_matches(h, '(?is)<h1[^>]*>(.*?)</h1>') THEN regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1) END) AS t
FROM (SELECT page_id, url, html AS h FROM pages) x) y""",
    "t39_model_kinds": """WITH n AS (SELECT p_size, p_brand || '-' || (['bge', 'vl', 'chat', 'image', 'gpt', 'embed-2'])[p_partkey % 6 + 1] || '-' || p_size AS name FROM part)
SELECT CASE WHEN contains(name, 'bge') OR contains(name, 'embed') THEN 'embedding' ELSE 'chat' END AS kind, contains(name, '-vl-') OR contains(name, 'image') AS sees, p_size > 25 AS failover, count(*) AS n FROM n GROUP BY 1, 2, 3""",
    "g25_import_stats": "SELECT source, CASE WHEN quality IS NULL THEN 'standalone' WHEN quality = 1 THEN 'matched' ELSE 'already' END AS kind, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "t28_quality_scores": "SELECT doc_id, round(least(n_chars % 1300 / 100.0::DOUBLE, 10), 1) AS score FROM documents",
}
