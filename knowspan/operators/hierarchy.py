"""Levels of a tree, batches of moves that keep it a tree, and the pairing of domains with their tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspan.operators import curation, relations
from knowspan.session import shared_folder, table


def _pointers(spark: SparkSession, tree: DataFrame, key: str, parent: str) -> DataFrame:
    """node, far, steps, least, open: how far each node's pointer leads, by pointer doubling.

    Every round each pointer jumps as far as the pointer it points to, so a tree of depth n takes log2(n) joins. A
    closed pointer leads to its root. One still open at the end has gone more steps than there are nodes, so ``far``
    lies in a loop and ``least`` is the smallest node passed. Each round is a table in the shared folder. Pointers to
    one popular node are spread by adaptive execution, as the side that is met has one row a node."""
    path = shared_folder(spark, "levels")
    known = tree.where(F.col(key).isNotNull()).select(F.col(key).alias("node"), F.col(parent).alias("up"))
    nodes = known.select(F.col("node").alias("up"), F.lit(1).cast("bigint").alias("steps"))
    at = known.join(nodes, "up", "left").select(
        "node",
        F.when(F.col("steps").isNotNull(), F.col("up")).otherwise(F.col("node")).alias("far"),
        F.coalesce("steps", F.lit(0)).cast("bigint").alias("steps"),
    )
    at.withColumn("least", F.col("node")).withColumn("open", F.col("steps") > 0).write.parquet(f"{path}/0")
    held = spark.read.parquet(f"{path}/0")
    total, done = held.count(), 0
    while 2**done <= total and not held.where("open").isEmpty():
        ahead = held.select(
            F.col("node").alias("far"),
            F.col("far").alias("_far"),
            F.col("steps").alias("_steps"),
            F.col("least").alias("_least"),
            F.col("open").alias("_open"),
        )
        moved = held.where("open").join(ahead, "far").select(
            "node",
            F.col("_far").alias("far"),
            (F.col("steps") + F.col("_steps")).alias("steps"),
            F.least("least", "_least").alias("least"),
            F.col("_open").alias("open"),
        )
        done += 1
        moved.unionByName(held.where("not open")).write.parquet(f"{path}/{done}")
        held = spark.read.parquet(f"{path}/{done}")
    return held


def levels(spark: SparkSession, tree: DataFrame, key: str, parent: str) -> DataFrame:
    """key, root, level (0 for a root), loop: one row for each node of (key, parent); keys are unique.

    A parent that isn't a node counts as none. Nodes in a loop, or below one, have neither root nor level;
    ``loop`` is the smallest node of the loop for those in it or below it, null for all others."""
    held = _pointers(spark, tree, key, parent)
    names = held.where("open").select(F.col("node").alias("far"), F.col("least").alias("loop"))
    looped = held.where("open").select("node", "far").join(names, "far").select(F.col("node").alias(key), "loop")
    rooted = held.where("not open").select(F.col("node").alias(key), F.col("far").alias("root"), F.col("steps").alias("level"))
    return rooted.unionByName(looped, allowMissingColumns=True)


def _loops(into: DataFrame) -> DataFrame:
    """node, loop of the open pointers' loops: after more steps than there are nodes each has ended in a loop, and each node of a loop is such an end."""
    return into.select(F.col("far").alias("node")).distinct().join(into.select("node", F.col("least").alias("loop")), "node")


def loop_nodes(spark: SparkSession, tree: DataFrame, key: str, parent: str) -> DataFrame:
    """node, loop: the nodes that lie in a loop, not those below one; loop is the smallest node of it."""
    return _loops(_pointers(spark, tree, key, parent).where("open"))


def reparent(spark: SparkSession, tree: DataFrame, key: str, parent: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree after a batch of moves (id, node, parent; ids are unique), and each move's outcome (id, node, outcome).

    A null parent makes a root. Outcomes: ``unknown`` (node or parent isn't there), ``own`` (a node below itself),
    ``later`` (a move of the same node with a smaller id counts), ``loop`` (it closes a loop), ``moved``.

    Of each loop that the moves close together, the move with the largest id is taken back, and its node returns to
    where it was, until no loop has a move in it. Loops that were there before and that no move touches stay; ``levels``
    shows them. A round of the fixpoint settles all loops that are there; a loop that then arises runs through a node
    just put back, so all its nodes led into a loop before, and the next round looks at those alone."""
    path = shared_folder(spark, "reparent")
    nodes = tree.select(F.col(key).alias("node")).where("node is not null")
    to = F.col("to")
    moves = asked.select("id", "node", F.col("parent").alias("to"))
    moves = moves.join(nodes.withColumn("_node", F.lit(True)), "node", "left").join(nodes.select(F.col("node").alias("to"), F.lit(True).alias("_to")), "to", "left")
    sane = F.when(F.col("_node").isNull() | (to.isNotNull() & F.col("_to").isNull()), "unknown").when(F.col("node") == to, "own")
    moves = moves.select("id", "node", "to", sane.alias("outcome"))
    first = moves.where("outcome is null").groupBy("node").agg(F.min("id").alias("_first"))
    moves = moves.join(first, "node", "left").withColumn("outcome", F.when(F.col("outcome").isNull() & (F.col("id") != F.col("_first")), "later").otherwise(F.col("outcome")))
    moves.drop("_first").write.parquet(f"{path}/0")
    held, done = spark.read.parquet(f"{path}/0"), 0

    def after(rows: DataFrame, moves: DataFrame) -> DataFrame:
        live = moves.where("outcome is null").select(F.col("node").alias(key), F.col("id").alias("_id"), F.col("to").alias("_to"))
        met = rows.join(live, key, "left").withColumn(parent, F.when(F.col("_id").isNotNull(), F.col("_to")).otherwise(F.col(parent)))
        return met.drop("_id", "_to")

    reach = tree
    while True:
        into = _pointers(spark, after(reach, held), key, parent).where("open")
        back = _loops(into).join(held.where("outcome is null"), "node").groupBy("loop").agg(F.max("id").alias("id"))
        held.join(back.select("id", F.lit("loop").alias("_outcome")), "id", "left").select("id", "node", "to", F.coalesce("outcome", "_outcome").alias("outcome")).write.parquet(f"{path}/{done + 1}")
        done += 1
        before, held = held, spark.read.parquet(f"{path}/{done}")
        if held.where("outcome = 'loop'").count() == before.where("outcome = 'loop'").count():
            return after(tree, held), held.select("id", "node", F.coalesce("outcome", F.lit("moved")).alias("outcome"))
        reach = tree.join(into.select(F.col("node").alias(key)), key, "left_semi")


def reconcile(tags: DataFrame, domains: DataFrame) -> DataFrame:
    """The tags (id, name, level, status, domain, parent) after domains (domain, name) and tags are paired again.

    A tag that isn't active, or whose domain isn't there, loses the level ``primary`` and becomes ``normal``. Each name
    of a domain then has an active primary tag: one of that name that isn't is raised to it, bound to the smallest domain
    of the name and taken from under its parent; one that lacks is made, with a null id that the writer fills. Names of
    tags are unique; domains without a name take no part. Doing it twice changes nothing more."""
    alive = domains.select("domain").distinct().withColumn("_alive", F.lit(True))
    ghost = (F.col("level") == "primary") & ((F.col("status") != "active") | F.col("status").isNull() | F.col("_alive").isNull())
    kept = tags.join(alive, "domain", "left").withColumn("level", F.when(ghost, "normal").otherwise(F.col("level"))).drop("_alive")
    wanted = domains.where("name is not null").groupBy("name").agg(F.min("domain").alias("_domain"))
    met = kept.join(wanted, "name", "full")
    firm = F.coalesce((F.col("level") == "primary") & (F.col("status") == "active"), F.lit(False))
    raised = F.col("_domain").isNotNull() & ~firm
    return met.select(
        "id",
        "name",
        F.when(raised, "primary").otherwise(F.col("level")).alias("level"),
        F.when(raised, "active").otherwise(F.col("status")).alias("status"),
        F.when(raised, F.col("_domain")).otherwise(F.col("domain")).alias("domain"),
        F.when(~raised, F.col("parent")).alias("parent"),
    )


def merge_domains(domains: DataFrame, files: DataFrame, referring: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Domains (domain, name) of one name become one, that with the most files, then the smallest id; and the tables that
    refer to them by ``domain``, moved to the one that stays. References to none or to unknown domains stay as they are."""
    sizes = relations.counts_with_zero(domains, "domain", files.where("domain is not null"), "_files")
    to = curation.keepers(domains.join(sizes, "domain"), "name", "domain", "_files").where("domain <> keeper")
    moved = [r.join(to, "domain", "left").withColumn("domain", F.coalesce("keeper", "domain")).drop("keeper") for r in referring]
    return relations.missing(domains, "domain", to), moved


# --- queries over the driver's tables -------------------------------------------------------------


def _chain(spark, d) -> DataFrame:
    """Parts as a forest: a part hangs below the one of half its number, those of size 1 below their next, so loops arise."""
    k = F.col("p_partkey")
    up = F.when(k % 97 == 0, None).when(F.col("p_size") == 1, k + 1).otherwise(F.floor(k / 2))
    return table(spark, d, "part").select(k.alias("tag"), F.nullif(up, F.lit(0)).cast("bigint").alias("parent"))


def q_levels(spark, d):
    return levels(spark, _chain(spark, d), "tag", "parent").select("tag", "root", "level")


def q_reparent(spark, d):
    """Every order asks to hang its customer below another, urgent ones below the next, low ones by their price; levels after the batch."""
    k = F.col("o_custkey")
    to = F.when(F.col("o_orderpriority") == "1-URGENT", k + 1).when(F.col("o_orderpriority") == "5-LOW", F.floor(F.col("o_totalprice") / 3000)).otherwise(F.floor(k / 2))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.nullif(F.floor(F.col("c_custkey") / 3), F.lit(0)).cast("bigint").alias("parent"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), k.alias("node"), F.nullif(to, F.lit(0)).cast("bigint").alias("parent"))
    after, outcomes = reparent(spark, customers, "node", "parent", asked)
    placed = levels(spark, after, "node", "parent")
    moved = outcomes.where("outcome = 'moved'").select("node", F.col("id").alias("moved_by"))
    return placed.join(moved, "node", "left").select("node", "root", "level", "moved_by", "loop")


def _paired(spark, d) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    named = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_size"))
    tags = table(spark, d, "part").groupBy(named.alias("name")).agg(F.min(k).alias("id"))
    tags = tags.select(
        "id",
        "name",
        F.when(F.col("id") % 3 == 0, "primary").otherwise("normal").alias("level"),
        F.when(F.col("id") % 4 == 0, "merged").otherwise("active").alias("status"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 40).alias("domain"),
        F.when(F.col("id") % 2 == 0, F.col("id") - 1).alias("parent"),
    )
    domains = table(spark, d, "supplier").select(F.col("s_suppkey").alias("domain"), F.concat(F.lit("Brand#"), 11 + F.col("s_suppkey") % 15, F.lit("/"), 1 + F.col("s_suppkey") % 50).alias("name"))
    return tags, domains


def q_reconcile(spark, d):
    tags, domains = _paired(spark, d)
    return reconcile(tags, domains)


def q_merge_domains(spark, d):
    c = table(spark, d, "customer")
    domains = c.select(F.col("c_custkey").alias("domain"), F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey")).alias("name"))
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("domain"))
    kept, (moved,) = merge_domains(domains, files, [files])
    return kept.join(moved.groupBy("domain").agg(F.count("*").alias("files")), "domain", "left").select("domain", "name", F.coalesce("files", F.lit(0)).alias("files"))


QUERIES = {
    "m14_levels": q_levels,
    "m13_reparent": q_reparent,
    "m14_reconcile": q_reconcile,
    "m14_merge_domains": q_merge_domains,
}
SQL = {
    "m14_levels": """WITH RECURSIVE t AS (SELECT p_partkey AS tag, nullif(CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_size = 1 THEN p_partkey + 1 ELSE p_partkey // 2 END, 0) AS parent FROM part),
r AS (SELECT tag, tag AS root, 0::BIGINT AS level FROM t WHERE parent IS NULL OR parent NOT IN (SELECT tag FROM t)
      UNION ALL SELECT t.tag, r.root, r.level + 1 FROM r JOIN t ON t.parent = r.tag)
SELECT tag, root, level FROM t LEFT JOIN r USING (tag)""",
    "m14_reconcile": """WITH t AS (SELECT min(p_partkey) AS id, p_brand || '/' || p_size AS name FROM part GROUP BY 2),
g AS (SELECT id, name, CASE WHEN id % 3 = 0 THEN 'primary' ELSE 'normal' END AS level, CASE WHEN id % 4 = 0 THEN 'merged' ELSE 'active' END AS status,
  CASE WHEN id % 5 <> 0 THEN id % 40 END AS domain, CASE WHEN id % 2 = 0 THEN id - 1 END AS parent FROM t),
d AS (SELECT s_suppkey AS domain, 'Brand#' || (11 + s_suppkey % 15) || '/' || (1 + s_suppkey % 50) AS name FROM supplier),
k AS (SELECT g.* REPLACE (CASE WHEN level = 'primary' AND (status <> 'active' OR domain IS NULL OR domain NOT IN (SELECT domain FROM d)) THEN 'normal' ELSE level END AS level) FROM g),
w AS (SELECT name, min(domain) AS home FROM d GROUP BY 1)
SELECT id, name, level, status, domain, parent FROM k WHERE name NOT IN (SELECT name FROM w) OR (level = 'primary' AND status = 'active')
UNION ALL SELECT k.id, w.name, 'primary', 'active', home, NULL FROM w LEFT JOIN k USING (name) WHERE k.id IS NULL OR NOT (level = 'primary' AND status = 'active')""",
    "m14_merge_domains": """WITH n AS (SELECT c_custkey AS domain, c_mktsegment || '-' || c_nationkey AS name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS files FROM customer)
SELECT arg_max(domain, (files, -domain)) AS domain, name, sum(files)::BIGINT AS files FROM n GROUP BY name""",
}
