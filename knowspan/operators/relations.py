"""Joins, set operations and trees over bridges, logs and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.functions import expressions as X
from knowspan.session import shared_folder, table


def counts_with_zero(keys: DataFrame, key: str, facts: DataFrame, name: str = "n") -> DataFrame:
    """Facts by key, 0 for keys without any. Facts are counted before the join."""
    counted = facts.groupBy(key).agg(F.count("*").alias(name))
    return keys.select(key).join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def any_tag(rows: DataFrame, key: str, bridge: DataFrame, tag: str, tags: list) -> DataFrame:
    """Rows that carry at least one of the tags."""
    return rows.join(bridge.where(F.col(tag).isin(tags)).select(key), key, "left_semi")


def missing(rows: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """Rows without a partner; nulls in the other side don't empty the result."""
    return rows.join(other.select(key), key, "left_anti")


def cooccurrence(bridge: DataFrame, group: str, item: str, seeds: DataFrame) -> DataFrame:
    """How often other items share a group with each seed. Only the groups of the seeds are expanded."""
    held = bridge.select(group, item).distinct()
    chosen = held.join(seeds.select(item), item, "left_semi").select(group, F.col(item).alias("seed"))
    return held.join(chosen, group).where(F.col(item) != F.col("seed")).groupBy("seed", item).agg(F.count("*").alias("shared"))


def by_prefix(paths: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """The deepest root above each path, by equality on the prefixes of the path instead of a comparison with every root."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    spread = paths.select(path, F.explode(prefixes).alias("_prefix")).where("_prefix <> ''")
    known = roots.select(F.rtrim(F.col(root), F.lit("/")).alias("_prefix"), F.col(root).alias("root"))
    best = spread.join(known, "_prefix").groupBy(path).agg(F.max_by("root", F.length("_prefix")).alias("root"))
    return paths.join(best, path, "left")


def tombstones(active: DataFrame, seen: DataFrame, root: str, key: str, cap: int) -> DataFrame:
    """Active rows that a walk didn't see, by root; a root that saw nothing, or would lose more than ``cap``, loses none."""
    walked = seen.groupBy(root).agg(F.count("*").alias("walked"))
    gone = active.join(seen.select(key), key, "left_anti")
    counted = gone.groupBy(root).agg(F.count("*").alias("gone"))
    plan = counted.join(walked, root, "left").select(root, "gone", F.coalesce("walked", F.lit(0)).alias("walked"))
    plan = plan.withColumn("skip", F.when(F.col("walked") == 0, "empty walk").when(F.col("gone") > cap, "over cap"))
    return gone.join(plan.where("skip is null").select(root), root, "left_semi")


def keep_first(lists: list[DataFrame], key: str) -> DataFrame:
    """The lists one after the other, each key where it comes first. Each list has a column ``pos``."""
    every = None
    for k, rows in enumerate(lists):
        rows = rows.withColumn("_list", F.lit(k))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("_list", "pos")
    return every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def chase(links: DataFrame, key: str, to: str, hops: int = 5) -> DataFrame:
    """Where each key's chain of pointers ends after at most ``hops`` steps; a loop ends where the hops end."""
    at = links.select(key, F.col(key).alias("target"))
    step = links.where(F.col(to).isNotNull()).select(F.col(key).alias("target"), F.col(to).alias("_next"))
    for _ in range(hops):
        at = at.join(step, "target", "left").select(key, F.coalesce("_next", "target").alias("target"))
    return at


def descendants(spark: SparkSession, tree: DataFrame, key: str, parent: str) -> DataFrame:
    """(ancestor, descendant) of every pair, each node with itself; a node in a loop is below all nodes of it.

    Level by level, each level a join written to the shared folder, so neither depth nor the number of pairs is limited."""
    path, level = shared_folder(spark, "tree"), 0
    edges = tree.where(F.col(parent).isNotNull()).select(F.col(parent).alias("_up"), F.col(key).alias("_down")).distinct()
    held = lambda k: f"{path}/level={k}"
    tree.select(F.col(key).alias("ancestor"), F.col(key).alias("descendant")).distinct().write.parquet(held(0))
    while not spark.read.parquet(held(level)).isEmpty():
        below = spark.read.parquet(held(level)).join(edges, F.col("descendant") == F.col("_up")).select("ancestor", F.col("_down").alias("descendant"))
        known = spark.read.parquet(*(held(k) for k in range(level + 1)))
        below.distinct().join(known, ["ancestor", "descendant"], "left_anti").write.parquet(held(level + 1))
        level += 1
    return spark.read.parquet(*(held(k) for k in range(level + 1)))


def subtree_sums(spark: SparkSession, tree: DataFrame, key: str, parent: str, values: DataFrame, value: str) -> DataFrame:
    """Each node's own sum, that of its direct children with it, and of its whole subtree."""
    own = tree.select(key, parent).join(values.groupBy(key).agg(F.sum(value).alias("own")), key, "left").withColumn("own", F.coalesce("own", F.lit(0)))
    children = own.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.sum("own").alias("below"))
    pairs = descendants(spark, tree, key, parent)
    total = pairs.join(own.select(F.col(key).alias("descendant"), "own"), "descendant").groupBy(F.col("ancestor").alias(key)).agg(F.sum("own").alias("subtree"))
    return own.join(children, key, "left").join(total, key).select(key, "own", (F.col("own") + F.coalesce("below", F.lit(0))).alias("with_children"), "subtree")


# --- queries over the driver's tables -------------------------------------------------------------


def _tree(spark, d) -> DataFrame:
    """Regions, nations and customers as one tree."""
    region = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.lit(None).cast("string").alias("up"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("up"))
    return region.unionByName(nation)


def q_inner_join(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def q_left_join_zero(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    return counts_with_zero(customers, "c_custkey", orders.select(F.col("o_custkey").alias("c_custkey")), "orders")


def q_preaggregated_join(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    joined = orders.join(lines, "o_orderkey", "left")
    return joined.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"), F.coalesce(F.sum("returned"), F.lit(0)).alias("returned"))


def q_semi_tags(spark, d):
    bridge = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return any_tag(table(spark, d, "orders"), "o_orderkey", bridge, "l_partkey", [1, 2, 3, 5, 8, 13]).select("o_orderkey", "o_orderstatus")


def q_anti_missing(spark, d):
    return missing(table(spark, d, "documents"), "doc_id", table(spark, d, "labels")).groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def q_cooccurrence(spark, d):
    bridge = table(spark, d, "lineitem")
    seeds = table(spark, d, "part").where("p_size <= 2").select(F.col("p_partkey").alias("l_partkey"))
    return cooccurrence(bridge, "l_orderkey", "l_partkey", seeds).where("shared >= 1")


def q_parent_name(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    customers = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.concat_ws(" / ", "r_name", "n_name").alias("path"))
    return named.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "path", F.coalesce("n", F.lit(0)).alias("n"))


def q_bridge_three_hop(spark, d):
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_orderkey").distinct().groupBy("p_brand").agg(F.count("*").alias("orders"))


def q_prefix_join(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("/kb/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id")).alias("path"))
    roots = spark.createDataFrame([("/kb/",), ("/kb/src1",), ("/kb/src1/fr",), ("/kb/src2/en/",), ("/other",)], "root string")
    return by_prefix(docs, "path", roots, "root").groupBy("root").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def q_first_message(spark, d):
    said = table(spark, d, "conversations")
    first = said.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.min(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("f"))
    return first.select("conv_id", "messages", "last_turn", F.substring("f.text", 1, 100).alias("first_message"))


def q_json_key_join(spark, d):
    events = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"), "event_type")
    return events.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "event_type").agg(F.count("*").alias("n"))


def q_union_distinct(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    a = docs.where("lang = 'fr'").select("doc_id")
    b = docs.where("source = 'src2'").select("doc_id")
    c = labels.where("quality = 0").select("doc_id")
    return a.union(b).union(c).distinct().groupBy(F.pmod("doc_id", F.lit(10)).alias("bucket")).agg(F.count("*").alias("n"))


def q_bag_concat_page(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "n_chars")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"))
    both = docs.unionByName(pages, allowMissingColumns=True)
    return both.orderBy(F.desc_nulls_last("n_chars"), "kind", "id").offset(40).limit(20)


def q_tombstone_plan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    seen = docs.where("doc_id % 9 <> 0 and source <> 'src6' and not (source = 'src7' and doc_id % 2 = 0)")
    return tombstones(docs, seen, "source", "doc_id", cap=20)


def q_keep_first(spark, d):
    docs = table(spark, d, "documents")
    longest = docs.orderBy(F.desc("n_chars"), "doc_id").limit(50)
    labelled = docs.join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").orderBy("doc_id").limit(50)
    lists = [longest.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))), labelled.withColumn("pos", F.row_number().over(Window.orderBy("doc_id")))]
    return keep_first(lists, "doc_id").select("doc_id", F.col("_list").alias("list"), "pos")


def q_pointer_chase(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.floor(F.col("p_partkey") / 2)).cast("bigint").alias("merged_into"))
    parts = parts.withColumn("merged_into", F.when(F.col("merged_into") > 0, F.col("merged_into")))
    return chase(parts, "p_partkey", "merged_into", 5).groupBy("target").agg(F.count("*").alias("n"))


def q_tree_rollup(spark, d):
    values = table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("node"), F.lit(1).cast("bigint").alias("n"))
    return subtree_sums(spark, _tree(spark, d), "node", "up", values, "n")


def q_relink(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))
    first = docs.groupBy("md5").agg(F.min("doc_id").alias("from_id"))
    return docs.join(first, "md5").where("doc_id <> from_id").select("doc_id", "from_id")


QUERIES = {
    "j01_inner_join": q_inner_join, "j02_left_join_zero": q_left_join_zero, "j03_preaggregated_join": q_preaggregated_join,
    "j04_semi_tags": q_semi_tags, "j05_anti_missing": q_anti_missing, "j06_cooccurrence": q_cooccurrence, "j07_parent_name": q_parent_name,
    "j08_bridge_three_hop": q_bridge_three_hop, "j10_prefix_join": q_prefix_join, "j11_first_message": q_first_message,
    "j12_json_key_join": q_json_key_join, "j17_relink": q_relink, "u01_union_distinct": q_union_distinct, "u03_bag_concat_page": q_bag_concat_page,
    "u04_tombstone_plan": q_tombstone_plan, "w09_keep_first": q_keep_first, "m12_pointer_chase": q_pointer_chase, "g08_tree_rollup": q_tree_rollup,
}
SQL = {
    "j01_inner_join": "SELECT lang, quality, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2",
    "j02_left_join_zero": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "j03_preaggregated_join": "SELECT o_custkey, count(DISTINCT o_orderkey) AS orders, coalesce(sum(l_quantity), 0) AS quantity, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "j04_semi_tags": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (1, 2, 3, 5, 8, 13))",
    "j05_anti_missing": "SELECT source, count(*) AS n, min(doc_id) AS first FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1",
    "j06_cooccurrence": "WITH b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT s.l_partkey AS seed, o.l_partkey, count(*) AS shared FROM b s JOIN part ON p_partkey = s.l_partkey AND p_size <= 2 JOIN b o ON o.l_orderkey = s.l_orderkey AND o.l_partkey <> s.l_partkey GROUP BY 1, 2",
    "j07_parent_name": "SELECT n_nationkey, r_name || ' / ' || n_name AS path, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation JOIN region ON r_regionkey = n_regionkey",
    "j08_bridge_three_hop": "SELECT p_brand, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "j10_prefix_join": "SELECT root, count(*) AS n, min(path) AS first FROM (SELECT path, CASE WHEN starts_with(path, '/kb/src1/fr/') THEN '/kb/src1/fr' WHEN starts_with(path, '/kb/src1/') THEN '/kb/src1' WHEN starts_with(path, '/kb/src2/en/') THEN '/kb/src2/en/' ELSE '/kb/' END AS root FROM (SELECT '/kb/' || source || '/' || lang || '/' || doc_id AS path FROM documents) p) t GROUP BY 1",
    "j11_first_message": "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, substring(arg_min(text, turn) FILTER (WHERE role = 'user'), 1, 100) AS first_message FROM conversations GROUP BY 1",
    "j12_json_key_join": "SELECT lang, event_type, count(*) AS n FROM events JOIN documents ON doc_id = CAST(json_extract(props, '$.k') AS BIGINT) GROUP BY 1, 2",
    "j17_relink": "SELECT doc_id, from_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS from_id FROM documents) t WHERE doc_id <> from_id",
    "u01_union_distinct": "SELECT doc_id % 10 AS bucket, count(*) AS n FROM (SELECT doc_id FROM documents WHERE lang = 'fr' UNION SELECT doc_id FROM documents WHERE source = 'src2' UNION SELECT doc_id FROM labels WHERE quality = 0) t GROUP BY 1",
    "u03_bag_concat_page": "SELECT * FROM (SELECT doc_id AS id, 'document' AS kind, n_chars FROM documents UNION ALL SELECT page_id, 'page', NULL FROM pages) t ORDER BY n_chars DESC NULLS LAST, kind, id LIMIT 20 OFFSET 40",
    "u04_tombstone_plan": """WITH seen AS (SELECT doc_id, source FROM documents WHERE doc_id % 9 <> 0 AND source <> 'src6' AND NOT (source = 'src7' AND doc_id % 2 = 0)),
gone AS (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM seen))
SELECT source, doc_id FROM gone WHERE source IN (SELECT source FROM seen) AND source IN (SELECT source FROM gone GROUP BY 1 HAVING count(*) <= 20)""",
    "w09_keep_first": """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents QUALIFY pos <= 50),
b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) QUALIFY pos <= 50)
SELECT doc_id, 0 AS list, pos::INTEGER AS pos FROM a UNION ALL SELECT doc_id, 1, pos::INTEGER FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""",
    "m12_pointer_chase": """WITH RECURSIVE l AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 AND p_partkey // 2 > 0 THEN p_partkey // 2 END AS t FROM part),
c AS (SELECT k, k AS target, 0 AS hop FROM l UNION ALL SELECT c.k, coalesce(l.t, c.target), hop + 1 FROM c LEFT JOIN l ON l.k = c.target WHERE hop < 5)
SELECT target, count(*) AS n FROM c WHERE hop = 5 GROUP BY 1""",
    "g08_tree_rollup": """WITH o AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS up, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS own FROM nation)
SELECT node, own, own AS with_children, own AS subtree FROM o UNION ALL SELECT up, 0, sum(own)::BIGINT, sum(own)::BIGINT FROM o GROUP BY up""",
}
