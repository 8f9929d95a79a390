"""Changes of a tree of files as a stream: scans, settling, and a snapshot that each batch takes one step on.

A scan lists the tree and adds its sightings, and those files that the scan before had and this one hasn't, to an inbox of
Parquet files. The stream reads the inbox; a change counts when it has stayed for a while (``next_seen``). What each path was
last seen as, and the snapshot, are tables that a batch reads as those before it and writes under its own number, so a
batch that comes again writes the same ones anew. All paths of a batch are worked on together, by joins and windows.
Content is read only for files that changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knowspan.operators import ingest
from knowspan.session import shared_folder, table
from knowspan.sources import tree

SIGHTING = "path string, at timestamp, size bigint, mtime timestamp, gone boolean"
SNAPSHOT = "path string, size bigint, mtime timestamp, md5 string, status string, state string"

#: What a path was last seen as, from when on, whether that was told; the time of the last scan; the last change that settled in this batch.
SEEN = "path string, size bigint, mtime timestamp, gone boolean, since timestamp, told boolean, clock timestamp, settled struct<at: timestamp, size: bigint, mtime: timestamp, gone: boolean>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def record(spark: SparkSession, folder: str, number: int, at: Column, files: DataFrame) -> None:
    """Add scan ``number`` (from 0, in turn) of files (path, size, mtime) to the inbox; one that is there already stays."""
    here = f"{folder}/inbox/scan={number}"
    if _exists(spark, f"{here}/_SUCCESS"):
        return
    now = files.select("path", at.alias("at"), "size", "mtime", F.lit(False).alias("gone"))
    if number:
        before = spark.read.schema(SIGHTING).parquet(f"{folder}/inbox/scan={number - 1}").where("not gone")
        lost = before.join(files.select("path"), "path", "left_anti")
        now = now.unionByName(lost.select("path", at.alias("at"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(True).alias("gone")))
    now.write.mode("overwrite").parquet(here)


def snapshot(spark: SparkSession, folder: str, before: int | None = None, kind: str = "snapshots", schema: str = SNAPSHOT) -> tuple[int, DataFrame]:
    """(number, rows) of the last snapshot, or of the last one before batch ``before``; -1 without any."""
    path = f"{folder}/{kind}"
    numbers = []
    if _exists(spark, path):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        names = [f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
        numbers = [int(n.removeprefix("batch=")) for n in names if _exists(spark, f"{path}/{n}/_SUCCESS")]
    numbers = [n for n in numbers if before is None or n < before]
    if not numbers:
        return -1, spark.createDataFrame([], schema)
    return max(numbers), spark.read.schema(schema).parquet(f"{path}/batch={max(numbers)}")


def next_seen(seen: DataFrame, sightings: DataFrame, seconds: float) -> DataFrame:
    """What paths were seen as after sightings (path, at, size, mtime, gone) in any order; those from before the clock of ``seen`` come too late.

    A path's sightings in turn are runs of equal ones; a run settles when the next one, or the clock, is ``seconds`` after its beginning."""
    before = F.broadcast(seen.agg(F.max("clock").alias("_before")))  # one row
    clock = F.broadcast(sightings.select("at").unionByName(seen.select(F.col("clock").alias("at"))).agg(F.max("at").alias("clock")))  # one row
    held = seen.select("path", F.col("since").alias("at"), "size", "mtime", "gone", "told", F.lit(True).alias("held"))
    fresh = sightings.crossJoin(before).where("_before is null or at >= _before").select("path", "at", "size", "mtime", "gone", F.lit(False).alias("told"), F.lit(False).alias("held"))
    what, turn = F.struct("size", "mtime", "gone"), Window.partitionBy("path").orderBy("at", F.desc("held"), "gone", "mtime", "size")
    begun = held.unionByName(fresh).withColumn("_was", F.lag(what).over(turn)).where(F.col("_was").isNull() | ~F.col("_was").eqNullSafe(what)).drop("_was")
    ends = begun.withColumn("_next", F.lead("at").over(turn)).crossJoin(clock)
    over = F.col("at") + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")) <= F.coalesce("_next", "clock")
    ends = ends.withColumn("_now", over & ~F.col("told")).withColumn("told", over | F.col("told"))
    order = F.struct(F.col("_next").isNull(), F.col("at"))
    last, settled = F.struct("size", "mtime", "gone", F.col("at").alias("since"), "told", "clock"), F.struct("at", "size", "mtime", "gone")
    return ends.groupBy("path").agg(F.max_by(last, order).alias("s"), F.max_by(settled, F.when(F.col("_now"), order)).alias("settled")).select("path", "s.*", "settled")


def merge(old: DataFrame, settled: DataFrame, fingerprint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The snapshot after settled changes (path, at, size, mtime, gone), of which the last of each path counts."""
    last = settled.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "gone"), F.struct("at", "gone", "mtime", "size")).alias("s")).select("path", "s.*")
    met = last.join(old, "path", "left").select("path", *(F.col(c) for c in ("gone",)), *(last[c].alias(f"new_{c}") for c in ("size", "mtime")), *(old[c].alias(f"old_{c}") for c in ("size", "mtime", "md5", "status")))
    same = F.col("new_size").eqNullSafe(F.col("old_size")) & F.col("new_mtime").eqNullSafe(F.col("old_mtime"))
    known = met.where("not gone").where(same).select("path", F.col("new_size").alias("size"), F.col("new_mtime").alias("mtime"), F.col("old_md5").alias("md5"))
    read = fingerprint(met.where("not gone").where(~same).select("path", F.col("new_size").alias("size"), F.col("new_mtime").alias("mtime")))
    seen = known.unionByName(read.where("md5 is not null"))
    touched = old.join(last.select("path"), "path", "left_semi")
    changed = ingest.next_snapshot(ingest.diff(touched, seen))
    pending = old.select("path", F.col("state").alias("_was"))
    changed = changed.join(pending, "path", "left").withColumn("state", F.when(F.col("status") == "active", F.coalesce("state", "_was"))).drop("_was")  # what waited still waits
    return old.join(last.select("path"), "path", "left_anti").unionByName(changed.select(*old.columns))


def follow(spark: SparkSession, folder: str, settle: float = 1.0, fingerprint: Callable[[DataFrame], DataFrame] = tree.digests) -> DataFrame:
    """Take in the scans that wait in the inbox and return the snapshot. Calls go on where the last one ended.

    A change settles once a later scan tells that its time is over. What came and went between two snapshots leaves no row."""
    sightings = spark.readStream.schema(SIGHTING).parquet(f"{folder}/inbox/*")

    def put(batch: DataFrame, number: int) -> None:
        _, seen = snapshot(spark, folder, number, "seen", SEEN)
        _, old = snapshot(spark, folder, number)
        here = f"{folder}/seen/batch={number}"
        next_seen(seen, batch, settle).write.mode("overwrite").parquet(here)
        now = spark.read.schema(SEEN).parquet(here).where("settled is not null").select("path", "settled.*")
        merge(old, now, fingerprint).write.mode("overwrite").parquet(f"{folder}/snapshots/batch={number}")

    query = sightings.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return snapshot(spark, folder)[1]


def scan(spark: SparkSession, root: str, folder: str, number: int, at: Column | None = None, **options: str) -> None:
    """Record scan ``number`` of a mounted tree."""
    record(spark, folder, number, F.current_timestamp() if at is None else at, tree.tree(spark, root, **options))


# --- queries over the driver's tables: documents as files that three scans see differently ---


def q_changes(spark, d):
    """Scan 0 sees all documents but those of one language; 1 lacks those of one source and sees others grown; what is new in scan 2 hasn't settled yet."""
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id")).alias("path"), "lang", "source", F.col("n_chars").alias("size"), F.md5(F.col("text").cast("binary")).alias("md5"))
    folder, time = shared_folder(spark, "tree"), lambda s: F.to_timestamp(F.lit(s))
    files = lambda rows, grown, day: rows.select("path", (F.col("size") + F.when(grown, 1).otherwise(0)).alias("size"), F.when(grown, time(day)).otherwise(time("2024-01-01")).alias("mtime"))
    record(spark, folder, 0, time("2024-02-01 00:00:00"), files(docs.where("lang <> 'fr'"), F.lit(False), "2024-01-01"))
    record(spark, folder, 1, time("2024-02-01 01:00:00"), files(docs.where("source <> 'src3'"), F.col("lang") == "de", "2024-02-01"))
    content = docs.select("path", "md5", F.col("size").alias("_size"))
    fingerprint = lambda rows: rows.join(content, "path").select("path", "size", "mtime", F.when(F.col("size") == F.col("_size"), F.col("md5")).otherwise(F.md5(F.concat("md5", F.lit("grown")))).alias("md5"))
    follow(spark, folder, 60.0, fingerprint)
    record(spark, folder, 2, time("2024-02-01 01:30:00"), files(docs, F.col("lang") == "de", "2024-02-01"))
    return follow(spark, folder, 60.0, fingerprint).select("path", "size", "md5", "status", "state")


QUERIES = {"r_tree_changes": q_changes}
SQL = {
    "r_tree_changes": """WITH x AS (SELECT source || '/' || doc_id AS path, lang, source, n_chars AS size, md5(text) AS md5 FROM documents)
SELECT path, size + CASE WHEN grown THEN 1 ELSE 0 END AS size, CASE WHEN grown THEN md5(md5 || 'grown') ELSE md5 END AS md5, CASE WHEN source = 'src3' THEN 'deleted' ELSE 'active' END AS status, CASE WHEN source <> 'src3' THEN 'pending' END AS state
FROM (SELECT *, lang = 'de' AND source <> 'src3' AS grown FROM x) t WHERE lang <> 'fr' OR source <> 'src3'""",
}
