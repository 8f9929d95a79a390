"""Event streams: windows, sessions, late rows, duplicates and machines with a state of their own.

A query here drains what its source holds (``availableNow``) and returns the table that it wrote, so the
same code runs under a scheduler or continuously.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from knowspan.session import shared_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """The events as a stream of files, with an event time that watermarks take."""
    reader = spark.readStream.schema(EVENTS)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run the stream to its end and read what it wrote. Complete results replace the table, others are added to it."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    kind = "overwrite" if mode == "complete" else "append"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode(kind).parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/*")


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", "2 days").groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, key: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", "1 day").groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def distinct_within(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def streaks(events: DataFrame, least: int = 5) -> DataFrame:
    """Per user the longest run without a view so far; the run itself is the state. Rows of a batch are taken in order of event_id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, best = state.get if state.exists else (0, 0)
        for kind in pd.concat(list(batches)).sort_values("event_id")["event_type"]:
            run = 0 if kind == "view" else run + 1
            best = max(best, run)
        state.update((run, best))
        yield pd.DataFrame({"user_id": [key[0]], "best": [best], "open": [best >= least]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, best bigint, open boolean", "run bigint, best bigint", "update", GroupStateTimeout.NoTimeout)


def q_tumbling(spark, d):
    return drain(tumbling(source(spark, d)), "complete", "tumbling").select(F.to_date("w.start").alias("day"), "event_type", "n")


def q_sliding(spark, d):
    return drain(sliding(source(spark, d)), "complete", "sliding").select(F.to_date("w.start").alias("day"), "n")


def q_sessions(spark, d):
    return drain(session_counts(source(spark, d)), "complete", "sessions").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def q_distinct(spark, d):
    return drain(distinct_within(source(spark, d), ["user_id", "event_type"]).select("user_id", "event_type"), "append", "distinct").groupBy("event_type").agg(F.count("*").alias("users"))


def q_streaks(spark, d):
    return drain(streaks(source(spark, d)), "update", "streaks").groupBy("user_id").agg(F.max("best").alias("best"), F.max("open").alias("open"))


QUERIES = {"r_stream_tumbling": q_tumbling, "r_stream_sliding": q_sliding, "r_stream_sessions": q_sessions, "r_stream_distinct": q_distinct, "r_stream_streaks": q_streaks}
SQL = {
    "r_stream_tumbling": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "r_stream_sliding": "SELECT day, count(*) AS n FROM (SELECT unnest([ts::DATE, (ts::DATE - 1)::DATE]) AS day FROM events) t GROUP BY 1",
    "r_stream_sessions": "SELECT user_id, 1 + count(*) FILTER (WHERE gap) AS sessions, count(*) AS events FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE AS gap FROM events) t GROUP BY 1",
    "r_stream_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "r_stream_streaks": "WITH r AS (SELECT user_id, event_type, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events), n AS (SELECT user_id, run, count(*) FILTER (WHERE event_type <> 'view') AS k FROM r GROUP BY 1, 2) SELECT user_id, max(k) AS best, max(k) >= 5 AS open FROM n GROUP BY 1",
}
