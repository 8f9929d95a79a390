"""Machines with a state for each key and event-time timers: cooling, decay and reviews.

A machine sees the rows of its key in a batch, keeps a value between batches and asks for a timer; Spark calls it
when the watermark has passed the timer, whether or not the key has new rows. State lies in RocksDB under the stream's
checkpoint, so a key costs memory only while it is worked on. Draining a stream gives what the batch functions of
``operators.attention`` give at the time of its last watermark.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from knowspan.config import Attention
from knowspan.session import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Machines reckon in microseconds and days since 1970, which no time zone of a worker can shift.
_HOUR, _DAY = 3_600_000_000, 86_400_000_000


class Machine(StatefulProcessor):
    """One value of state; a subclass has ``STATE``, ``OUT`` and the two steps."""

    STATE = OUT = ""
    #: Columns of OUT that hold microseconds and are handed on as timestamps.
    TIMES: tuple[str, ...] = ()

    def __init__(self, settings: Attention = Attention()):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.STATE)

    def held(self):
        return self.state.get() if self.state.exists() else None

    def timer(self, at: int) -> None:
        """The only timer of the key; timers are in milliseconds and never early."""
        at = -(-at // 1000)
        for old in list(self.handle.listTimers()):
            if old != at:
                self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Cooling(Machine):
    """(doc_id, at): a document cools from its first entry on, once, and is released when its time is over."""

    STATE = "entered_at bigint, released boolean"
    OUT = "doc_id bigint, step int, entered_at bigint, release_at bigint, status string"
    TIMES = ("entered_at", "release_at")

    def row(self, key, entered: int, released: bool) -> Row:
        return Row(doc_id=key[0], step=int(released), entered_at=entered, release_at=entered + self.settings.cooling_hours * _HOUR, status="released" if released else "cooling")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(r.us for r in rows)
        held = self.held()
        if held is None or not held[1] and first < held[0]:
            self.state.update((first, False))
            self.timer(first + self.settings.cooling_hours * _HOUR)
            yield self.row(key, first, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entered, _ = self.held()
        self.state.update((entered, True))
        yield self.row(key, entered, True)


class Decay(Machine):
    """(doc_id, at): touches. A document gets warm and then cold as days pass after the last one; it doesn't come back."""

    STATE = "last bigint, touches bigint, lifecycle string"
    TIMES = ("last_touched_at",)
    OUT = "doc_id bigint, step bigint, last_touched_at bigint, touch_count bigint, lifecycle string"

    def after(self, last: int, days: int) -> int:
        """When the date is more than ``days`` after that of ``last``."""
        return (last // _DAY + days + 1) * _DAY

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, touches, lifecycle = self.held() or (None, 0, None)
        for r in rows:
            last, touches = r.us if last is None else max(last, r.us), touches + 1
        self.state.update((last, touches, lifecycle))
        if lifecycle != "cold":
            self.timer(self.after(last, self.settings.cold_days if lifecycle == "warm" or touches > self.settings.warm_touches else self.settings.warm_days))
        yield Row(doc_id=key[0], step=touches * 3, last_touched_at=last, touch_count=touches, lifecycle=lifecycle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, touches, _ = self.held()
        cold = timerValues.getCurrentWatermarkInMs() * 1000 >= self.after(last, self.settings.cold_days)
        if not cold:
            self.timer(self.after(last, self.settings.cold_days))
        lifecycle = "cold" if cold else "warm"
        self.state.update((last, touches, lifecycle))
        yield Row(doc_id=key[0], step=touches * 3 + (2 if cold else 1), last_touched_at=last, touch_count=touches, lifecycle=lifecycle)


class Reviews(Machine):
    """(doc_id, at, id, kind, stars): ratings and finished reviews, in order of at and id within a batch.

    Each finished review leads to the next stage and its due date by the stars known then; two or fewer archive the document. A timer tells when it is due.
    The rows of a key in one batch are sorted in memory: the source bounds them by its trigger."""

    STATE = "stars int, stage int, due int, archived boolean, waiting boolean, step bigint"
    OUT = "doc_id bigint, step bigint, stage int, due date, archived boolean, waiting boolean"

    def plan(self, stars: int | None) -> tuple[int, ...]:
        return self.settings.stages_five if stars is None or stars >= 5 else self.settings.stages_three

    def told(self, key, state: tuple) -> Row:
        _, stage, due, archived, waiting, step = state
        return Row(doc_id=key[0], step=step, stage=stage, due=None if due is None else dt.date(1970, 1, 1) + dt.timedelta(days=due), archived=archived, waiting=waiting)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stars, stage, due, archived, waiting, step = self.held() or (None, 0, None, False, False, 0)
        for r in sorted(rows, key=lambda r: (r.us, r.id)):
            if r.kind == "stars":
                stars = r.stars
            elif not archived:
                archived, waiting = stars is not None and stars <= 2, False
                if archived:
                    due = None
                else:
                    plan = self.plan(stars)
                    stage = min(stage + 1, len(plan) - 1)
                    due = r.us // _DAY + plan[stage]
        state = (stars, stage, due, archived, waiting, step + 1)
        self.state.update(state)
        if due is not None and not waiting:
            self.timer(due * _DAY)
        else:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        yield self.told(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stars, stage, due, archived, _, step = self.held()
        state = (stars, stage, due, archived, True, step + 1)
        self.state.update(state)
        yield self.told(key, state)


def run(rows: DataFrame, key: str, machine: Machine, late: str = "0 seconds") -> DataFrame:
    """The stream of what a machine tells. ``rows`` has at, the event time, that the watermark follows."""
    rows.sparkSession.conf.set(PROVIDER, ROCKS)  # the only store that such machines can use
    times = [c for c, kind in rows.dtypes if kind == "timestamp" and c != "at"]
    rows = rows.withColumns({"us": F.unix_micros("at")} | {c: F.unix_micros(c) for c in times})
    told = rows.withWatermark("at", late).groupBy(key).transformWithState(machine, machine.OUT, "append", "eventTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in machine.TIMES})


def drain(told: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run the stream over what its source holds and read everything told so far. With the same ``folder`` the state goes on."""
    folder = folder or shared_folder(told.sparkSession, name)
    query = told.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return told.sparkSession.read.schema(told.schema).parquet(f"{folder}/out")


def last_told(told: DataFrame, key: str = "doc_id") -> DataFrame:
    return told.groupBy(key).agg(F.max_by(F.struct(*told.columns), "step").alias("_r")).select("_r.*")


# --- queries over the driver's tables -------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    from knowspan.streaming.events import source

    return source(spark, d)


def q_cooling(spark, d):
    seen = _events(spark, d).where("event_type = 'view'").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("at"))
    return last_told(drain(run(seen, "doc_id", Cooling()), "cooling")).select("doc_id", F.col("entered_at").cast("timestamp_ntz").alias("entered_at"), "status")


def q_decay(spark, d):
    orders = spark.readStream.schema(spark.read.parquet(f"{d}/orders.parquet").schema).parquet(f"{d}/order[s].parquet")
    touches = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return last_told(drain(run(touches, "doc_id", Decay()), "decay")).select("doc_id", F.to_date("last_touched_at").alias("last"), "touch_count", "lifecycle")


def q_reviews(spark, d):
    kind = F.when(F.col("event_type") == "click", "stars").when(F.col("event_type") == "purchase", "done")
    rows = _events(spark, d).select(F.col("user_id").alias("doc_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"), kind.alias("kind"), (F.col("event_id") % 5 + 1).cast("int").alias("stars")).where("kind is not null")
    return last_told(drain(run(rows, "doc_id", Reviews()), "reviews")).select("doc_id", "stage", "due", "archived", "waiting")


QUERIES = {"r_cooling_machine": q_cooling, "r_decay_machine": q_decay, "r_review_machine": q_reviews}
SQL = {
    "r_cooling_machine": "WITH v AS (SELECT * FROM events WHERE event_type = 'view') SELECT user_id AS doc_id, min(ts) AS entered_at, CASE WHEN min(ts) + INTERVAL 48 HOURS <= (SELECT max(ts) FROM v) THEN 'released' ELSE 'cooling' END AS status FROM v GROUP BY 1",
    "r_decay_machine": """WITH t AS (SELECT o_custkey AS doc_id, max(o_orderdate)::DATE AS last, count(*) AS touch_count, (SELECT max(o_orderdate)::DATE FROM orders) AS now FROM orders GROUP BY 1)
SELECT doc_id, last, touch_count, CASE WHEN now - last > 180 THEN 'cold' WHEN now - last > 90 AND touch_count <= 1 THEN 'warm' END AS lifecycle FROM t""",
    "r_review_machine": """WITH RECURSIVE e AS (SELECT user_id, ts, event_type = 'click' AS rating, (event_id % 5 + 1)::INTEGER AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('click', 'purchase')),
m AS (SELECT user_id, 0::BIGINT AS n, NULL::INTEGER AS stars, 0 AS stage, NULL::DATE AS due, false AS archived FROM (SELECT DISTINCT user_id FROM e) u
  UNION ALL SELECT user_id, pos, CASE WHEN rating THEN s ELSE stars END, CASE WHEN done THEN next ELSE stage END,
    CASE WHEN rating OR archived THEN due WHEN done THEN day + CASE WHEN five THEN [1, 3, 7, 14, 30][next + 1] ELSE [1, 3, 7][next + 1] END END, archived OR NOT rating AND coalesce(stars <= 2, false)
  FROM (SELECT m.*, e.ts::DATE AS day, e.rating, e.s, e.n AS pos, coalesce(stars >= 5, true) AS five, NOT rating AND NOT archived AND coalesce(stars > 2, true) AS done,
    least(stage + 1, CASE WHEN coalesce(stars >= 5, true) THEN 4 ELSE 2 END) AS next FROM m JOIN e ON e.user_id = m.user_id AND e.n = m.n + 1) x)
SELECT user_id AS doc_id, stage, due, archived, coalesce(due <= (SELECT max(ts) FROM e), false) AS waiting FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
}
