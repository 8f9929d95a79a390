"""Outputs by digest: nothing twice, damage found."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from knowspan.sources import outputs as O


def test_publish_once_and_verify(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([(1, "a", None), (2, None, 0.5), (2, None, 0.5)], "i int, t string, x double")
    folder, written = O.publish(rows, root, "rows", "r1", "2024-01-01")
    assert written and O.publish(rows.orderBy(F.desc("i")).repartition(3), root, "rows", "r1", "2024-01-02") == (folder, False)
    held = sorted(glob.glob(f"{tmp_path}/**", recursive=True))
    assert O.publish(rows, root, "rows", "r1", "2024-01-03") == (folder, False)
    assert sorted(glob.glob(f"{tmp_path}/**", recursive=True)) == held and not glob.glob(f"{tmp_path}/rows/.stage*")
    other, written = O.publish(rows.distinct(), root, "rows", "r2", "2024-01-03")
    assert written and other != folder
    O.publish(rows.limit(0), root, "none", "r2", "2024-01-03")
    assert [(r.run, r.name, r.rows) for r in O.ledger(spark, root).orderBy("run", "name").collect()] == [("r1", "rows", 3), ("r2", "none", 0), ("r2", "rows", 2)]
    assert [r.ok for r in O.verify(spark, root).collect()] == [True, True, True]
    spoilt = glob.glob(f"{folder[7:]}/*.parquet")[0]
    raw = bytearray(open(spoilt, "rb").read())
    raw[len(raw) // 3] ^= 1
    open(spoilt, "wb").write(raw)
    assert sorted(r.digest for r in O.verify(spark, root).where("not ok").collect()) == [folder.rsplit("/", 1)[1]]


def test_rows_that_change_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        O.publish(spark.range(5).select(F.udf(lambda i: os.urandom(8).hex())("id").alias("u")), f"file://{tmp_path}", "u", "r", "2024-01-01")
    assert not glob.glob(f"{tmp_path}/u/*") and not glob.glob(f"{tmp_path}/u/.stage*")


def test_a_day_without_picks(spark):
    days = spark.sql("select date'2024-01-02' as day, 0L as entries, cast(null as double) as quality")
    picks = spark.createDataFrame([], "day date, pos int, title string, path string, domain string, quality double, out_of_pool boolean, reason string")
    row = O.daily_report(days, picks).first()
    assert row.markdown == "# Daily report 2024-01-02\n\n- new entries: 0\n\n## Worth reading\n- no picks today\n" and "<li>no picks today</li>" in row.html
