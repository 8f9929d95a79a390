"""Machines, trees and their changes, against batch functions and plain walks."""

import datetime as dt
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from knowspan.config import Attention, Gate
from knowspan.operators import attention
from knowspan.session import shared_folder
from knowspan.sources import tree as source
from knowspan.streaming import machines, tree

T = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
AT = lambda h: T + dt.timedelta(hours=h)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def put(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/n={n}")


def test_cooling_over_batches(spark):
    folder, schema = shared_folder(spark, "t"), "doc_id bigint, at timestamp"
    batches = [[(1, AT(0)), (2, AT(5)), (1, AT(2))], [(2, AT(3)), (3, AT(20))], [(1, AT(60)), (4, AT(51))]]
    for n, b in enumerate(batches):
        put(spark, folder, n, b, schema)
        told = machines.drain(machines.run(stream(spark, folder, schema), "doc_id", machines.Cooling(), "10 hours"), "c", folder)
    now = F.lit(AT(50)).cast("timestamp")  # the watermark: ten hours before the last row
    entered = spark.createDataFrame([r for b in batches for r in b], "doc_id bigint, entered_at timestamp")
    pool = attention.release(attention.enter_cooling(spark.createDataFrame([], "doc_id bigint, entered_at timestamp, release_at timestamp, status string"), entered), now)
    assert {(r.doc_id, r.status, r.release_at) for r in machines.last_told(told).collect()} == {(r.doc_id, r.status, r.release_at) for r in pool.collect()}


def test_decay_over_batches(spark):
    folder, schema = shared_folder(spark, "t"), "doc_id bigint, at timestamp"
    for n, b in enumerate([[(1, AT(0)), (2, AT(0)), (2, AT(30)), (3, AT(24 * 95))], [(4, AT(24 * 182))]]):
        put(spark, folder, n, b, schema)
        told = machines.drain(machines.run(stream(spark, folder, schema), "doc_id", machines.Decay()), "d", folder)
    # at day 182: touched at day 0 once, at day 1 twice, at day 95 once, just now
    assert {r.doc_id: r.lifecycle for r in machines.last_told(told).collect()} == {1: "cold", 2: "cold", 3: None, 4: None}


def test_reviews_are_next_review(spark):
    schema = "doc_id bigint, at timestamp, id bigint, kind string, stars int"
    rows = [(1, AT(0), 1, "stars", 5), (1, AT(1), 2, "done", None), (2, AT(1), 3, "done", None), (3, AT(0), 4, "stars", 3), (3, AT(1), 5, "done", None), (4, AT(0), 6, "stars", 2), (4, AT(1), 7, "done", None), (9, AT(24 * 4), 8, "stars", 1)]
    folder = shared_folder(spark, "t")
    put(spark, folder, 0, rows, schema)
    got = {r.doc_id: r for r in machines.last_told(machines.drain(machines.run(stream(spark, folder, schema), "doc_id", machines.Reviews()), "r", folder)).collect()}
    stars = spark.createDataFrame([(d, i, s) for d, _, i, k, s in rows if k == "stars"], "doc_id bigint, id bigint, stars int")
    queue = spark.createDataFrame([(d, 0) for d in (1, 2, 3, 4)], "doc_id bigint, stage int")
    for r in attention.next_review(queue, stars, F.lit("2024-01-01").cast("date")).collect():
        assert (got[r.doc_id].archived, got[r.doc_id].due) == (r.archived, r.due) and (r.archived or got[r.doc_id].stage == r.next_stage)
    assert {d: r.waiting for d, r in got.items()} == {1: True, 2: True, 3: True, 4: False, 9: False}


def write(root, path, text="x"):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "w") as f:
        f.write(text)


@pytest.fixture
def folder(tmp_path):
    root = str(tmp_path)
    for path in ("a.md", "sub/b.HTML", "sub/c.txt", "node_modules/d.md", "node_modules/keep/e.md", "sub/dist/f.md", "own/g.md", "sub/.hidden/h.md"):
        write(root, path, path * 3)
    os.symlink(f"{root}/sub", f"{root}/link")
    os.symlink(f"{root}/a.md", f"{root}/alias.md")
    return root


def test_tree(spark, folder):
    gate = Gate(path_whitelist=(f"{folder}/node_modules/keep",))
    got = {r.path: (r.size, bytes(r.head)) for r in source.tree(spark, folder, gate, head=4, own=f"{folder}/own").collect()}
    want = ["a.md", "sub/b.HTML", "node_modules/keep/e.md", "sub/.hidden/h.md"]
    assert got == {f"{folder}/{p}": (3 * len(p), p[:4].encode()) for p in want}
    assert [r.path for r in source.tree(spark, folder).where("name = 'a.md'").collect()] == [f"{folder}/a.md"]
    assert source.tree(spark, f"{folder}/nothing").collect() == []


def test_what_is_listed(folder, monkeypatch):
    seen = []
    listed = source._listed
    monkeypatch.setattr(source, "_listed", lambda f: seen.append(f) or listed(f))
    reader = source.TreeReader({"path": folder, "exclude": "node_modules,dist"})
    reader.partitions()
    assert sorted(seen) == sorted([folder, f"{folder}/sub", f"{folder}/sub/.hidden", f"{folder}/own"])
    from pyspark.sql.datasource import StringStartsWith

    seen.clear()
    reader = source.TreeReader({"path": folder})
    list(reader.pushFilters([StringStartsWith(("path",), f"{folder}/sub/dist/")]))
    reader.partitions()
    assert sorted(seen) == sorted([folder, f"{folder}/sub", f"{folder}/sub/dist"])


def test_changes_of_a_tree(spark, tmp_path):
    root, state = str(tmp_path / "files"), shared_folder(spark, "t")
    when = iter(range(0, 100, 10))

    def step(n):
        tree.scan(spark, root, state, n, F.lit(AT(next(when))).cast("timestamp"))
        return {r.path: r for r in tree.follow(spark, state).collect()}

    write(root, "a.md", "one"), write(root, "b.md", "two"), write(root, "c.md", "three")
    assert step(0) == {}  # nothing has settled yet
    assert {p.removeprefix(root): r.status for p, r in step(1).items()} == {"/a.md": "active", "/b.md": "active", "/c.md": "active"}
    write(root, "a.md", "changed"), os.remove(f"{root}/b.md"), write(root, "new/d.md", "four"), write(root, "brief.md", "x")
    step(2)
    os.remove(f"{root}/brief.md")
    now = step(3)
    tree.scan(spark, root, state, 3, F.lit(AT(0)).cast("timestamp"))  # a scan that comes again is skipped
    active = {p: (r.size, r.md5) for p, r in now.items() if r.status == "active"}
    rescan = {r.path: (r.size, r.md5) for r in source.digests(source.tree(spark, root)).collect()}
    assert active == rescan and now[f"{root}/b.md"].status == "deleted"
    assert rescan[f"{root}/a.md"][1] == hashlib.md5(b"changed").hexdigest()
    write(root, "b.md", "back")
    step(4)
    assert {p for p, r in step(5).items() if r.status == "active"} == set(rescan) | {f"{root}/b.md"}


def test_a_scan_of_many_files(spark):
    """However many files wait, a call steps once, so what is written grows with the paths and not with files times paths."""
    state = shared_folder(spark, "t")
    files = spark.range(300).select(F.concat(F.lit("p"), "id").alias("path"), "id", F.col("id").alias("size"), F.lit(AT(0)).cast("timestamp").alias("mtime"))
    for n in (0, 1):
        tree.record(spark, state, n, F.lit(AT(n)).cast("timestamp"), files.repartition(100, "id"))
    assert sum(f.endswith(".parquet") for f in os.listdir(f"{state}/inbox/scan=0".removeprefix("file:"))) > 64
    got = tree.follow(spark, state, 60.0, lambda rows: rows.withColumn("md5", F.md5("path"))).collect()
    assert {(r.path, r.size, r.status) for r in got} == {(f"p{k}", k, "active") for k in range(300)}
    assert len([f for f in os.listdir(f"{state}/snapshots".removeprefix("file:")) if f.startswith("batch=")]) == 1


def test_settling_is_a_plain_walk(spark):
    """Runs of equal sightings over three batches, each path by itself."""
    r, wait, clock = random.Random(5), 3, 0
    seen, held = spark.createDataFrame([], tree.SEEN), {}
    for _ in range(3):
        times = [clock + k for k in range(1, 9)]
        rows = [(f"p{p}", at, *r.choice([(1, False), (2, False), (None, True)])) for p in range(30) for at in times if r.random() < 0.4]
        told, clock = {}, max(at for _, at, _, _ in rows)
        for path, at, *what in sorted(rows, key=lambda x: x[:2]):
            run = held.get(path)
            if run is None or run[0] != what:
                if run and not run[2] and run[1] + wait <= at:
                    told[path] = (run[1], *run[0])
                held[path] = [what, at, False]
        for path, run in held.items():
            if not run[2] and run[1] + wait <= clock:
                told[path], run[2] = (run[1], *run[0]), True
        sightings = spark.createDataFrame([(p, T + dt.timedelta(seconds=at), size, None, gone) for p, at, size, gone in rows], tree.SIGHTING)
        seen = tree.next_seen(seen, sightings, float(wait)).localCheckpoint()
        second = lambda t: round((t.astimezone(dt.timezone.utc) - T).total_seconds())
        got = seen.collect()
        assert {x.path: [[x.size, x.gone], second(x.since), x.told] for x in got} == held
        assert {x.path: (second(x.settled.at), x.settled.size, x.settled.gone) for x in got if x.settled} == told


def test_external_entries(spark, tmp_path):
    root = str(tmp_path)
    write(root, "one.md", "# One\n**来源**: a.md\n\nSome text\n\n最后更新: 2024-05-01\n"), write(root, ".git/two.md", "# Two"), write(root, ".x/three.md", "# Three")
    got = source.external_entries(spark, root).collect()
    assert [(r.path, r.title, r.source, r.updated, r.summary) for r in got] == [(f"{root}/one.md", "One", "a.md", "2024-05-01", "Some text")]
