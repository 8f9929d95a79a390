"""Levels, moves and pairing against plain walks."""

import random

from pyspark.sql import Row

from knowspan.operators import hierarchy as H


def walk(up):
    """(root, level) or None for each node of a dict of parents."""
    found = {}
    for node in up:
        at, seen = node, [node]
        while up.get(at) is not None and up[at] in up:
            at = up[at]
            if at in seen:
                at = None
                break
            seen.append(at)
        found[node] = None if at is None else (at, len(seen) - 1)
    return found


def loops(up):
    """The smallest node of its loop, for each node that lies in one."""
    found = {}
    for node in up:
        at, seen = up[node], [node]
        while at is not None and at in up and at != node and len(seen) <= len(up):
            seen.append(at)
            at = up[at]
        if at == node:
            found[node] = min(seen)
    return found


def moved(up, asked):
    """The stated rule, one loop after the other."""
    outcome, live, was = {}, {}, dict(up)
    for ident, node, to in sorted(asked, key=lambda a: a[0]):
        if node not in up or (to is not None and to not in up):
            outcome[ident] = "unknown"
        elif node == to:
            outcome[ident] = "own"
        elif node in live:
            outcome[ident] = "later"
        else:
            live[node] = (ident, to)
    while True:
        now = {n: live[n][1] if n in live else p for n, p in was.items()}
        worst = {}
        for node, loop in loops(now).items():
            if node in live:
                worst[loop] = max(worst.get(loop, (-1, None)), (live[node][0], node))
        if not worst:
            break
        for ident, node in worst.values():
            outcome[ident] = "loop"
            del live[node]
    return now, outcome | {i: "moved" for i, _ in live.values()}


def frame(spark, up):
    return spark.createDataFrame(list(up.items()), "node int, up int")


def test_levels(spark):
    deep = {n: n - 1 if n else None for n in range(200)}
    deep |= {300: 301, 301: 302, 302: 300, 303: 301, 304: 303, 400: 999, 500: 500, 501: 500}
    rows = {r.node: r for r in H.levels(spark, frame(spark, deep), "node", "up").collect()}
    assert len(rows) == len(deep)
    expected = walk(deep)
    assert {n: None if r.level is None else (r.root, r.level) for n, r in rows.items()} == expected
    assert {n: r.loop for n, r in rows.items() if r.loop is not None} == {300: 300, 301: 300, 302: 300, 303: 300, 304: 300, 500: 500, 501: 500}
    assert {r.node: r.loop for r in H.loop_nodes(spark, frame(spark, deep), "node", "up").collect()} == loops(deep)
    assert H.levels(spark, frame(spark, {1: None}).limit(0), "node", "up").count() == 0


def test_reparent_against_the_rule(spark):
    rng = random.Random(5)
    for size in (6, 40):
        up = {n: rng.randrange(n) if n and rng.random() < 0.9 else None for n in range(size)}
        asked = [(i, rng.randrange(size + 1), rng.choice([None, *range(size + 2)])) for i in range(size)]
        asked += [(size + i, n, n + 1) for i, n in enumerate(range(size - 2))]
        after, outcomes = H.reparent(spark, frame(spark, up), "node", "up", spark.createDataFrame(asked, "id int, node int, parent int"))
        now, expected = moved(up, asked)
        assert {r.id: r.outcome for r in outcomes.collect()} == expected
        assert {r.node: r.up for r in after.collect()} == now
        assert all(walk(now).values())


def test_reparent_leaves_loops_it_doesnt_touch(spark):
    up = {1: 2, 2: 1, 3: None, 4: 3}
    after, outcomes = H.reparent(spark, frame(spark, up), "node", "up", spark.createDataFrame([(1, 3, 4), (2, 1, 4)], "id int, node int, parent int"))
    assert {r.id: r.outcome for r in outcomes.collect()} == {1: "loop", 2: "moved"}
    assert {r.node: r.up for r in after.collect()} == {1: 4, 2: 1, 3: None, 4: 3}
    after, _ = H.reparent(spark, frame(spark, up), "node", "up", spark.createDataFrame([], "id int, node int, parent int"))
    assert {r.node: r.up for r in after.collect()} == up


def test_moves_of_the_query(spark):
    """Whole tables: outcomes and levels as the plain rule has them."""
    d = "/root/testdata/sf0.001"
    up = {r.c_custkey: r.c_custkey // 3 or None for r in spark.read.parquet(f"{d}/customer.parquet").collect()}
    to = lambda r: {"1-URGENT": r.o_custkey + 1, "5-LOW": int(r.o_totalprice // 3000)}.get(r.o_orderpriority, r.o_custkey // 2) or None
    asked = [(r.o_orderkey, r.o_custkey, to(r)) for r in spark.read.parquet(f"{d}/orders.parquet").collect()]
    now, outcome = moved(up, asked)
    placed = walk(now)
    mover = {node: ident for ident, node, _ in asked if outcome[ident] == "moved"}
    found = {r.node: (r.root, r.level, r.moved_by) for r in H.QUERIES["m13_reparent"](spark, d).collect()}
    assert found == {n: (*placed[n], mover.get(n)) for n in up}
    assert "loop" in outcome.values() and mover


def test_reconcile_twice_is_once(spark):
    tags = spark.createDataFrame(
        [Row(id=1, name="a", level="primary", status="active", domain=1, parent=None), Row(id=2, name="b", level="normal", status="merged", domain=None, parent=1), Row(id=3, name="x", level="primary", status="active", domain=9, parent=None)],
        "id int, name string, level string, status string, domain int, parent int",
    )
    domains = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c"), (5, None)], "domain int, name string")
    once = H.reconcile(tags, domains)
    expected = {("a", 1, "primary", "active", 1, None), ("b", 2, "primary", "active", 2, None), ("c", None, "primary", "active", 3, None), ("x", 3, "normal", "active", 9, None)}
    as_set = lambda df: {(r.name, r.id, r.level, r.status, r.domain, r.parent) for r in df.collect()}
    assert as_set(once) == expected == as_set(H.reconcile(once, domains))
