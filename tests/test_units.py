"""Boundary cases of kernels, predicates and small languages."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knowspan.config import Attention, Gate, gate_issues, load
from knowspan.functions import expressions as X
from knowspan.functions import kernels as K
from knowspan.operators import attention, gates, relations, search, sessions, windows
from knowspan.plans.query import aliases_of, parse
from knowspan.sources import files


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'string'}" for n, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("y")).first()["y"]


def test_query_language():
    q = parse('graph "two words" title:intro tag:ml -draft gh', {"gh": "tag:github gh extra"})
    assert (q.text, q.title, q.tags, q.exclude) == ("graph two words gh extra", ["intro"], ["ml", "github"], ["draft"])
    assert q.recall == "graph two words gh extra intro"
    assert parse("a", {"a": "b", "b": "a"}).text == "a"  # a loop of aliases ends
    assert parse("title: -").title == [] and parse("title:gh", {"gh": "x"}).title == ["gh"]
    assert aliases_of("{bad") == {} and aliases_of('{"a": "b", "c": 1}') == {"a": "b"}


def test_settings():
    assert load(Gate, "nonsense") == Gate() and load(Gate, '{"min_size": 10, "min_chars": "x"}') == Gate(min_size=10)
    assert load(Attention, '{"stages_five": [1, 2]}').stages_five == (1, 2)
    assert ("exclude_dirs", "a/b has a slash and can't match a segment") in gate_issues(Gate(exclude_dirs=("a/b",)))
    assert [f for f, _ in gate_issues(Gate(min_size=-1, code_ratio=2.0))] == ["min_size", "code_ratio"]


@pytest.mark.parametrize(
    "path, size, text, gate, passed, rule",
    [
        ("/r/a.md", 511, "x" * 400, Gate(), False, "minSize"),
        ("/r/a.md", 512, "x" * 300, Gate(), True, None),
        ("/r/a.md", 512, "x" * 299, Gate(), False, "minChars"),
        ("/r/AGENTS.md", 1, "", Gate(), True, None),
        ("/r/my-PRD.md", 1, "", Gate(), True, None),
        ("/r/my-PRD.md", 1, "", Gate(blacklist=("prd",)), True, None),
        ("/r/my-prd.md", 1, "", Gate(blacklist=("prd",)), False, "blacklist"),
        ("/r/x/a.md", 1, "", Gate(path_whitelist=("/r/x",), blacklist=("a.md",)), True, None),
        ("/r/a.md", 1, "", Gate(enabled=False), True, None),
        ("/r/a.md", 999, "y" * 300 + "\n```\n" + "z\n" * 40 + "```", Gate(), False, "codeRatio"),
        ("/r/a.md", 1, "", Gate(min_size=None, min_chars=None, code_ratio=None), True, None),
    ],
)
def test_gate(spark, path, size, text, gate, passed, rule):
    v = one(spark, gates.decide(F.col("p"), F.col("n"), F.col("t"), gate), p=path, n=size, t=text)
    assert (v.passed, v.rule) == (passed, rule)


def test_gate_pieces(spark):
    text = "---\na: b\n---\n# Head\n* one `x`\n```\ncode\n```\nend　  "
    assert one(spark, X.effective_chars("t"), t=text) == len("onexend")
    assert one(spark, gates.streamed_code_ratio(F.col("t")), t="a\n```\nb\nc\n```\nd") == 3 / 6
    bad = one(spark, gates.blacklist_hit(F.col("p"), ["/[/", "*.tmp", "zz"]), p="/a/b.tmp")
    assert bad == "*.tmp"
    for path, expected in {"/k/node_modules/a.md": True, "/k/ok/a.md": False, "/k/LICENSE": True, "/k/x.log": True, "/k/skill.md": True, "/k/skills/a.md": True}.items():
        assert one(spark, gates.excluded(F.col("p"), "/k", Gate()), p=path) is expected, path
    for url, blocked in {"http://10.1.2.3/x": True, "https://172.20.1.1": True, "ftp://a.b": True, "https://example.com/a": False, "http://localhost:80": True, "nonsense": True}.items():
        assert one(spark, gates.private_host(F.col("u")), u=url) is blocked, url


def test_expressions(spark):
    assert one(spark, X.query_of("a"), a='{"query": " x "}') == "x"
    assert one(spark, X.query_of("a"), a='{"query": "cut off in the mid') == "cut off in the mid"
    assert one(spark, X.query_of("a"), a="{}") is None
    assert one(spark, X.query_terms("q"), q="知识图 ab Abc-d 文") == ["知识", "识图", "文", "abc-d"]
    assert one(spark, X.overlap_ratio(X.query_terms("q"), F.lit("x")), q="a b") is None
    assert one(spark, X.redact("t"), t="password = abc, Bearer x.y") == "[REDACTED], [REDACTED]"
    assert one(spark, X.cosine("a", "b"), a=[1.0, 0.0], b=[-1.0, 0.0]) == -1.0
    assert one(spark, X.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0
    assert one(spark, X.cosine("a", "b"), a=[1.0], b=[1.0, 0.0]) == 0.0
    assert one(spark, X.like_escape("t"), t=r"50%_\x") == r"50\%\_\\x"
    assert one(spark, X.parse_time("t"), t="2026-01-02T03:04:05.678Z") == dt.datetime(2026, 1, 2, 3, 4, 5, 678000)
    assert one(spark, X.parse_time("t"), t="soon") is None
    assert one(spark, X.iso_week(F.to_date("t")), t="2021-01-03") == "2020-W53"
    assert one(spark, X.slug("t"), t="  Hello, World! 知识 ") == "hello-world-知识"
    assert one(spark, X.tokens_by_script("t"), t="知识abcde") == 4
    assert one(spark, search.occurrences(F.col("t"), "aa"), t="aaaa") == 3
    assert one(spark, X.extension("p"), p="/a.b/c.MD") == ".md"


def test_sessions(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at), (2, at + dt.timedelta(minutes=30)), (3, at + dt.timedelta(minutes=61)), (4, None)]
    df = spark.createDataFrame([(i, "u", t) for i, t in rows], "id bigint, u string, t timestamp_ntz")
    assert sorted((r.id, r.session) for r in sessions.sessions(df, "u", "t", "id").collect()) == [(1, 1), (2, 1), (3, 2)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 20_000), min_size=1, max_size=30))
def test_session_count_is_one_more_than_the_gaps(spark, minutes):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "u", at + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)], "id bigint, u string, t timestamp_ntz")
    ordered = sorted(minutes)
    gaps = sum(b - a > 30 for a, b in zip(ordered, ordered[1:]))
    assert sessions.sessions(df, "u", "t", "id").agg(F.max("session")).first()[0] == gaps + 1


def test_global_sessions_of_the_whole_stream(spark, duck):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    gap = "ts - lag(ts) OVER (ORDER BY ts, event_id) > INTERVAL 7 MINUTE"
    want = duck.sql(f"SELECT event_id, 1 + sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT FROM (SELECT *, {gap} AS gap FROM events) g ORDER BY 1").fetchall()
    got = sessions.global_sessions(events, "ts", "event_id", 7)
    assert sorted((r.event_id, r.session) for r in got.collect()) == want and want[-1] and len({s for _, s in want}) > 1
    at = dt.datetime(2024, 1, 1, 0, 50)
    minutes = [0, 20, 50, 81, 81 + 300, 381 + 30, 411 + 1500]  # over the hour: kept, exactly 30, 31, empty hours, exactly 30, a day
    rows = [(i, at + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)] + [(99, None)]
    few = sessions.global_sessions(spark.createDataFrame(rows, "id bigint, t timestamp_ntz"), "t", "id")
    assert few.columns == ["id", "t", "session"] and sorted((r.id, r.session) for r in few.collect()) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (6, 4)]


def test_relations(spark):
    roots = spark.createDataFrame([("/a",), ("/a/b/",)], "root string")
    paths = spark.createDataFrame([("/a/b/c",), ("/ab",), ("/a",)], "path string")
    assert {r.path: r.root for r in relations.by_prefix(paths, "path", roots, "root").collect()} == {"/a/b/c": "/a/b/", "/ab": None, "/a": "/a"}
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "k int, t int")
    assert {r.k for r in relations.chase(loop, "k", "t").collect()} == {1, 2, 3}
    active = spark.createDataFrame([("r", 1), ("r", 2), ("s", 3), ("t", 4), ("t", 5), ("t", 6)], "root string, id int")
    seen = spark.createDataFrame([("r", 1), ("t", 9)], "root string, id int")
    assert [(r.root, r.id) for r in relations.tombstones(active, seen, "root", "id", 2).collect()] == [("r", 2)]


def test_budget(spark):
    items = spark.createDataFrame([("d", i) for i in range(6)], "day string, id int")
    got = attention.capped(items, "day", [F.asc("id")]).collect()
    assert len(got) == 4 and got[0].soft_capped and not got[0].hard_capped and got[0].hidden == 2
    costs = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 3, 1)], "g string, o int, c int")
    assert [r.o for r in windows.within_budget(costs, ["g"], [F.asc("o")], "c", 10).collect()] == [1]


def test_chunks():
    text = "before\n# A\none\n## B\n```\n# no heading\n```\n~~~\n## neither\n~~~\n# C\n\n"
    assert [(n, p) for n, p, _ in K.chunks(text)] == [(0, ""), (1, "# A"), (2, "# A > ## B")]
    assert K.chunks("  \n") == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=400))
def test_titles_are_short_and_stable(text):
    once = K.clean_title(text)
    assert len(once) <= 161 and "\n" not in once
    if text[:1] not in "{[":
        assert K.clean_title(once) == once or once[:1] in "{["


def test_kernels():
    assert K.clean_title('{"x": 1, "title": "A  b"}') == "A b" and K.clean_title("{bad") == "{bad"
    assert len(K.clean_title('{"title": "' + "y" * 110_000 + '"}')) == 161
    assert K.normal_key("ＡＢ c　d") == "abcd"
    assert K.front_matter("---\ntitle: 'X'\n---\nrest") == ({"title": "X"}, "rest") and K.front_matter("---\nx") == ({}, "---\nx")
    html = "<html><head><title>T</title><link rel='canonical' href='u'></head><body><nav>no</nav><main><h1>H</h1><p>a <b>b</b></p><ul><li>x<li>y</ul><pre>c  d</pre></main></body></html>"
    assert K.html_markdown(html) == "# H\n\na **b**\n\n- x\n- y\n\n```\nc  d\n```"
    assert K.html_meta(html)[:4] == ("T", "H", None, "u")
    assert K.tolerant_json('say {"a": "b", "c": [1, 2') == {"a": "b", "c": [1, 2]}
    assert K.tolerant_json('{"a": "b", "cut') == {"a": "b"} and K.tolerant_json("none") is None
    assert K.rule_score(".md", 60_000, "# a\n## b\n## c\n|x|\n|-|\n|1|\n")[:5] == (1, 3, 2, 1, 0)
    assert K.rule_score(".md", 1, "```\n" + "x\n" * 20 + "```\ny")[4] == 2  # code alone, without a heading
    long = "# h\n" + "a" * 9000 + "\n# i\n" + "b" * 9000
    assert len(K.compress(long)) < 1200 and "# i" in K.compress(long) and K.compress("short") == "short"
    assert len(K.compress("x" * 50_000)) <= 12_288


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.md").write_text("---\ntitle: One\ndate: 2024-01-02\n---\n# Not this\nbody")
    (tmp_path / "two.md").write_text("text\n## Two\n")
    (tmp_path / "three.txt").write_text("no")
    got = {r.title: r for r in files.markdown_files(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"One", "Two"} and got["One"].date == dt.datetime(2024, 1, 2)
    records = spark.createDataFrame([(1, 'a "b", c', dt.datetime(2024, 1, 5)), (2, "line\nbreak", dt.datetime(2024, 2, 5))], "id int, note string, at timestamp")
    files.archive(records, f"file://{tmp_path}/arch", "at")
    back = files.read_archive(spark, f"file://{tmp_path}/arch", "id int, note string, at timestamp")
    assert sorted((r.id, r.note, r.month) for r in back.collect()) == [(1, 'a "b", c', "2024-01"), (2, "line\nbreak", "2024-02")]
    assert [r.id for r in files.read_archive(spark, f"file://{tmp_path}/arch", "id int, note string, at timestamp", "BREAK", "2024-02").collect()] == [2]
    (tmp_path / "g.json").write_text('{"samples": [{"type": "gate", "source": "x", "expected": "pass"}, {"type": "gate", "source": "x"}, {"type": "distill", "source": "y", "mustInclude": ["k"]}, {"type": "odd", "source": "z"}]}')
    assert sorted(r.issue or "" for r in files.golden(spark, f"file://{tmp_path}/g.json").collect()) == ["", "", "no expectation", "unknown type"]
    assert one(spark, files.vectors_of_text("t"), t="[1.5, 2]") == [1.5, 2.0]


def test_fusion_ignores_the_order_of_routes(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc_id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "doc_id int, rank int")
    x = {r.doc_id: round(r.base, 12) for r in search.fuse([a, b], "doc_id").collect()}
    assert x == {r.doc_id: round(r.base, 12) for r in search.fuse([b, a], "doc_id").collect()} and max(x, key=x.get) == 2
