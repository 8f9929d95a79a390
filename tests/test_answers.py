"""Answers of models: stated fixtures, and what must not be read."""

import json

import pytest
from pyspark.sql import functions as F

from knowspan.functions import answers as A


def read(spark, texts, use):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", use(F.col("t")).alias("v"))
    return [v for _, v in sorted(((r.i, r.v) for r in rows.collect()), key=lambda p: p[0])]


def as_json(use):
    return lambda t: F.to_json(use(t))


def test_strict(spark):
    good = ['{"a":1}', " [1,2] ", '"x"', "5", "null", "[]"]
    bad = ['{"a":1} x', 'x {"a":1}', '{"a":1}}', '{"a":1}],[', '{"a":1},0],[', "1,2", "", None, '{"a":tru', "{'a':1}", "],["]
    kinds = read(spark, good + bad, lambda t: A.kind(A.strict(t)))
    assert kinds == ["OBJECT", "ARRAY", "STRING", "BIGINT", "VOID", "ARRAY"] + [None] * len(bad)


def test_located(spark):
    groups = '{"groups":[{"canonical":"RAG","members":["RAG 检索"],"reason":"同义"}]}'
    texts = [
        '{"groups":[{"canonical":"金融监管","members":["银保监会"],"reason":"银保监会为机构，"银保监会监管"为从属，归入"金融监管""},{"canonical":"错误处理","members":["错误码处理","错误码排查"],"reason":"变体"}]}',
        '{"groups":[{"canonical":"AI Agent","members":["AI 代理"],"reason":"归入"AI Agent""}]}',
        '{"groups":[{"canonical":"RAG","members":["RAG 检索"],"reason":"引用 \\"锚点\\" 属正常转义"}]}',
        '{"groups":[{"canonical":"RAG","members":["RAG 检',
        "模型拒绝输出",
        f"```json\n{groups}\n```",
        f"好的，以下是结果：{groups}",
        '[{"canonical":"RAG"}]',
        None,
    ]
    found = [v and json.loads(v) for v in read(spark, texts, as_json(A.located))]
    assert [len(f["groups"]) if isinstance(f, dict) else f for f in found] == [2, 1, 1, None, None, 1, 1, [{"canonical": "RAG"}], None]
    assert found[0]["groups"][1]["members"] == ["错误码处理", "错误码排查"] and "金融监管" in found[0]["groups"][0]["reason"]
    assert found[2]["groups"][0]["reason"] == '引用 "锚点" 属正常转义'


def plain_bare(text):
    """Quote by quote, as a reader would."""
    out, inside, i = "", False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and inside:
            out, i = out + text[i : i + 2], i + 2
            continue
        if c == '"':
            rest = text[i + 1 :].lstrip(" \n\t")
            if not inside:
                inside = True
            elif not rest or rest[0] in ",}]:":
                inside = False
            else:
                c = '\\"'
        out, i = out + c, i + 1
    return out


def test_bare_quotes(spark):
    texts = ['{"a":"b"}', '"a "b" c"', '{"a": "x"y" , "b":"\\"z\\"" }', '"open', '""""', "", '{"a":"b" \n }', '"a" "b" ', '{"k":"' + 'w "q" ' * 200 + '"}']
    assert read(spark, texts, A.bare_quotes) == [plain_bare(t) for t in texts]


def test_entry(spark):
    texts = [
        '\n{"title":"NeoData","summary":"数据查询服务，81 个工具。","points":["81 个","支持 output_fields 裁',
        '{"title":"标题完整","summary":"摘要写到一半被截',
        '\n\n```json\n{"title":"围栏样本","summary":"摘要"}\n```',
        "抱歉，内容过长。",
        json.dumps({"title": 5, "tags": ["a", " b ", "", 3, "c", "d", "e"], "importance": "huge", "hook": {"text": "x" * 50, "verdict": "y" * 50, "action": "must_read"}, "points": ["p", " ", 1], "entities": [{"n": "N"}, {"t": "x"}, 3], "relations": [{"a": "A", "b": "B"}, {"a": "A"}]}),
        '{"points":["a',
    ]
    rows = read(spark, texts, A.entry)
    assert (rows[0].title, rows[0].summary, rows[0].points) == ("NeoData", "数据查询服务，81 个工具。", [])
    assert (rows[1].title, rows[1].summary) == ("标题完整", "摘要写到一半被截")
    assert rows[2].title == "围栏样本" and rows[2].hook is None and rows[2].importance == "useful"
    assert rows[3].title == rows[3].summary == "" == rows[5].title and rows[3].tags == []
    full = rows[4]
    assert full.title == "5" and full.tags == ["a", "b", "c", "d"] and full.importance == "useful" and full.points == ["p"]
    assert tuple(full.hook) == ("x" * 30, "y" * 20, "keep")
    assert [tuple(e) for e in full.entities] == [("N", "")] and [tuple(r) for r in full.relations] == [("A", "相关", "B", None)]


def test_answer(spark):
    texts = ['{"answer":"yes"}', '```json\n{"answer":"fenced"}\n```', '{"other":" ","text":"second"}', '{"answer":"cut off', '{"answer":"cut "} ', "plain words ", '{"answer": 3}', None]
    assert read(spark, texts, A.answer) == ["yes", "fenced", "second", "cut off", "cut ", "plain words", '{"answer": 3}', None]


def test_quiz(spark):
    q = lambda **k: {"type": "short", "question": " Q ", "answer": "A", **k}
    texts = [
        json.dumps({"questions": [q(), q(type="essay"), q(answer=" "), q(type="choice", options=["a"]), q(type="choice", options=["a", "b", " "], sources=[3, "4", 0, "x"])]}),
        json.dumps({"questions": [q() for _ in range(12)]}),
        json.dumps({"questions": [q(question="")]}),
        "no quiz",
    ]
    found = read(spark, texts, A.quiz)
    assert [x.type for x in found[0]] == ["short", "choice"] and found[0][0].question == "Q" and found[0][0].options is None
    assert found[0][1].options == ["a", "b"] and found[0][1].sources == [3, 4]
    assert len(found[1]) == 8 and found[2:] == [None, None]


def stored(**k):
    claim = {"claim": "c", "status": "active", "evidence": ["read_log:12"], "confidence": 0.5}
    return json.dumps({"schema_version": "1", "role_pattern": "r", "claims": [claim | k.pop("claim", {})], **k})


@pytest.mark.parametrize("bad", [{"schema_version": 1}, {"role_pattern": 3}, {"claims": "x"}, {"claim": {"claim": " "}}, {"claim": {"status": "gone"}}, {"claim": {"evidence": ["Read:1"]}}, {"claim": {"evidence": "x"}}, {"claim": {"confidence": 1.5}}, {"claim": {"confidence": "high"}}])
def test_profile_is_read_whole_or_not(spark, bad):
    fine, rejected = read(spark, [stored(portrait="p"), stored(**bad)], A.profile)
    assert fine.portrait == "p" and fine.claims[0].evidence == ["read_log:12"] and rejected is None


def test_fresh_profile(spark):
    claim = {"claim": " c ", "evidence_refs": ["E1"], "confidence": 0.8}
    base = {"role_pattern": "r", "claims": [claim], "domains": [{"domain": "d", "proficiency": "expert", "claims": [claim]}]}
    texts = [json.dumps(base), json.dumps(base | {"claims": [claim | {"evidence_refs": ["E9"]}]}), json.dumps(base | {"domains": [{"domain": "d", "proficiency": "guru", "claims": []}]}), json.dumps({"role_pattern": "r", "claims": []})]
    known = F.create_map(F.lit("E1"), F.lit("file:1"))
    found = read(spark, texts, lambda t: A.fresh_profile(t, known))
    assert found[0].claims[0].claim == "c" and found[0].claims[0].evidence == ["file:1"]
    assert [c.claim for c in found[0].domains[0].claims] == ["proficiency: expert", "c"] and found[0].domains[0].claims[0].confidence == 0.8
    assert found[1] is None and found[2] is None and found[3].domains == []
