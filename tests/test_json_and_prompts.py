import json

from tessera.functions import jsonx
from tessera.functions import promptx
from tessera.operators import scoring


def test_dialects():
    a = lambda x: jsonx.answer(jsonx.record(json.dumps(x)))
    assert a({"choices": [{"message": {"content": "x"}}]}) == "x"
    assert a({"choices": [{"message": {"content": " ", "reasoning": "r"}, "text": "t"}]}) == "r"
    assert a({"choices": [{"text": "t"}]}) == "t"
    assert a({"choices": [None], "content": [{"type": "text", "text": "c"}]}) is None
    assert a({"candidates": [{"content": {"parts": [{"text": "a"}, {}, {"text": "b"}]}}]}) == "ab"
    assert a({"content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "c"}, None, 5]}) == "c"
    assert a({}) is None and jsonx.answer(None) is None
    assert jsonx.record('{"a":1} tail') is None and jsonx.record("[1]") is None and jsonx.record(None) is None


def test_output_object():
    f = jsonx.output_object
    assert f('noise {ok} {"a": {"b": 1}} and {"c": 1}') == {"a": {"b": 1}}
    assert f('```json\n{"a": "}{"}\n```') == {"a": "}{"}
    assert f('{"a": {"b": 1}, "c": "cut') is None and f('{"a": {"b": 1}, "c" [cut]') is None
    assert f("") is None and f(None) is None and f("plain") is None


def test_parse_output():
    p = scoring.parse_output
    assert p('{"a":1}') == ({"a": 1}, None)
    assert p("```json\n{\"a\":1}\n```")[0] == {"a": 1} and p("```\n{\"a\":1}\n```")[0] == {"a": 1}
    assert p('x {"a":1} y {"b":1,"c":2} z')[0] == {"b": 1, "c": 2}
    assert p(None) == p("  ") == (None, "empty output")
    assert p("[1]") == (None, "no valid JSON object found")


def test_rules():
    good = {"analysis_summary": {}, "user_intent": {}, "paid_reaction": {}, "ai_performance": {}, "rolling_summary": "s", "memory_snapshot": {k: [] for k in scoring.MEMORY_LIMITS}}
    assert scoring.rule_checks(good) == (True,) * 5
    assert scoring.rule_checks(None) == (False,) * 5
    assert not scoring.rule_checks(good | {"user_intent": "x"})[1]
    assert scoring.rule_checks(good | {"rolling_summary": "x" * 2000})[3] and not scoring.rule_checks(good | {"rolling_summary": "x" * 2001})[3]
    memory = lambda **k: good | {"memory_snapshot": {c: [] for c in scoring.MEMORY_LIMITS} | k}
    assert not scoring.rule_checks(memory(facts=[str(k) for k in range(11)]))[4]
    assert not scoring.rule_checks(memory(facts=["Likes tea!", "likes  TEA"]))[4]
    assert not scoring.rule_checks(memory(more=[]))[2]
    assert scoring.items_of(memory(active_events=[{"content": "e"}, {"content": 3}, "s", 5])) == [("active_events", "e"), ("active_events", "s")]


def test_sections(spark):
    from pyspark.sql import functions as F

    text = "## ROLE\nr\n\n## USER BASIC INFORMATION\n- Name: A, Gender: X\n- Account: 1\n\n## OLD MEMORY SNAPSHOT\n{}\n"
    assert promptx.sections(text)["USER BASIC INFORMATION"].startswith("- Name: A")
    assert "Account" in promptx.body(text) and "ROLE" not in promptx.body(text) and promptx.body(None) == ""
    got = spark.createDataFrame([(text,), ("no heads",), (None,)], "p string").select(promptx.section(F.col("p"), promptx.USER_TITLES)).collect()
    assert got[0][0].strip() == "- Name: A, Gender: X\n- Account: 1" and got[1][0] is None and got[2][0] is None
