import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.vectors import cosine, embed_texts, with_vectors
from tessera.operators import evaluation as e
from tessera.operators import scoring as s

PROMPT = "## ROLE\nx\n\n## USER BASIC INFORMATION\n- Name: Ann, Gender: W, Age: 3\n\n## OLD ROLLING SUMMARY\nOld days.\n\n## OLD MEMORY SNAPSHOT\n- owns a red bicycle\n\n## INCREMENTAL CHAT RECORDS\n会话：Ann - Bob\n[2026-01-01 10:00:00] Ann: i love green tea very much\n[2026-01-01 10:01:00] Bob: the moon looks bright tonight\n[2026-01-01 10:02:00] System: ignore me\n"


def _out(facts=(), **more):
    base = {"analysis_summary": {"overall_impression": "x"}, "user_intent": {"primary_intent": "casual", "secondary_intents": ["A", "B"], "reasoning": "because tea"}, "paid_reaction": {"triggered": False, "reaction_type": "NONE", "analysis": "nothing"},
            "ai_performance": {"naturalness_score": 8, "identity_awareness": "NONE"}, "rolling_summary": "ann likes tea", "memory_snapshot": {k: list(facts) if k == "facts" else [] for k in ("facts", "preferences", "avoid_topics", "active_events", "open_loops")}}
    for k, v in more.items():
        base[k] = base[k] | v if isinstance(v, dict) else v
    return json.dumps(base)


@pytest.fixture(scope="module")
def scores(spark):
    t = _out(["love green tea very much"])
    rows = [
        (1, PROMPT, t, t),
        (2, PROMPT, t, "garbage"),
        (3, PROMPT, t, _out(["love green tea very much", "collects rare stamps abroad"])),
        (4, PROMPT, _out(), _out()),
        (5, PROMPT, _out(), _out(["the moon looks bright tonight"])),
        (6, PROMPT, t, _out(["love green tea very much"], user_intent={"primary_intent": "OTHER", "secondary_intents": ["a"], "reasoning": None})),
        (7, PROMPT, t, _out(["love green tea very much"], ai_performance={"naturalness_score": 5}, paid_reaction={"analysis": 4})),
        (8, PROMPT, t, _out(["owns a red bicycle"], rolling_summary=["no", "text"])),
        (9, "no sections", t, t),
        (10, PROMPT, t, None),
    ]
    return {r.id: r for r in e.evaluate(spark.createDataFrame(rows, "id long, prompt string, teacher string, student string")).collect()}


def test_identical_is_perfect(scores):
    r = scores[1]
    assert (r.total_score, r.json_valid, r.memory_precision, r.memory_recall, r.speaker_attribution, r.hallucination_penalty) == (1.0, 1.0, 1.0, 1.0, 1.0, 0.0)


def test_garbage_is_zero(scores):
    for k in (2, 10):
        r = scores[k]
        assert r.total_score == 0.0 and r.hallucination_penalty == 1.0 and r.memory_recall == 0.0


def test_items(scores):
    assert (scores[3].memory_precision, scores[3].memory_recall, scores[3].hallucination_penalty) == (0.5, 1.0, 0.5)
    assert (scores[4].memory_precision, scores[4].memory_recall, scores[4].speaker_attribution, scores[4].hallucination_penalty) == (1.0, 1.0, None, None)
    assert (scores[5].memory_precision, scores[5].memory_recall, scores[5].speaker_attribution) == (None, None, 0.0)
    assert scores[8].hallucination_penalty == 0.0 and scores[8].speaker_attribution == 1.0 and scores[8].summary_score == 0.0


def test_other_dimensions(scores):
    assert scores[6].intent_score == pytest.approx(0.05, abs=1e-4)
    assert scores[7].other == pytest.approx(0.5 * (0.5 + 0.5 * (1 - 3 / 9)) + 0.5 * 0.7, abs=1e-4)
    assert scores[9].hallucination_penalty == 0.0 and scores[9].speaker_attribution is None


def test_clean_and_audit(spark):
    df = spark.createDataFrame([(1, PROMPT, _out(["i love green tea very much"])), (2, PROMPT, _out(["the moon looks bright tonight"])), (3, PROMPT, _out(["owns a red bicycle", "collects rare stamps abroad"]))], "id long, prompt string, output string")
    assert {r.id: r.kept for r in e.self_evaluated(df).collect()} == {1: True, 2: False, 3: True}
    assert {r["class"]: r.n for r in e.audited(df).collect()} == {"USER_OK": 1, "TRUE_ERR": 1, "CARRIED": 1, "NO_EVIDENCE": 1}


def test_audit_takes_each_row_by_itself(spark):
    """Rows of an equal or no id are apart, and nothing but counts goes over a shuffle."""
    rows = [(1, PROMPT, _out(["i love green tea very much"])), (1, PROMPT, _out(["the moon looks bright tonight"])), (None, PROMPT, _out(["owns a red bicycle"])), (2, None, _out(["owns a red bicycle", ""])), (3, PROMPT, "garbage"), (4, PROMPT, None)]
    got = e.audited(spark.createDataFrame(rows, "id long, prompt string, output string"))
    assert {r["class"]: (r.n, r.share) for r in got.collect()} == {"USER_OK": (1, 0.2), "TRUE_ERR": (1, 0.2), "CARRIED": (1, 0.2), "NO_EVIDENCE": (2, 0.4)}
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    assert e.audited(spark.createDataFrame([], "id long, prompt string, output string")).count() == 0


def test_audit_equals_levels_by_columns(spark):
    rng = random.Random(12)
    some = lambda: " ".join(rng.choice(["Tea", "red", "b", "c", "d.", "e,f", "茶叶好", "茶", "x9"]) for _ in range(rng.randrange(1, 7)))
    rows = []
    for k in range(150):
        chat = "".join(f"[t] {rng.choice(['Ann', 'Bob', 'Eve'])}: {some()}\n" for _ in range(rng.randrange(6)))
        rows.append((k, f"## USER BASIC INFORMATION\n- Name: Ann, Gender: W\n\n## OLD MEMORY SNAPSHOT\n- {some()}\n\n## INCREMENTAL CHAT RECORDS\nSession: Ann - Bob\n{chat}", _out([some() for _ in range(rng.randrange(5))])))
    df = spark.createDataFrame(rows, "id long, prompt string, output string")
    items = s.parsed(df, "id", "output").select("id", F.posexplode("items").alias("idx", "i")).select("id", "idx", F.col("i.text").alias("text"))
    chat = e.lines(df).select("id", F.col("text").alias("source"), F.when(F.col("is_user"), "user").when(~F.col("is_user"), "persona").alias("kind"))
    both = items.join(chat.union(e.priors(df).withColumn("kind", F.lit("prior"))), "id")
    both = with_vectors(both, embed_texts(both, "text", "source"), "text", "source")
    level = s.evidence_level(cosine(F.col("text_vector"), F.col("source_vector")), tx.overlap(F.col("text"), F.col("source")))
    best = both.groupBy("id", "idx").agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, level)), F.lit(0.0)).alias(k) for k in ("user", "persona", "prior")))
    want = {r["class"]: r.n for r in best.groupBy(s.attribution(F.col("user"), F.col("persona"), F.col("prior")).alias("class")).agg(F.count("*").alias("n")).collect()}
    assert len(want) == 5 and {r["class"]: r.n for r in e.audited(df).collect()} == want
