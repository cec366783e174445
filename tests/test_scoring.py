import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.vectors import cosine, embed_texts
from tessera.operators import scoring as s


def _items(spark, *texts):
    return spark.createDataFrame([("s", "facts", k, t) for k, t in enumerate(texts)], "id string, category string, idx int, text string")


def test_exact_then_greedy(spark):
    got = s.exact_matches(_items(spark, "Likes tea", "x", "likes tea!"), _items(spark, "LIKES TEA", "likes-tea", "likes tea"), ["id", "category"]).collect()
    assert sorted((r.teacher_idx, r.student_idx) for r in got) == [(0, 0), (2, 1)]
    pairs = spark.createDataFrame([("s", 0, 0, 0.9), ("s", 1, 0, 0.9), ("s", 0, 1, 0.8), ("s", 1, 1, 0.7)], "id string, teacher_idx int, student_idx int, sim double")
    got = s.greedy_matches(pairs, ["id"]).collect()
    assert sorted((r.teacher_idx, r.student_idx) for r in got) == [(0, 1), (1, 0)]


def test_precision_recall(spark):
    df = spark.createDataFrame([(1, 2, 2), (0, 0, 0), (0, 0, 3), (0, 2, 0)], "m int, t int, s int")
    got = df.select(s.precision(F.col("m"), F.col("t"), F.col("s")), s.recall(F.col("m"), F.col("t"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5), (1.0, 1.0), (None, None), (0.0, 0.0)]


def test_evidence(spark):
    rows = [("a", 0, 1.0, 0.9, False), ("a", 1, 0.0, 0.1, True), ("b", 0, 1.0, 0.9, False), ("b", 1, 0.5, 0.6, True), ("c", 0, 0.5, 0.6, False), ("d", None, 1.0, 0.9, None), ("e", 0, 0.0, 0.0, True), ("f", 0, 1.0, 0.7, True), ("f", 1, 1.0, 0.7, True)]
    got = {r.id: tuple(r)[1:] for r in s.best_evidence(spark.createDataFrame(rows, "id string, idx int, level double, sim double, is_user boolean"), ["id"]).collect()}
    assert got["a"] == (1.0, 0, False) and got["b"] == (1.0, 0, True) and got["c"] == (0.5, 0, None)
    assert got["d"] == (1.0, None, True) and got["e"] == (0.0, None, None) and got["f"] == (1.0, 0, True)


def test_weighted_total(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (0.5, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(s.weighted_total({"json_valid": F.col("a"), "other": F.col("b")})).collect()]
    assert got == [1.0, 0.0, pytest.approx((0.05 + 0.07) / 0.17, abs=1e-4)]
    with pytest.raises(ValueError):
        s.weighted_total({"nope": F.lit(1.0)})
    with pytest.raises(NotImplementedError):
        s.judge()


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.normalize(F.lit("A-b, 3 例!"))) == "ab3例"
    assert sorted(one(tx.word_set(F.lit("Tea 茶叶好 x 茶")))) == sorted(["tea", "x", "茶叶", "叶好", "茶"])
    assert one(tx.overlap(F.lit("a b c d"), F.lit("b C"))) == 0.5 and one(tx.overlap(F.lit("!"), F.lit("b"))) == 0.0
    assert one(tx.fence_body(F.lit("x ```json\n{1}\n``` y"))).strip() == "{1}"
    assert one(tx.bare_lines(F.lit("- a -\n\n  b\r\n"))) == ["a", "b"]
    assert one(tx.joined_url(F.lit("http://h//"), "/v1")) == "http://h/v1"
    assert one(F.size(tx.shingles(F.lit("x" * 127)))) == 0 and one(F.size(tx.shingles(F.concat(*(F.lit(str(k)) for k in range(250)))))) == 3


def test_cosine_and_embedding(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    assert one(cosine(v(1, 0), v(2, 0))) == 1.0 and one(cosine(v(0, 0), v(2, 0))) == 0.0 and one(cosine(F.lit(None).cast("array<float>"), v(1))) == 0.0
    df = spark.createDataFrame([("a b", "a b"), ("c", None), ("", "c")], "x string, y string")
    got = {r.text: r.vector for r in embed_texts(df, "x", "y").collect()}
    assert set(got) == {"a b", "c"} and abs(sum(v * v for v in got["a b"]) - 1) < 1e-6


def test_semantic_join_takes_every_left_row(spark, tmp_path):
    from tessera.queries import queries

    rows = [(k, [1.0, k % 7 / 10, -k % 5 / 10], k % 3) for k in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query, r.found) for r in queries()["semantic_join"](spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a in range(0, 90, 2) for b in range(1, 90, 2) if a % 3 == b % 3}


def test_rounding_by_the_exact_value(spark):
    import random

    from tessera.functions.numbers import round_places

    rng = random.Random(3)
    values = [0.12345, 0.12355, 0.00005, 0.00015, 0.03125, 0.09375, 0.5, 0.0, 1.0, -0.00005, -0.12345, 2.00005, None] + [k / 100000 for k in range(5, 100000, 970)] + [rng.random() for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", round_places(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [None if x is None else round(x, 4) for x in values]
    tag = s.high_risk_reasons({k: F.lit(0.5) for k in ("json_valid", "intent_score", "memory_precision", "memory_recall", "speaker_attribution", "summary_score", "other", "hallucination_penalty")}, F.lit("length"))
    assert spark.range(1).select(tag.alias("t")).first().t == ["json_invalid", "intent_low", "truncated", "memory_precision", "memory_recall", "speaker_attribution", "summary_score", "other", "hallucination_high"]
