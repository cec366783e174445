import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers, sinks


def _file(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_prompt_files(spark, tmp_path):
    rows = lambda path: [(r.content, r.category) for r in readers.prompts(spark, path).orderBy("row_no").collect()]
    assert rows(_file(tmp_path, "a.txt", "one\n\n two \none\n")) == [("one", "默认"), ("two", "默认"), ("one", "默认")]
    assert rows(_file(tmp_path, "a.csv", 'Content,Category\n"x, ""q""",k\n\ny,\n')) == [('x, "q"', "k"), ("y", "默认")]
    assert rows(_file(tmp_path, "a.jsonl", '{"content":"x"}\n\n{"content":"","category":"c"}\n')) == [("x", "默认"), ("", "c")]
    with pytest.raises(ValueError, match="line 2"):
        readers.prompts(spark, _file(tmp_path, "b.jsonl", '{"content":"x"}\nno\n'))


def test_tolerant_dump_and_window(spark, tmp_path):
    path = _file(tmp_path, "d.jsonl", "\n".join([json.dumps({"id": 1, "student": "a", "finish_reason": "length"}), "oops", json.dumps({"id": 2, "student": "b"})]))
    got = readers.dump(spark, path).orderBy("row_no").collect()
    assert [(r.id, r.student, r.student_raw, r.bad_json) for r in got] == [(1, "", "a", False), (None, None, None, True), (2, "b", "b", False)]
    assert readers.window(readers.dump(spark, path), 1, 1).count() == 1
    with pytest.raises(ValueError):
        readers.dump(spark, path, least=9)


def test_numbers_are_dense_over_splits_and_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, k in (("b", 3), ("a", 400), ("c", 90)):
        _file(tmp_path / "d", name + ".jsonl", "".join(json.dumps({"id": i, "student": name * (i % 50)}) + "\n" for i in range(k)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.lines(spark, str(tmp_path / "d"))
        assert rows.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path / "d")).rdd.getNumPartitions() > 5
        got = rows.orderBy("row_no").collect()
        assert [r.row_no for r in got] == list(range(1, 494)) and [json.loads(r.value)["id"] for r in got] == [*range(400), *range(3), *range(90)]
        assert readers.window(readers.dump(spark, str(tmp_path / "d")), 350, 100).count() == 100
        (tmp_path / "d" / "b.jsonl").write_text('{"id": 1}\nno\n')
        with pytest.raises(ValueError, match="line 402"):
            readers.jsonl(spark, str(tmp_path / "d"), readers.DUMP, strict=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_series_and_plan(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("x", T.DoubleType())])
    a, b = _file(tmp_path, "a.jsonl", '{"x":1.0}\n'), _file(tmp_path, "b=1.jsonl", '{"x":2.0}\n{"x":3.0}\n')
    got = readers.series(spark, [f"m={a}", f"n={b}"], schema)
    assert {(r.series, r.series_no): r["count"] for r in got.groupBy("series", "series_no").count().collect()} == {("m", 0): 1, ("n", 1): 2}
    assert "Scan" in readers.describe(spark, got)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "q", "b"), (1, "p", "a")], "row_no long, prompt string, output string")
    sinks.write_jsonl(df, sinks.record("messages", F.col("prompt"), F.col("output")), str(tmp_path / "j"), "row_no", gzip=True)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert {x["messages"][1]["content"] for x in lines} == {"a", "b"}
    assert sinks.write_once(df, str(tmp_path / "o")) and not sinks.write_once(df, str(tmp_path / "o"))
    assert sinks.export_increment(df.where("row_no = 1"), "row_no", str(tmp_path / "e")) == 1
    assert sinks.export_increment(df, "row_no", str(tmp_path / "e")) == 1 and sinks.export_increment(df, "row_no", str(tmp_path / "e")) == 0
    assert sinks.write_splits(df.withColumn("split", F.lit("train")), "split", str(tmp_path / "s"), {"seed": 1})["sizes"] == {"train": 2}
    good, bad = sinks.validate(df, {"short": F.length("prompt") < 5, "is_p": F.col("prompt") == "p"})
    assert good.count() == 1 and bad.first().reasons == ["is_p"]
