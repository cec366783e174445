import json

from pyspark.sql import functions as F

from tessera.operators import nested


def test_intervals_nest():
    tree = {"a": [{"b": [1, None]}, [], "x"], "c": {"d": [2]}}
    rows = nested.label(tree, lambda p: True, True)
    pre = [r[1] for r in rows]
    assert pre == list(range(1, len(rows) + 1)) and sorted(r[2] for r in rows) == pre
    by = {(r[0], r[1]): r for r in rows}
    inner, outer = next(r for r in rows if r[0] == "a[].b[]"), next(r for r in rows if r[0] == "a[]")
    assert outer[1] < inner[1] and outer[2] > inner[2]
    other = next(r for r in rows if r[0] == "c.d[]")
    assert not (outer[1] < other[1] and outer[2] > other[2])
    assert [r[4] for r in rows if r[0] == "a[].b[]"] == [0, 1] and [r[5] for r in rows if r[0] == "a[]"] == ["object", "array", "string"]
    assert len(by) == len(rows)


def test_node_tables_and_links(spark):
    docs = [(1, json.dumps({"h": [{"t": [1, 2]}, None, {"t": []}, {"t": [3]}]})), (1, json.dumps({"h": [{"t": [9]}]})), (2, "no json"), (3, None), (None, '{"h": [5]}'), (4, "{}"), (5, '{"h": null}'), (6, '{"h": {"t": [1]}}')]
    df = spark.createDataFrame(docs, "key long, text string").withColumn("doc", F.lit("clash")).withColumn("pre", F.lit(0))
    rows = nested.nodes(df, F.col("key"), F.col("text"), None, ("h[]", "h[].t[]")).cache()
    assert rows.where("type = 'h[]'").count() == 6
    linked = nested.within(rows.where("type = 'h[].t[]'"), rows.where("type = 'h[]'"))
    assert sorted((r.key, r.outer_pos, r.pos) for r in linked.collect()) == [(1, 0, 0), (1, 0, 0), (1, 0, 1), (1, 3, 0)]
    assert rows.where("key is null").count() == 1
    assert nested.nodes(df.limit(0), F.col("key"), F.col("text")).count() == 0


def test_deep_and_long():
    deep = "[" * 500 + "]" * 500
    rows = nested.label(json.loads(deep), lambda p: p.endswith("[]"), False)
    assert len(rows) == 499 and rows[-1][3] == 499
    assert len(nested.label(list(range(100_000)), lambda p: True, False)) == 100_001
