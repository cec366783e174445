import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog as c


def test_status_table(spark):
    rows = [(0, 0, 0, 0, "COMPLETED"), (4, 0, 0, 0, "PENDING"), (4, 1, 0, 1, "RUNNING"), (4, 4, 0, 4, "COMPLETED"), (4, 4, 2, 2, "PARTIAL"), (4, 4, 4, 0, "FAILED")]
    df = spark.createDataFrame(rows, "t int, c int, f int, s int, want string")
    got = df.select("want", c.batch_status(F.col("t"), F.col("c"), F.col("f"), F.col("s")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_paging_search_guards(spark):
    df = spark.createDataFrame([(k, f"Model {k}", "x" if k % 2 else None) for k in range(1, 31)], "id long, name string, tag string")
    rows, total = c.page(c.search(df, "mODEL 1", "name", "tag"), [F.desc("id")], 1, 5)
    assert total == 11 and [r.id for r in rows.collect()] == [19, 18, 17, 16, 15]
    assert c.search(df, "", "name").count() == 30
    with pytest.raises(ValueError):
        c.page(df, [F.col("id")], 0, 5)
    refs = spark.createDataFrame([(1,), (1,), (None,), (3,)], "model long")
    assert {r.id: r.n_references for r in c.referenced(df, "id", refs, "model").where("n_references > 0").collect()} == {1: 2, 3: 1}
    ids = spark.createDataFrame([(2,), (3,)], "id long")
    with pytest.raises(ValueError):
        c.delete_all_or_none(df, "id", ids, refs, "model")
    assert c.delete_all_or_none(df, "id", ids.where("id = 2"), refs, "model").count() == 29
    wanted = spark.createDataFrame([(5,), (77,), (77,), (None,)], "id long")
    assert [r.id for r in c.missing(df, "id", wanted).collect()] == [77]
    assert c.unique_but(df, "name", "Model 3", "id", 3) and not c.unique_but(df, "name", "Model 3", "id", 4)
    with pytest.raises(KeyError):
        c.lookup(df, "id", 99)
    assert c.page_of_groups(df.withColumn("g", F.col("id") % 7), "g", 2, 2).select("g").distinct().count() == 2
    changed = c.upsert(df, spark.createDataFrame([(1, "new", None), (50, "more", None)], df.schema), "id")
    assert changed.count() == 31 and changed.where("id = 1").first().name == "new"


def test_tasks_for(spark):
    models, prompts = spark.createDataFrame([(9,), (4,), (4,), (None,)], "id long"), spark.createDataFrame([(k * 17,) for k in range(200)], "id long")
    rows = sorted((r.task_no, r.prompt_id, r.model_id) for r in c.tasks_for(models, prompts, "id", "id").collect())
    assert [r[0] for r in rows] == list(range(1, 401)) and rows[0][1:] == (0, 4) and rows[3][1:] == (17, 9)
    assert c.tasks_for(models, prompts.limit(0), "id", "id").count() == 0


def test_import(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "  "), (4, "b" * 2001), (5, "c"), (6, None)], "row_no long, content string")
    none = spark.createDataFrame([], "content_hash string")
    new, counts = c.import_new(rows, "content", "row_no", none)
    assert [r.row_no for r in new.orderBy("row_no").collect()] == [1, 5]
    assert tuple(counts.first()) == (2, 1, 3)
    again, counts = c.import_new(rows, "content", "row_no", new)
    assert again.count() == 0 and tuple(counts.first()) == (0, 3, 3)


def test_progress_and_rate(spark):
    df = spark.createDataFrame([(1, 3), (0, 0)], "a long, b long")
    assert [r[0] for r in df.select(c.progress(F.col("a"), F.col("b"))).collect()] == [33, 0]
    assert c.success_rate(df.where("a > 9"), F.col("a") > 0, F.col("a") == 0).first().rate is None
