from tessera.operators import tasks as t

LOG = [(1, 1, "claim"), (1, 2, "claim"), (1, 3, "succeed"), (1, 4, "fail"), (2, 1, "claim"), (2, 2, "fail"), (2, 3, "retry"), (2, 4, "claim"), (3, 1, "succeed"), (4, 1, "claim"), (4, 2, "release")]
WANT = {1: ("SUCCESS", 1, 2), 2: ("RUNNING", 2, 0), 3: ("PENDING", 0, 1), 4: ("PENDING", 1, 0)}


def test_replay(spark):
    log = spark.createDataFrame(LOG, "task long, seq long, action string")
    assert {r.task: (r.state, r.attempts, r.ignored) for r in t.replay(log, "task", "seq", "action").collect()} == WANT


def test_stream_equals_replay(spark, tmp_path):
    from tessera.streaming.task_stream import run_available

    log = spark.createDataFrame(LOG, "task long, seq long, action string")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    assert {r.task: (r.state, r.attempts, r.ignored) for r in run_available(spark, stream).collect()} == WANT


def test_retry_and_recover(spark):
    df = spark.createDataFrame([(1, "FAILED", "e"), (2, "PENDING", None), (3, "RUNNING", None), (4, "SUCCESS", "k")], "id long, state string, error string")
    after, ids = t.retry_failed(df, "id")
    assert sorted(r.id for r in ids.collect()) == [1, 2]
    assert {r.id: r.error for r in after.collect()} == {1: None, 2: None, 3: None, 4: "k"}
    assert t.recover(df).where("state = 'PENDING'").count() == 2


def test_run_tasks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad")], "id long, prompt string")

    def call(row):
        if row["prompt"] == "bad":
            raise RuntimeError("x" * 2000)
        return row["prompt"] * 2

    got = {r.id: r for r in t.run_tasks(df, call, wait=0.0).collect()}
    assert (got[1].state, got[1].output, got[1].attempts) == ("SUCCESS", "aa", 1)
    assert (got[2].state, len(got[2].error), got[2].attempts) == ("FAILED", 1000, 3)
