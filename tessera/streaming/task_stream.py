"""The task state machine as a stream of events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.tasks import step
from tessera.session import Scratch

OUT = "task long, state string, attempts long, ignored long, seen long"
STATE = "state string, attempts long, ignored long, seen long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state, attempts, ignored, seen = held.get if held.exists else ("PENDING", 0, 0, 0)
    events = pd.concat(list(batches)).sort_values("seq")  # one task's events of one trigger
    for action in events.action:
        state, ok = step(state, action)
        attempts += ok and action == "claim"
        ignored += not ok
        seen += 1
    held.update((state, int(attempts), int(ignored), int(seen)))
    yield pd.DataFrame([(key[0], state, int(attempts), int(ignored), int(seen))], columns=["task", "state", "attempts", "ignored", "seen"])


def states(events: DataFrame) -> DataFrame:
    """A row for each task with new events in a trigger, from a stream of (task, seq, action)."""
    return events.groupBy("task").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Run all available input to its end and give the last state of each task.

    Every trigger's rows go to a table of the shared folder; seen grows with each, so the last is the largest.
    """
    scratch = Scratch(spark, "stream")
    out, checkpoint = scratch.path("states"), scratch.path(f"checkpoint-{uuid.uuid4().hex}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated trigger replaces its own rows

    query = states(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    from tessera.operators.tasks import latest

    rows = spark.read.schema(OUT + ", batch long").parquet(out)
    return latest(rows, "task", ["seen"]).select("task", "state", "attempts", "ignored")
