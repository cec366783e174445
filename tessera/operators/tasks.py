"""State of tasks from an append-only log of transitions.

Instead of updating rows, every attempt to move a task is an event. The state
is a fold over a task's events in order: an edge that its present state does
not allow changes nothing, so delivery at least once does no harm.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The states and the edges between them, by action.
EDGES = {"claim": ("PENDING", "RUNNING"), "release": ("RUNNING", "PENDING"), "succeed": ("RUNNING", "SUCCESS"), "fail": ("RUNNING", "FAILED"), "retry": ("FAILED", "PENDING")}
ERROR_CHARS = 1000


def step(state: str, action: str) -> tuple[str, bool]:
    """(state after the action, whether it was allowed)."""
    edge = EDGES.get(action)
    return (edge[1], True) if edge and edge[0] == state else (state, False)


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key, by map-side maxima rather than a sort of each key's history."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def replay(events: DataFrame, key: str, order: str, action: str) -> DataFrame:
    """(key, state, attempts, ignored): the state of each task after all its events, in order.

    A fold with built-in functions. A task's whole history is in one row, as
    in any table of its states; a task has few events.
    """
    history = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(action).alias("a")))).alias("h"))
    edges = F.create_map(*(F.lit(x) for k, (a, b) in EDGES.items() for x in (f"{k}:{a}", b)))
    start = F.struct(F.lit("PENDING").alias("state"), F.lit(0).cast("long").alias("attempts"), F.lit(0).cast("long").alias("ignored"))

    def move(s, e):
        to = F.try_element_at(edges, F.concat_ws(":", e["a"], s["state"]))
        claimed = (to == "RUNNING").cast("long")
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["attempts"] + F.coalesce(claimed, F.lit(0).cast("long"))).alias("attempts"), (s["ignored"] + to.isNull().cast("long")).alias("ignored"))

    return history.select(key, F.aggregate("h", start, move).alias("s")).select(key, "s.*")


def retry_failed(tasks: DataFrame, key: str, state: str = "state") -> tuple[DataFrame, DataFrame]:
    """(tasks after a retry of the failed ones, ids that are pending then); output and error of the reset ones are cleared."""
    failed = F.col(state) == "FAILED"
    cleared = {c: F.when(~failed, F.col(c)) for c in ("error", "output", "finished_at") if c in tasks.columns}
    after = tasks.withColumns({**cleared, state: F.when(failed, "PENDING").otherwise(F.col(state))})
    return after, after.where(F.col(state) == "PENDING").select(key)


def recover(tasks: DataFrame, state: str = "state") -> DataFrame:
    """Running tasks of a worker that went away become pending again."""
    return tasks.withColumn(state, F.when(F.col(state) == "RUNNING", "PENDING").otherwise(F.col(state)))


def claims(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first event of each key, which wins the claim."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("n = 1").drop("n")


def run_tasks(tasks: DataFrame, call: Callable[[dict], str], most_retries: int = 2, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """tasks with state, output, error, attempts, elapsed_ms from an injected model call.

    Each failed call is tried again after wait * 2**n seconds, most_retries
    times; the error is cut to 1000 characters. Runs within the partitions.
    """
    schema = tasks.schema.simpleString()[7:-1] + ",state:string,output:string,error:string,attempts:int,elapsed_ms:long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                began = time.monotonic()
                error = output = None
                for attempt in range(most_retries + 1):
                    try:
                        output, error = call(row), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)[:ERROR_CHARS]
                        if attempt < most_retries:
                            sleep(wait * 2**attempt)
                out.append(("SUCCESS" if error is None else "FAILED", output, error, attempt + 1, int((time.monotonic() - began) * 1000)))
            yield pdf.assign(**{c: [o[k] for o in out] for k, c in enumerate(("state", "output", "error", "attempts", "elapsed_ms"))})

    return tasks.mapInPandas(run, schema.replace(":", " "))


def echo_model(row: dict) -> str:
    """The offline stand-in for a model server."""
    return f"{row.get('model')}: {row.get('prompt')}"
