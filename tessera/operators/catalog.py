"""Catalog of models, prompts, batches and tasks: search, paging, guards, status, aggregates.

Every function takes and returns DataFrames. Nulls in a filtered column never
match, as in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numbers import round_places


def search(df: DataFrame, keyword: str | None, *columns: str) -> DataFrame:
    """Rows where any of the columns contains the keyword, whatever case; wildcards in it keep their meaning."""
    if not keyword:
        return df
    match = F.lit(False)
    for c in columns:
        match = match | F.col(c).ilike(f"%{keyword}%")
    return df.where(match)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, int]:
    """One page (from 1) in the given order, and the number of rows before paging."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page is at least 1, page size 1 to 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size), df.count()


def with_total(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page with the total beside each row."""
    rows, total = page(df, order, number, size)
    return rows.withColumn("total", F.lit(total).cast("long"))


def page_of_groups(df: DataFrame, group: str, number: int, size: int) -> DataFrame:
    """All rows of one page of groups in ascending order; groups are never split."""
    groups = df.select(group).distinct().orderBy(group).offset((number - 1) * size).limit(size)
    return df.join(F.broadcast(groups), group, "left_semi")  # at most size rows


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key; an error where there is none."""
    found = df.where(F.col(key) == F.lit(value))
    if found.isEmpty():
        raise KeyError(f"{key} {value} not found")
    return found


def missing(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The wanted keys that df lacks, each once."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(df.select(key), key, "left_anti")


def referenced(df: DataFrame, key: str, references: DataFrame, foreign: str) -> DataFrame:
    """df with n_references: how many rows of references point to each row."""
    counts = references.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias("n_references"))
    return df.join(counts, key, "left").withColumn("n_references", F.coalesce("n_references", F.lit(0)))


def delete_all_or_none(df: DataFrame, key: str, ids: DataFrame, references: DataFrame, foreign: str) -> DataFrame:
    """df without the ids; an error, and no deletion, where any of them is referenced."""
    if not ids.join(references, ids[key] == references[foreign], "left_semi").isEmpty():
        raise ValueError("referenced rows can't be deleted")
    return df.join(ids.select(key), key, "left_anti")


def unique_but(df: DataFrame, column: str, value: object, key: str, own: object = None) -> bool:
    """Whether no other row (than own) has the value."""
    taken = df.where(F.col(column) == F.lit(value))
    return (taken if own is None else taken.where(F.col(key) != F.lit(own))).isEmpty()


def upsert(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes in place of, or beside, those of df with the same key."""
    return df.join(changes.select(key), key, "left_anti").unionByName(changes)


def tasks_for(models: DataFrame, prompts: DataFrame, model_id: str, prompt_id: str, most_models: int = 1000) -> DataFrame:
    """(task_no, prompt_id, model_id): every model with every prompt, prompt by prompt.

    The models, a checked number, ride along as one array; prompts may be any
    number. task_no is computed from the ranks, so there is no global sort of tasks.
    """
    ids = sorted(r[0] for r in models.select(model_id).where(F.col(model_id).isNotNull()).distinct().limit(most_models + 1).collect())
    if len(ids) > most_models:
        raise ValueError(f"more than {most_models} models")
    ranked = dense_rank_by(prompts.select(F.col(prompt_id).alias("prompt_id")).where("prompt_id is not null").distinct(), "prompt_id")
    rows = ranked.select("prompt_id", "rank", F.posexplode(F.array(*map(F.lit, ids)).cast("array<long>")).alias("place", "model_id"))
    return rows.select(((F.col("rank") - 1) * len(ids) + F.col("place") + 1).alias("task_no"), "prompt_id", "model_id")


def dense_rank_by(df: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """df with rank: 1, 2, ... by a unique numeric column, from counts of its ranges rather than one task's sort."""
    bounds = df.agg(F.min(column), F.max(column)).first()
    if bounds[0] is None:
        return df.withColumn("rank", F.lit(None).cast("long"))
    width = max(1, -(-(bounds[1] - bounds[0] + 1) // parts))
    marked = df.withColumn("part", F.expr(f"({column} - {bounds[0]}) div {width}"))
    counts = marked.groupBy("part").agg(F.count("*").alias("n"))  # parts rows
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return marked.withColumn("place", place).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")


def batch_status(total: Column, completed: Column, failed: Column, succeeded: Column) -> Column:
    """COMPLETED, FAILED or PARTIAL once all tasks are done, else RUNNING or PENDING."""
    done = F.when(failed == 0, "COMPLETED").when(succeeded == 0, "FAILED").otherwise("PARTIAL")
    return F.when(completed >= total, done).when(completed > 0, "RUNNING").otherwise("PENDING")


def batches(tasks: DataFrame, batch: str, ok: Column, failed: Column) -> DataFrame:
    """Counters and status of each batch, from its tasks' states."""
    counts = tasks.groupBy(batch).agg(F.count("*").alias("total_tasks"), F.count_if(ok).alias("succeed_tasks"), F.count_if(failed).alias("failed_tasks"))
    counts = counts.withColumn("completed_tasks", F.col("succeed_tasks") + F.col("failed_tasks"))
    return counts.withColumn("status", batch_status(*(F.col(c) for c in ("total_tasks", "completed_tasks", "failed_tasks", "succeed_tasks"))))


def progress(done: Column, total: Column) -> Column:
    """Whole percent, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(done * 100, total)), F.lit(0)).cast("int")


def success_rate(df: DataFrame, ok: Column, failed: Column) -> DataFrame:
    """One row: succeeded, failed, and the rate among finished ones to 4 places, null if none is."""
    counts = df.agg(F.count_if(ok).alias("succeeded"), F.count_if(failed).alias("failed"))
    return counts.withColumn("rate", round_places(F.try_divide("succeeded", F.col("succeeded") + F.col("failed"))))


def first_occurrences(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row of each content, by SHA-256 of the columns joined by NUL; nulls count as empty."""
    joined = F.concat_ws("\0", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    hashed = df.withColumn("content_hash", F.sha2(joined, 256))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias(order))  # map-side minima: a hot content costs one row a task
    return hashed.join(first, ["content_hash", order], "left_semi")


def import_new(rows: DataFrame, text: str, order: str, existing: DataFrame, longest: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(new rows, one row of counts) of an import: blank and too long texts are invalid, known and repeated ones skipped."""
    bare = F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    marked = rows.withColumn("content", bare).withColumn("valid", F.coalesce((F.col("content") != "") & (F.length("content") <= longest), F.lit(False)))
    good = marked.where("valid")
    new = first_occurrences(good, ["content"], order).join(existing.select("content_hash"), "content_hash", "left_anti")
    imported = new.agg(F.count("*").alias("imported_count"))
    counts = marked.agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("invalid_count"))
    both = imported.join(counts, F.lit(True))  # one row each
    return new.drop("valid"), both.select("imported_count", (F.col("n_valid") - F.col("imported_count")).alias("skipped_count"), "invalid_count")
