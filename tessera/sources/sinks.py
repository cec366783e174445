"""Writers of datasets, reports and splits."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def record(kind: str, prompt: Column, output: Column) -> Column:
    """JSON text of a dataset row: raw ({prompt, output}) or messages (chat format)."""
    if kind == "raw":
        return F.to_json(F.struct(prompt.alias("prompt"), output.alias("output")))
    if kind == "messages":
        turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
        return F.to_json(F.struct(F.array(turn("user", prompt), turn("assistant", output)).alias("messages")))
    raise ValueError(f"unknown kind {kind}")


def chat_payload(model: Column, system: Column, prompt: Column, max_tokens: Column, temperature: Column) -> Column:
    """JSON text of a chat request; a null or blank system prompt is left out."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.when(F.coalesce(F.trim(system), F.lit("")) != "", F.array(turn("system", system), turn("user", prompt))).otherwise(F.array(turn("user", prompt)))
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"), temperature.alias("temperature"), max_tokens.alias("max_tokens")))


def write_jsonl(df: DataFrame, column: Column, path: str, order: str, gzip: bool = False, mode: str = "error") -> None:
    """One JSON text a line, range-sorted by order: files in name order are in row order."""
    rows = df.select(F.col(order), column.alias("value")).orderBy(order).select("value")
    rows.write.mode(mode).option("compression", "gzip" if gzip else "none").text(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Write a table unless it is there; whether it was written."""
    if exists(df.sparkSession, path):
        return False
    df.write.parquet(path)
    return True


def export_increment(df: DataFrame, key: str, path: str) -> int:
    """Append rows with keys above the greatest already exported; the number of new rows.

    The exported table itself is the state, so a repeated or failed run neither loses nor repeats rows.
    """
    spark = df.sparkSession
    last = spark.read.parquet(path).agg(F.max(key)).first()[0] if exists(spark, path) else None
    new = df if last is None else df.where(F.col(key) > last)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def write_splits(df: DataFrame, split: str, path: str, params: dict) -> dict:
    """A folder for each split, and a manifest of counts and parameters."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/rows")
    counts = {r[split]: r["count"] for r in df.groupBy(split).count().collect()}  # a row for each split
    manifest = {"sizes": counts, "params": params}
    df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all rules, the others with reasons); a null outcome fails."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())))
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)
