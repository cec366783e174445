"""Readers of prompts, datasets, dumps and score files; each row has its place in row_no."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PROMPTS = T.StructType([T.StructField("content", T.StringType()), T.StructField("category", T.StringType())])
DATASET = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("output", T.StringType())])
DUMP = T.StructType([T.StructField("id", T.LongType()), T.StructField("student", T.StringType()), T.StructField("finish_reason", T.StringType())])
DEFAULT_CATEGORY = "默认"


def _numbered(scan: DataFrame) -> DataFrame:
    """A scan of files with row_no: dense from 1 over all files, by path and then by place in the file, however many splits there are.

    Rows are counted by split first; a row's number is the rows of the splits before plus its place in its own.
    """
    marked = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = marked.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    offsets = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return marked.join(offsets, ["_file", "_start"]).withColumn("row_no", F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_file", "_start", "_id", "_first", "_before")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, row_no): lines of text files, numbered from 1 without gaps."""
    return _numbered(spark.read.text(path))


def jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Rows of a JSONL file with row_no and bad_json; blank lines are skipped, and counted in row_no.

    strict: the first malformed line raises an error that names it. Otherwise
    malformed lines come out with bad_json true and nulls.
    """
    rows = lines(spark, path).where(F.trim("value") != "")
    holder = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = rows.select("row_no", F.from_json("value", holder, {"columnNameOfCorruptRecord": "_bad"}).alias("j"), "value")
    parsed = parsed.select("row_no", "value", *(F.col(f"j.{f.name}").alias(f.name) for f in schema), F.col("j._bad").isNotNull().alias("bad_json"))
    if strict:
        first = parsed.where("bad_json").agg(F.min("row_no")).first()[0]
        if first is not None:
            raise ValueError(f"line {first}: not a JSON object")
    return parsed


def csv_prompts(spark: SparkSession, path: str, category: str = DEFAULT_CATEGORY) -> DataFrame:
    """(row_no, content, category) of a CSV; header rows (content, category in any case) and rows with a blank first cell are skipped."""
    rows = spark.read.csv(path, schema="content string, category string", header=False, quote='"', escape='"', multiLine=True, enforceSchema=True)
    rows = _numbered(rows)
    header = (F.lower(F.trim("content")) == "content") & (F.lower(F.trim(F.coalesce("category", F.lit("category")))) == "category")
    kept = rows.where((F.trim("content") != "") & ~header)
    return kept.select("row_no", "content", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(category)).alias("category"))


def text_prompts(spark: SparkSession, path: str, category: str = DEFAULT_CATEGORY) -> DataFrame:
    return lines(spark, path).where(F.trim("value") != "").select("row_no", F.trim("value").alias("content"), F.lit(category).alias("category"))


def prompts(spark: SparkSession, path: str, category: str = DEFAULT_CATEGORY) -> DataFrame:
    """(row_no, content, category) of a .json, .jsonl, .csv or other (text) file."""
    end = path.lower().rpartition(".")[2]
    if end in ("json", "jsonl"):
        rows = jsonl(spark, path, PROMPTS, strict=True)
        return rows.select("row_no", "content", F.substring(F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(category)), 1, 50).alias("category"))
    return csv_prompts(spark, path, category) if end == "csv" else text_prompts(spark, path, category)


def window(df: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows by place: offset are skipped, then limit kept, malformed ones counted too."""
    kept = df.where(F.col("row_no") > offset)
    return kept if limit is None else kept.where(F.col("row_no") <= offset + limit)


def dump(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """A student dump with student_raw; outputs cut by length become empty. Fewer rows than least is an error."""
    rows = jsonl(spark, path, DUMP).drop("value")
    if least and rows.count() < least:
        raise ValueError(f"the dump has fewer than {least} rows")
    return rows.withColumn("student_raw", F.col("student")).withColumn("student", F.when(F.col("finish_reason") == "length", "").otherwise(F.col("student")))


def series(spark: SparkSession, specs: list[str], schema: T.StructType) -> DataFrame:
    """Score files given as LABEL=PATH, each a series with its ordinal."""
    out = None
    for k, spec in enumerate(specs):
        label, _, path = spec.partition("=")
        part = jsonl(spark, path, schema).drop("value").select(F.lit(label).alias("series"), F.lit(k).alias("series_no"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def describe(spark: SparkSession, df: DataFrame) -> str:
    """The formatted plan, in place of index and EXPLAIN output."""
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
