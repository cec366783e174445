"""Queries of the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import catalog, corpora, parsing, scores
from tessera.tables import table


#: The lists of the model output and of the call trace.
OUTPUT_LISTS = ("user_intent.secondary_intents", *(f"memory_snapshot.{x}" for x in ("facts", "preferences", "avoid_topics", "open_loops", "active_events")))
INNER_LISTS = (("trace.hops[]", "tries"), ("output.memory_snapshot.active_events[]", "evidence"))


def _wire_tree(text: str) -> object:
    from tessera.functions import jsonx

    wire = jsonx.record(text)
    return None if wire is None else {"trace": wire.get("trace"), "output": jsonx.output_object(jsonx.answer(wire))}


def _nodes(spark: SparkSession, folder: str, values: bool) -> DataFrame:
    """Node tables of both nested columns as one; the documents of one table have other numbers than those of the other."""
    from tessera.operators import nested
    from tessera.session import Scratch

    types = ("trace.hops[]", *(f"output.{x}[]" for x in OUTPUT_LISTS), *(f"{outer}.{name}[]" for outer, name in INNER_LISTS))
    calls = nested.nodes(table(spark, folder, "export_user_chat_analysis"), F.col("id"), F.col("response"), _wire_tree, types, values)
    scores = table(spark, folder, "sample_score")
    details = nested.nodes(scores, F.col("score_no"), F.to_json("details", {"ignoreNullFields": "false"}), None, ("memory_details[]",), values)
    both = calls.withColumn("tbl", F.lit("response")).union(details.withColumn("doc", -1 - F.col("doc")).withColumn("tbl", F.lit("details")))
    return Scratch(spark, "nested").keep(both.select("tbl", "doc", "key", "type", "pre", "post", "pos", *(("kind", "value") if values else ())), "nodes")


def p3_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Node tables of both nested columns as one, with the type of each node."""
    return _nodes(spark, folder, False)


def p3_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The flat tables, one for each type, as one: each list element with its kind and value (JSON), its place, and that of the element it lies in."""
    from tessera.operators import nested

    rows = _nodes(spark, folder, True)
    columns = ("tbl", "key", "type", "pos", "kind", "value")
    deep = [f"{outer}.{name}[]" for outer, name in INNER_LISTS]
    out = rows.where(~F.col("type").isin(deep)).select(*columns, F.lit(None).cast("int").alias("parent_pos"))
    for outer, name in INNER_LISTS:
        linked = nested.within(rows.where(F.col("type") == f"{outer}.{name}[]"), rows.where(F.col("type") == outer))
        out = out.union(linked.select(*columns, F.col("outer_pos").alias("parent_pos")))
    return out


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.operators import nested

    rows = p3_nodes(spark, folder)
    place = F.concat(F.expr("substring(type, 1, length(type) - 1)"), F.col("pos").cast("string"), F.lit("]"))
    deep = [f"{outer}.{name}[]" for outer, name in INNER_LISTS]
    out = rows.where(~F.col("type").isin(deep)).select("tbl", F.col("key").alias("parent_id"), place.alias("path"))
    for outer, name in INNER_LISTS:
        linked = nested.within(rows.where(F.col("type") == f"{outer}.{name}[]"), rows.where(F.col("type") == outer))
        path = F.concat(F.lit(outer[:-1]), F.col("outer_pos").cast("string"), F.lit(f"].{name}["), F.col("pos").cast("string"), F.lit("]"))
        out = out.union(linked.select("tbl", F.col("key").alias("parent_id"), path.alias("path")))
    return out


_AREAS = (catalog.R, parsing.R, scores.R, corpora.R)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
    return {k: f for r in _AREAS for k, f in r.queries.items()} | own


def oracle_sql() -> dict[str, str]:
    return {k: q for r in _AREAS for k, q in r.sql.items()}
