"""Every query with SQL gives the SQL's result on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


def _rows(pdf):
    def plain(x):
        if hasattr(x, "item"):
            x = x.item()
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)

    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in pdf.itertuples(index=False, name=None)), list(pdf.columns)


def _names():
    from tessera.queries import oracle_sql

    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, name):
    from tessera.queries import oracle_sql, queries

    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    assert _rows(queries()[name](spark, FOLDER).toPandas()) == _rows(con.sql(oracle_sql()[name]).df())


def test_entry_and_the_rest(spark):
    import __spark_entry__ as entry
    from tessera.queries import oracle_sql, queries

    assert entry.entry(spark).count() > 0
    for name in sorted(set(queries()) - set(oracle_sql())):
        assert queries()[name](spark, FOLDER).count() >= 0


def test_nested_elements_equal_a_walk(spark):
    import json
    from collections import Counter

    from tessera.functions import jsonx
    from tessera.queries import p3_found

    want = Counter()
    for r in spark.read.parquet(f"{FOLDER}/export_user_chat_analysis.parquet").select("id", "response").collect():
        wire = jsonx.record(r.response)
        if wire is None:
            continue

        def walk(x, path, wanted, id_=r.id):
            if isinstance(x, dict):
                for k, v in x.items():
                    walk(v, f"{path}.{k}" if path else k, wanted)
            elif isinstance(x, list):
                import re

                for i, v in enumerate(x):
                    p = f"{path}[{i}]"
                    if re.sub(r"\d+", "", p) in wanted:
                        want["response", id_, p] += 1
                    walk(v, p, wanted)

        lists = {f"output.memory_snapshot.{k}[]" for k in ("facts", "preferences", "avoid_topics", "open_loops", "active_events")}
        wanted = lists | {"trace.hops[]", "trace.hops[].tries[]", "output.user_intent.secondary_intents[]", "output.memory_snapshot.active_events[].evidence[]"}
        walk({"trace": wire.get("trace"), "output": jsonx.output_object(jsonx.answer(wire))}, "", wanted)
    for r in spark.read.parquet(f"{FOLDER}/sample_score.parquet").select("score_no", "details").collect():
        for i, _ in enumerate((r.details and r.details.memory_details) or ()):
            want["details", r.score_no, f"memory_details[{i}]"] += 1
    assert Counter(map(tuple, p3_found(spark, FOLDER).collect())) == want
    assert json is not None


def test_flat_tables_hold_the_values(spark):
    import json

    from tessera.queries import p3_found, p3_tables

    rows = p3_tables(spark, FOLDER).collect()
    assert len(rows) == p3_found(spark, FOLDER).count()
    assert all((r.parent_pos is not None) == (r.type.count("[]") == 2) for r in rows)
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float), "null": type(None)}
    assert all(isinstance(json.loads(r.value) if r.value is not None else None, kinds[r.kind]) for r in rows)
    texts = {(r.key, r.pos): json.loads(r.value).get("text") for r in rows if r.tbl == "details" and r.kind == "object"}
    want = {(r.score_no, i): x.text for r in spark.read.parquet(f"{FOLDER}/sample_score.parquet").select("score_no", "details").collect() for i, x in enumerate((r.details and r.details.memory_details) or ()) if x is not None}
    assert texts == want
