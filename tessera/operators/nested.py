"""Nested records as flat node tables, linked by interval labels.

A depth-first traversal gives every node of a document its pre-order and its
post-order number. A node lies within another exactly if its pre-order number
is greater and its post-order number smaller, so tables of nodes of any type
can be linked by containment, whatever lies between them, without a foreign
key for each pair of types.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "doc long, key long, type string, pre int, post int, level int, pos int, kind string, value string"
_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def label(root: object, want: Callable[[str], bool], values: bool) -> list[tuple]:
    """(type, pre, post, level, pos, kind, value) of the wanted nodes of one document, in pre-order.

    A node's type is its path with [] for each list; pos is its place in its
    list, null for a member of an object. Works on a stack, so depth is free.
    """
    out: list[list] = []
    pre = post = 0
    stack: list[tuple] = [(root, "", None, 0, None)]
    while stack:
        node, path, pos, level, row = stack.pop()
        if level < 0:  # all below it is done
            post += 1
            if row is not None:
                row[2] = post
            continue
        pre += 1
        row = None
        if want(path):
            kind = _KINDS.get(type(node), "other")
            row = [path, pre, 0, level, pos, kind, (json.dumps(node, ensure_ascii=False) if values and node is not None else None)]
            out.append(row)
        stack.append((None, "", None, -1, row))
        if isinstance(node, dict):
            dot = path + "." if path else ""
            stack.extend((v, dot + k, None, level + 1, None) for k, v in reversed(node.items()))
        elif isinstance(node, list):
            inner = path + "[]"
            stack.extend((node[i], inner, i, level + 1, None) for i in range(len(node) - 1, -1, -1))
    return [tuple(r) for r in out]


def nodes(df: DataFrame, key: Column, text: Column, read: Callable[[str], object] = None, types: tuple[str, ...] | None = None, values: bool = False) -> DataFrame:
    """The node table of all documents: NODES.

    read turns a text into a tree of dicts and lists, by default as JSON;
    None means there is no document. types: the types to emit, by default
    every list element. doc tells rows apart that repeat a key. A null text,
    and one that can't be read, gives no rows; a null key stays null.
    """
    wanted = frozenset(types or ())
    want = wanted.__contains__ if types else (lambda path: path.endswith("[]"))

    def as_json(text: str) -> object:
        try:
            return json.loads(text)
        except (ValueError, RecursionError):
            return None

    parse = read or as_json
    schema = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("type", pa.string()), ("pre", pa.int32()), ("post", pa.int32()), ("level", pa.int32()), ("pos", pa.int32()), ("kind", pa.string()), ("value", pa.string())])

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for doc, k, t in zip(*(c.to_pylist() for c in batch.columns)):
                tree = parse(t)
                if tree is None:
                    continue
                for row in label(tree, want, values):
                    for column, value in zip(columns, (doc, k, *row)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    picked = df.select(F.monotonically_increasing_id().alias("doc"), key.cast("long").alias("key"), text.alias("text"))
    return picked.where("text is not null").mapInArrow(run, NODES)


def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Each node of inner beside the node of outer that contains it: the columns of inner, then outer's as outer_*.

    One equi-join on the document; the interval condition is its residue.
    """
    renamed = outer.select(*(F.col(c).alias(f"outer_{c}") for c in ("doc", "pre", "post", "pos")))
    inside = (F.col("doc") == F.col("outer_doc")) & (F.col("pre") > F.col("outer_pre")) & (F.col("post") < F.col("outer_post"))
    return inner.join(renamed, inside)
