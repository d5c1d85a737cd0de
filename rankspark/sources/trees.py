"""Taxonomy trees as JSON: flattened to one row a node, validated, listed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_tree(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """(idx, path, parent_path, depth, frequency) of a nested {title, idx, frequency, links} file. Titles must be there;
    indices, if numbered, must be whole, distinct and without gaps from 0. A tree is small: it is read on the driver."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    rows, stack = [], [(json.loads(text), "", 0)]
    while stack:
        node, parent, depth = stack.pop()
        if not isinstance(node.get("title"), str) or (numbered and not isinstance(node.get("idx"), int)):
            raise ValueError(f"a node under {parent or '/'} has no title or no whole idx")
        own = f"{parent}/{node['title']}"
        frequency = node.get("frequency")
        rows.append((node.get("idx"), own, parent or None, depth + 1, None if frequency is None else float(frequency)))
        stack += [(x, own, depth + 1) for x in node.get("links") or []]
    if numbered and sorted(r[0] for r in rows) != list(range(len(rows))):
        raise ValueError("indices must be distinct and without gaps")
    return spark.createDataFrame(rows, "idx int, path string, parent_path string, depth int, frequency double")


def children(tree: DataFrame, path: str) -> DataFrame:
    return tree.where(F.col("parent_path") == "/" + path.strip("/"))


def tree_json(tree: DataFrame) -> str:
    """The nested form of a flattened tree."""
    nodes = {r["path"]: {"title": r["path"].rsplit("/", 1)[1], "idx": r["idx"], "frequency": r["frequency"], "links": []} for r in tree.orderBy("idx").collect()}
    roots = []
    for path, node in nodes.items():
        parent = nodes.get(path.rsplit("/", 1)[0])
        (parent["links"] if parent else roots).append(node)
    if len(roots) != 1:
        raise ValueError("a tree has one root")
    return json.dumps(roots[0])
