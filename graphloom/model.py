"""Property-graph views: nodes and edges as DataFrames over relational tables.

``nodes``: node_id, label, key, name, props. ``edges``: src, dst, type. Both are
unions of one branch a label or type, so asking for some labels or types builds, scans
and plans only those. ``NODES_SQL`` and ``EDGES_SQL`` are the same views in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import table

#: label -> (table, key column, name column, columns kept as properties)
LABELS = {
    "Region": ("region", "r_regionkey", "r_name", ()),
    "Nation": ("nation", "n_nationkey", "n_name", ()),
    "Customer": ("customer", "c_custkey", "c_name", ("c_mktsegment",)),
    "Supplier": ("supplier", "s_suppkey", "s_name", ()),
    "Part": ("part", "p_partkey", "p_name", ("p_brand", "p_type")),
    "Order": ("orders", "o_orderkey", None, ("o_orderstatus", "o_orderpriority")),
}
#: type -> (table, source label, source key, target label, target key, several rows a pair)
TYPES = {
    "PART_OF": ("nation", "Nation", "n_nationkey", "Region", "n_regionkey", False),
    "LOCATED_IN": ("customer", "Customer", "c_custkey", "Nation", "c_nationkey", False),
    "BASED_IN": ("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey", False),
    "PLACED": ("orders", "Customer", "o_custkey", "Order", "o_orderkey", False),
    "CONTAINS": ("lineitem", "Order", "l_orderkey", "Part", "l_partkey", True),
    "SUPPLIED_BY": ("lineitem", "Order", "l_orderkey", "Supplier", "l_suppkey", True),
}


def node_id(label: str, key: str) -> Column:
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def nodes(spark: SparkSession, folder: str, labels: list[str] | None = None) -> DataFrame:
    out = []
    for label in labels or LABELS:
        name, key, title, props = LABELS[label]
        t = table(spark, folder, name, [key, *([title] if title else []), *props])
        pairs = [x for p in props for x in (F.lit(p), F.col(p))]
        out.append(t.select(node_id(label, key).alias("node_id"), F.lit(label).alias("label"), F.col(key).cast("string").alias("key"), (F.col(title) if title else F.lit(None).cast("string")).alias("name"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("props")))
    return union(out)


def edges(spark: SparkSession, folder: str, types: list[str] | None = None, once: bool = True) -> DataFrame:
    """Edges of the types; ``once=False`` spares the shuffle that makes pairs stated by several rows unique."""
    out = []
    for kind in types or TYPES:
        name, a, ka, b, kb, several = TYPES[kind]
        e = table(spark, folder, name, [ka, kb]).select(node_id(a, ka).alias("src"), node_id(b, kb).alias("dst"), F.lit(kind).alias("type"))
        out.append(e.distinct() if several and once else e)
    return union(out)


def _nodes_sql() -> str:
    parts = [f"SELECT '{label}:' || CAST({key} AS VARCHAR) node_id, '{label}' label, CAST({key} AS VARCHAR) key, {title or 'CAST(NULL AS VARCHAR)'} name FROM {name}" for label, (name, key, title, _) in LABELS.items()]
    return "nodes AS (" + " UNION ALL ".join(parts) + ")"


def _edges_sql() -> str:
    parts = [f"SELECT {'DISTINCT ' if several else ''}'{a}:' || CAST({ka} AS VARCHAR) src, '{b}:' || CAST({kb} AS VARCHAR) dst, '{kind}' type FROM {name}" for kind, (name, a, ka, b, kb, several) in TYPES.items()]
    return "edges AS (" + " UNION ALL ".join(parts) + ")"


NODES_SQL, EDGES_SQL = _nodes_sql(), _edges_sql()
GRAPH_SQL = f"{NODES_SQL}, {EDGES_SQL}"
BOTH_SQL = "both_ways AS (SELECT src x, dst y FROM edges UNION SELECT dst, src FROM edges)"
