import random
import threading

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "E") for a, b in pairs], "src string, dst string, type string")


def test_reach_equals_search(spark, monkeypatch):
    rnd = random.Random(2)
    pairs = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(45)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    start, want = "n1", {"n1": 0}
    level = {"n1"}
    for d in range(1, 4):
        level = {y for x in level for y in near.get(x, ())} - set(want)
        want |= dict.fromkeys(level, d)
    s = spark.createDataFrame([(start,)], "node_id string")
    for small in (200_000, 0):
        monkeypatch.setattr(G, "BROADCAST_ROWS", small)
        assert {r.node_id: r.hops for r in G.reach(s, edges(spark, pairs), 3).collect()} == want


def test_components_equal_union_find(spark):
    rnd = random.Random(4)
    pairs = [(f"n{rnd.randrange(80)}", f"n{rnd.randrange(80)}") for _ in range(60)] + [(None, "x"), ("y", "y")] + [(f"c{i}", f"c{i + 1}") for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node_id: r.component for r in G.components(spark, spark.createDataFrame(pairs, "x string, y string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert G.components(spark, spark.createDataFrame([], "x string, y string")).collect() == []


def test_upserts(spark):
    nodes = spark.createDataFrame([("A", "1", {"x": "old", "y": "keep"})], "label string, key string, props map<string,string>")
    upd = spark.createDataFrame([("A", "1", {"x": "first"}, 0), ("A", "1", {"x": "last", "y": None}, 1), ("B", "2", {}, 0), ("bad type", "3", {"z": "1"}, 0), ("A", None, {"z": "1"}, 0)], "label string, key string, props map<string,string>, ordinal int")
    got = {(r.label, r.key): (r.props, r.created) for r in G.upsert_nodes(nodes, upd).collect()}
    assert got == {("A", "1"): ({"x": "last", "y": "keep"}, False), ("B", "2"): ({}, True)}
    ids = spark.createDataFrame([("A:1",), ("B:2",)], "node_id string")
    old = spark.createDataFrame([("A:1", "T", "B:2", {"c": "1"})], "src string, type string, dst string, props map<string,string>")
    new = spark.createDataFrame([("A:1", "T", "B:2", {"c": "1"}, 0), ("A:1", "T", "B:2", {"c": "2"}, 1), ("A:1", "T", "Z:9", {}, 2)], "src string, type string, dst string, props map<string,string>, ordinal int")
    assert sorted(r.props["c"] for r in G.upsert_edges(old, new, ids).collect()) == ["1", "2"]
    assert [r.props["c"] for r in G.upsert_edges(old, new, ids, by_props=False).collect()] == ["2"]


def test_prefer_and_first_seen(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert sorted(tuple(r) for r in G.prefer([a, b], "k").collect()) == [(1, "a"), (2, "c")]
    df = spark.createDataFrame([(1, 5), (1, 2), (2, 9)], "k int, o int")
    assert sorted(tuple(r) for r in G.first_seen(df, ["k"], ["o"]).collect()) == [(1, 2), (2, 9)]


def test_strip_internal(spark):
    df = spark.createDataFrame([({"a": "1", "embedding": "x"},)], "p map<string,string>")
    assert df.select(G.strip_internal(F.col("p")).alias("p")).first().p == {"a": "1"}


def test_equal_pairs_are_tiled(spark):
    rows = [("x", f"n{i % 57}", f"c{i % 5}") for i in range(60)] + [("y", "m", None), (None, "o", "c1"), ("z", None, "c1"), ("z", None, "c1")]
    df = spark.createDataFrame(rows, "v string, b string, d string")
    new = df.where("d in ('c1', 'c2')").withColumnsRenamed({"b": "a", "d": "c"})
    want = sorted(((r[0], r[1], r[2], n[1], n[2]) for r in rows for n in rows if n[2] in ("c1", "c2") and n[0] == r[0] and r[0]), key=str)
    for tile, run in ((4096, 256), (7, 8), (5, 3)):
        assert sorted(map(tuple, G.equal_pairs(new, df, ["v"], tile, run).select("v", "b", "d", "a", "c").collect()), key=str) == want
    assert G.equal_pairs(new.limit(0), df, ["v"]).collect() == [] == G.equal_pairs(new, df.limit(0), ["v"]).collect()


def test_common_value_is_not_one_task(spark, tmp_path):
    nodes = [{"node_id": f"k{i}", "label": "L", "val": "v", "case_id": f"FIR-2024-{i}" if i < 60 else f"FIR-2020-{i}"} for i in range(9_000)]
    pq.write_table(pa.Table.from_pylist(nodes), tmp_path / "kg_nodes.parquet")
    got = entry.queries()["blocked_incremental_join"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in got) == 60 * 8_999 and len(got) > 1


def test_context_pairs_no_suppliers(spark, tmp_path):
    pq.write_table(pa.table({"r_regionkey": [0], "r_name": ["ASIA"]}), tmp_path / "region.parquet")
    pq.write_table(pa.table({"n_nationkey": [3, 4], "n_name": ["CHINA", "INDIA"], "n_regionkey": [0, 0]}), tmp_path / "nation.parquet")
    n = 60_000
    pq.write_table(pa.table({"s_suppkey": range(n), "s_name": [f"s{i}" for i in range(n)], "s_nationkey": [3 if i else 4 for i in range(n)]}), tmp_path / "supplier.parquet")
    # 3.6e9 pairs of suppliers would not end within minutes
    timer = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        got = entry.queries()["varlen_context"](spark, str(tmp_path)).groupBy("ctx").count().collect()
    finally:
        timer.cancel()
    assert sorted(map(tuple, got)) == [("ASIA|CHINA", n - 1), ("ASIA|INDIA", 1)]
