import random

from graphloom.llm import components


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def run(spark, pairs, **kw):
    df = spark.createDataFrame([(a, b, "clash") for a, b in pairs], "a string, b string, record_id string")
    rows = components.connected_components(spark, df, **kw).collect()
    out = {r.record_id: r.group_id for r in rows}
    assert len(out) == len(rows)
    return out


def test_random_graphs_on_many_cells(spark):
    rnd = random.Random(1)
    for n, m in ((60, 40), (200, 260)):
        pairs = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)]
        assert run(spark, pairs, cell_edges=10) == brute(pairs)


def test_chain_star_and_repeats(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    random.Random(2).shuffle(chain)
    star = [("hub", f"s{i}") for i in range(150)]
    pairs = chain + star + [(b, a) for a, b in star] + star
    assert run(spark, pairs, cell_edges=15) == brute(pairs)


def test_nulls_self_pairs_and_empty(spark):
    assert run(spark, [("a", None), (None, "b"), ("c", "c"), (None, None)]) == {}
    assert run(spark, []) == {}
    assert run(spark, [("", "x"), ("x", "y" * 5000)]) == {"": "", "x": "", "y" * 5000: ""}


def test_local_union_find():
    assert components.local_components(["b", "d"], ["a", "c"]) == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_a_hub_fills_no_cell(spark, monkeypatch):
    """A hub with nearly all edges: its cells are cut, and no part holds more than a few times the limit."""
    from pyspark.sql import functions as F

    edges = spark.range(3_000).select(F.lit("hub").alias("a"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("b")).unionByName(spark.createDataFrame([("v1", "w1"), ("w2", "w3")], "a string, b string"))
    got = {r.record_id: r.group_id for r in components.connected_components(spark, edges, cell_edges=50).collect()}
    assert len(got) == 3_004 and got["w2"] == got["w3"] == "w2" and {got[k] for k in got if k not in ("w2", "w3")} == {"hub"}
