import pytest

from graphloom import cypher
from graphloom.cypher.parser import CypherError


@pytest.fixture(scope="module")
def g(spark):
    n = spark.createDataFrame([("P:1", "P", "1", "Ann", {"age": "3"}), ("P:2", "P", "2", "Bob", {}), ("C:1", "C", "1", "Rome", {}), ("P:3", "P", "3", None, {})], "node_id string, label string, key string, name string, props map<string,string>")
    e = spark.createDataFrame([("P:1", "C:1", "IN"), ("P:2", "C:1", "IN"), ("P:1", "P:2", "KNOWS"), ("P:2", "P:3", "KNOWS")], "src string, dst string, type string")
    return cypher.Graph(n, e)


def rows(g, q, **params):
    return [tuple(r) for r in cypher.run(g, q, params, limit=None).collect()]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("MATCH (p:P)-[:IN]->(c:C) RETURN p.name AS n ORDER BY n", [("Ann",), ("Bob",)]),
        ("MATCH (c:C)<-[:IN]-(p) RETURN c.name AS c, count(p) AS n, collect(p.name) AS l", [("Rome", 2, ["Ann", "Bob"])]),
        ("MATCH (p:P) OPTIONAL MATCH (p)-[:IN]->(c) RETURN p.key AS k, c.name AS c ORDER BY k", [("1", "Rome"), ("2", "Rome"), ("3", None)]),
        ("MATCH (p:P {name: $n})-[:KNOWS*1..2]->(q) RETURN q.key AS k ORDER BY k", [("2",), ("3",)]),
        ("MATCH (p:P {key: '1'})-[:KNOWS*0..1]->(q) RETURN q.key AS k ORDER BY k", [("1",), ("2",)]),
        ("MATCH (a:P)-[:KNOWS]-(b:P) RETURN count(*) AS n", [(4,)]),
        ("MATCH (a:P)-[r:KNOWS|IN]->(b) RETURN type(r) AS t, count(*) AS n ORDER BY n DESC, t", [("IN", 2), ("KNOWS", 2)]),
        ("MATCH (p:P) WHERE p.name IS NOT NULL AND (p.name STARTS WITH 'A' OR p.name ENDS WITH 'b') RETURN p.name AS n ORDER BY n DESC SKIP 1 LIMIT 1", [("Ann",)]),
        ("MATCH (p:P) WITH p.label AS l, count(*) AS n WHERE n > 2 RETURN l, n", [("P", 3)]),
        ("MATCH (p:P) WHERE p.age = '3' RETURN p.name AS n", [("Ann",)]),
        ("UNWIND [1, 2, 3] AS x RETURN x * 2 AS y ORDER BY y DESC", [(6,), (4,), (2,)]),
        ("MATCH (p:P {key: '1'}) RETURN [x IN ['a', 'b', 'c'] WHERE x <> 'b' | toUpper(x)][..1] AS l, any(x IN ['a'] WHERE x = 'a') AS t", [(["A"], True)]),
        ("MATCH (p:P) RETURN DISTINCT p.label AS l UNION MATCH (c:C) RETURN c.label AS l", [("P",), ("C",)]),
        ("MATCH (a:P)-[:IN]->(c)<-[:IN]-(b:P) RETURN a.key AS a, b.key AS b ORDER BY a", [("1", "2"), ("2", "1")]),
        ("MATCH (p:P {key: '9'}) RETURN p.name AS n", []),
    ],
)
def test_queries(g, query, expected):
    assert sorted(map(str, rows(g, query, n="Ann"))) == sorted(map(str, expected))


def test_limit_is_put_on_queries_without_one(g):
    assert len(cypher.run(g, "MATCH (p:P) RETURN p.key AS k", limit=2).collect()) == 2
    assert len(cypher.run(g, "MATCH (p:P) RETURN p.key AS k LIMIT 3", limit=2).collect()) == 3


@pytest.mark.parametrize(
    "text, expected",
    [("MATCH (n) DETACH DELETE n", True), ("match (n) delete n", True), ("DROP INDEX x", True), ("CALL apoc.schema.drop()", True), ("CALL db.index.drop('a')", True), ("MATCH (n) WHERE n.name = 'delete me' RETURN n", False), ("MATCH (n) SET n.x = 1", False), ("CREATE (n)", False), ("MERGE (n)", False), ('MATCH (n {t: "DROP"}) RETURN n', False)],
)
def test_guard(text, expected):
    assert cypher.is_destructive(text) is expected


@pytest.mark.parametrize("text", ["MATCH (n RETURN n", "FOO (n)", "MATCH (n) RETURN nope(n)", "MATCH (n) DELETE n", "UNWIND [1] x"])
def test_refuses(g, text):
    with pytest.raises(CypherError):
        cypher.run(g, text)


def test_unbounded_paths_run_to_the_end(spark):
    """A chain of twelve and a ring of three: no number of hops is set."""
    n = 12
    nodes = spark.createDataFrame([(f"n{i}", "P", str(i), f"n{i}", {}) for i in range(n)] + [(f"r{i}", "R", str(i), f"r{i}", {}) for i in range(3)], "node_id string, label string, key string, name string, props map<string,string>")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "NEXT") for i in range(n - 1)] + [(f"r{i}", f"r{(i + 1) % 3}", "NEXT") for i in range(3)], "src string, dst string, type string")
    g = cypher.Graph(nodes, edges)
    at = lambda q: sorted(int(r.k) for r in cypher.run(g, q, limit=1_000).collect())
    assert at("MATCH (a:P {key: '0'})-[:NEXT*]->(b) RETURN b.key AS k") == list(range(1, n))
    assert at("MATCH (a:P {key: '0'})-[:NEXT*3..]->(b) RETURN b.key AS k") == list(range(3, n))
    assert at("MATCH (a:P {key: '0'})-[:NEXT*2..4]->(b) RETURN b.key AS k") == [2, 3, 4]
    assert at("MATCH (a:R {key: '0'})-[:NEXT*2..]->(b) RETURN b.key AS k") == [0, 1, 2]


def test_wide_tables_are_not_cut(spark, monkeypatch):
    from graphloom import sinks

    monkeypatch.setattr(sinks, "MAX_COLUMNS", 3)
    df = spark.createDataFrame([("a", {f"p{i}": "x" for i in range(4)})], "k string, props map<string,string>")
    with pytest.raises(ValueError):
        sinks.wide(df, "k", "props")
