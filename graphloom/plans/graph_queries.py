"""Queries of the graph operators, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import cypher
from ..model import BOTH_SQL, EDGES_SQL, GRAPH_SQL, NODES_SQL, edges, nodes
from ..operators import graph as G
from ..session import tune
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its twin."""

    def add(fn):
        def call(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        call.__name__, call.__doc__ = name, fn.__doc__
        QUERIES[name] = call
        if sql:
            SQL[name] = sql
        return fn

    return add


def with_graph(sql: str) -> str:
    return f"WITH {GRAPH_SQL} {sql}"


def with_nodes(sql: str) -> str:
    return f"WITH {NODES_SQL} {sql}"


def with_edges(sql: str) -> str:
    return f"WITH {EDGES_SQL} {sql}"


# --- counts and scans
@query("label_counts", with_nodes("SELECT label, count(*) n FROM nodes GROUP BY label"))
def _(s, d):
    return nodes(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("edge_type_counts", with_edges("SELECT type, count(*) n FROM edges GROUP BY type"))
def _(s, d):
    return edges(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("graph_totals", with_graph("SELECT (SELECT count(*) FROM nodes) n_nodes, (SELECT count(*) FROM edges) n_edges"))
def _(s, d):
    n, e = nodes(s, d).agg(F.count(F.lit(1)).alias("n_nodes")), edges(s, d).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.crossJoin(e)  # one row each


@query("node_lookup", with_nodes("SELECT node_id, name FROM nodes WHERE label = 'Customer' AND key = '7'"))
def _(s, d):
    return nodes(s, d, ["Customer"]).where("key = '7'").select("node_id", "name")


@query("scan_missing_embedding", "SELECT node_id, label FROM kg_nodes WHERE embedding IS NULL")
def _(s, d):
    return table(s, d, "kg_nodes", ["node_id", "label", "embedding"]).where("embedding is null").select("node_id", "label")


@query("scan_vectors", "SELECT node_id, coalesce(embed_text, '') embed_text FROM kg_nodes WHERE embedding IS NOT NULL")
def _(s, d):
    return table(s, d, "kg_nodes", ["node_id", "embed_text", "embedding"]).where("embedding is not null").select("node_id", F.coalesce("embed_text", F.lit("")).alias("embed_text"))


@query("embedding_coverage", "SELECT label, count(*) n, count(embedding) embedded, floor(count(embedding) * 1.0 / count(*) * 10000 + 0.5) / 10000 coverage FROM kg_nodes GROUP BY label")
def _(s, d):
    g = table(s, d, "kg_nodes", ["label", "embedding"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("embedded"))
    return g.withColumn("coverage", F.floor(F.col("embedded") / F.col("n") * 10000 + 0.5) / 10000)


@query("catalog_counts", " UNION ALL ".join(f"SELECT '{t}' dataset, count(*) n FROM {t}" for t in ("case_records", "person_records", "documents", "kg_nodes")))
def _(s, d):
    from ..sources.files import catalogue

    return catalogue({t: table(s, d, t) for t in ("case_records", "person_records", "documents", "kg_nodes")})


@query("next_sequence_id", "SELECT CAST(coalesce(max(TRY_CAST(regexp_extract(case_id, '^FIR-2024-(\\d+)', 1) AS BIGINT)), 0) + 1 AS BIGINT) next_id FROM case_records")
def _(s, d):
    from ..sources.files import next_sequence

    return next_sequence(table(s, d, "case_records", ["case_id"]), "case_id", "FIR-2024-")


@query("prefer_variant", "SELECT regexp_replace(source, '[0-9]$', '') base, max(source) picked FROM (SELECT DISTINCT coalesce(source, 'none') source FROM documents) GROUP BY 1")
def _(s, d):
    from ..sources.files import prefer_variant

    t = table(s, d, "documents", ["source"]).select(F.coalesce("source", F.lit("none")).alias("source")).distinct()
    return prefer_variant(t, "source", "_facts").select("base", F.col("source").alias("picked"))


@query("kv_parse", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) k FROM events")
def _(s, d):
    from ..sources.files import key_values

    t = table(s, d, "events", ["event_id", "ts", "props"])
    text = F.concat(F.col("ts").cast("string"), F.lit("\nrun\nk: "), F.get_json_object("props", "$.k"))
    return t.select("event_id", text.alias("t")).select("event_id", key_values(F.col("t"), ("k",), ())[2])


# --- filters and projections
@query("property_search", with_nodes("SELECT node_id FROM nodes JOIN part ON node_id = 'Part:' || CAST(p_partkey AS VARCHAR) WHERE label = 'Part' AND (contains(p_brand, '2') OR contains(p_type, '2'))"))
def _(s, d):
    n = nodes(s, d, ["Part"])
    return n.where(F.exists(F.map_values("props"), lambda v: F.contains(v, F.lit("2")))).select("node_id")


@query("keyword_search", with_nodes("SELECT node_id, name FROM nodes WHERE contains(lower(name), 'nation_1') OR contains(lower(name), 'asia')"))
def _(s, d):
    return nodes(s, d).where(F.lower("name").contains("nation_1") | F.lower("name").contains("asia")).select("node_id", "name")


@query("ci_equality", with_nodes("SELECT node_id FROM nodes WHERE lower(name) = lower('Asia')"))
def _(s, d):
    return nodes(s, d).where(F.lower("name") == F.lower(F.lit("Asia"))).select("node_id")


@query("quantified_predicates", "SELECT case_id FROM gold_cases WHERE len(list_filter(gold.locations, lambda x: contains(x, 'Block'))) > 0 AND len(list_filter(gold.crime_types, lambda x: contains(x, 'murder'))) = 0")
def _(s, d):
    t = table(s, d, "gold_cases", ["case_id", "gold"])
    return t.where(F.exists("gold.locations", lambda x: F.contains(x, F.lit("Block"))) & ~F.exists("gold.crime_types", lambda x: F.contains(x, F.lit("murder")))).select("case_id")


@query("label_membership", with_nodes("SELECT node_id FROM nodes WHERE label IN ('Region', 'Nation')"))
def _(s, d):
    return nodes(s, d).where(F.array_contains(F.array(F.lit("Region"), F.lit("Nation")), F.col("label"))).select("node_id")


@query("id_in_list", with_nodes("SELECT node_id, name FROM nodes WHERE node_id IN ('Nation:1', 'Nation:2', 'Customer:3')"))
def _(s, d):
    return nodes(s, d).where(F.col("node_id").isin("Nation:1", "Nation:2", "Customer:3")).select("node_id", "name")


@query("distinct_filtered", "SELECT DISTINCT lower(gender) g FROM person_records WHERE contains(lower(role), 'suspect') AND gender IS NOT NULL ORDER BY g LIMIT 5")
def _(s, d):
    t = table(s, d, "person_records", ["role", "gender"])
    return t.where(F.lower("role").contains("suspect") & F.col("gender").isNotNull()).select(F.lower("gender").alias("g")).distinct().orderBy("g").limit(5)


@query("prefix_join", "SELECT k.node_id, count(*) n FROM kg_nodes k JOIN case_records c ON c.case_id = k.case_id WHERE starts_with(k.node_id, 'FIR-2019') GROUP BY k.node_id")
def _(s, d):
    k, c = table(s, d, "kg_nodes", ["node_id", "case_id"]).where(F.col("node_id").startswith("FIR-2019")), table(s, d, "case_records", ["case_id"])
    return k.join(c, "case_id").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query("visible_types", with_graph("SELECT src, dst, type FROM edges WHERE split_part(src, ':', 1) IN ('Nation', 'Region') AND split_part(dst, ':', 1) IN ('Nation', 'Region')"))
def _(s, d):
    return G.induced(edges(s, d), nodes(s, d, ["Nation", "Region"])).select("src", "dst", "type")


@query("display_name", "SELECT node_id, coalesce(nullif(val, ''), nullif(embed_text, ''), node_id) shown FROM kg_nodes")
def _(s, d):
    return table(s, d, "kg_nodes", ["node_id", "val", "embed_text"]).select("node_id", F.coalesce(F.nullif("val", F.lit("")), F.nullif("embed_text", F.lit("")), "node_id").alias("shown"))


@query("primary_label", "SELECT node_id, label AS first_label FROM kg_nodes WHERE label IS NOT NULL")
def _(s, d):
    labels = F.array(F.lit("Embedded"), F.col("label"))
    return table(s, d, "kg_nodes", ["node_id", "label"]).select("node_id", F.try_element_at(F.filter(labels, lambda x: x != "Embedded"), F.lit(1)).alias("first_label")).where("first_label is not null")


@query("first_id_key", "SELECT case_id v, count(*) n FROM case_records WHERE case_id IS NOT NULL GROUP BY case_id")
def _(s, d):
    m = F.create_map(F.lit("title"), F.col("title"), F.lit("case_id"), F.col("case_id"))
    k = F.try_element_at(F.filter(F.map_keys(m), lambda x: F.endswith(x, F.lit("_id"))), F.lit(1))
    return table(s, d, "case_records", ["case_id", "title"]).select(F.element_at(m, k).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query("strip_internal", "SELECT node_id, label, val FROM kg_nodes")
def _(s, d):
    return table(s, d, "kg_nodes").drop("embedding", "embed_text", "is_embedded", "case_id")


@query("named_projection", "SELECT case_id, title || '|' || coalesce(status, '') s FROM case_records")
def _(s, d):
    t = table(s, d, "case_records", ["case_id", "title", "status"]).select("case_id", F.struct("title", F.coalesce("status", F.lit("")).alias("status")).alias("p"))
    return t.select("case_id", F.concat_ws("|", "p.title", "p.status").alias("s"))


@query("record_value", "SELECT person_id, coalesce(nullif(name, ''), nullif(description, ''), nullif(role, '')) v FROM person_records")
def _(s, d):
    t = table(s, d, "person_records", ["person_id", "name", "description", "role"])
    return t.select("person_id", F.coalesce(*[F.nullif(c, F.lit("")) for c in ("name", "description", "role")]).alias("v"))


# --- joins
@query("one_hop_typed", with_edges("SELECT src, dst FROM edges WHERE type = 'PLACED' AND src IN ('Customer:1', 'Customer:4', 'Customer:7')"))
def _(s, d):
    return edges(s, d, ["PLACED"]).where(F.col("src").isin("Customer:1", "Customer:4", "Customer:7")).select("src", "dst")


@query("one_hop_undirected", f"WITH {EDGES_SQL}, {BOTH_SQL} SELECT y node_id FROM both_ways WHERE x = 'Nation:3'")
def _(s, d):
    return G.undirected(edges(s, d)).where("x = 'Nation:3'").select(F.col("y").alias("node_id"))


@query("optional_match", "SELECT n.n_name name, count(s.s_suppkey) n FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
def _(s, d):
    n, b = nodes(s, d, ["Nation"]), edges(s, d, ["BASED_IN"])
    return n.join(b, n["node_id"] == b["dst"], "left").groupBy("name").agg(F.count("src").alias("n"))


@query("optional_branches_agg", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) n_orders, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) nation FROM customer")
def _(s, d):
    c = table(s, d, "customer", ["c_custkey", "c_nationkey"])
    o = table(s, d, "orders", ["o_custkey"]).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    n = table(s, d, "nation", ["n_nationkey", "n_name"]).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return c.join(o, "c_custkey", "left").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).cast("bigint").alias("n_orders"), "nation")


@query("fallback_match", "SELECT c_custkey k, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'P' ELSE 'any' END origin, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND (o_orderstatus = 'P' OR NOT EXISTS (SELECT 1 FROM orders q WHERE q.o_custkey = c_custkey AND q.o_orderstatus = 'P'))) n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s, d):
    o = table(s, d, "orders", ["o_custkey", "o_orderstatus"])
    a, b = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.lit("P").alias("origin")), o.select(F.col("o_custkey").alias("k"), F.lit("any").alias("origin"))
    return G.prefer([a.groupBy("k", "origin").agg(F.count(F.lit(1)).alias("n")), b.groupBy("k", "origin").agg(F.count(F.lit(1)).alias("n"))], "k")


@query("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(s, d):
    return table(s, d, "customer", ["c_custkey"]).join(table(s, d, "orders", ["o_custkey", "o_totalprice"]).where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("anti_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM review_labels WHERE doc_id IS NOT NULL)")
def _(s, d):
    return table(s, d, "documents", ["doc_id"]).join(table(s, d, "review_labels", ["doc_id"]), "doc_id", "left_anti")


@query("batch_lookup_join", "SELECT e.event_id, s.tz_name FROM time_events e LEFT JOIN stations s ON e.station_code = s.station_code")
def _(s, d):
    return table(s, d, "time_events", ["event_id", "station_code"]).join(table(s, d, "stations", ["station_code", "tz_name"]), "station_code", "left").select("event_id", "tz_name")


@query("id_remap", "SELECT coalesce(x.n, m.a) src, coalesce(y.n, m.b) dst FROM match_candidates m LEFT JOIN (SELECT node_id o, label || '/' || node_id n FROM kg_nodes) x ON x.o = m.a LEFT JOIN (SELECT node_id o, label || '/' || node_id n FROM kg_nodes) y ON y.o = m.b")
def _(s, d):
    m = table(s, d, "match_candidates", ["a", "b"]).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("X").alias("type"))
    ids = table(s, d, "kg_nodes", ["node_id", "label"]).select(F.col("node_id").alias("old_id"), F.concat_ws("/", "label", "node_id").alias("new_id"))
    return G.remap(m, ids).select("src", "dst")


@query("anchor_edges", "SELECT DISTINCT c.case_id src, k.node_id dst FROM kg_nodes k JOIN case_records c ON c.case_id = k.case_id")
def _(s, d):
    k, c = table(s, d, "kg_nodes", ["node_id", "case_id"]), table(s, d, "case_records", ["case_id"]).distinct()
    return k.join(c, "case_id").select(F.col("case_id").alias("src"), F.col("node_id").alias("dst")).distinct()


@query("endpoint_type_resolution", "WITH k AS (SELECT CAST(c_custkey AS VARCHAR) key, 2 o, 'Customer' l FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 1, 'Supplier' FROM supplier) SELECT key, min_by(l, o) label FROM k GROUP BY key")
def _(s, d):
    from ..ontology import NodeType, Ontology, endpoint_types

    o = Ontology({n: NodeType(n, {}, "key") for n in ("Supplier", "Customer")}, {})
    n = nodes(s, d, ["Customer", "Supplier"]).select("label", "key")
    return endpoint_types(s, n.select("key").distinct(), n, o)


@query("blocked_incremental_join", "SELECT n.node_id a, k.node_id b FROM kg_nodes n JOIN kg_nodes k ON n.label = k.label AND n.val = k.val AND n.case_id <> k.case_id WHERE starts_with(n.case_id, 'FIR-2024')")
def _(s, d):
    """(a, b): as blocked_incremental_join, all cases of the newest year as the new side."""
    k = table(s, d, "kg_nodes", ["node_id", "label", "val", "case_id"])
    n = k.where(F.col("case_id").startswith("FIR-2024")).select(F.col("node_id").alias("a"), "label", "val", F.col("case_id").alias("c"))
    return G.equal_pairs(n, k.withColumnRenamed("node_id", "b"), ["label", "val"]).where("c <> case_id").select("a", "b")


# --- traversal
START = "Customer:1"


def _reach_sql(depth: int, tail: str) -> str:
    levels = [f"l0 AS (SELECT '{START}' node_id)"]
    for i in range(1, depth + 1):
        levels.append(f"l{i} AS (SELECT node_id FROM l{i - 1} UNION SELECT y FROM l{i - 1} JOIN both_ways ON x = node_id)")
    return f"WITH {EDGES_SQL}, {BOTH_SQL}, {', '.join(levels)} {tail}"


def _start(s):
    return s.createDataFrame([(START,)], "node_id string")


for _depth in (1, 2, 3):

    @query(f"subgraph_k{_depth}", _reach_sql(_depth, f"SELECT node_id FROM l{_depth}"))
    def _(s, d, depth=_depth):
        return G.reach(_start(s), edges(s, d, once=False), depth).select("node_id")


@query("subgraph_induced_edges", _reach_sql(2, "SELECT src, dst, type FROM edges WHERE src IN (SELECT node_id FROM l2) AND dst IN (SELECT node_id FROM l2)"))
def _(s, d):
    return G.induced(edges(s, d), G.reach(_start(s), edges(s, d, once=False), 2)).select("src", "dst", "type")


@query("varlen_context", f"WITH {GRAPH_SQL}, {BOTH_SQL}, h AS (SELECT DISTINCT a.x s, b.y t FROM both_ways a JOIN both_ways b ON a.y = b.x WHERE starts_with(a.x, 'Supplier:') AND starts_with(a.y, 'Nation:') UNION SELECT x, y FROM both_ways WHERE starts_with(x, 'Supplier:') AND starts_with(y, 'Nation:')) SELECT s node_id, array_to_string(list_sort(list(DISTINCT name))[1:40], '|') ctx FROM h JOIN nodes ON node_id = t WHERE t <> s AND (label = 'Region' OR label = 'Nation') GROUP BY s")
def _(s, d):
    e = edges(s, d, ["BASED_IN", "PART_OF"])
    both, names = G.undirected(e), nodes(s, d, ["Region", "Nation"]).select(F.col("node_id").alias("t"), "name")
    one = both.where(F.col("x").startswith("Supplier:")).select(F.col("x").alias("s"), F.col("y").alias("t"))
    # only regions and nations are named in the end: the other suppliers of a nation aren't paired with each of its suppliers
    named = both.join(names.select(F.col("t").alias("y")), "y", "left_semi")
    two = one.join(named, F.col("t") == F.col("x")).select("s", F.col("y").alias("t"))
    h = one.unionByName(two).distinct().where("s <> t").join(names, "t")
    return h.groupBy(F.col("s").alias("node_id")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 40), "|").alias("ctx"))


@query("relationship_patterns", with_edges("SELECT DISTINCT split_part(src, ':', 1) a, type, split_part(dst, ':', 1) b FROM edges ORDER BY a, type, b LIMIT 40"))
def _(s, d):
    part = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    return edges(s, d).select(part(F.col("src")).alias("a"), "type", part(F.col("dst")).alias("b")).distinct().orderBy("a", "type", "b").limit(40)


@query("full_graph_sample", with_graph("SELECT n.node_id, e.dst FROM (SELECT node_id FROM nodes ORDER BY node_id LIMIT 50) n LEFT JOIN edges e ON e.src = n.node_id"))
def _(s, d):
    n = nodes(s, d).select("node_id").orderBy("node_id").limit(50)
    e = edges(s, d)
    return n.join(e, n["node_id"] == e["src"], "left").select("node_id", "dst")


@query("two_hop_fallback", with_edges("SELECT DISTINCT a.src s, b.dst t FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'LOCATED_IN' AND b.type = 'PART_OF'"))
def _(s, d):
    a, b = edges(s, d, ["LOCATED_IN"]).select(F.col("src").alias("s"), F.col("dst").alias("m")), edges(s, d, ["PART_OF"]).select(F.col("src").alias("m"), F.col("dst").alias("t"))
    return a.join(b, "m").select("s", "t").distinct()


@query("case_summary", f"WITH {GRAPH_SQL}, {BOTH_SQL} SELECT n.label, n.node_id FROM both_ways JOIN nodes n ON n.node_id = y WHERE x = '{START}' ORDER BY n.node_id LIMIT 50")
def _(s, d):
    near = G.undirected(edges(s, d)).where(F.col("x") == START).select(F.col("y").alias("node_id"))
    return nodes(s, d).join(near, "node_id", "left_semi").select("label", "node_id").orderBy("node_id").limit(50)


@query("reverse_hop_template", "SELECT n_name name, count(*) n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(s, d):
    e, n = edges(s, d, ["LOCATED_IN"]), nodes(s, d, ["Nation"])
    return n.join(e, n["node_id"] == e["dst"]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_SAME = "same AS (SELECT DISTINCT least(a, b) u, greatest(a, b) v FROM match_candidates WHERE accepted AND a <> b), sym AS (SELECT u x, v y FROM same UNION SELECT v, u FROM same)"


def _same_as(s, d):
    m = table(s, d, "match_candidates", ["a", "b", "accepted"]).where("accepted and a <> b")
    return m.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()


@query("same_as_closure", f"WITH {_SAME}, s0 AS (SELECT node_id FROM kg_nodes WHERE label = 'Person'), s1 AS (SELECT node_id a, node_id b FROM s0 UNION SELECT node_id, y FROM s0 JOIN sym ON x = node_id), s2 AS (SELECT a, b FROM s1 UNION SELECT a, y FROM s1 JOIN sym ON x = b), s3 AS (SELECT a, b FROM s2 UNION SELECT a, y FROM s2 JOIN sym ON x = b) SELECT a node_id, count(DISTINCT k.case_id) case_count FROM s3 JOIN kg_nodes k ON k.node_id = b GROUP BY a")
def _(s, d):
    """(node_id, case_count): as same_as_closure, from every person."""
    k = table(s, d, "kg_nodes", ["node_id", "label", "case_id"])
    pairs = _same_as(s, d)
    sym = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    seen = k.where("label = 'Person'").select(F.col("node_id").alias("a"), F.col("node_id").alias("b")).distinct()
    for _i in range(3):
        seen = seen.unionByName(seen.join(sym, F.col("b") == F.col("x")).select("a", F.col("y").alias("b"))).distinct()
    return seen.join(k.select(F.col("node_id").alias("b"), "case_id"), "b").groupBy(F.col("a").alias("node_id")).agg(F.count_distinct("case_id").alias("case_count"))


@query("cross_case_lookup", f"WITH {_SAME}, p AS (SELECT node_id, case_id FROM kg_nodes WHERE label = 'Person'), s1 AS (SELECT node_id a, node_id b FROM p UNION SELECT node_id, y FROM p JOIN sym ON x = node_id), s2 AS (SELECT a, b FROM s1 UNION SELECT a, y FROM s1 JOIN sym ON x = b), s3 AS (SELECT a, b FROM s2 UNION SELECT a, y FROM s2 JOIN sym ON x = b), t AS (SELECT case_id, min(title) title FROM case_records GROUP BY 1) SELECT DISTINCT s3.a node_id, k.case_id, t.title FROM s3 JOIN p ON p.node_id = s3.a JOIN kg_nodes k ON k.node_id = s3.b LEFT JOIN t ON t.case_id = k.case_id WHERE k.case_id <> p.case_id")
def _(s, d):
    """(node_id, case_id, title): other cases in which a person occurs, through up to three links."""
    k = table(s, d, "kg_nodes", ["node_id", "label", "case_id"])
    pairs = _same_as(s, d)
    sym = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    people = k.where("label = 'Person'").select(F.col("node_id").alias("a"), F.col("case_id").alias("own"))
    seen = people.select("a", F.col("a").alias("b"))
    for _i in range(3):
        seen = seen.unionByName(seen.join(sym, F.col("b") == F.col("x")).select("a", F.col("y").alias("b"))).distinct()
    titles = table(s, d, "case_records", ["case_id", "title"]).groupBy("case_id").agg(F.min("title").alias("title"))
    at = seen.join(k.select(F.col("node_id").alias("b"), "case_id"), "b").join(people, "a").where("case_id <> own").select(F.col("a").alias("node_id"), "case_id").distinct()
    return at.join(titles, "case_id", "left").select("node_id", "case_id", "title")

_CC = f"WITH RECURSIVE {_SAME}, r(x, m) AS (SELECT x, x FROM sym UNION SELECT sym.y, r.m FROM r JOIN sym ON sym.x = r.x WHERE r.m < sym.y), c AS (SELECT x node_id, min(m) component FROM r GROUP BY x)"


@query("connected_components", f"{_CC} SELECT node_id, component FROM c")
def _(s, d):
    return G.components(s, _same_as(s, d))


@query("component_sizes", f"{_CC} SELECT size, count(*) n FROM (SELECT component, count(*) size FROM c GROUP BY component) GROUP BY size")
def _(s, d):
    return G.components(s, _same_as(s, d)).groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


# --- writes as resulting frames
@query("upsert_nodes", "SELECT 'Customer' label, key, seg, note, created FROM (SELECT CAST(c_custkey AS VARCHAR) key, c_mktsegment seg, CASE WHEN c_custkey % 10 = 0 THEN 'seen' END note, false created FROM customer UNION ALL SELECT 'new' || CAST(s_suppkey AS VARCHAR), NULL, 'seen', true FROM supplier)")
def _(s, d):
    old = nodes(s, d, ["Customer"]).select("label", "key", F.map_from_arrays(F.array(F.lit("seg")), F.array(F.col("props").getItem("c_mktsegment"))).alias("props"))
    upd = table(s, d, "customer", ["c_custkey"]).where("c_custkey % 10 = 0").select(F.lit("Customer").alias("label"), F.col("c_custkey").cast("string").alias("key"))
    upd = upd.unionByName(table(s, d, "supplier", ["s_suppkey"]).select(F.lit("Customer").alias("label"), F.concat(F.lit("new"), F.col("s_suppkey").cast("string")).alias("key")))
    upd = upd.select("label", "key", F.create_map(F.lit("note"), F.lit("seen"), F.lit("seg"), F.lit(None).cast("string")).alias("props"), F.lit(0).alias("ordinal"))
    return G.upsert_nodes(old, upd).select("label", "key", F.col("props").getItem("seg").alias("seg"), F.col("props").getItem("note").alias("note"), "created")


@query("upsert_edges", with_edges("SELECT src, type, dst FROM edges WHERE type = 'BASED_IN' UNION SELECT 'Supplier:' || CAST(s_suppkey AS VARCHAR), 'NEAR', 'Nation:' || CAST(s_nationkey AS VARCHAR) FROM supplier"))
def _(s, d):
    empty = F.create_map().cast("map<string,string>").alias("props")
    old = edges(s, d, ["BASED_IN"]).select("src", "type", "dst", empty)
    upd = table(s, d, "supplier", ["s_suppkey", "s_nationkey"]).select(F.concat(F.lit("Supplier:"), F.col("s_suppkey").cast("string")).alias("src"), F.lit("NEAR").alias("type"), F.concat(F.lit("Nation:"), F.col("s_nationkey").cast("string")).alias("dst"), empty, F.lit(1).alias("ordinal"))
    bad = upd.withColumn("dst", F.lit("Nation:none"))
    return G.upsert_edges(old, upd.unionByName(upd).unionByName(bad), nodes(s, d, ["Supplier", "Nation"])).select("src", "type", "dst")


@query("same_as_upsert", "WITH m AS (SELECT least(a, b) src, greatest(a, b) dst, scored_at, max(conf) conf FROM match_candidates WHERE accepted AND a <> b AND conf IS NOT NULL AND scored_at IS NOT NULL AND a IN (SELECT node_id FROM kg_nodes) AND b IN (SELECT node_id FROM kg_nodes) GROUP BY 1, 2, 3) SELECT src, dst, arg_max(conf, scored_at) score FROM m GROUP BY 1, 2")
def _(s, d):
    """(src, dst, score): links told apart by their ends alone; the score last set stands."""
    m = table(s, d, "match_candidates", ["a", "b", "accepted", "conf", "scored_at"]).where("accepted and a <> b and conf is not null and scored_at is not null")
    m = m.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "scored_at").agg(F.max("conf").alias("conf"))
    upd = m.select("src", F.lit("SAME_AS").alias("type"), "dst", F.create_map(F.lit("score"), F.col("conf").cast("string")).alias("props"), F.unix_micros(F.col("scored_at").cast("timestamp")).alias("ordinal"))
    out = G.upsert_edges(upd.drop("ordinal").limit(0), upd, table(s, d, "kg_nodes", ["node_id"]), by_props=False)
    return out.select("src", "dst", F.col("props").getItem("score").cast("double").alias("score"))


@query("upsert_idempotent", "SELECT count(*) n, count(DISTINCT n_nationkey) k FROM nation")
def _(s, d):
    old = nodes(s, d, ["Nation"]).select("label", "key", "props")
    upd = old.withColumn("ordinal", F.lit(0))
    once = G.upsert_nodes(old, upd).drop("created")
    return G.upsert_nodes(once, upd).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("k"))


@query("unique_key_violations", "SELECT 'Case' label, case_id key, count(*) n FROM case_records GROUP BY case_id HAVING count(*) > 1")
def _(s, d):
    return G.unique_violations(table(s, d, "case_records", ["case_id"]).select(F.lit("Case").alias("label"), F.col("case_id").alias("key")))


@query("validate_nodes", "SELECT person_id key, (name IS NOT NULL AND role IS NOT NULL) valid FROM person_records")
def _(s, d):
    from ..ontology import NodeType, Ontology, valid_nodes

    o = Ontology({"Person": NodeType("Person", {}, "person_id", ["name", "role"])}, {})
    props = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("role"), F.col("role")), lambda k, v: v.isNotNull())
    return valid_nodes(s, table(s, d, "person_records", ["person_id", "name", "role"]).select(F.lit("Person").alias("label"), F.col("person_id").alias("key"), props.alias("props")), o).select("key", "valid")


@query("validate_edges", with_edges("SELECT src, dst, type FROM edges WHERE type IN ('PART_OF', 'LOCATED_IN')"))
def _(s, d):
    from ..ontology import Ontology, RelType, valid_edges

    o = Ontology({}, {"PART_OF": RelType("PART_OF", ["Nation"], ["Region"]), "LOCATED_IN": RelType("LOCATED_IN", ["Customer"], ["Nation"]), "PLACED": RelType("PLACED", ["Order"], ["Customer"])})
    part = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    e = edges(s, d).withColumn("src_label", part(F.col("src"))).withColumn("dst_label", part(F.col("dst")))
    return valid_edges(s, e, o).select("src", "dst", "type")


@query("embedding_write", "SELECT node_id, (embedding IS NOT NULL OR val IS NOT NULL) has_vector FROM kg_nodes")
def _(s, d):
    k = table(s, d, "kg_nodes", ["node_id", "val", "embedding"])
    upd = k.where("embedding is null and val is not null").select("node_id", F.array(F.lit(1.0).cast("float")).alias("new"))
    return k.join(upd, "node_id", "left").select("node_id", F.coalesce("embedding", "new").isNotNull().alias("has_vector"))


@query("append_annotation", "SELECT node_id, count(*) n FROM (SELECT node_id FROM kg_nodes WHERE label = 'Weapon' UNION ALL SELECT node_id FROM kg_nodes WHERE label = 'Weapon' AND val = 'nylon rope') GROUP BY node_id")
def _(s, d):
    k = table(s, d, "kg_nodes", ["node_id", "label", "val"]).where("label = 'Weapon'")
    return k.select("node_id").unionByName(k.where("val = 'nylon rope'").select("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query("status_update", "SELECT case_id, CASE WHEN case_id = 'FIR-2019-00000000' THEN 'closed' ELSE status END status FROM case_records")
def _(s, d):
    from ..sinks import set_status

    return set_status(table(s, d, "case_records", ["case_id", "status"]), "FIR-2019-00000000", "closed")


@query("case_report_counts", _reach_sql(3, f"SELECT '{START}' case_id, (SELECT count(*) FROM l3) n_nodes, (SELECT count(*) FROM edges WHERE src IN (SELECT node_id FROM l3) AND dst IN (SELECT node_id FROM l3)) n_edges"))
def _(s, d):
    r = G.reach(_start(s), edges(s, d, once=False), 3)
    n, m = r.agg(F.count(F.lit(1)).alias("n_nodes")), G.induced(edges(s, d), r).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.crossJoin(m).select(F.lit(START).alias("case_id"), "n_nodes", "n_edges")  # one row each


# --- top-k, sets, collections
@query("topk_recent", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def _(s, d):
    return table(s, d, "events", ["event_id", "ts"]).orderBy(F.desc("ts"), "event_id").limit(20)


@query("ordered_list_200", "SELECT DISTINCT case_id FROM case_records ORDER BY case_id LIMIT 200")
def _(s, d):
    return table(s, d, "case_records", ["case_id"]).distinct().orderBy("case_id").limit(200)


@query("page_sort", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'customer') ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 20")
def _(s, d):
    return table(s, d, "customer", ["c_custkey", "c_name", "c_acctbal"]).where(F.lower("c_name").contains("customer")).orderBy(F.desc("c_acctbal"), "c_custkey").offset(20).limit(10).select("c_custkey", "c_name")


@query("set_union_distinct", "SELECT c_nationkey k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(s, d):
    return table(s, d, "customer", ["c_nationkey"]).select(F.col("c_nationkey").alias("k")).unionByName(table(s, d, "supplier", ["s_nationkey"]).select(F.col("s_nationkey").alias("k"))).distinct()


@query("set_except_both", "(SELECT 'left' side, l_partkey k FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)) UNION ALL (SELECT 'right', l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity < 3) WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45))")
def _(s, d):
    t = table(s, d, "lineitem", ["l_partkey", "l_quantity"])
    a, b = t.where("l_quantity > 45").select(F.col("l_partkey").alias("k")), t.where("l_quantity < 3").select(F.col("l_partkey").alias("k"))
    return a.exceptAll(a.limit(0)).distinct().join(b, "k", "left_anti").select(F.lit("left").alias("side"), "k").unionByName(b.distinct().join(a, "k", "left_anti").select(F.lit("right").alias("side"), "k"))


@query("set_intersect", "SELECT c_nationkey k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(s, d):
    return table(s, d, "customer", ["c_nationkey"]).select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier", ["s_nationkey"]).select(F.col("s_nationkey").alias("k")))


@query("pool_merge", "SELECT arg_min(name, o) name FROM (SELECT r_name name, 0 o FROM region UNION ALL SELECT lower(r_name), 1 FROM region UNION ALL SELECT n_name, 2 FROM nation) GROUP BY lower(name)")
def _(s, d):
    r, n = table(s, d, "region", ["r_name"]), table(s, d, "nation", ["n_name"])
    pool = r.select(F.col("r_name").alias("name"), F.lit(0).alias("o")).unionByName(r.select(F.lower("r_name").alias("name"), F.lit(1).alias("o"))).unionByName(n.select(F.col("n_name").alias("name"), F.lit(2).alias("o")))
    return G.first_seen(pool.withColumn("k", F.lower("name")), ["k"], ["o"]).select("name")


@query("modal_union", "SELECT n_name name, NULL::VARCHAR seg FROM nation UNION ALL SELECT c_name, c_mktsegment FROM customer")
def _(s, d):
    a, b = table(s, d, "nation", ["n_name"]).select(F.col("n_name").alias("name")), table(s, d, "customer", ["c_name", "c_mktsegment"]).select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(b, allowMissingColumns=True)


@query("collect_struct", "SELECT c_nationkey k, array_to_string(list_sort(list(c_name || '/' || c_mktsegment)), ';') m FROM customer GROUP BY c_nationkey")
def _(s, d):
    g = table(s, d, "customer", ["c_nationkey", "c_name", "c_mktsegment"]).groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list(F.concat_ws("/", "c_name", "c_mktsegment"))).alias("m"))
    return g.select("k", F.array_join("m", ";").alias("m"))


@query("group_type_counts", "SELECT label, count(*) n, array_to_string(list_sort(list(DISTINCT val)), '|') vals FROM kg_nodes WHERE val IS NOT NULL GROUP BY label ORDER BY n DESC, label")
def _(s, d):
    return table(s, d, "kg_nodes", ["label", "val"]).where("val is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("val")), "|").alias("vals")).orderBy(F.desc("n"), "label")


@query("agg_suite", "SELECT o_orderstatus, count(*) n, floor(sum(o_totalprice) * 100 + 0.5) / 100 total, floor(avg(o_totalprice) * 100 + 0.5) / 100 mean FROM orders GROUP BY o_orderstatus ORDER BY n DESC")
def _(s, d):
    r2 = lambda c: F.floor(c * 100 + 0.5) / 100
    return table(s, d, "orders", ["o_orderstatus", "o_totalprice"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), r2(F.sum("o_totalprice")).alias("total"), r2(F.avg("o_totalprice")).alias("mean")).orderBy(F.desc("n"))


@query("dedup_first_seen", "SELECT arg_min(doc_id, doc_id) doc_id FROM documents GROUP BY lower(trim(text))")
def _(s, d):
    # the first id of each text, by a hash aggregate instead of a sort
    return table(s, d, "documents", ["doc_id", "text"]).groupBy(F.lower(F.trim("text")).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("interleave_classes", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) rn FROM documents WHERE lang IN ('en', 'fr')) ORDER BY rn, lang LIMIT 40")
def _(s, d):
    t = table(s, d, "documents", ["doc_id", "lang"]).where(F.col("lang").isin("en", "fr"))
    return t.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))).orderBy("rn", "lang").limit(40).select("doc_id", "lang")


@query("one_per_combo", "SELECT lang, source, min(doc_id) doc_id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source")
def _(s, d):
    return G.first_seen(table(s, d, "documents", ["doc_id", "lang", "source"]).where("lang is not null and source is not null"), ["lang", "source"], ["doc_id"])


@query("round_robin", "SELECT doc_id, ['a', 'b', 'c'][CAST((doc_id % 3) AS INT) + 1] t FROM documents")
def _(s, d):
    kinds = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return table(s, d, "documents", ["doc_id"]).select("doc_id", F.element_at(kinds, (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("t"))


# --- Cypher
def _graph(s, d, labels=None, types=None):
    return cypher.Graph(nodes(s, d, labels), edges(s, d, types))


@query("cypher_match_return", "SELECT n_name name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def _(s, d):
    return cypher.run(_graph(s, d), "MATCH (n:Nation)-[:PART_OF]->(r:Region {name: $region}) RETURN n.name AS name", {"region": "ASIA"}, limit=None)


@query("cypher_agg", "SELECT c_custkey::VARCHAR key, count(*) n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def _(s, d):
    return cypher.run(_graph(s, d, ["Customer", "Order"], ["PLACED"]), "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.key AS key, count(o) AS n ORDER BY n DESC, key LIMIT 20")


@query("cypher_varlen", _reach_sql(2, f"SELECT node_id id FROM l2 WHERE node_id <> '{START}'"))
def _(s, d):
    return cypher.run(_graph(s, d), "MATCH (c:Customer {key: '1'})-[*1..2]-(m) WHERE m.node_id <> c.node_id RETURN DISTINCT m.node_id AS id", limit=None)


@query("cypher_optional", "SELECT n.n_name name, count(s.s_suppkey) n FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
def _(s, d):
    return cypher.run(_graph(s, d), "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:BASED_IN]->(n) RETURN n.name AS name, count(s) AS n", limit=None)


@query("cypher_unwind", "SELECT x, x * 2 y FROM (SELECT unnest([1, 2, 3]) x)")
def _(s, d):
    return cypher.run(_graph(s, d, ["Region"], ["PART_OF"]), "UNWIND [1, 2, 3] AS x RETURN x, x * 2 AS y", limit=None)


@query("cypher_with", "SELECT n_name name, count(*) k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 40")
def _(s, d):
    return cypher.run(_graph(s, d), "MATCH (c:Customer)-[:LOCATED_IN]->(n:Nation) WITH n, count(c) AS k WHERE k > 40 RETURN n.name AS name, k", limit=None)


@query("cypher_two_rels", "SELECT r_name region, count(*) pairs FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey::VARCHAR < b.n_nationkey::VARCHAR JOIN region ON r_regionkey = a.n_regionkey GROUP BY r_name")
def _(s, d):
    return cypher.run(_graph(s, d), "MATCH (a:Nation)-[:PART_OF]->(r:Region)<-[:PART_OF]-(b:Nation) WHERE a.key < b.key RETURN r.name AS region, count(*) AS pairs", limit=None)


@query("cypher_expressions", "SELECT r_name n, CASE WHEN starts_with(r_name, 'A') THEN 'a' ELSE 'other' END k, contains(r_name, 'E') e, lower(r_name) l FROM region")
def _(s, d):
    return cypher.run(_graph(s, d), "MATCH (r:Region) RETURN r.name AS n, CASE WHEN r.name STARTS WITH 'A' THEN 'a' ELSE 'other' END AS k, r.name CONTAINS 'E' AS e, toLower(r.name) AS l", limit=None)


@query("limit_injection", with_nodes("SELECT count(*) n FROM (SELECT node_id FROM nodes WHERE label = 'Customer' LIMIT 50)"))
def _(s, d):
    return cypher.run(_graph(s, d), "MATCH (c:Customer) RETURN c.key AS key").agg(F.count(F.lit(1)).alias("n"))


@query("query_text_labels", "SELECT q, array_to_string(list_sort(list_distinct(regexp_extract_all(q, ':([A-Z][A-Za-z]+)', 1))), '|') labels FROM (SELECT unnest(['MATCH (a:Customer)-[:PLACED]->(o:Order)', 'MATCH (n:Nation)']) q)")
def _(s, d):
    q = s.createDataFrame([("MATCH (a:Customer)-[:PLACED]->(o:Order)",), ("MATCH (n:Nation)",)], "q string")
    return q.select("q", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("q", F.lit(":([A-Z][A-Za-z]+)"), 1))), "|").alias("labels"))


@query("schema_hallucination", with_nodes("SELECT l FROM (SELECT unnest(['Customer', 'Wizard', 'Nation', 'Dragon']) l) WHERE l NOT IN (SELECT label FROM nodes)"))
def _(s, d):
    used = s.createDataFrame([(x,) for x in ("Customer", "Wizard", "Nation", "Dragon")], "l string")
    return used.join(nodes(s, d).select(F.col("label").alias("l")).distinct(), "l", "left_anti")


@query("blob_contains", "SELECT n_nationkey k, contains(lower(n_name), 'nation_2') hit FROM nation")
def _(s, d):
    return table(s, d, "nation", ["n_nationkey", "n_name"]).select(F.col("n_nationkey").alias("k"), F.lower(F.to_json(F.struct("n_name"))).contains("nation_2").alias("hit"))


@query("same_as_template", f"WITH {_SAME}, p AS (SELECT node_id, case_id FROM kg_nodes WHERE label = 'Person' AND case_id IS NOT NULL), sp AS (SELECT x, y FROM sym WHERE x IN (SELECT node_id FROM p) AND y IN (SELECT node_id FROM p)), s1 AS (SELECT node_id a, node_id b FROM p UNION SELECT node_id, y FROM p JOIN sp ON x = node_id), s2 AS (SELECT a, b FROM s1 UNION SELECT a, y FROM s1 JOIN sp ON x = b), s3 AS (SELECT a, b FROM s2 UNION SELECT a, y FROM s2 JOIN sp ON x = b) SELECT DISTINCT s3.a person, p.case_id \"case\" FROM s3 JOIN p ON p.node_id = s3.b")
def _(s, d):
    """(person, case): the recommended cross-case pattern, run as a query: every case a person or one linked to them within three steps is involved in."""
    k = table(s, d, "kg_nodes", ["node_id", "label", "case_id"]).where("label = 'Person' and case_id is not null")
    none = F.create_map().cast("map<string,string>")
    people = k.select("node_id", "label", F.col("node_id").alias("key"), F.lit(None).cast("string").alias("name"), none.alias("props"))
    cases = k.select("case_id").distinct().select(F.concat(F.lit("case:"), "case_id").alias("node_id"), F.lit("Case").alias("label"), F.col("case_id").alias("key"), F.lit(None).cast("string").alias("name"), none.alias("props"))
    ids = k.select("node_id")
    same = _same_as(s, d).join(ids.withColumnRenamed("node_id", "x"), "x", "left_semi").join(ids.withColumnRenamed("node_id", "y"), "y", "left_semi").select(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit("SAME_AS").alias("type"))
    involved = k.select(F.col("node_id").alias("src"), F.concat(F.lit("case:"), "case_id").alias("dst"), F.lit("INVOLVED_IN").alias("type"))
    g = cypher.Graph(people.unionByName(cases), same.unionByName(involved))
    return cypher.run(g, "MATCH (p:Person)-[:SAME_AS*0..3]-(q:Person)-[:INVOLVED_IN]->(c:Case) RETURN DISTINCT p.key AS person, c.key AS case", {}, limit=None)
