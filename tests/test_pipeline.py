"""Documents to a graph end to end, batch and stream, with offline providers; fusion, hypotheses."""

import pytest
from pyspark.sql import functions as F

from graphloom import pipeline as P
from graphloom.streaming import streams

DOCS = [
    ("d1", "Mr Anil Sharma was seen. Mr Anil Sharma ran with a knife. It was murder on 3.5.2020.", "clash"),
    ("d2", "Officer said Mr Anil Sharma used a knife in the robbery.", "clash"),
    ("d3", "Mrs Vera Kobitali reported the theft on 4.5.2020.", "clash"),
    ("d4", None, "x"), (None, "Mr Anil Sharma", "x"), ("d5", "", "x"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string, embedding string")


def test_batch_and_again(spark):
    nodes, edges = P.empty_graph(spark)
    got = P.ingest(spark, frame(spark, DOCS), nodes, edges)
    names = {(r.label, r.name) for r in got.nodes.collect()}
    assert {("Person", "Mr Anil Sharma"), ("Weapon", "knife"), ("CrimeType", "murder"), ("CrimeType", "robbery"), ("Person", "Mrs Vera Kobitali")} <= names
    assert got.nodes.where("embedding is null").count() == 0 and got.nodes.where("name = 'knife'").count() == 1
    assert got.counters["nodes_created"] == got.nodes.count() and got.counters["relationships_created"] == got.edges.where("type = 'INVOLVED_IN'").count() == 3
    again = P.ingest(spark, frame(spark, DOCS), got.nodes, got.edges)
    assert again.counters == {"nodes_created": 0, "relationships_created": 0, "links_created": 0} and again.nodes.count() == got.nodes.count()
    none = P.ingest(spark, frame(spark, []), nodes, edges)
    assert none.nodes.count() == none.edges.count() == 0


def variants(docs):
    """An extractor with local ids that leaves spellings as they are."""
    e = docs.where("text is not null").select("doc_id", F.lit("Person").alias("entity_type"), F.lit("p1").alias("entity_id"), F.col("text").alias("name"), F.lit(0.9).alias("confidence"))
    r = e.select("doc_id", F.col("entity_id").alias("source_entity_id"), F.col("entity_id").alias("target_entity_id"), F.lit("KNOWS").alias("relationship_type"), F.lit(0.5).alias("confidence"))
    return e, r


def test_variants_of_other_documents_are_linked(spark):
    nodes, edges = P.empty_graph(spark)
    first = P.ingest(spark, frame(spark, [("d1", "Ramesh Kumar Sharma", "")]), nodes, edges, extract=variants)
    assert [r.node_id for r in first.nodes.collect()] == ["d1_p1"] and first.edges.count() == 0
    second = P.ingest(spark, frame(spark, [("d2", "Rameshkumar Sharma", ""), ("d3", "Vera Kobitali", "")]), first.nodes, first.edges, extract=variants)
    assert [(r.src, r.type, r.dst) for r in second.edges.collect()] == [("d1_p1", "SAME_AS", "d2_p1")] and second.counters == {"nodes_created": 2, "relationships_created": 0, "links_created": 1}


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        frame(spark, DOCS[i : i + 1]).write.mode("append").parquet(f"{tmp_path}/docs")
    store = P.ingest_stream(streams.read(spark, f"{tmp_path}/docs", files_per_trigger=1).select("doc_id", "text"), P.GraphStore(spark))
    whole = P.ingest(spark, frame(spark, DOCS[:3]), *P.empty_graph(spark))
    assert len(store.counters) >= 3
    assert {(r.label, r.name) for r in store.nodes.collect()} == {(r.label, r.name) for r in whole.nodes.collect()}
    assert sum(c["nodes_created"] for c in store.counters) == store.nodes.count()


def test_fusion_bears_one_failure(spark):
    docs = frame(spark, DOCS[:1])

    def broken():
        raise RuntimeError("no image")

    one = P.fuse(lambda: variants(docs), broken)
    assert one["errors"] == {"image": "no image"} and [r.modality for r in one["entities"].collect()] == ["text"]
    both = P.fuse(lambda: variants(docs), lambda: variants(docs), lambda a, b: (a.limit(1), variants(docs)[1].limit(0)))
    assert sorted(r.modality for r in both["entities"].collect()) == ["image", "multimodal_synthesis", "text"]
    with pytest.raises(RuntimeError):
        P.fuse(broken, broken)


def test_hypotheses_are_stored_once(spark):
    node = lambda i, label, name: (i, label, "c1", name, None, None)
    nodes = spark.createDataFrame([node("c1", "Case", "a case"), node("c2", "Case", None), node("p", "Person", "Anil"), node("w", "Weapon", "knife"), node("l", "Location", "Rusholt"), node("x", "CrimeType", "murder")], P.NODES)
    edges = spark.createDataFrame([("p", "INVOLVED_IN", "c1", None), ("w", "USED_IN", "c1", None), ("c1", "OCCURRED_AT", "l", None), ("c1", "HAS_CRIME", "x", None), ("c1", "HAS_CRIME", "x", None)], P.EDGES)
    found, nodes, edges = P.hypothesise(nodes, edges)
    got = {r.case_id: (r.description, r.mechanism, r.confidence) for r in found.collect()}
    assert got == {"c1": ("murder with knife at Rusholt", "knife", 0.8), "c2": ("incident", "unknown", 0.0)}
    _, nodes, edges = P.hypothesise(nodes, edges)
    assert nodes.where("label = 'Hypothesis' and embedding is not null").count() == 2 and edges.where("type = 'HAS_EVIDENCE'").count() == 2
