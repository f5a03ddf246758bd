import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import ontology, providers, sinks
from graphloom.shared import Scratch, shared_dir
from graphloom.sources import files, paged
from graphloom.streaming import streams

ONTOLOGY = {"nodes": {"Person": {"properties": {"name": "string"}, "unique_key": "person_id", "required": ["name"]}, "Case": {"properties": {}}}, "relationships": {"IN": {"source": "Person", "target": ["Case"]}}, "enums": {"Role": ["a", "b"]}}


def test_text_and_gold_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "a_facts.txt").write_text("facts")
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "g.json").write_text(json.dumps({"case_id": "c", "gold": {"persons": [["Ann", "victim"]], "locations": ["x"]}}))
    assert [tuple(r) for r in files.text_documents(spark, str(tmp_path)).collect()] == [("a", "one"), ("b", "two")]
    assert {r.doc_id: r.text for r in files.preferred_texts(spark, str(tmp_path)).collect()} == {"a": "facts", "b": "two"}
    assert files.gold_cases(spark, str(tmp_path)).first().gold.persons == [["Ann", "victim"]]
    assert [r.doc_id for r in files.gold_stems(spark, str(tmp_path)).collect()] == ["g"]


def test_csv_with_other_column_names(spark, tmp_path):
    p = tmp_path / "j.csv"
    p.write_text('Case_Title,Judgment\nState v X,"' + "The accused was convicted of murder by the police. " * 20 + '"\nShort,"murder police"\nCivil,"' + "rent contract " * 60 + '"\n')
    rows = files.judgments_csv(spark, str(p)).collect()
    assert [r.title for r in rows] == ["State v X"] and rows[0].doc_id.startswith("SC-")


def test_key_values_and_folders(spark, tmp_path):
    text = "2020-01-01\nDrip test\nHeight: 30 cm\nAngle = 45.5\nSurface: wood"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(*files.key_values(F.col("t"), ("Height", "Angle", "Mass"), ("Surface",))).first()
    assert (r.date, r.description, r.height, r.angle, r.mass, r.surface) == ("2020-01-01", "Drip test", 30.0, 45.5, None, "wood")
    for d, names in (("e1", ("a.txt", "a.jpg")), ("e2", ("b.txt",))):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_bytes(b"x")
    assert [r.dir.rpartition("/")[2] for r in files.experiment_folders(spark, str(tmp_path)).collect()] == ["e1"]
    (tmp_path / "train" / "cut").mkdir(parents=True)
    (tmp_path / "train" / "cut" / "i.png").write_bytes(b"x")
    assert [(r.split, r.category) for r in files.images(spark, str(tmp_path)).where("path like '%png'").collect()] == [("train", "cut")]


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    assert spark.read.format("paged").load().collect() == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", {"a": "=x", "b": 'q"r'}), ("2", {"c": "z"})], "id string, props map<string,string>")
    sinks.write_csv(df, "id", "props", str(tmp_path / "csv"))
    back = {r.id: (r.a, r.b, r.c) for r in spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()}
    assert back["1"][:2] == ("'=x", 'q"r') and back["2"][2] == "z"
    n = spark.createDataFrame([("a",), ("b",)], "node_id string")
    e = spark.createDataFrame([("a", "b", "T"), ("a", "zz", "T")], "src string, dst string, type string")
    sinks.write_graph_json(n, e, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/edges")).count() == 1
    sinks.append_log(n, str(tmp_path / "log"))
    sinks.append_log(n, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    sinks.write_documents(spark.createDataFrame([("d1", "text")], "doc_id string, text string"), str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).first().value == "text"
    new = sinks.append_missing(n, n.limit(0), "node_id", str(tmp_path / "gold"))
    assert new.count() == 2 and sinks.append_missing(n, spark.read.json(str(tmp_path / "gold")), "node_id", str(tmp_path / "gold2")).count() == 0
    assert [x.count() for x in sinks.clear(spark, n, e, "yes-delete-all-data")] == [0, 0]
    for bad in ("", ".x", "a/"):
        with pytest.raises(ValueError):
            sinks.safe_filename(bad)
    assert sinks.safe_filename("../a b.txt") == "a_b.txt"
    with pytest.raises(ValueError):
        sinks.set_status(n, "a", "gone")


def test_ontology(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps(ONTOLOGY))
    o = ontology.Ontology.load(str(tmp_path / "o.json"))
    assert o.unique_key("Case") == "case_id" and o.unique_key("Other") == "other_id" and len(o.constraints()) == 2
    assert "(Person)-[:IN]->(Case)" in o.describe()
    n = spark.createDataFrame([("Person", {"name": "x"}), ("Person", {}), ("Nope", {"name": "x"})], "label string, props map<string,string>")
    assert sorted((r.label, len(r.props), r.valid) for r in ontology.valid_nodes(spark, n, o).collect()) == [("Nope", 1, False), ("Person", 0, False), ("Person", 1, True)]
    e = spark.createDataFrame([("IN", "Person", "Case"), ("IN", "Case", "Person"), ("X", "Person", "Case")], "type string, src_label string, dst_label string")
    assert ontology.valid_edges(spark, e, o).count() == 1


def test_providers(spark):
    e = providers.HashingEmbedder(16)
    a, b, c = e.embed(["nylon rope", "nylon ropes", ""])
    assert a @ b > 0.5 and np.linalg.norm(a) == pytest.approx(1) and not c.any()
    df = spark.createDataFrame([("1", "rope", None), ("2", None, None), ("3", "x", [1.0])], "id string, val string, embedding array<float>")
    out = {r.id: r for r in providers.backfill(df, "val", e).collect()}
    assert len(out) == 3 and out["3"].embedding == [1.0] and len(out["1"].embedding) == 16 and all(r.is_embedded for r in out.values())
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    waits = []
    assert providers.retry(flaky, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    docs = spark.createDataFrame([("d", "Mr Ram Lal struck with a knife. A murder on 3.5.2020."), ("n", None)], "doc_id string, text string")
    ents, rels = providers.extract(docs)
    assert {(r.entity_type, r.name) for r in ents.collect()} == {("Person", "Mr Ram Lal"), ("Weapon", "knife"), ("CrimeType", "murder"), ("TimeEvent", "3.5.2020")}
    assert rels.count() == 1


def test_answers(spark, folder):
    from graphloom import cypher
    from graphloom.model import edges, nodes

    g = cypher.Graph(nodes(spark, folder, ["Region", "Nation"]), edges(spark, folder, ["PART_OF"]))
    assert providers.answer(g, "How many Regions are there?")["rows"] == [{"n": 5}]
    assert len(providers.answer(g, "Who is linked to ASIA?")["rows"]) == 5


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        spark.sql(f"select {i} id, 'u' || ({i} % 2) u, timestamp_ntz'2020-01-01 0{i * 3}:00:00' ts").coalesce(1).write.mode("append").parquet(src)
    scratch = Scratch(spark, "t")
    up = streams.upsert_stream(streams.read(spark, src, 1), ["u"], "ts", scratch)
    assert {r.u: r.id for r in up.collect()} == {"u0": 2, "u1": 1}
    seen = []
    streams.incremental(streams.read(spark, src, 1), lambda b, n: seen.append(b.count()), str(tmp_path / "ck"))
    assert sum(seen) == 3
    t = streams.drain(streams.tumbling(streams.read(spark, src), "ts", [], "6 hours"), "complete", scratch)
    assert sorted(r.n for r in t.collect()) == [1, 2]
    assert streams.sessions(spark.read.parquet(src), "ts", "u", "2 hours").count() == 3


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == shared_dir(spark)
    df, path = Scratch(spark, "x").write(spark.range(3).toDF("a"))
    assert df.count() == 3 and path.startswith(shared_dir(spark))
