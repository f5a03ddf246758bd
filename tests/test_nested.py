import json

import pytest

from graphloom.operators import nested
from graphloom.plans import records

ROOTS = ("injuries", "organ_findings")
ALL = (*ROOTS, "associated_injuries", "samples", "slides", "readings")


def rows(spark, docs, tables=ALL, roots=ROOTS):
    df = spark.createDataFrame(docs, "report_id string, payload string, path string")
    out = nested.relations(nested.objects(df, "report_id", "payload"), tables, roots).where("path <> ''").collect()
    return {(r.doc_key, r.path): r for r in out}


def test_layouts_read_alike(spark):
    item = {"organ": "heart", "samples": [{"sample_id": "S1", "slides": [{"slide_no": 1}]}]}
    docs = [
        ("list", json.dumps({"organ_findings": [item]}), "x"),
        ("alone", json.dumps({"findings": {"organ_findings": item}}), "x"),
        ("keyed", json.dumps({"organ_findings": {"10": {"organ": "b"}, "2": item}}), "x"),
        ("text", json.dumps({"organ_findings": json.dumps([item])}), "x"),
    ]
    got = rows(spark, docs)
    for k in ("list", "alone", "keyed", "text"):
        assert got[k, "organ_findings[0].samples[0].slides[0]"].vals == {"slide_no": "1"}
        assert got[k, "organ_findings[0].samples[0]"].parent_path == "organ_findings[0]"
    assert got["keyed", "organ_findings[1]"].vals == {"organ": "b"}


def test_broken_null_and_empty(spark):
    docs = [("a", "{", "x"), ("b", None, "x"), (None, json.dumps({"injuries": [{}]}), "x"), ("c", "", "x"), ("d", json.dumps({"injuries": [None, 5, {"type": None}]}), "x"), ("e", '{"injuries": NaN}', "x"), ("f", json.dumps({"injuries": None, "organ_findings": {}}), "x")]
    got = rows(spark, docs)
    assert list(got) == [("d", "injuries[2]")]
    assert got["d", "injuries[2]"].vals == {"type": None}
    assert rows(spark, []) == {}


def test_inlined_values_and_deep_nesting(spark):
    deep = {"type": "t0"}
    for i in range(1, 200):
        deep = {"type": f"t{i}", "associated_injuries": [deep]}
    got = rows(spark, [("a", json.dumps({"injuries": [{"dimensions": {"length_cm": 1.5, "unit": {"n": "cm"}}, "tags": ["x"]}]}), "x"), ("b", json.dumps({"injuries": [deep]}), "x")])
    assert got["a", "injuries[0]"].vals == {"tags": '["x"]'}
    assert {(tuple(x.names), *x.vals.items()) for x in got["a", "injuries[0]"].inlined} == {(("dimensions",), ("length_cm", "1.5")), (("dimensions", "unit"), ("n", "cm"))}
    assert len([k for k in got if k[0] == "b"]) == 200


def test_plan_names_why(spark):
    edges = [("", "injuries", True), ("", "findings", False), ("findings", "injuries", False), ("injuries", "dimensions", False), ("injuries", "assoc", False), ("assoc", "assoc", False), ("", "unit", False), ("dimensions", "unit", False)]
    assert nested.relation_plan(edges) == {"assoc": "recursive", "injuries": "repeated", "unit": "shared"}
    docs = spark.createDataFrame([("a", json.dumps({"injuries": [{"type": "x", "dimensions": {"l": 1}}]})), ("b", "{")], "k string, p string")
    assert nested.schema_graph(nested.objects(docs, "k", "p")) == [("", "injuries", True), ("injuries", "dimensions", False)]
    tables = nested.shared_inlining(docs, "k", "p")
    assert [(r.doc_key, r.path, r["dimensions.l"], r.type) for r in tables["injuries"].collect()] == [("a", "injuries[0]", "1", "x")]
    assert [r.path for r in tables[""].collect()] == [""]
    assert {k: t.count() for k, t in nested.shared_inlining(docs.limit(0), "k", "p").items()} == {"": 0}


def test_the_plan_makes_the_tables(spark):
    """Elements without a table stand inside their parent's row; the objects asked for are found there too."""
    doc = {"findings": {"organ_findings": [{"organ": "heart", "samples": {"sample_id": "S1", "slides": {"slide_no": 3}}}]}}
    df = spark.createDataFrame([("r", json.dumps(doc))], "report_id string, payload string")
    found = nested.objects(df, "report_id", "payload")
    plan = nested.relation_plan(nested.schema_graph(found))
    assert plan == {"organ_findings": "repeated"}
    expected = {("organ_findings[0]", "heart"), ("organ_findings[0].samples[0]", "S1"), ("organ_findings[0].samples[0].slides[0]", "3")}
    sizes = set()
    for p in (plan, {**plan, "samples": "shared"}, {}, {"findings": "shared"}):
        out = nested.relations(found, p, ROOTS)
        assert {(r.path, r.label) for r in records.objects_of(out, p).collect()} == expected
        sizes.add(tuple(sorted((r.element, r.parent_element, len(r.inlined)) for r in out.collect())))
    assert len(sizes) >= 3  # another plan, other tables
    flat = nested.flat_table(nested.relations(found, plan), "organ_findings").collect()
    assert [(r.path, r["samples.sample_id"], r["samples.slides.slide_no"], r.parent_element) for r in flat] == [("findings[0].organ_findings[0]", "S1", "3", "")]


def test_too_many_names_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(nested, "MAX_NAMES", 50)
    docs = spark.createDataFrame([(f"r{j}", json.dumps({f"k{i}": {"x": 1} for i in range(j * 20, j * 20 + 20)})) for j in range(4)], "k string, p string")
    with pytest.raises(ValueError):
        nested.schema_graph(nested.objects(docs, "k", "p"))


def test_latest_takes_one_row_per_key(spark):
    df = spark.sql("select * from values ('a','1',timestamp_ntz'2020-01-01'),('a','2',timestamp_ntz'2021-01-01'),('a','0',null),(null,'3',null),('b',null,null) t(k,v,at)")
    assert sorted((r.k, r.v) for r in nested.latest(df, "k", "at", ["v"]).collect()) == [("a", "2"), ("b", None)]
