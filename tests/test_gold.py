"""Annotation adapters, agreement, averages over types and trials."""

import json

from graphloom.operators import gold as G

GOLD = {
    "fir": {"complainant_name": "Anil Rao", "suspect_description": "Mr. Ram Lal, aged 30", "witness_statements": ["Ms. Vera Das, saw him", "nobody"], "location_details": "Scene: the old bridge. x; near the market", "police_station": "Rusholt", "weapon_details": " knife ", "timeline_events": [{"description": "he left"}, {}]},
    "court_judgment": {"judge_names": ["J. One"], "accused_names": ["A. Two"], "legal_sections": [{"section": "302", "act": "IPC"}], "verdict": "guilty"},
    "postmortem": {"deceased_name": "B. Three", "injuries": [{"type": "cut", "location": "arm"}], "toxicology_results": [{"substance": "ethanol"}], "organ_findings": [{"organ": "heart"}]},
    "lab_report": {"analyst_name": "C. Four", "samples": [{"sample_type": "blood", "source": "shirt"}], "tests_performed": [{"test_name": "ABO", "result": "B"}]},
    "witness_deposition": {"witness_name": "D. Five", "persons_mentioned": ["E. Six"], "key_claims": [{"claim": "I saw it"}]},
    "soco_report": {"scene_officer": "F. Seven", "chain_of_custody": [{"handler": "G. Eight", "action": "sealed"}], "evidence_collected": [{"description": "glove"}]},
    "other": {"x": 1},
}


def annotations(spark, extra=()):
    return spark.createDataFrame([(f"k-{t}", t, json.dumps(g), "clash") for t, g in GOLD.items()] + list(extra), "doc_key string, source_type string, gold string, entity_type string")


def test_six_adapters(spark):
    got = {(r.source_type, r.entity_type): r.gold for r in G.gold_items(annotations(spark, [("bad", "fir", "{", "x"), (None, "fir", "{}", "x"), ("null", "fir", None, "x")])).collect() if r.gold}
    assert got == {
        ("fir", "Person"): ["Anil Rao", "Ram Lal", "Vera Das"], ("fir", "Location"): ["the old bridge", "near the market", "Rusholt"], ("fir", "Weapon"): ["knife"], ("fir", "TimeEvent"): ["he left"],
        ("court_judgment", "Person"): ["J. One", "A. Two"], ("court_judgment", "LegalSection"): ["302 IPC"], ("court_judgment", "Verdict"): ["guilty"],
        ("postmortem", "Person"): ["B. Three"], ("postmortem", "InjuryPattern"): ["cut at arm"], ("postmortem", "ToxicologyResult"): ["ethanol"], ("postmortem", "OrganFinding"): ["heart"],
        ("lab_report", "Person"): ["C. Four"], ("lab_report", "Sample"): ["blood from shirt"], ("lab_report", "TestResult"): ["ABO: B"],
        ("witness_deposition", "Person"): ["D. Five", "E. Six"], ("witness_deposition", "Statement"): ["I saw it"],
        ("soco_report", "Person"): ["F. Seven", "G. Eight"], ("soco_report", "PhysicalEvidence"): ["glove"], ("soco_report", "ChainOfCustody"): ["G. Eight sealed"],
    }


def test_scores_by_type_over_all_and_macro(spark):
    found = spark.createDataFrame([("k-fir", "Person", "Mr Anil Rao"), ("k-fir", "Person", "Nobody Else"), ("k-fir", "Weapon", "knife"), ("k-fir", "Colour", "red"), ("k-fir", "Person", None)], "doc_key string, entity_type string, name string")
    got = {r.entity_type: r for r in G.evaluate_documents(annotations(spark).where("source_type = 'fir'"), found).collect()}
    assert (got["Person"].tp, got["Person"].fp, got["Person"].fn) == (1, 1, 2) and got["Weapon"].f1 == 1.0
    assert (got["*"].tp, got["*"].fp, got["*"].fn) == (2, 1, 6) and "Colour" not in got
    types = [r for k, r in got.items() if k not in ("*", "macro")]
    assert abs(got["macro"].f1 - sum(r.f1 for r in types) / len(types)) < 1e-4


def test_agreement_of_two_annotators(spark):
    a = {"persons": [["Anil Rao", "Accused No. 1"], ["Vera Das", "witness"], ["Zed Why", None]], "locations": ["Rusholt"], "weapons": None, "crime_types": ["murder", "arson"], "time_events": ["3 May 2020", "2019"]}
    b = {"persons": [["Anil Raao", "accused"], ["Vera Das", "victim"]], "locations": ["Rusholt", "Qorin"], "weapons": ["rope"], "crime_types": ["homicide"], "time_events": ["May 2020"]}
    df = spark.createDataFrame([("c1", a, b), ("c2", None, None)], f"case_id string, a struct<{G.ANNOTATION.replace(' array', ':array')}>, b struct<{G.ANNOTATION.replace(' array', ':array')}>")
    by_type, kappas, odd = G.agreement(df)
    assert {r.entity_type: (r.tp, r.fp, r.fn) for r in by_type.collect()} == {"Person": (2, 0, 1), "Location": (1, 1, 0), "Weapon": (0, 1, 0), "CrimeType": (1, 0, 1), "TimeEvent": (1, 0, 1)}
    assert {r.kind: (r.n, r.po) for r in kappas.collect()} == {"person_role": (2, 0.5), "primary_crime": (2, 1.0)}
    assert {(r.kind, r.value, r.a, r.b) for r in odd.collect()} == {("role", "Vera Das", "witness", "victim"), ("person", "Zed Why", "yes", "no"), ("location", "Qorin", "no", "yes"), ("weapon", "rope", "no", "yes"), ("crimetype", "arson", "yes", "no")}


def test_trials_and_date_coverage(spark):
    runs = spark.createDataFrame([("m", 0.5), ("m", 0.7), ("n", 1.0)], "model string, f1 double")
    assert {r.model: (r.trials, r.f1_mean, r.f1_sd) for r in G.over_trials(runs, ["model"], ["f1"]).collect()} == {"m": (2, 0.6, 0.1), "n": (1, 1.0, 0.0)}
    df = spark.createDataFrame([(["3 May 2020", "2019"], ["seen 2020"]), ([], ["2020"]), (["2018"], None)], "g array<string>, f array<string>")
    assert [r.c for r in df.select(G.date_coverage(df, "g", "f").alias("c")).collect()] == [0.5, None, 0.0]
