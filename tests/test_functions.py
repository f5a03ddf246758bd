from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from graphloom.functions import dates as D
from graphloom.functions import jsontext
from graphloom.functions import text as T


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r


def test_text(spark):
    assert one(spark, T.name_normalise, " Dr. Anil  K. Sharma (accused) ") == "anil k sharma"
    assert one(spark, T.name_normalise, "JJ. Hon'ble Sub-Inspector Rao, the appellant; MD Khan") == "rao khan"
    assert one(spark, lambda c: T.name_normalise(c, F.lit(False)), "The Late Road, Pune") == "the late road pune"
    assert one(spark, T.eval_normalise, "Mr. Sir  Anil  Rao") == "anil rao"
    assert one(spark, T.document_prefix, "doc_16bead11_person_1") == "doc_16bead11"
    assert one(spark, T.document_prefix, "b_1") == "b_1"
    assert one(spark, T.keywords, "Who was the witness in FIR-2019 near Rome") == ["witness", "fir-2019", "near", "rome"]
    assert one(spark, T.keywords, "Please find all of the weapons used by suspects") == ["please", "weapons", "used", "suspects"]
    assert one(spark, T.html_strip, "<p>a <b>b</b></p>\n c") == "a b c"
    assert one(spark, T.csv_guard, "=1+1") == "'=1+1" and one(spark, T.csv_guard, "a=1") == "a=1"
    assert one(spark, T.crime_categories, "Robbed, then set ablaze: Murder") == ["arson", "murder", "robbery"]
    assert one(spark, lambda c: T.primary_crime(T.crime_categories(c)), "robbery; arson") == "arson" and one(spark, lambda c: T.primary_crime(T.crime_categories(c)), "theft") == "none"
    assert [one(spark, T.role_normalise, x) for x in ("Co-Accused", "Forensic expert", " Prime Suspect ", "")] == ["accused", "forensic_analyst", "prime suspect", "unknown"]
    assert [one(spark, T.city, x) for x in ("New Delhi", "Greater NOIDA", "Pune")] == ["delhi", "noida", ""]
    assert one(spark, T.same_place, "Red Fort, New Delhi", "the district of Delhi, near Red Fort area")
    assert not one(spark, T.same_place, "Pune Camp", "Camp Nashik") and not one(spark, T.same_place, "at", "Pune")
    assert [one(spark, lambda a, b: T.should_link(F.lit("Person"), a, b, F.lit(1.0)), *x) for x in (("Ajay Kumar [a]", "ajay kumar"), ("Anil Rao [1]", "anil rao"), ("Anil Rao", "Anil Roy"))] == [False, True, False]
    assert one(spark, T.is_criminal, "the accused was convicted", None) and not one(spark, T.is_criminal, "x" * 3000 + " murder theft", "a title") and one(spark, T.is_criminal, "murder", "FIR 12")
    assert one(spark, T.safe_id, "a b/c.txt") == "a_b_c.txt"
    assert one(spark, T.titled_person, "Mr. Ram Lal, aged 30") == "Mr. Ram Lal"
    facts = "He ran away from the scene. " * 10
    assert one(spark, T.facts_section, f"Title\nBrief facts:\n{facts}\nJUDGMENT:\nguilty") == facts.strip()
    assert one(spark, T.facts_section, f"Title\nThe facts of the case are: {facts}\n2. It is so.") == facts.strip()
    assert one(spark, T.facts_section, "Title\n" + "y" * 4000) == "y" * 3000 and one(spark, T.facts_section, "short") == ""


def test_seq_ratio_and_bound(spark):
    pairs = [("anil sharma", "sharma anil"), ("a" * 250, "a" * 249 + "b"), ("", ""), ("x", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", T.seq_ratio("a", "b").alias("r"), T.ratio_bound(F.col("a"), F.col("b")).alias("u")).collect():
        if r.b is None:
            assert r.r is None
        else:
            assert r.r == pytest.approx(SequenceMatcher(None, r.a, r.b).ratio())
            assert r.a == "" or r.u >= r.r - 1e-12


@pytest.mark.parametrize("a, b, ratio, expected", [("anil sharma", "anil k sharma", 0.9, (0.95, 2, True, False)), ("sharma", "anil sharma", 0.7, (0.7, 1, True, False)), ("g c x", "g s x", 0.8, (0.8, 3, False, True))])
def test_name_score(spark, a, b, ratio, expected):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(T.name_score(F.col("a"), F.col("b"), F.lit(ratio)).alias("s")).first().s
    assert (r.score, r.min_tokens, r.subset, r.conflict) == expected


def test_dates(spark):
    assert str(one(spark, D.ladder, "2020-02-03T04:05:06")) == "2020-02-03 04:05:06"
    assert str(one(spark, D.ladder, "March 2020")) == "2020-03-01 00:00:00"
    assert one(spark, D.ladder, "evening") is None
    assert one(spark, D.compatible, "3 May 2020", "May 2020") and not one(spark, D.compatible, "3 May 2020", "June 2020") and one(spark, D.compatible, "2020", "June 2020")


@pytest.mark.parametrize("text, expected", [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": [1]}\n```', '{"a": [1]}'), ('Sure: {"a": {"b": "}"}} ok', '{"a": {"b": "}"}}'), ('{"a": "cut', '{"a": "cut"}'), ('{"a": 1, "b": ', '{"a": 1}'), ('[{"b": 1}, {"c":', '[{"b": 1}]'), ("", None), (None, None), ("no json", None)])
def test_json_repair(text, expected):
    assert jsontext.repair(text) == expected


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(T.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == pytest.approx([0.0, 1.0])


def test_category_match_equals_brute_force(spark):
    import re

    values, entries = ["mrdr ", "assalt", "robbery.", "peerjury", "Counterfeitung", "armed robbery", "theft of car", "rob", "...", "tax"], ["Murder", "assault", "robbery", "perjury", "counterfeiting", "vehicle theft"]
    plain = lambda x: re.sub("[^a-z0-9 ]", " ", x.lower()).strip()
    want = {(v, e) for v in values for e in entries if (a := plain(v)) and (a in (b := plain(e)) or b in a or set(a.split()) & set(b.split()) or SequenceMatcher(None, a, b).ratio() >= 0.7)}
    got = T.category_matches(spark.createDataFrame([(v,) for v in values], "v string"), spark.createDataFrame([(e,) for e in entries], "name string")).collect()
    assert {(r.v, r.name) for r in got} == want and len(got) == len(want)
    assert {("assalt", "assault"), ("robbery.", "robbery"), ("peerjury", "perjury"), ("rob", "robbery"), ("theft of car", "vehicle theft")} <= want


def test_cat_match_uses_all_branches(spark, folder):
    import __spark_entry__ as entry
    from graphloom.sources.tables import table

    v = table(spark, folder, "case_records", ["crime_type"]).where("crime_type is not null").select(F.lower("crime_type").alias("v")).distinct()
    want = T.category_matches(v, table(spark, folder, "crime_type_list", ["name"]).distinct())
    assert set(entry.queries()["cat_match"](spark, folder).collect()) == set(want.collect())
