"""Hand annotations: what each kind of document's annotation names, agreement of two annotators, scores over types and trials.

An adapter is a schema of the annotation (JSON) and, for each entity type, the columns that
name entities of it; annotations of one kind are parsed and spread in one projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from . import metrics as M

def _none() -> Column:
    return F.array().cast("array<string>")


def _list(c: Column) -> Column:
    """The texts of an array that say something."""
    return F.filter(F.coalesce(c, _none()), lambda x: x.isNotNull() & (F.trim(x) != ""))


def _one(*columns: Column) -> Column:
    return _list(F.array(*columns))


def _each(c: Column, text: Callable[[Column], Column]) -> Column:
    return _list(F.transform(c, text))


def _titled(c: Column) -> Column:
    """A titled name up to the comma, '' if the text doesn't begin with one."""
    return F.trim(F.regexp_extract(c, r"^(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?)\s*(.+?),", 1))


def _described(c: Column) -> Column:
    """A titled name, else the first two words of a text of two or more."""
    words = F.split(F.trim(c), r"\s+")
    return F.when(_titled(c) != "", _titled(c)).when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " "))


def _places(c: Column) -> Column:
    """Sentences of a location text of more than five characters, what stands behind a colon."""
    pieces = F.filter(F.transform(F.split(c, "[.;]"), lambda p: F.trim(p)), lambda p: F.length(p) > 5)
    return F.transform(pieces, lambda p: F.when(p.contains(":"), F.trim(F.regexp_replace(p, "^[^:]*:", ""))).otherwise(p))


@dataclass(frozen=True)
class Adapter:
    schema: str
    types: dict[str, Callable[[Column], Column]]


_EVENTS = "timeline_events array<struct<description:string>>"
_timeline = lambda g: _each(g["timeline_events"], lambda e: e["description"])
#: Kind of document -> how its annotation is read.
ADAPTERS = {
    "fir": Adapter(
        f"complainant_name string, victim_name string, suspect_description string, witness_statements array<string>, location_details string, police_station string, weapon_details string, vehicle_details string, evidence_description string, bloodstain_evidence string, {_EVENTS}",
        {
            "Person": lambda g: F.concat(_one(g["complainant_name"], g["victim_name"], _described(g["suspect_description"])), _each(g["witness_statements"], _titled)),
            "Location": lambda g: F.concat(_list(_places(g["location_details"])), _one(g["police_station"])),
            "Weapon": lambda g: _one(F.trim(g["weapon_details"])),
            "Vehicle": lambda g: _one(F.trim(g["vehicle_details"])),
            "TimeEvent": _timeline,
            "Evidence": lambda g: _one(g["evidence_description"], g["bloodstain_evidence"]),
        },
    ),
    "court_judgment": Adapter(
        f"judge_names array<string>, accused_names array<string>, victim_names array<string>, witness_names array<string>, lawyer_names array<string>, locations array<string>, location_details string, evidence_items array<string>, legal_sections array<struct<section:string,act:string>>, weapon_details string, vehicle_details string, verdict string, {_EVENTS}",
        {
            "Person": lambda g: F.concat(*[_list(g[f"{r}_names"]) for r in ("judge", "accused", "victim", "witness", "lawyer")]),
            "Location": lambda g: F.concat(_list(g["locations"]), _one(g["location_details"])),
            "Evidence": lambda g: _list(g["evidence_items"]),
            "TimeEvent": _timeline,
            "LegalSection": lambda g: _each(g["legal_sections"], lambda s: F.concat_ws(" ", s["section"], s["act"])),
            "Weapon": lambda g: _one(g["weapon_details"]),
            "Vehicle": lambda g: _one(g["vehicle_details"]),
            "Verdict": lambda g: _one(g["verdict"]),
        },
    ),
    "postmortem": Adapter(
        "deceased_name string, examining_doctor string, injuries array<struct<type:string,location:string>>, toxicology_results array<struct<substance:string>>, organ_findings array<struct<organ:string>>, cause_of_death string",
        {
            "Person": lambda g: _one(g["deceased_name"], g["examining_doctor"]),
            "InjuryPattern": lambda g: _each(g["injuries"], lambda i: F.concat_ws(" at ", i["type"], i["location"])),
            "ToxicologyResult": lambda g: _each(g["toxicology_results"], lambda t: t["substance"]),
            "OrganFinding": lambda g: _each(g["organ_findings"], lambda o: o["organ"]),
            "CauseOfDeath": lambda g: _one(g["cause_of_death"]),
        },
    ),
    "lab_report": Adapter(
        "analyst_name string, requesting_officer string, samples array<struct<sample_type:string,source:string>>, tests_performed array<struct<test_name:string,result:string>>, dna_profiles array<struct<profile_type:string,match_result:string>>",
        {
            "Person": lambda g: _one(g["analyst_name"], g["requesting_officer"]),
            "Sample": lambda g: _each(g["samples"], lambda s: F.concat_ws(" from ", s["sample_type"], s["source"])),
            "TestResult": lambda g: _each(g["tests_performed"], lambda t: F.concat_ws(": ", t["test_name"], t["result"])),
            "DNAProfile": lambda g: _each(g["dna_profiles"], lambda d: F.concat_ws(" ", d["profile_type"], d["match_result"])),
        },
    ),
    "witness_deposition": Adapter(
        f"witness_name string, persons_mentioned array<string>, recording_officer string, key_claims array<struct<claim:string>>, locations_mentioned array<string>, {_EVENTS}",
        {
            "Person": lambda g: F.concat(_one(g["witness_name"]), _list(g["persons_mentioned"]), _one(g["recording_officer"])),
            "Statement": lambda g: _each(g["key_claims"], lambda c: c["claim"]),
            "Location": lambda g: _list(g["locations_mentioned"]),
            "TimeEvent": _timeline,
        },
    ),
    "soco_report": Adapter(
        "scene_officer string, chain_of_custody array<struct<handler:string,action:string>>, evidence_collected array<struct<description:string>>",
        {
            "Person": lambda g: F.concat(_one(g["scene_officer"]), _each(g["chain_of_custody"], lambda c: c["handler"])),
            "PhysicalEvidence": lambda g: _each(g["evidence_collected"], lambda e: e["description"]),
            "ChainOfCustody": lambda g: _each(g["chain_of_custody"], lambda c: F.concat_ws(" ", c["handler"], c["action"])),
        },
    ),
}


def gold_items(annotations: DataFrame, adapters: dict[str, Adapter] = ADAPTERS) -> DataFrame:
    """(doc_key, source_type, entity_type, gold ARRAY<STRING>) of annotations (doc_key, source_type, gold JSON).

    Kinds without an adapter, broken JSON and null keys give no row; types that name nothing an empty array.
    """
    out = None
    for kind, adapter in adapters.items():
        part = annotations.where((F.col("source_type") == kind) & F.col("doc_key").isNotNull()).withColumn("g", F.from_json("gold", adapter.schema)).where(F.col("g").isNotNull() & F.get_json_object("gold", "$").startswith("{"))
        types = F.array(*[F.struct(F.lit(t).alias("entity_type"), fn(F.col("g")).alias("gold")) for t, fn in adapter.types.items()])
        part = part.select("doc_key", "source_type", F.explode(types).alias("x")).select("doc_key", "source_type", "x.entity_type", "x.gold")
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_documents(annotations: DataFrame, extracted: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(entity_type, tp, fp, fn, precision, recall, f1): found entities (doc_key, entity_type, name) against annotations; '*' over all, 'macro' the mean of the types' scores.

    A type of a document counts if either side names something of it; found types the adapter doesn't know don't count.
    """
    found = extracted.where(F.col("name").isNotNull()).groupBy("doc_key", "entity_type").agg(F.array_sort(F.collect_list("name")).alias("found"))  # one document's entities of a type
    both = gold_items(annotations).join(found, ["doc_key", "entity_type"], "left").withColumn("k", F.concat_ws("\u0001", "entity_type", "doc_key"))
    clean = lambda c: F.transform(F.coalesce(c, _none()), T.eval_normalise)
    counts = M.greedy_match(both.select("k", clean(F.col("gold")).alias("gold"), clean(F.col("found")).alias("found")), "k", "gold", "found", threshold)
    by = M.micro(counts.where("tp + fp + fn > 0").withColumn("entity_type", F.split_part("k", F.lit("\u0001"), F.lit(1))), "entity_type").select("entity_type", "tp", "fp", "fn", "precision", "recall", "f1")
    return by.unionByName(macro(by, "entity_type"))


def macro(scores: DataFrame, by: str) -> DataFrame:
    """One row 'macro': unweighted means of the scores of all types but '*'."""
    mean = [T.round4(F.avg(c)).alias(c) for c in ("precision", "recall", "f1")]
    total = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    return scores.where(F.col(by) != "*").agg(*total, *mean).select(F.lit("macro").alias(by), "tp", "fp", "fn", "precision", "recall", "f1")


def over_trials(scores: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and population standard deviation of each score over trials, to three places."""
    three = lambda c: F.floor(c * 1000 + 0.5) / 1000
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("trials"), *[x for c in columns for x in (three(F.avg(c)).alias(f"{c}_mean"), three(F.stddev_pop(c)).alias(f"{c}_sd"))])


def date_coverage(df: DataFrame, gold: str, found: str) -> Column:
    """Share of the years of annotated dates that found dates name too; null without annotated years."""
    spread = lambda c: F.array_distinct(F.flatten(F.transform(F.coalesce(F.col(c), _none()), D.years)))
    return F.try_divide(F.size(F.array_intersect(spread(gold), spread(found))).cast("double"), F.size(spread(gold)))


ANNOTATION = "persons array<array<string>>, locations array<string>, weapons array<string>, crime_types array<string>, time_events array<string>"


def _matched(df: DataFrame, threshold: float) -> DataFrame:
    """(k, g, f, pairs): ``g`` and ``f`` with the places (from 0) greedily matched by similarity."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, g, f in zip(pdf["k"], pdf["g"], pdf["f"]):
                rows.append((k, [[i, j] for i, j, _ in M.greedy_pairs(list(g), list(f), threshold)]))
            yield pd.DataFrame(rows, columns=["k", "pairs"])

    return df.join(df.select("k", F.transform("g", T.eval_normalise).alias("g"), F.transform("f", T.eval_normalise).alias("f")).mapInPandas(run, "k string, pairs array<array<int>>"), "k")


def agreement(cases: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Agreement of two annotators over cases (case_id, a, b), both structs of ``ANNOTATION``; ``case_id`` is unique.

    Returns (entity_type, tp, fp, fn, f1) of persons, places, weapons, crime types and dates;
    (kind, n, po, kappa) of the roles of persons both name and of the main crime; and
    (case_id, kind, value, a, b) of everything they disagree on. Nulls count as empty.
    """
    side = lambda s, c: F.coalesce(F.col(f"{s}.{c}"), _none())
    names = lambda s: F.filter(F.transform(F.coalesce(F.col(f"{s}.persons"), F.array().cast("array<array<string>>")), lambda p: F.coalesce(F.try_element_at(p, F.lit(1)), F.lit(""))), lambda n: n != "")
    roles = lambda s: F.transform(F.filter(F.coalesce(F.col(f"{s}.persons"), F.array().cast("array<array<string>>")), lambda p: F.coalesce(F.try_element_at(p, F.lit(1)), F.lit("")) != ""), lambda p: T.role_normalise(F.try_element_at(p, F.lit(2))))
    texts = lambda s, c: F.filter(side(s, c), lambda x: x.isNotNull())
    listed = [F.struct(F.lit("Person").alias("t"), names("a").alias("g"), names("b").alias("f"))] + [F.struct(F.lit(t).alias("t"), texts("a", c).alias("g"), texts("b", c).alias("f")) for t, c in (("Location", "locations"), ("Weapon", "weapons"))]
    long = cases.select("case_id", F.explode(F.array(*listed)).alias("x")).select(F.concat_ws("\u0001", "x.t", "case_id").alias("k"), "case_id", F.col("x.t").alias("entity_type"), "x.g", "x.f")
    matched = _matched(long.select("k", "g", "f"), threshold).select("k", "pairs").join(long, "k")
    n = F.size("pairs")
    fuzzy = matched.select("case_id", "entity_type", n.alias("tp"), (F.size("f") - n).alias("fp"), (F.size("g") - n).alias("fn"))
    crimes = lambda s: T.crime_categories(F.array_join(texts(s, "crime_types"), " "))
    sets = cases.select("case_id", crimes("a").alias("ca"), crimes("b").alias("cb"))
    crime = sets.select("case_id", F.lit("CrimeType").alias("entity_type"), F.size(F.array_intersect("ca", "cb")).alias("tp"), F.size(F.array_except("cb", "ca")).alias("fp"), F.size(F.array_except("ca", "cb")).alias("fn"))
    dated = lambda s: F.transform(texts(s, "time_events"), lambda t: F.struct(D.years(t).alias("y"), D.months(t).alias("m")))
    dates = M.greedy_dates(cases.select("case_id", dated("a").alias("g"), dated("b").alias("f"), F.size(texts("b", "time_events")).alias("n")), "case_id", "g", "f", "n").withColumn("entity_type", F.lit("TimeEvent"))
    counts = fuzzy.unionByName(crime).unionByName(dates.select("case_id", "entity_type", "tp", "fp", "fn")).groupBy("entity_type").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])
    three = lambda c: F.round(c, 3)
    by_type = counts.withColumn("f1", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, three(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))).otherwise(1.0))

    both = matched.where("entity_type = 'Person'").join(cases.select("case_id", roles("a").alias("ra"), roles("b").alias("rb")), "case_id")
    # of several mentions of one name the last one's role counts
    last = lambda names_, roles_, name: F.element_at(roles_, (F.size(names_) + 1 - F.array_position(F.reverse(names_), name)).cast("int"))
    met = both.select("case_id", "g", "f", "ra", "rb", F.explode("pairs").alias("p")).select("case_id", F.col("g")[F.col("p")[0]].alias("value"), "g", "f", "ra", "rb", F.col("f")[F.col("p")[1]].alias("other"))
    role = met.select("case_id", "value", last(F.col("g"), F.col("ra"), F.col("value")).alias("a"), last(F.col("f"), F.col("rb"), F.col("other")).alias("b"))
    main = sets.select("case_id", T.primary_crime(F.col("ca")).alias("a"), T.primary_crime(F.col("cb")).alias("b"))
    kappas = None
    for kind, df in (("person_role", role), ("primary_crime", main)):
        row = M.kappa(df, "a", "b").select(F.lit(kind).alias("kind"), F.coalesce("n", F.lit(0)).alias("n"), T.round4(F.col("po")).alias("po"), three(F.col("kappa")).alias("kappa"))
        kappas = row if kappas is None else kappas.unionByName(row)

    left = lambda c, at: F.array_except(F.col(c), F.transform("pairs", lambda p: F.col(c)[p[at]])) if c else None
    only = lambda items, which: matched.select("case_id", F.lower("entity_type").alias("kind"), F.explode(items).alias("value"), *[F.lit("yes" if s == which else "no").alias(s) for s in ("a", "b")])
    unmatched = lambda c, at: F.when(F.col("entity_type") == "Person", left(c, at)).otherwise(F.filter(F.col(c), lambda x: ~F.array_contains(F.transform("pairs", lambda p: F.col(c)[p[at]]), x)))
    odd = lambda x, y, which: sets.select("case_id", F.lit("crimetype").alias("kind"), F.explode(F.array_except(x, y)).alias("value"), *[F.lit("yes" if s == which else "no").alias(s) for s in ("a", "b")])
    disagreements = role.where("a <> b").select("case_id", F.lit("role").alias("kind"), "value", "a", "b").unionByName(only(unmatched("g", 0), "a")).unionByName(only(unmatched("f", 1), "b")).unionByName(odd("ca", "cb", "a")).unionByName(odd("cb", "ca", "b"))
    return by_type, kappas, disagreements
