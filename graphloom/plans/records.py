"""Queries of the core record-processing operators (flat tables, instants)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import instants, nested
from ..session import tune
from ..shared import Scratch
from ..sources.tables import table

#: Outermost arrays of a postmortem document, and all arrays whose objects get rows.
ROOTS = ("injuries", "organ_findings", "toxicology_results")
ELEMENTS = (*ROOTS, "associated_injuries", "samples", "slides", "readings")
#: The value that labels an object.
LABEL = {"injuries": "type", "associated_injuries": "type", "organ_findings": "organ", "toxicology_results": "substance", "samples": "sample_id", "slides": "slide_no", "readings": "run"}


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    return nested.latest(table(spark, folder, "postmortem_reports", ["report_id", "payload", "received_at"]), "report_id", "received_at", ["payload"])


def _layout(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple[str, str, bool]], dict[str, str]]:
    """The objects of all reports as written down, their schema graph and its plan."""
    found, _ = Scratch(spark, "nested").write(nested.objects(_reports(spark, folder), "report_id", "payload"))
    graph = nested.schema_graph(found)
    return found, graph, nested.relation_plan(graph)


def objects_of(rows: DataFrame, plan: dict[str, str]) -> DataFrame:
    """(report_id, path, label) from the tables of a plan: rows of those that have one, and what is inlined into a row, through it."""
    label = lambda element, vals: F.coalesce(*[F.when(element == e, vals.getItem(v)) for e, v in LABEL.items()], F.lit(""))
    own = rows.where(F.col("element").isin([e for e in ELEMENTS if e in plan])).select(F.col("doc_key").alias("report_id"), "path", label(F.col("element"), F.col("vals")).alias("label"))
    inside = rows.select("doc_key", "path", F.explode("inlined").alias("x")).withColumn("element", F.element_at("x.names", -1)).where(F.col("element").isin([e for e in ELEMENTS if e not in plan]))
    below = F.array_join(F.transform("x.names", lambda n: F.concat(n, F.lit("[0]"))), ".")
    inside = inside.select(F.col("doc_key").alias("report_id"), F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), below).alias("path"), label(F.col("element"), F.col("x.vals")).alias("label"))
    return own.unionByName(inside)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(report_id, path, label): one row per object of the seven arrays.

    The layout is read from the documents; an element that has a table by the
    shared-inlining rule gives that table's rows, one that was inlined is read out of the
    row it was inlined into.
    """
    tune(spark)
    found, _, plan = _layout(spark, folder)
    return objects_of(nested.relations(found, plan, ROOTS), plan)


def p2_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(report_id, element, path, parent_element, parent_path, position, n_values, n_inlined): all rows of all tables with their foreign keys."""
    tune(spark)
    found, _, plan = _layout(spark, folder)
    rows = nested.relations(found, plan)
    return rows.select(F.col("doc_key").alias("report_id"), "element", "path", "parent_element", "parent_path", "position", F.size("vals").alias("n_values"), F.size("inlined").alias("n_inlined"))


def p2_layout(spark: SparkSession, folder: str) -> DataFrame:
    """(parent, child, repeated, relation): the schema graph and what the shared-inlining rule makes of each element."""
    tune(spark)
    _, graph, plan = _layout(spark, folder)
    return spark.createDataFrame([(p, c, m, plan.get(c, "inlined")) for p, c, m in graph], "parent string, child string, repeated boolean, relation string")


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """record_key, source, seq, written of both tables, one row per key, with its station's clock."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    ev = table(spark, folder, "time_events", ["event_id", "timestamp", "date", "time", "station_code", "ingested_at"])
    written = F.coalesce(blank("timestamp"), F.when(blank("date").isNotNull() & blank("time").isNotNull(), F.concat_ws(" ", "date", "time")))
    ev = (
        ev.where(F.col("event_id").isNotNull())
        .select("event_id", "ingested_at", "station_code", written.alias("written"))
        .groupBy("event_id")
        .agg(F.min_by(F.struct("station_code", "written", "ingested_at"), F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp_ntz"))).alias("r"))
        .select(F.col("event_id").alias("record_key"), F.col("r.station_code").alias("station_code"), F.col("r.ingested_at").cast("string").alias("seq"), F.col("r.written").alias("written"))
    )
    cases = table(spark, folder, "case_records", ["case_id", "police_station", "ingested_at"]).where(F.col("case_id").isNotNull()).groupBy("case_id").agg(F.min_by("police_station", "ingested_at").alias("station_code"))
    gold = table(spark, folder, "gold_cases", ["case_id", "gold"]).where(F.col("case_id").isNotNull()).select("case_id", F.posexplode("gold.time_events").alias("i", "written"))
    gold = gold.join(cases, "case_id", "left").select(F.concat("case_id", F.lit("#"), F.col("i").cast("string")).alias("record_key"), "station_code", F.lit(None).cast("string").alias("seq"), "written")
    st = table(spark, folder, "stations", ["station_code", "tz_name", "date_order"]).dropDuplicates(["station_code"])
    return ev.unionByName(gold.dropDuplicates(["record_key"])).join(st, "station_code", "left").withColumnRenamed("station_code", "source")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(record_key, instant_us): the instant of every record whose written moment names exactly one."""
    tune(spark)
    return instants.resolve_instants(spark, _written(spark, folder)).select("record_key", "instant_us")


def p4_formats(spark: SparkSession, folder: str) -> DataFrame:
    """(source_fmt, n): how often each format was chosen."""
    tune(spark)
    return instants.resolve_instants(spark, _written(spark, folder)).groupBy(F.col("fmt").alias("source_fmt")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_tables": p2_tables, "p2_layout": p2_layout, "p4_found": p4_found, "p4_formats": p4_formats}
