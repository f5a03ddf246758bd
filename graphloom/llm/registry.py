"""Queries of this subpackage over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from ..shared import Scratch
from ..sources.tables import table
from . import abuse, addresses, canonical, canonical_twin, components, leakage, names, packing, vectors


def _named(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "person_records", ["person_id", "name", "age", "gender", "phone"]).withColumnRenamed("person_id", "record_key")
    gold = table(spark, folder, "gold_cases", ["case_id", "gold"]).select("case_id", F.posexplode("gold.persons").alias("i", "p"))
    gold = gold.select(F.concat("case_id", F.lit("#"), F.col("i").cast("string")).alias("record_key"), F.try_element_at("p", F.lit(1)).alias("name"), F.lit(None).cast("int").alias("age"), F.lit(None).cast("string").alias("gender"), F.lit(None).cast("string").alias("phone"))
    return people.unionByName(gold)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(record_key_a, record_key_b): records that mean the same person or organisation."""
    tune(spark)
    return names.link_names(spark, _named(spark, folder))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(record_key, group_id, n_links): the group of every named record and how many others are in it."""
    tune(spark)
    at, _ = Scratch(spark, "names").write(names.name_groups(spark, _named(spark, folder)))
    sizes = at.groupBy("group_id").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return at.join(sizes, "group_id").select("record_key", "group_id", "n_links")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(record_key, crime_type_id): the list entry each written crime type means, or 'unmatched'."""
    tune(spark)
    cases = table(spark, folder, "case_records", ["case_id", "crime_type", "ingested_at"]).where(F.col("case_id").isNotNull()).groupBy("case_id").agg(F.min_by("crime_type", "ingested_at").alias("value"))
    gold = table(spark, folder, "gold_cases", ["case_id", "gold"]).where(F.col("case_id").isNotNull()).dropDuplicates(["case_id"]).select("case_id", F.posexplode("gold.crime_types").alias("i", "value"))
    values = cases.select(F.col("case_id").alias("record_key"), "value").unionByName(gold.select(F.concat("case_id", F.lit("#"), F.col("i").cast("string")).alias("record_key"), "value"))
    reference = table(spark, folder, "crime_type_list").selectExpr("crime_type_id entry_id", "name", "legal_code code")
    return canonical.map_to_list(spark, values, reference).select("record_key", F.col("entry_id").alias("crime_type_id"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, group_id): the group of every node linked to another by an accepted pair."""
    tune(spark)
    edges = table(spark, folder, "match_candidates", ["a", "b", "accepted"]).where("accepted").select("a", "b")
    return components.connected_components(spark, edges)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(node_id_a, node_id_b): pairs of cosine 0.90 or more, one among the 5 most similar others of the other."""
    tune(spark)
    nodes = table(spark, folder, "kg_nodes", ["node_id", "embedding"]).select(F.col("node_id").alias("id"), "embedding")
    return vectors.similar_pairs(spark, nodes, k=5, least=0.90).select(F.col("id_a").alias("node_id_a"), F.col("id_b").alias("node_id_b"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """(record_key_a, record_key_b): records that give the same street address."""
    tune(spark)
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    own = table(spark, folder, "location_records", ["location_id", "address", "name"]).select(F.col("location_id").alias("record_key"), F.coalesce(blank("address"), "name").alias("address"))
    read = table(spark, folder, "location_extractions", ["case_id", "extracted"]).select("case_id", F.posexplode("extracted").alias("i", "address")).select(F.concat("case_id", F.lit("#"), F.col("i").cast("string")).alias("record_key"), "address")
    return addresses.same_addresses(spark, own.unionByName(read))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """(sequence_id, position, doc_id, start_token, n_tokens): all documents in sequences of 2 048 tokens."""
    tune(spark)
    return packing.pack(spark, table(spark, folder, "documents", ["doc_id", "text"]), "doc_id", "text", 2048)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id): documents that hold at least two fifths of an item's words."""
    tune(spark)
    docs, items = table(spark, folder, "documents", ["doc_id", "text"]), table(spark, folder, "eval_items", ["item_id", "text"])
    return leakage.leaks(spark, docs, items).select("doc_id", "item_id").distinct()


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, score): the probability that a document is abusive, hateful or sexual."""
    tune(spark)
    return abuse.score_documents(spark, table(spark, folder, "documents", ["doc_id", "text", "source"]), table(spark, folder, "review_labels", ["doc_id", "toxic"]))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id): the documents whose score reaches one half."""
    return p10_scores(spark, folder).where("score >= 0.5").select("doc_id").distinct()


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """(source, n_documents, n_flagged, rate) of every source, the unnamed one included."""
    by = p10_scores(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("score") >= 0.5).alias("n_flagged"))
    return by.withColumn("rate", F.col("n_flagged") / F.col("n_documents"))


P5_SQL = """
WITH RECURSIVE e AS (
  SELECT DISTINCT least(a, b) u, greatest(a, b) v FROM match_candidates WHERE accepted AND a IS NOT NULL AND b IS NOT NULL AND a <> b
), n AS (SELECT u x, v y FROM e UNION ALL SELECT v, u FROM e),
reach(x, r) AS (SELECT x, x FROM n UNION SELECT n.y, reach.r FROM reach JOIN n ON n.x = reach.x WHERE reach.r < n.y)
SELECT x AS record_id, min(r) AS group_id FROM reach GROUP BY x
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_groups": p1_groups, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p8_packed": p8_packed, "p9_found": p9_found, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": canonical_twin.P3_SQL, "p5_found": P5_SQL}
