"""From documents to a resolved graph: extract, prefix, deduplicate, store, embed, resolve; fusion of two kinds of source; hypotheses about cases.

A graph is two tables, ``NODES`` and ``EDGES``. ``ingest`` is a batch job over any number of
documents; ``ingest_stream`` runs it on the micro-batches of a stream and keeps the graph in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import providers
from .operators import resolution as R
from .shared import Scratch

NODES = "node_id string, label string, doc string, name string, role string, embedding array<float>"
EDGES = "src string, type string, dst string, confidence double"
#: Names of its document a node is compared by at most, as surveyed.
CONTEXT = 40

Extract = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass
class Ingested:
    """The graph after a batch and what the batch added: nodes_created, relationships_created, links_created."""

    nodes: DataFrame
    edges: DataFrame
    counters: dict[str, int]


def empty_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)


def prefix_ids(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids made unique by their document's id; ids that begin with it stay."""
    own = lambda c: F.when(F.col(c).startswith(F.concat(F.col("doc_id"), F.lit("_"))), F.col(c)).otherwise(F.concat_ws("_", "doc_id", c))
    return entities.withColumn("entity_id", own("entity_id")), relations.withColumn("source_entity_id", own("source_entity_id")).withColumn("target_entity_id", own("target_entity_id"))


def in_context(nodes: DataFrame) -> DataFrame:
    """Nodes as resolution wants them, with the first ``CONTEXT`` other names of their document."""
    said = nodes.where("name is not null and doc is not null").select("doc", F.lower(F.trim("name")).alias("w")).where("w <> ''").distinct()
    first = said.withColumn("r", F.row_number().over(W.partitionBy("doc").orderBy("w"))).where(F.col("r") <= CONTEXT + 1)
    case = first.groupBy("doc").agg(F.array_sort(F.collect_list("w")).alias("said"))  # CONTEXT + 1 names at most
    ctx = F.slice(F.filter(F.coalesce("said", F.array().cast("array<string>")), lambda x: x != F.lower(F.trim("name"))), 1, CONTEXT)
    known = nodes.where("embedding is not null and name is not null").join(case, "doc", "left")
    return R.prepare(known.select(F.col("node_id").alias("eid"), "label", "doc", "name", F.coalesce("role", F.lit("")).alias("role"), F.col("embedding").alias("emb"), ctx.alias("ctx")), "name").drop("name")


def ingest(spark: SparkSession, docs: DataFrame, nodes: DataFrame, edges: DataFrame, extract: Extract | None = None, embedder: providers.Embedder | None = None, floor: float = 0.78, scratch: Scratch | None = None) -> Ingested:
    """Extract from ``docs`` (doc_id, text), deduplicate within the batch and against ``nodes``, store, embed what has no vector, link what is one thing.

    Entities without a name are told apart by id; an edge needs both ends; links are edges
    SAME_AS between nodes of one label and different documents, of which one is new. Null ids and
    texts give nothing, and a batch ingested again adds nothing.
    """
    scratch = scratch or Scratch(spark, "ingest")
    entities, relations = prefix_ids(*(extract or providers.extract)(docs))
    entities, _ = scratch.write(entities.where("doc_id is not null").dropDuplicates(["entity_id"]))
    known = nodes.select(F.col("label").alias("entity_type"), "name", F.col("node_id").alias("entity_id"))
    rows = entities.select("entity_type", "entity_id", "name", F.col("entity_id").alias("ordinal"))
    said = relations.select(F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst"), F.col("relationship_type").alias("type"))
    fresh, _, said = R.deduplicate(rows, known, said)
    role = F.col("role") if "role" in entities.columns else F.lit(None).cast("string")
    added = fresh.join(entities.select("entity_id", "doc_id", role.alias("role")), "entity_id").join(nodes.select(F.col("node_id").alias("entity_id")), "entity_id", "left_anti")
    added = added.select(F.col("entity_id").alias("node_id"), F.col("entity_type").alias("label"), F.col("doc_id").alias("doc"), "name", "role", F.lit(None).cast("array<float>").alias("embedding"))
    new = providers.backfill(added, "name", embedder).select("node_id", "label", "doc", "name", "role", "embedding")
    new, _ = scratch.write(new)
    all_nodes, _ = scratch.write(nodes.select(*new.columns).unionByName(new))

    ids = all_nodes.select("node_id")
    whole = said.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").where("src <> dst").distinct()
    key = ["src", "type", "dst"]
    made, _ = scratch.write(whole.join(edges.select(*key), key, "left_anti").select(*key, F.lit(None).cast("double").alias("confidence")))
    people = in_context(all_nodes)
    fresh_people = people.join(new.select(F.col("node_id").alias("eid")), "eid", "left_semi")
    linked = R.decide(R.candidates(people.where(F.col("label").isin(*R.RESOLVABLE)), floor, new=fresh_people)).where("accepted")
    links, _ = scratch.write(linked.select(F.col("a_eid").alias("src"), F.lit("SAME_AS").alias("type"), F.col("b_eid").alias("dst"), "confidence").join(edges.select(*key), key, "left_anti"))
    all_edges, _ = scratch.write(edges.select(*key, "confidence").unionByName(made).unionByName(links))
    return Ingested(all_nodes, all_edges, {"nodes_created": new.count(), "relationships_created": made.count(), "links_created": links.count()})


class GraphStore:
    """The graph as last written; each micro-batch makes the next version of it."""

    def __init__(self, spark: SparkSession, name: str = "graph") -> None:
        self.spark, self.scratch = spark, Scratch(spark, name)
        self.nodes, self.edges = empty_graph(spark)
        self.counters: list[dict[str, int]] = []

    def add(self, docs: DataFrame, batch: int = 0, **how) -> None:
        got = ingest(self.spark, docs.where("doc_id is not null"), self.nodes, self.edges, scratch=self.scratch, **how)
        self.nodes, self.edges = got.nodes, got.edges
        self.counters.append(got.counters)


def ingest_stream(stream: DataFrame, store: GraphStore, **how) -> GraphStore:
    """Ingest a stream of (doc_id, text) batch by batch; what was done is remembered beside the graph."""
    from .streaming import streams

    streams.incremental(stream, lambda docs, n: store.add(docs, n, **how), f"{store.scratch.root}/progress")
    return store


def fuse(text: Callable[[], tuple[DataFrame, DataFrame]], image: Callable[[], tuple[DataFrame, DataFrame]], synthesise: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> dict:
    """Entities and relations of two extractions of one matter as one set, each row with its ``modality``.

    An extraction that fails counts as empty and its error is told; if both fail the first
    error is raised. ``synthesise`` may add rows of modality 'multimodal_synthesis' from both.
    """
    parts, errors = {}, {}
    for name, run in (("text", text), ("image", image)):
        try:
            parts[name] = run()
        except Exception as e:  # told in the result
            errors[name] = e
    if not parts:
        raise errors["text"]
    if synthesise is not None:
        entities = [p[0] for p in parts.values()]
        parts["multimodal_synthesis"] = synthesise(entities[0], entities[-1])
    both = [None, None]
    for name, part in parts.items():
        for i, df in enumerate(part):
            df = df.withColumn("modality", F.lit(name))
            both[i] = df if both[i] is None else both[i].unionByName(df, allowMissingColumns=True)
    return {"entities": both[0], "relations": both[1], "errors": {k: str(e) for k, e in errors.items()}}


#: What a case's evidence is gathered by: name -> (edge type, whether the case is the edge's source, label).
BRANCHES = {
    "evidence": ("HAS_EVIDENCE", True, "Evidence"), "persons": ("INVOLVED_IN", False, "Person"), "locations": ("OCCURRED_AT", True, "Location"),
    "weapons": ("USED_IN", False, "Weapon"), "crimes": ("HAS_CRIME", True, "CrimeType"),
}


def case_evidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, evidence, persons, locations, weapons, crimes): distinct names around every Case node, empty where there are none."""
    cases = nodes.where("label = 'Case'").select(F.col("node_id").alias("case_id"))
    at = nodes.select("node_id", "label", "name")
    out = None
    for branch, (kind, outward, label) in BRANCHES.items():
        own, other = ("src", "dst") if outward else ("dst", "src")
        part = edges.where(F.col("type") == kind).select(F.col(own).alias("case_id"), F.col(other).alias("node_id")).join(at.where(F.col("label") == label), "node_id").select("case_id", F.lit(branch).alias("branch"), "name")
        out = part if out is None else out.unionByName(part)
    out = out.where("name is not null").distinct()
    lists = [F.array_sort(F.collect_list(F.when(F.col("branch") == b, F.col("name")))).alias(b) for b in BRANCHES]
    return cases.join(out, "case_id", "left").groupBy("case_id").agg(*lists)


def rule_hypotheses(evidence: DataFrame) -> DataFrame:
    """(case_id, hypothesis_id, description, mechanism, confidence, supporting): one hypothesis a case from what is known of it, the default provider.

    Confidence grows with the kinds of evidence there are, a fifth for each.
    """
    kinds = sum((F.when(F.size(b) > 0, 1).otherwise(0) for b in BRANCHES), F.lit(0))
    mechanism = F.coalesce(F.try_element_at("weapons", F.lit(1)), F.try_element_at("crimes", F.lit(1)), F.lit("unknown"))
    said = F.concat_ws(" ", F.coalesce(F.try_element_at("crimes", F.lit(1)), F.lit("incident")), F.when(F.size("weapons") > 0, F.concat(F.lit("with "), F.col("weapons")[0])), F.when(F.size("locations") > 0, F.concat(F.lit("at "), F.col("locations")[0])))
    support = F.slice(F.concat("evidence", "weapons", "persons"), 1, 10)
    return evidence.select("case_id", F.concat(F.lit("hyp_"), "case_id").alias("hypothesis_id"), said.alias("description"), mechanism.alias("mechanism"), (kinds / 5).alias("confidence"), support.alias("supporting"))


def hypothesise(nodes: DataFrame, edges: DataFrame, provider: Callable[[DataFrame], DataFrame] = rule_hypotheses, embedder: providers.Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hypotheses, nodes, edges): hypotheses about every case, stored as nodes with vectors and HAS_EVIDENCE edges from their case.

    Made again, a hypothesis replaces the one of its id, and its edge's confidence.
    """
    found = provider(case_evidence(nodes, edges))
    new = providers.backfill(found.select(F.col("hypothesis_id").alias("node_id"), F.lit("Hypothesis").alias("label"), F.col("case_id").alias("doc"), F.col("description").alias("name"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("array<float>").alias("embedding")), "name", embedder)
    kept = nodes.join(found.select(F.col("hypothesis_id").alias("node_id")), "node_id", "left_anti")
    made = found.select(F.col("case_id").alias("src"), F.lit("HAS_EVIDENCE").alias("type"), F.col("hypothesis_id").alias("dst"), "confidence")
    old = edges.join(made.select("src", "type", "dst"), ["src", "type", "dst"], "left_anti")
    return found, kept.unionByName(new.select(*kept.columns)), old.unionByName(made)
