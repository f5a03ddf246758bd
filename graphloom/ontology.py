"""Declared node and relationship types: loading, validation, constraints, description."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


@dataclass
class NodeType:
    name: str
    properties: dict[str, str]
    unique_key: str
    required: list[str] = field(default_factory=list)


@dataclass
class RelType:
    name: str
    sources: list[str]
    targets: list[str]
    properties: dict[str, str] = field(default_factory=dict)


@dataclass
class Ontology:
    """Node types, relationship types and closed vocabularies; small by nature, held by the driver."""

    nodes: dict[str, NodeType]
    rels: dict[str, RelType]
    enums: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict) -> "Ontology":
        nodes = {k: NodeType(k, v.get("properties", {}), v.get("unique_key") or f"{k.lower()}_id", v.get("required", [])) for k, v in d.get("nodes", {}).items()}
        one = lambda v: v if isinstance(v, list) else [v]
        rels = {k: RelType(k, one(v["source"]), one(v["target"]), v.get("properties", {})) for k, v in d.get("relationships", {}).items()}
        return cls(nodes, rels, d.get("enums", {}))

    @classmethod
    def load(cls, path: str) -> "Ontology":
        """From a JSON file, or YAML where PyYAML is installed."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yml", ".yaml")):
            import yaml

            return cls.from_dict(yaml.safe_load(text))
        return cls.from_dict(json.loads(text))

    def unique_key(self, label: str) -> str:
        return self.nodes[label].unique_key if label in self.nodes else f"{label.lower()}_id"

    def constraints(self) -> list[str]:
        """One uniqueness check a node type, as SQL over a table of its name."""
        return [f"SELECT {n.unique_key}, count(*) AS n FROM {n.name} GROUP BY {n.unique_key} HAVING count(*) > 1" for n in self.nodes.values()]

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(label, unique_key, required), (type, source_label, target_label), (enum, value)."""
        n = spark.createDataFrame([(x.name, x.unique_key, x.required, i) for i, x in enumerate(self.nodes.values())], "label string, unique_key string, required array<string>, ordinal int")
        r = spark.createDataFrame([(x.name, s, t) for x in self.rels.values() for s in x.sources for t in x.targets], "type string, source_label string, target_label string")
        e = spark.createDataFrame([(k, v) for k, vs in self.enums.items() for v in vs], "enum string, value string")
        return n, r, e

    def describe(self) -> str:
        lines = ["Node types:"] + [f"- {n.name} ({', '.join(n.properties)}), key {n.unique_key}" for n in self.nodes.values()]
        lines += ["Relationships:"] + [f"- ({'|'.join(r.sources)})-[:{r.name}]->({'|'.join(r.targets)})" for r in self.rels.values()]
        return "\n".join(lines)


def valid_nodes(spark: SparkSession, nodes: DataFrame, ontology: Ontology) -> DataFrame:
    """``nodes`` (label, props) with ``valid``: known type and all required properties present."""
    types, _, _ = ontology.frames(spark)
    joined = nodes.join(types.select("label", "required"), "label", "left")
    return joined.withColumn("valid", F.col("required").isNotNull() & (F.size(F.array_except(F.coalesce("required", F.array()), F.map_keys("props"))) == 0)).drop("required")


def valid_edges(spark: SparkSession, edges: DataFrame, ontology: Ontology) -> DataFrame:
    """Edges (type, src_label, dst_label) whose type allows these ends."""
    _, rels, _ = ontology.frames(spark)
    return edges.join(rels, (edges["type"] == rels["type"]) & (edges["src_label"] == rels["source_label"]) & (edges["dst_label"] == rels["target_label"]), "left_semi")


def endpoint_types(spark: SparkSession, ids: DataFrame, nodes: DataFrame, ontology: Ontology) -> DataFrame:
    """(key, label): the first type, in the ontology's order, that has a node of this key."""
    types, _, _ = ontology.frames(spark)
    known = nodes.select("label", "key").join(types.select("label", "ordinal"), "label", "left")
    return ids.join(known, "key").groupBy("key").agg(F.min_by("label", F.struct(F.coalesce("ordinal", F.lit(10**6)), "label")).alias("label"))
