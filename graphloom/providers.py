"""Interfaces for extraction, embedding, translation and interpretation, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Words and letter triples hashed to signed coordinates, scaled to unit length."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            low = (t or "").lower()
            for g in re.findall(r"\w+", low) + [low[j : j + 3] for j in range(max(0, len(low) - 2))]:
                h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def retry(fn: Callable, attempts: int = 3, first: float = 2.0, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """Calls ``fn`` again after a failure, waiting twice as long each time; the last failure is raised."""
    for i in range(attempts):
        try:
            return fn()
        except Exception:
            if i == attempts - 1:
                raise
            sleep(min(longest, first * 2**i))


def backfill(nodes: DataFrame, text: str, embedder: Embedder | None = None, only_missing: bool = True) -> DataFrame:
    """``nodes`` with ``embedding`` and ``is_embedded`` filled in where missing (or everywhere)."""
    embedder = embedder or HashingEmbedder()
    cols = [c for c in nodes.columns if c not in ("embedding", "is_embedded")]
    todo = nodes.where(F.col("embedding").isNull()) if only_missing else nodes

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf["embedding"] = list(embedder.embed(pdf[text].fillna("").tolist()))
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(*cols).schema.fields) + ", embedding array<float>"
    new = todo.select(*cols).mapInPandas(run, schema).withColumn("is_embedded", F.lit(True))
    if not only_missing:
        return new
    return nodes.where(F.col("embedding").isNotNull()).select(*cols, "embedding", F.lit(True).alias("is_embedded")).unionByName(new)


# Words the rule extractor looks for.
WEAPONS = ("knife", "pistol", "revolver", "rod", "axe", "hammer", "rope", "bat", "brick", "chisel", "stick")
CRIMES = ("murder", "robbery", "rape", "theft", "kidnapping", "assault", "burglary", "extortion", "forgery", "arson")


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Entities (doc_id, entity_type, entity_id, name, confidence) and relations, by rules, all in built-ins.

    Stage one finds persons by title, dates, weapons and crimes; stage two relates the
    persons of a document to it and to its crimes.
    """
    base = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    low = F.lower("text")
    find = lambda kind, values: base.select("doc_id", F.lit(kind).alias("entity_type"), F.explode(F.array_distinct(values)).alias("name"))
    found = (
        find("Person", F.regexp_extract_all("text", F.lit(r"\b((?:constable|officer|complainant|Mr|Mrs|Dr) [A-Z][a-z]+ [A-Z][a-z]+)"), 1))
        .unionByName(find("TimeEvent", F.regexp_extract_all("text", F.lit(r"\b(\d{1,2}\.\d{1,2}\.\d{4})"), 1)))
        .unionByName(find("Weapon", F.array_compact(F.array(*[F.when(low.rlike(rf"\b{w}\b"), w) for w in WEAPONS]))))
        .unionByName(find("CrimeType", F.array_compact(F.array(*[F.when(low.contains(c), c) for c in CRIMES]))))
    )
    entities = found.withColumn("entity_id", F.concat_ws("_", "doc_id", F.lower("entity_type"), F.substring(F.sha2(F.col("name"), 256), 1, 8))).withColumn("confidence", F.lit(0.9))
    persons = entities.where("entity_type = 'Person'").select("doc_id", F.col("entity_id").alias("source_entity_id"))
    others = entities.where("entity_type = 'CrimeType'").select("doc_id", F.col("entity_id").alias("target_entity_id"))
    relations = persons.join(others, "doc_id").select("doc_id", "source_entity_id", "target_entity_id", F.lit("INVOLVED_IN").alias("relationship_type"), F.lit(0.7).alias("confidence"))
    return entities, relations


#: Labels a graph may have to be asked about in words.
MAX_LABELS = 1_000


class TemplateTranslator:
    """Questions to queries by templates; the first that fits wins."""

    TEMPLATES = (
        (r"how many (\w+?)s?\b", "MATCH (n:{0}) RETURN count(n) AS n"),
        (r"(?:list|show)(?: all)?(?: the)? (\w+?)s\b", "MATCH (n:{0}) RETURN n.name AS name ORDER BY name"),
        (r"who is (?:linked|connected|related) to (.+)", "MATCH (a {{name: '{0}'}})--(b) RETURN DISTINCT b.name AS name ORDER BY name"),
    )

    def translate(self, question: str, labels: list[str]) -> str:
        by_name = {x.lower(): x for x in labels}
        for pattern, query in self.TEMPLATES:
            if m := re.search(pattern, question.strip().rstrip("?"), re.IGNORECASE):
                word = m[1]
                return query.format(by_name.get(word.lower(), by_name.get(word.lower() + "s", word.replace("'", ""))))
        return "MATCH (n) RETURN n.label AS label, count(n) AS n ORDER BY n DESC"


def answer(graph, question: str, translator: TemplateTranslator | None = None, attempts: int = 3) -> dict:
    """Translates, guards, runs, and on failure tries again; at most 30 rows are put in words."""
    from .cypher import run

    labels = [r.label for r in graph.nodes.select("label").distinct().limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError("too many labels")
    last = None
    for _ in range(attempts):
        query = (translator or TemplateTranslator()).translate(question, labels)
        try:
            rows = [r.asDict() for r in run(graph, query).limit(30).collect()]
            return {"query": query, "rows": rows, "answer": f"{len(rows)} row(s): " + "; ".join(", ".join(f"{k}={v}" for k, v in r.items()) for r in rows[:5])}
        except Exception as e:  # reported with the last attempt
            last = str(e)
    return {"query": query, "rows": [], "answer": "", "error": last}
