"""Writers: guarded CSV, graph JSON, append-only logs, keyed documents, status updates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import csv_guard

#: Property names above which a wide table is refused: properties are used as values.
MAX_COLUMNS = 5_000
STATUSES = ("open", "investigating", "closed", "cold")


def wide(df: DataFrame, key: str, props: str) -> DataFrame:
    """One column a property name seen, sorted, '' where missing; cells guarded against formulas. More than ``MAX_COLUMNS`` names are an error."""
    names = sorted(r.k for r in df.select(F.explode(F.map_keys(props)).alias("k")).distinct().limit(MAX_COLUMNS + 1).collect())
    if len(names) > MAX_COLUMNS:
        raise ValueError("too many property names for a wide table")
    return df.select(key, *[csv_guard(F.coalesce(F.col(props).getItem(n), F.lit(""))).alias(n) for n in names])


def write_csv(df: DataFrame, key: str, props: str, path: str) -> None:
    wide(df, key, props).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str, limit: int = 2_000) -> None:
    """Nodes (the first ``limit`` by id, as the export is defined) and the edges between them."""
    from .operators.graph import induced

    some = nodes.orderBy("node_id").limit(limit)
    some.write.mode("overwrite").json(f"{path}/nodes")
    induced(edges, some).write.mode("overwrite").json(f"{path}/edges")


def append_log(df: DataFrame, path: str) -> None:
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """(doc_id, text) as text files, one folder a document."""
    df.select("doc_id", "text").write.mode("overwrite").partitionBy("doc_id").text(path)


def append_missing(df: DataFrame, existing: DataFrame | None, key: str, path: str) -> DataFrame:
    """Appends the rows whose key isn't there yet; returns them."""
    new = df if existing is None else df.join(existing.select(key), key, "left_anti")
    new.write.mode("append").json(path)
    return new


def set_status(cases: DataFrame, case_id: str, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    hit = F.col("case_id") == case_id
    return cases.withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def clear(spark: SparkSession, nodes: DataFrame, edges: DataFrame, confirm: str) -> tuple[DataFrame, DataFrame]:
    """Empty frames of the same schemas; only with the confirmation spelt out."""
    if confirm != "yes-delete-all-data":
        raise ValueError("confirmation missing")
    return nodes.limit(0), edges.limit(0)


def safe_filename(name: str) -> str:
    out = re.sub(r"[^\w.\-]", "_", name.rpartition("/")[2])
    if not out or out.startswith("."):
        raise ValueError("unusable file name")
    return out
