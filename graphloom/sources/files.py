"""Files as DataFrames: text documents, gold JSON, CSV with varying columns, images, key-value texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD_SCHEMA = "case_id string, title string, crime_type string, source string, narrative string, gold struct<persons:array<array<string>>,locations:array<string>,weapons:array<string>,crime_types:array<string>,time_events:array<string>>"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def text_documents(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(doc_id, text) of the ``*.txt`` files, facts files left out, in order of name."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text")).where(~F.col("doc_id").endswith("_facts"))
    df = df.orderBy("doc_id")
    return df.limit(limit) if limit else df


def preferred_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text): ``<id>_facts.txt`` where there is one, else ``<id>.txt``."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("name"), F.col("value").alias("text"))
    return prefer_variant(df, "name", "_facts").withColumnRenamed("base", "doc_id").drop("name")


def prefer_variant(df: DataFrame, name: str, suffix: str) -> DataFrame:
    """Per base name the row with the suffix if there is one."""
    base = F.regexp_replace(F.col(name), f"{re.escape(suffix)}$", "")
    cols = [c for c in df.columns]
    return df.groupBy(base.alias("base")).agg(F.max_by(F.struct(*cols), F.col(name).endswith(suffix).cast("int")).alias("r")).select("base", *[F.col("r").getField(c).alias(c) for c in cols])


def gold_cases(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(GOLD_SCHEMA).option("pathGlobFilter", "*.json").json(folder, multiLine=True)


def gold_stems(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("doc_id"))


def coalesced(df: DataFrame, names: tuple[str, ...]) -> Column:
    have = {c.lower(): c for c in df.columns}
    found = [F.when(F.trim(F.col(f"`{have[n]}`")) != "", F.col(f"`{have[n]}`")) for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def judgments_csv(spark: SparkSession, path: str, least: int = 500, limit: int | None = None) -> DataFrame:
    """(doc_id, title, text) from a CSV whose columns go by various names; criminal matters of some length only."""
    from ..functions.text import keyword_hits

    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    text, title, key = coalesced(raw, ("text", "judgment", "judgement", "content", "body")), coalesced(raw, ("title", "case_title", "name")), coalesced(raw, ("id", "case_id", "doc_id", "number"))
    df = raw.select(key.alias("k"), F.coalesce(title, F.lit("")).alias("title"), text.alias("text"))
    df = df.where((F.length("text") >= least) & (keyword_hits(F.concat_ws(" ", F.substring("text", 1, 3000), "title")) >= 2))
    df = df.withColumn("doc_id", F.coalesce("k", F.concat(F.lit("SC-"), F.substring(F.sha2(F.col("text"), 256), 1, 8)))).drop("k")
    return df.orderBy("doc_id").limit(limit) if limit else df


def images(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg,ppm}") -> DataFrame:
    """(path, split, category, content) of all images below a folder laid out split/category/file."""
    parts = F.split("path", "/")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", F.element_at(parts, -3).alias("split"), F.element_at(parts, -2).alias("category"), "content")


def experiment_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(dir, text_file, image_file) of the folders that hold at least one text and one image."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"))
    return listing.groupBy("dir").agg(F.min(F.when(F.col("path").endswith(".txt"), F.col("path"))).alias("text_file"), F.min(F.when(F.col("path").endswith(".jpg"), F.col("path"))).alias("image_file")).where("text_file is not null and image_file is not null")


def key_values(text: Column, numeric: tuple[str, ...], strings: tuple[str, ...]) -> list[Column]:
    """First line as date, second as description, then ``Key: value`` or ``Key = number`` fields; null where missing."""
    lines = F.split(text, "\n")
    get = lambda k: F.regexp_extract(text, rf"(?im)^\s*{re.escape(k)}\s*[:=]\s*([^\n]+?)\s*$", 1)
    name = lambda k: re.sub(r"\W+", "_", k.lower())
    out = [F.nullif(F.trim(F.try_element_at(lines, F.lit(1))), F.lit("")).alias("date"), F.nullif(F.trim(F.try_element_at(lines, F.lit(2))), F.lit("")).alias("description")]
    out += [F.nullif(get(k), F.lit("")).alias(name(k)) for k in strings]
    return out + [F.regexp_extract(get(k), r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double").alias(name(k)) for k in numeric]


def next_sequence(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the number after the greatest suffix of names with this prefix, 1 if there is none."""
    n = F.regexp_extract(F.col(column), rf"^{re.escape(prefix)}(\d+)", 1).try_cast("bigint")
    return names.agg((F.coalesce(F.max(n), F.lit(0)) + 1).cast("bigint").alias("next_id"))


def catalogue(frames: dict[str, DataFrame]) -> DataFrame:
    """(dataset, n) of each frame."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dataset"), "n")
        out = one if out is None else out.unionByName(one)
    return out
