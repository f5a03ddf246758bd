"""Precision, recall, agreement and thresholds."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round4
from ..shared import Scratch
from .running import running_totals


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def with_scores(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp, fn; 0 where undefined."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", round4(p)).withColumn("recall", round4(r)).withColumn("f1", round4(ratio(2 * p * r, p + r)))


def confusion(df: DataFrame, by: list[str], gold: str, predicted: str) -> DataFrame:
    g, p = F.col(gold) == 1, F.col(predicted) == 1
    return df.groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


def micro(df: DataFrame, by: str) -> DataFrame:
    """Summed counts by type and over all ('*') in one pass."""
    return with_scores(df.groupingSets([[F.col(by)], []], F.col(by)).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.grouping(by).alias("g")).withColumn(by, F.when(F.col("g") == 1, "*").otherwise(F.col(by))).drop("g"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of paired labels; 1 where chance agreement is complete."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))
    chance = rows.join(cols, F.col("x") == F.col("y")).agg(F.coalesce(F.sum(F.col("nx").cast("double") * F.col("ny")), F.lit(0.0)).alias("c"))
    seen = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0)).alias("agree"))
    po, pe = F.col("agree") / F.col("n"), F.col("c") / (F.col("n").cast("double") * F.col("n"))
    return seen.crossJoin(chance).select("n", po.alias("po"), pe.alias("pe"), F.when(1 - pe <= 1e-9, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))  # one row each


def frontier(df: DataFrame, score: str, gold: str) -> DataFrame:
    """Per distinct score: accepted, tp, fp, precision and recall of the threshold at it.

    Counts are taken per distinct score first, and their running totals range by range.
    """
    by = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.count_if(gold).alias("g"))
    run = running_totals(by, [], [F.desc(score)], {"accepted": "n", "tp": "g"}, Scratch(df.sparkSession, "frontier"))
    return run.select(score, "accepted", "tp", (F.col("accepted") - F.col("tp")).alias("fp"), round4(F.col("tp") / F.col("accepted")).alias("precision"), round4(ratio(F.col("tp"), F.col("all_tp"))).alias("recall"))


def pair_counts(df: DataFrame, by: str, case: str) -> DataFrame:
    """Pairs within a label and across different cases, from counts alone."""
    per = df.groupBy(by, case).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(by).agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("bigint").alias("pairs"))


def greedy_pairs(gold: list[str], found: list[str], threshold: float) -> list[tuple[int, int, float]]:
    """Each gold value in order takes the best unused found value of at least ``threshold``."""
    used: set[int] = set()
    out = []
    for i, g in enumerate(gold):
        best, at = 0.0, -1
        for j, f in enumerate(found):
            if j not in used and (s := SequenceMatcher(None, g, f).ratio()) > best:
                best, at = s, j
        if at >= 0 and best >= threshold:
            used.add(at)
            out.append((i, at, best))
    return out


def greedy_match(df: DataFrame, key: str, gold: str, found: str, threshold: float = 0.75) -> DataFrame:
    """(key, tp, fp, fn) of one greedy assignment a row; ``gold`` and ``found`` are arrays of normalised values.

    The lists are those of one document, so each row is bounded; null lists count as empty.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for k, g, f in zip(pdf[key], pdf[gold], pdf[found]):
                g, f = [x for x in (g if g is not None else []) if x], [x for x in (f if f is not None else []) if x]
                tp = len(greedy_pairs(g, f, threshold))
                rows.append((k, tp, len(f) - tp, len(g) - tp))
            yield pd.DataFrame(rows, columns=[key, "tp", "fp", "fn"])

    return df.select(key, gold, found).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, tp bigint, fp bigint, fn bigint")


def greedy_dates(df: DataFrame, key: str, gold: str, found: str, total: str) -> DataFrame:
    """(key, tp, fp, fn): each gold date in order takes the first unused found one that shares a year and, if both name months, a month.

    Dates are structs of years ``y`` and months ``m``. ``found`` may hold as many of one kind as there are
    gold dates; ``total`` is the number of all. Null lists count as empty.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for k, g, f, n in zip(pdf[key], pdf[gold], pdf[found], pdf[total]):
                free = [(set(x["y"]), set(x["m"])) for x in f] if f is not None else []
                want = [(set(x["y"]), set(x["m"])) for x in g] if g is not None else []
                tp = 0
                for y, m in want:
                    at = next((i for i, (fy, fm) in enumerate(free) if y & fy and (not m or not fm or m & fm)), None)
                    if at is not None:
                        free.pop(at)
                        tp += 1
                n = 0 if pd.isna(n) else int(n)
                rows.append((k, tp, n - tp, len(want) - tp))
            yield pd.DataFrame(rows, columns=[key, "tp", "fp", "fn"])

    return df.select(key, gold, found, total).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, tp bigint, fp bigint, fn bigint")


def numeric_error(df: DataFrame, by: str, predicted: str, gold: str, tolerance: str) -> DataFrame:
    d = F.abs(F.col(predicted) - F.col(gold))
    return df.where(F.col(gold).isNotNull()).groupBy(by).agg(F.avg(d).alias("mae"), F.avg((d <= F.col(tolerance)).cast("double")).alias("within"))
