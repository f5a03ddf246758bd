"""Chronology of events: gaps, contradictions, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import hours_between


def ordered(events: DataFrame, case: str, ts: str, tie: str) -> DataFrame:
    """Chronological position of each event of its case; events without a time come last."""
    w = W.partitionBy(case).orderBy(F.col(ts).asc_nulls_last(), tie)
    return events.withColumn("position", F.row_number().over(w))


def gaps(events: DataFrame, case: str, ts: str, tie: str, least: float = 2.0, high: float = 6.0) -> DataFrame:
    """Consecutive events of a case more than ``least`` hours apart: warning, from ``high`` hours on high."""
    w = W.partitionBy(case).orderBy(F.col(ts).asc_nulls_last(), tie)
    pairs = events.withColumn("prev", F.lag(tie).over(w)).withColumn("gap_hours", hours_between(F.col(ts), F.lag(ts).over(w)))
    return pairs.where(F.col("gap_hours") > least).select(case, F.col("prev").alias("from_event"), F.col(tie).alias("to_event"), "gap_hours", F.when(F.col("gap_hours") < high, "warning").otherwise("high").alias("severity"))


def spans(events: DataFrame, case: str, ts: str) -> DataFrame:
    """First and last time and hours between; null if an event of the case has no time."""
    out = events.groupBy(case).agg(F.min(ts).alias("start"), F.when(F.count(ts) == F.count(F.lit(1)), F.max(ts)).alias("end"), F.count(F.lit(1)).alias("n_events"))
    return out.withColumn("hours", hours_between(F.col("end"), F.col("start")))


def contradictions(precedes: DataFrame, events: DataFrame, key: str, ts: str, follows: DataFrame | None = None) -> DataFrame:
    """Pairs said to precede each other whose times say otherwise; ``follows`` is read the other way round."""
    said = precedes.select("src_event", "dst_event")
    if follows is not None:
        said = said.unionByName(follows.select(F.col("dst_event").alias("src_event"), F.col("src_event").alias("dst_event")))
    a, b = events.select(F.col(key).alias("src_event"), F.col(ts).alias("from_ts")), events.select(F.col(key).alias("dst_event"), F.col(ts).alias("to_ts"))
    return said.join(a, "src_event").join(b, "dst_event").where("from_ts > to_ts")
