"""Running totals over one order that no single task need hold.

Rows are range-partitioned by group and order and written down with the number of their
partition. Each partition's sums of each group are added up in the order of the partitions
(a row a partition and group in it), and inside a partition a window does the rest. So a
group that holds all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Scratch


def running_totals(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], scratch: Scratch) -> DataFrame:
    """``df`` with, for each ``name: column`` of ``sums``, the total of the column up to and with each row, and ``all_name`` of the whole group.

    ``order`` must tell the rows of a group apart. An empty table gives an empty result.
    """
    ranged = df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("part", F.spark_partition_id())
    ranged, _ = scratch.write(ranged)
    own = ranged.groupBy("part", *by).agg(*[F.sum(c).alias(f"own_{n}") for n, c in sums.items()])
    before, whole = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)  # as many rows as partitions
    offsets = own.select("part", *by, *[F.coalesce(F.sum(f"own_{n}").over(before), F.lit(0)).alias(f"base_{n}") for n in sums], *[F.sum(f"own_{n}").over(whole).alias(f"all_{n}") for n in sums])
    keys = ["part", *by]
    # groups may be null, so they are compared null-safely
    named = offsets.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[c for c in offsets.columns if c not in keys])
    match = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys]
    joined = ranged.join(named, match).drop(*[f"o_{k}" for k in keys])
    inside = W.partitionBy("part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = joined.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"base_{n}")).alias(n) for n, c in sums.items()], *[f"all_{n}" for n in sums])
    return out
