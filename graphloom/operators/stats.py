"""Descriptive and inferential statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..shared import Scratch
from .running import running_totals


def describe(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """count, mean, population deviation, min, max, median of each feature; nulls are left out.

    All is taken from the counts of distinct values, which are aggregated before they are
    shuffled; the exact median is where their running total passes the middle.
    """
    by = by or []
    keys = [*by, "feature"]
    long = df.unpivot(by, features, "feature", "x").where(F.col("x").isNotNull())
    values = long.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(values, keys, [F.col("x").asc()], {"upto": "n"}, Scratch(df.sparkSession, "stats"))
    low, high = F.floor((F.col("all_upto") + 1) / 2), F.floor((F.col("all_upto") + 2) / 2)  # the middle places, one and the same for odd counts
    holds = lambda place: F.max(F.when((F.col("upto") >= place) & (F.col("upto") - F.col("n") < place), F.col("x")))
    middle = run.groupBy(*keys).agg(((holds(low) + holds(high)) / 2).alias("median"))
    base = long.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    named = middle.select(*[F.col(k).alias(f"m_{k}") for k in keys], "median")
    return base.join(named, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]).select(*keys, "n", "mean", "std", "min", "max", "median")


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_inc(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(1 - x, b, a)
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h * math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b)) / a


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on its distribution function."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    cdf = lambda t: 1 - 0.5 * beta_inc(df / (df + t * t), df / 2, 0.5)
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    """0.975 quantile of t by degrees of freedom."""
    table = {d: t_quantile(0.975, d) if d and d > 0 else None for d in df.dropna().unique()}
    return df.map(table).astype("float64")


def t_interval(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """95 % interval of each mean (n - 1 degrees of freedom); for n > 1."""
    long = df.unpivot(by or [], features, "feature", "x").where(F.col("x").isNotNull())
    g = long.groupBy(*(by or []), "feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("sem")).where("n > 1")
    half = t_critical((F.col("n") - 1).cast("double")) * F.col("sem")
    return g.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of each pair of features in one pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs])).alias("p")).select("p.a", "p.b", "p.r")


def _norm_ppf(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def shapiro_wilk(x: list[float]) -> tuple[float, float]:
    """W and p of the Shapiro-Wilk test (Royston 1995), for 4 to 5 000 values that aren't all equal."""
    n = len(x)
    x = sorted(x)
    m = [_norm_ppf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    ssm = sum(v * v for v in m)
    u = 1 / math.sqrt(n)
    an = m[-1] / math.sqrt(ssm) + u * (0.221157 + u * (-0.147981 + u * (-2.071190 + u * (4.434685 - 2.706056 * u))))
    if n > 5:
        an1 = m[-2] / math.sqrt(ssm) + u * (0.042981 + u * (-0.293762 + u * (-1.752461 + u * (5.682633 - 3.582633 * u))))
        phi = (ssm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
        a = [-an, -an1, *[v / math.sqrt(phi) for v in m[2:-2]], an1, an]
    else:
        phi = (ssm - 2 * m[-1] ** 2) / (1 - 2 * an**2)
        a = [-an, *[v / math.sqrt(phi) for v in m[1:-1]], an]
    mean = sum(x) / n
    ss = sum((v - mean) ** 2 for v in x)
    if ss == 0:
        return float("nan"), float("nan")
    w = min(1.0, sum(p * q for p, q in zip(a, x)) ** 2 / ss)
    if w == 1.0:
        return w, 1.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -math.log(max(1e-300, g - math.log(1 - w)))
        mu = 0.5440 + n * (-0.39978 + n * (0.025054 - 0.0006714 * n))
        s = math.exp(1.3822 + n * (-0.77857 + n * (0.062767 - 0.0020322 * n)))
    else:
        y, ln = math.log(1 - w), math.log(n)
        mu = -1.5861 + ln * (-0.31082 + ln * (-0.083751 + 0.0038915 * ln))
        s = math.exp(-0.4803 + ln * (-0.082676 + 0.0030302 * ln))
    z = (y - mu) / s
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def normality(df: DataFrame, by: str, x: str, order: str, first: int = 5000) -> DataFrame:
    """Per group the test over its first 5 000 values in ``order``, with mean and population deviation of all.

    The limit is the test's own definition; a group reaches a task only with these values.
    """
    from pyspark.sql import Window as W

    head = df.where(F.col(x).isNotNull()).withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("r") <= first).select(by, x)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[x].tolist()
        w, p = shapiro_wilk(v) if len(v) > 3 else (float("nan"), float("nan"))
        return pd.DataFrame({"g": [str(pdf[by].iloc[0])], "w": [w], "p": [p], "is_normal": [bool(p > 0.05)]})

    tests = head.groupBy(by).applyInPandas(test, "g string, w double, p double, is_normal boolean")
    return df.groupBy(F.col(by).cast("string").alias("g")).agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma")).join(tests, "g")


def nearest_distances(points: DataFrame, group: str, key: str, x: str, y: str) -> DataFrame:
    """Per group mean and population deviation of nearest-neighbour distances, extent and centroid; (0, 0) counts as missing.

    One group is the points of one image; its grid has about one point a cell. A point whose
    nearest neighbour in the nine cells around it isn't proven nearest is measured against
    all points of its group.
    """
    pts = points.where((F.col(x) != 0) | (F.col(y) != 0)).select(group, key, F.col(x).alias("x"), F.col(y).alias("y"))
    box = pts.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    sized = pts.join(box, group).withColumn("cell", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-12)) / F.greatest(F.lit(1.0), F.floor(F.sqrt("n"))))
    celled = sized.withColumn("gx", F.floor((F.col("x") - F.col("x0")) / F.col("cell"))).withColumn("gy", F.floor((F.col("y") - F.col("y0")) / F.col("cell"))).select(group, key, "x", "y", "cell", "gx", "gy")
    other = celled.select(group, F.col(key).alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "gx", "gy")
    step = F.sequence(F.lit(-1), F.lit(1))
    around = celled.withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).withColumn("gx", F.col("gx") + F.col("i")).withColumn("gy", F.col("gy") + F.col("j"))
    dist = F.min(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))).alias("dist")
    best = around.join(other, [group, "gx", "gy"]).where(F.col(key) != F.col("other")).groupBy(group, key, "cell").agg(dist).where("dist <= cell").select(group, key, "dist")
    rest = celled.join(best.select(group, key), [group, key], "left_anti").select(group, key, "x", "y")
    whole = rest.join(other.select(group, "other", "ox", "oy"), group).where(F.col(key) != F.col("other")).groupBy(group, key).agg(dist)
    return best.unionByName(whole).groupBy(group).agg(F.avg("dist").alias("mean_dist"), F.stddev_pop("dist").alias("std_dist")).join(box.select(group, "n", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), "cx", "cy"), group)


def thin_points(df: DataFrame, group: str, order: str, x: str, y: str, least: float) -> DataFrame:
    """Greedy thinning in ``order``: a point stays if no kept one is nearer than ``least``. One group is one image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        kept: dict[tuple[int, int], list[tuple[float, float]]] = {}
        keep = []
        for px, py in zip(pdf[x], pdf[y]):
            cx, cy = int(px // least), int(py // least)
            near = any((px - qx) ** 2 + (py - qy) ** 2 < least * least for i in (-1, 0, 1) for j in (-1, 0, 1) for qx, qy in kept.get((cx + i, cy + j), ()))
            keep.append(not near)
            if not near:
                kept.setdefault((cx, cy), []).append((px, py))
        return pdf[keep]

    return df.groupBy(group).applyInPandas(run, df.schema)


def shape_features(df: DataFrame) -> DataFrame:
    """Circularity, aspect ratio, solidity and eccentricity from area, perimeter, width, height, hull, major, minor."""
    return df.select("*", F.try_divide(4 * F.lit(math.pi) * F.col("area"), F.col("perimeter") ** 2).alias("circularity"), F.try_divide(F.col("width"), F.col("height")).alias("aspect_ratio"), F.try_divide(F.col("area"), F.col("hull")).alias("solidity"), F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("minor"), F.col("major")) ** 2)).alias("eccentricity"))


def bootstrap_interval(df: DataFrame, value: str, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """Mean and 95 % interval by resampling with Poisson(1) weights: one pass, no row is copied.

    Each row draws its weight in every resample from a hash of (seed, row, resample), so the
    result is repeatable under any partitioning.
    """
    import numpy as np
    import pyarrow as pa

    # Poisson(1) by inversion: a weight for each of 2**16 equally likely values
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    weight = np.searchsorted(cdf, (np.arange(2**16) + 0.5) / 2**16).astype(np.uint8)
    step = np.arange(1, -(-resamples // 4) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def draw(h):
        """SplitMix64 of (row's hash, place): four weights from each number."""
        x = h[:, None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return weight[(x ^ (x >> np.uint64(31))).view(np.uint16)[:, :resamples]]

    def run(batches):
        s, n = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            v, h = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for i in range(0, len(v), 256):
                w = draw(h[i : i + 256]).astype(np.float64)
                s += v[i : i + 256] @ w
                n += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32)), pa.array(s), pa.array(n)], names=["b", "s", "n"])

    base = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double"), F.xxhash64(F.lit(seed), *df.columns).alias("h"))
    means = base.mapInArrow(run, "b int, s double, n double").groupBy("b").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
