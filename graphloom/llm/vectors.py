"""Nearest vectors through multiprobe p-stable hashing.

Vectors are scaled to unit length, so cosine ``c`` is distance ``sqrt(2 - 2c)``. A
table's hash is a row of ``floor(a.x / w)`` for Gaussian directions ``a`` (2-stable).
It has two parts. The first ``coarse`` functions name the bucket that is shuffled;
each vector is sent once a table. The remaining ``fine`` functions are looked up
inside the bucket, where a query visits its own cell and then the cells its
coordinates lie closest to, in the order of estimated success of the perturbation
sets (Lv et al., VLDB 2007). What is sent is 36 bytes a vector and table: the fine
coordinates and a 128-bit sign sketch of the table's own, which sieves a cell's members before
anything is reported; what one table's sketch loses another one may find. The candidates of all
tables are merged and every one is verified by exact cosine on the full vectors.

The coarse functions divide the vectors into buckets of ``BUCKET`` unrelated ones at any
size, by their number and by the width of their cells (``plan``). The more of them there are, the
less often a near pair agrees on all; so the number of tables grows with the number of
vectors until a pair at the very threshold is found with probability ``TARGET``. (Sending a query
to a second coarse bucket costs as much as a further table and finds less, so only
the fine part is probed.) Exact copies are taken together first: of a group of equal
vectors only the first few ids can be among the nearest ones of anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Scratch

#: Tables at least, width of a fine cell in units of a unit vector's projection, and perturbation sets tried after the own cell.
TABLES, WIDTH, PROBES = 9, 1.2, 64
#: Probability with which a pair at the threshold is to be found.
TARGET = 0.96
#: Fine coordinates are sent in sixteenths of a cell.
STEP = 16
#: Unrelated vectors a coarse bucket should hold.
BUCKET = 100_000
#: Standard deviations by which a near pair's sketches may differ more than expected.
SLACK = 1.5
#: Query-candidate pairs compared at once, which bounds memory in a bucket of any size.
BLOCK = 2_000_000


def agreement(distance: float, width: float) -> float:
    """Probability that two vectors at this distance agree on one function (Datar et al., SoCG 2004)."""
    t = width / max(distance, 1e-9)
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def coarse_part(n: int, least: float, bucket: int = BUCKET) -> tuple[int, float, float]:
    """(functions, width of a cell, probability that a pair at the threshold agrees on all) dividing ``n`` unrelated vectors into buckets."""
    if n <= bucket:
        return 0, WIDTH, 1.0
    best = (0, WIDTH, 0.0)
    for k in range(1, 33):
        lo, hi = 0.05, 200.0
        for _ in range(60):
            w = (lo + hi) / 2
            lo, hi = (lo, w) if agreement(math.sqrt(2), w) ** k > bucket / n else (w, hi)
        p = agreement(math.sqrt(2 - 2 * least), lo) ** k
        if p > best[2] and lo > 0.5:
            best = (k, lo, p)
    return best


def planted(n: int, cosine: float, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` pairs of unit vectors of this very cosine."""
    rng = np.random.default_rng([seed, n])
    x, z = rng.standard_normal((n, dim)), rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return x.astype(np.float32), (cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z).astype(np.float32)


def fine_success(least: float, fine: int, probes: int, width: float, dim: int, seed: int, n: int = 2_000) -> float:
    """Share of planted pairs at the threshold that one table finds inside their common bucket."""
    x, y = planted(n, least, max(dim, 2), seed)
    ids = np.arange(2 * n)
    sets, limit = perturbations(fine, probes), hamming_limit(least)
    both = np.concatenate([x, y])
    _, _, q = next(encode(both, 1, 0, fine, 1.0, width, seed))
    found = np.zeros(n, bool)
    for a, b in bucket_pairs(ids, q, sketch(both, seed), sets, limit, seed):
        found[a[b - a == n]] = True
    return float(found.mean())


def plan(n: int, least: float, dim: int, width: float = WIDTH, probes: int = PROBES, tables: int = TABLES, seed: int = 11) -> tuple[int, float, int, int]:
    """(coarse functions, their width, fine functions, tables) for ``n`` vectors of ``dim`` numbers."""
    coarse, wide, share = coarse_part(n, least)
    fine = max(4, min(8, math.ceil(math.log(max(min(n, BUCKET), 2)) / -math.log(agreement(math.sqrt(2), width)))))
    hit = min(0.999, share * fine_success(least, fine, probes, width, dim, seed))
    return coarse, wide, fine, max(tables, math.ceil(math.log(1 - TARGET) / math.log(1 - hit))) if hit > 0 else tables


def perturbations(fine: int, probes: int) -> list[tuple[int, ...]]:
    """The perturbation sets, as positions in the order of distance to the cell's walls, by expected success.

    Positions j and 2*fine-1-j are the two walls of one coordinate and never occur together.
    """
    m = fine
    score = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) if j < m else 1 - (2 * m - j) / (m + 1) + (2 * m - j) * (2 * m - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(2 * m)]
    sets = []
    for size in range(1, min(4, m) + 1):
        for s in combinations(range(2 * m), size):
            if all(2 * m - 1 - j not in s for j in s):
                sets.append((sum(score[j] for j in s), s))
    return [s for _, s in sorted(sets)[:probes]]


def directions(dim: int, table: int, coarse: int, fine: int, wide: float, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, table, dim])
    a = rng.standard_normal((dim, coarse + fine)).astype(np.float32) / np.array([wide] * coarse + [width] * fine, np.float32)
    return a, rng.uniform(0, 1, coarse + fine).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def _mix(codes: np.ndarray, seed: int) -> np.ndarray:
    """Linear 64-bit hash of integer rows: a change of one coordinate adds a constant."""
    r = np.random.default_rng([seed, codes.shape[1]]).integers(1, 2**63 - 1, codes.shape[1], dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        return (codes.astype(np.int64) * r).sum(axis=1, dtype=np.int64)


def encode(x: np.ndarray, tables: int, coarse: int, fine: int, wide: float, width: float, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per table: (table, bucket of each row, fine coordinates in sixteenths as int8)."""
    for t in range(tables):
        a, b = directions(x.shape[1], t, coarse, fine, wide, width, seed)
        y = x @ a + b
        bucket = _mix(np.floor(y[:, :coarse]), seed + 1 + t) if coarse else np.zeros(len(x), np.int64)
        yield t, bucket, np.clip(np.floor(y[:, coarse:] * STEP), -128, 127).astype(np.int8)


def sketch(x: np.ndarray, seed: int) -> np.ndarray:
    """128 signs of random projections as two 64-bit words a row."""
    a = np.random.default_rng([seed, 7, x.shape[1]]).standard_normal((x.shape[1], 128)).astype(np.float32)
    return np.packbits((x @ a) > 0, axis=1).view(np.uint64)


def hamming_limit(cosine: float) -> int:
    """Differing signs a near pair's sketches may have at most: ``SLACK`` standard deviations above the expected number."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(128 * p + SLACK * math.sqrt(128 * p * (1 - p)))


class Cells:
    """Runs of equal keys in a sorted array, looked up by an open hash table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.first, self.count = np.unique(keys, return_index=True, return_counts=True)
        self.bits = max(4, (4 * len(self.keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(self.keys), dtype=np.int32), self._slot(self.keys)
        while len(left):
            free = self.table[at[left]] < 0
            self.table[at[left][free]] = left[free]
            left = left[self.table[at[left]] != left]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the keys that have a run, which runs)."""
        at = self._slot(keys)
        place, run = np.arange(len(keys)), self.table[at]
        found = []
        while len(place):
            some = run >= 0
            place, run = place[some], run[some]
            same = self.keys[run] == keys[place]
            found.append((place[same], run[same]))
            place = place[~same]
            at[place] = (at[place] + 1) & self.mask
            run = self.table[at[place]]
        return np.concatenate([x[0] for x in found] or [place]), np.concatenate([x[1] for x in found] or [run])


def bucket_pairs(ids: np.ndarray, q: np.ndarray, sk: np.ndarray, probes: list[tuple[int, ...]], limit: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (smaller id, greater id) of one bucket whose sketches differ in at most ``limit`` signs."""
    n, m = q.shape
    if n < 2:
        return
    code, frac = q >> 4, (q & 15).astype(np.float32) / STEP + 0.5 / STEP
    r = np.random.default_rng([seed, m]).integers(1, 2**63 - 1, m, dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        home = (code.astype(np.int64) * r).sum(axis=1, dtype=np.int64)
        order = np.argsort(home, kind="stable")
        cells = Cells(home[order])
        s0, s1 = np.ascontiguousarray(sk[:, 0]), np.ascontiguousarray(sk[:, 1])
        t0, t1 = s0[order], s1[order]  # as a cell's members lie together
        walls = np.concatenate([frac, 1 - frac], axis=1)
        rank = np.argsort(walls, axis=1, kind="stable")
        delta = np.ascontiguousarray(np.concatenate([-r, r])[rank].T)  # what crossing the j-th closest wall adds to the hash
        for s in [(), *probes]:
            hit = home + sum(delta[j] for j in s) if s else home
            some, run = cells.find(hit)
            lo, count = cells.first[run], cells.count[run]
            ends = np.cumsum(count)
            start = 0
            while start < len(some):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
                part, c = some[start:stop], count[start:stop]
                at = np.arange(c.sum()) + np.repeat(lo[start:stop] - np.cumsum(c) + c, c)
                # half of the sketch rules most out
                far = np.bitwise_count(np.repeat(s0[part], c) ^ t0[at])
                near = np.flatnonzero(far <= limit)
                i, at, far = np.repeat(part, c)[near], at[near], far[near]
                far = far + np.bitwise_count(s1[i] ^ t1[at])
                j = order[at]
                near = (far <= limit) & (i != j if s else i < j)
                a, b = ids[i[near]], ids[j[near]]
                yield np.minimum(a, b), np.maximum(a, b)
                start = stop


def similar_pairs(spark: SparkSession, vectors: DataFrame, k: int, least: float, tables: int = TABLES, width: float = WIDTH, probes: int = PROBES, seed: int = 11) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: pairs of cosine at least ``least`` in which one is among the ``k`` most similar others of the other.

    ``vectors`` has ``id`` STRING and ``embedding`` ARRAY<FLOAT>. Null ids, null, empty
    and all-zero vectors and vectors with a null or NaN take no part; nor do vectors of
    another length than most. Ties go to the smaller id. A repeated id with the same
    vector counts once. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "vectors")
    usable = vectors.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("id").isNotNull() & (F.size("embedding") > 0))
    usable = usable.where(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v)) & F.exists("embedding", lambda v: v != 0))
    ids, ids_path = scratch.write(usable.select("id", F.xxhash64("id").alias("h"), F.xxhash64("embedding").alias("vh"), F.size("embedding").alias("dim")))
    facts = ids.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    empty = spark.createDataFrame([], "id_a string, id_b string, cosine double")
    if facts is None:
        return empty
    n, dim = facts.n, facts.dim
    coarse, wide, fine, tables = plan(n, least, dim, width, probes, tables, seed)
    sets, limit = perturbations(fine, probes), hamming_limit(least)

    # copies: of a group of equal vectors the first k + 1 ids stand for all
    ids = ids.where(F.col("dim") == dim).dropDuplicates(["id"])
    crowded = ids.groupBy("vh").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > k + 1)
    n_crowded = crowded.count()
    spare = copies = None
    if n_crowded:
        crowded, _ = scratch.write(crowded)
        first = ids.join(crowded, "vh").withColumn("r", F.row_number().over(W.partitionBy("vh").orderBy("id")))
        first, _ = scratch.write(first.where(F.col("r") <= k + 1).select("vh", "id", "r"))
        spare = ids.join(crowded, "vh", "left_semi").join(first.select("id"), "id", "left_anti").select("id", "vh")
        copies = spare.join(first.where(F.col("r") <= k).select("vh", F.col("id").alias("other")), "vh").select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), F.lit(1.0).alias("cosine"))
    kept = usable.where(F.size("embedding") == dim)
    if spare is not None:
        kept = kept.join(spare.select("id"), "id", "left_anti")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            x = x / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-300).astype(np.float32)
            h = batch.column(0)
            for t, bucket, q in encode(x, tables, coarse, fine, wide, width, seed):
                sk = sketch(x, seed + t).view(np.int64)
                pad = np.zeros((len(q), 8), np.int8)
                pad[:, :fine] = q
                with np.errstate(over="ignore"):
                    key = ((bucket + np.int64(t)) * np.int64(-7046029254386353131) >> np.int64(32)).astype(np.int32)  # buckets of one key only meet needlessly
                yield pa.RecordBatch.from_arrays([pa.array(key), h, pa.array(pad.view(np.int64)[:, 0]), pa.array(np.ascontiguousarray(sk[:, 0])), pa.array(np.ascontiguousarray(sk[:, 1]))], names=["bucket", "h", "q", "s0", "s1"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket -> distinct candidate pairs of each run of buckets."""
        names = ("bucket", "h", "q", "s0", "s1")
        held: list[list[np.ndarray]] = []

        def search(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            bucket, h, q, s0, s1 = rows
            found = []
            size = 0

            def flush():
                a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                o = np.lexsort((b, a))
                a, b = a[o], b[o]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["ha", "hb"])

            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            for lo, hi in zip(edge[:-1], edge[1:]):
                code = np.ascontiguousarray(q[lo:hi]).view(np.int8).reshape(-1, 8)[:, :fine]
                sk = np.stack([s0[lo:hi], s1[lo:hi]], axis=1).view(np.uint64)
                for a, b in bucket_pairs(h[lo:hi], code, sk, sets, limit, seed):
                    if len(a):
                        found.append((a, b))
                        size += len(a)
                    if size > 500_000:
                        yield flush()
                        found, size = [], 0
            if found:
                yield flush()

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(x).to_numpy() for x in names]
            bucket = cols[0]
            last = int(np.searchsorted(bucket[::-1] != bucket[-1], True)) if bucket[0] != bucket[-1] else len(bucket)
            cut = len(bucket) - last  # rows of the last bucket may go on in the next batch
            if held and (cut or held[-1][0][0] != bucket[0]):
                rows = [np.concatenate(c) for c in zip(*held)] if held[-1][0][0] != bucket[0] else [np.concatenate([*(x[i] for x in held), cols[i][:cut]]) for i in range(5)]
                if held[-1][0][0] != bucket[0]:
                    yield from search(rows)
                    if cut:
                        yield from search([c[:cut] for c in cols])
                else:
                    yield from search(rows)
                held = [[c[cut:] for c in cols]]
            else:
                if cut:
                    yield from search([c[:cut] for c in cols])
                held.append([c[cut:] for c in cols])
        if held:
            yield from search([np.concatenate(c) for c in zip(*held)])

    rows = kept.select(F.xxhash64("id").alias("h"), "embedding").mapInArrow(hashes, "bucket int, h bigint, q bigint, s0 bigint, s1 bigint")
    pairs = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(candidates, "ha bigint, hb bigint").distinct()

    # exact reranking; ids are looked up by their hash, so a clash of hashes only adds rows that are verified too
    full = kept.select(F.xxhash64("id").alias("h"), "id", "embedding")
    side = lambda c, x: full.select(F.col("h").alias(f"h{c}"), F.col("id").alias(f"id{x}"), F.col("embedding").alias(f"e{x}"))
    both = pairs.join(side("a", 1), "ha").join(side("b", 2), "hb").where(F.col("id1") != F.col("id2"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(2)).astype(np.float64), _matrix(batch.column(3)).astype(np.float64)
            c = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            near = pa.array(c >= least - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near), pa.array(c).filter(near)], names=["id1", "id2", "cosine"])

    verified = both.select("id1", "id2", "e1", "e2").mapInArrow(exact, "id1 string, id2 string, cosine double")
    verified, _ = scratch.write(verified)
    scratch.drop(ids_path if not n_crowded else None)
    directed = verified.select("id1", "id2", "cosine").unionByName(verified.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "cosine")).dropDuplicates(["id1", "id2"])
    nearest = directed.withColumn("r", F.row_number().over(W.partitionBy("id1").orderBy(F.desc(F.round("cosine", 9)), "id2"))).where(F.col("r") <= k)
    out = nearest.select(F.least("id1", "id2").alias("id_a"), F.greatest("id1", "id2").alias("id_b"), "cosine")
    if copies is not None:
        out = out.unionByName(copies)
    return out.dropDuplicates(["id_a", "id_b"])
