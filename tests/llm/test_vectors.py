import numpy as np

from graphloom.llm import vectors

SCHEMA = "id string, embedding array<float>, cosine double"


def brute(rows, k, least):
    ids = [i for i, v in rows]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for i in range(len(ids)):
        near = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= least), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in near}
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 32))
    rows = [(f"c{i:02d}-{j}", (centres[i] + 0.25 * rng.standard_normal(32)).astype("f4").tolist()) for i in range(60) for j in range(8)]
    rows += [(f"r{i:03d}", (3 * rng.standard_normal(32)).astype("f4").tolist()) for i in range(300)]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], SCHEMA)
    got = {(r.id_a, r.id_b) for r in vectors.similar_pairs(spark, df, 5, 0.9).collect()}
    truth = brute(rows, 5, 0.9)
    assert len(got & truth) >= 0.97 * len(truth)
    assert len(got - truth) <= 0.02 * len(truth)


def test_hot_group_of_copies(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal(16).astype("f4").tolist()
    rows = [(f"k{i:03d}", v) for i in range(80)] + [(f"z{i}", rng.standard_normal(16).astype("f4").tolist()) for i in range(20)]
    df = spark.createDataFrame([(i, e, None) for i, e in rows], SCHEMA)
    got = {(r.id_a, r.id_b) for r in vectors.similar_pairs(spark, df, 5, 0.9).collect()}
    assert got == brute(rows, 5, 0.9)


def test_nulls_zeros_and_empty(spark):
    df = spark.createDataFrame([("a", None, 0.0), ("b", [0.0, 0.0], 0.0), ("c", [1.0, None], 0.0), (None, [1.0, 0.0], 0.0), ("d", [float("nan"), 1.0], 0.0), ("e", [], 0.0), ("f", [1.0, 0.0], 0.0), ("g", [2.0, 0.0], 0.0), ("g", [2.0, 0.0], 0.0), ("h", [1.0, 2.0, 3.0], 0.0)], SCHEMA)
    assert [(r.id_a, r.id_b) for r in vectors.similar_pairs(spark, df, 5, 0.9).collect()] == [("f", "g")]
    assert vectors.similar_pairs(spark, df.limit(0), 5, 0.9).collect() == []


def test_perturbations_are_valid_and_ordered():
    sets = vectors.perturbations(6, 50)
    assert len(sets) == 50 and sets[0] == (0,)
    assert all(11 - j not in s for s in sets for j in s)


def test_tables_grow_so_that_recall_does_not_fall():
    """Planted pairs of cosine 0.90 through the very hashes of each size."""
    x, y = vectors.planted(1_500, 0.9, 64, 3)
    both, ids = np.concatenate([x, y]), np.arange(3_000)
    for n in (200_000, 2_000_000, 20_000_000, 200_000_000):
        coarse, wide, fine, tables = vectors.plan(n, 0.9, 64)
        assert n * vectors.agreement(2**0.5, wide) ** coarse <= 1.05 * max(vectors.BUCKET, n if not coarse else 0)
        found = np.zeros(1_500, bool)
        for t, bucket, q in vectors.encode(both, tables, coarse, fine, wide, vectors.WIDTH, 11):
            for a, b in vectors.bucket_pairs(ids, q, vectors.sketch(both, 11 + t), vectors.perturbations(fine, vectors.PROBES), vectors.hamming_limit(0.9), 11):
                hit = (b - a == 1_500) & (bucket[a] == bucket[b])
                found[a[hit]] = True
        assert found.mean() >= 0.95, n
