import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import images, metrics, resolution, stats, timeline


def test_gap_boundaries(spark):
    t0 = datetime(2020, 1, 1)
    steps = [0, 2 * 3600, 4 * 3600 + 1, 10 * 3600 + 1, None]
    rows = [("c", f"e{i}", None if s is None else t0 + timedelta(seconds=s)) for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "case string, event string, ts timestamp_ntz")
    got = [(r.to_event, r.severity) for r in timeline.gaps(df, "case", "ts", "event").collect()]
    assert got == [("e2", "warning"), ("e3", "high")]
    assert timeline.spans(df, "case", "ts").first().hours is None
    assert [r.event for r in timeline.ordered(df, "case", "ts", "event").orderBy("position").collect()][-1] == "e4"
    pre = spark.createDataFrame([("e1", "e0"), ("e0", "e1")], "src_event string, dst_event string")
    assert [r.src_event for r in timeline.contradictions(pre, df, "event", "ts").collect()] == ["e1"]


def test_quantiles_and_normality():
    for df, t in ((1, 12.7062), (10, 2.2281), (30, 2.0423)):
        assert stats.t_quantile(0.975, df) == pytest.approx(t, abs=1e-3)
    w, p = stats.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (w, p) == (pytest.approx(0.7888, abs=2e-3), pytest.approx(0.0067, abs=1e-3))


def test_intervals_and_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, 5.0)], "a double, b double")
    got = {r.feature: r for r in stats.t_interval(df, ["a", "b"]).collect()}
    assert set(got) == {"a"} and got["a"].low == pytest.approx(2 - 4.30265 / 3**0.5, abs=1e-3)
    d = {r.feature: (r.n, r.mean) for r in stats.describe(df, ["a", "b"]).collect()}
    assert d == {"a": (3, 2.0), "b": (1, 5.0)}


def test_nearest_distances_equal_brute_force(spark):
    rnd = random.Random(1)
    pts = [("g", i, rnd.random() ** 3 * 100, rnd.random() * 5) for i in range(60)] + [("h", 1, 1.0, 1.0), ("z", 1, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "grp string, k int, px double, py double")
    r = {x.grp: x for x in stats.nearest_distances(df, "grp", "k", "px", "py").collect()}["g"]
    own = [(x, y) for g, _, x, y in pts if g == "g"]
    best = [min(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for j, (a, b) in enumerate(own) if j != i) for i, (x, y) in enumerate(own)]
    assert r.mean_dist == pytest.approx(np.mean(best)) and r.std_dist == pytest.approx(np.std(best)) and r.n == 60


def test_thinning_and_bootstrap(spark):
    df = spark.createDataFrame([("i", k, float(x), 0.0) for k, x in enumerate((0, 3, 11, 12, 25))], "img string, k int, x double, y double")
    assert sorted(r.x for r in stats.thin_points(df, "img", "k", "x", "y", 10.0).collect()) == [0.0, 11.0, 25.0]
    v = spark.createDataFrame([(float(i % 7), i) for i in range(500)], "v double, k int")
    b = stats.bootstrap_interval(v, "v", 400).first()
    half = 1.96 * np.std([i % 7 for i in range(500)]) / 500**0.5
    assert b.low == pytest.approx(b.mean - half, rel=0.05) and b.high == pytest.approx(b.mean + half, rel=0.05)


def test_bootstrap_is_of_the_order_values(spark, folder):
    import __spark_entry__ as entry
    from graphloom.sources.tables import table

    v = np.array([r[0] for r in table(spark, folder, "orders", ["o_totalprice"]).where("o_totalprice is not null").collect()])
    b = entry.queries()["bootstrap_ci"](spark, folder).first()
    half = 1.96 * v.std() / len(v) ** 0.5
    assert b.mean == pytest.approx(v.mean(), abs=half / 5)
    assert b.mean - b.low == pytest.approx(half, rel=0.15) and b.high - b.mean == pytest.approx(half, rel=0.15)


def test_metrics(spark):
    assert metrics.greedy_pairs(["ram lal", "ram"], ["ram", "ram lall"], 0.75) == [(0, 1, pytest.approx(14 / 15)), (1, 0, 1.0)]
    df = spark.createDataFrame([("k", ["a b", "x"], ["a b", "y"]), ("e", None, None)], "k string, g array<string>, f array<string>")
    assert sorted(tuple(r) for r in metrics.greedy_match(df, "k", "g", "f").collect()) == [("e", 0, 0, 0), ("k", 1, 1, 1)]
    lab = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (None, 1)], "a int, b int")
    assert metrics.kappa(lab, "a", "b").first().kappa == pytest.approx(0.5)
    same = spark.createDataFrame([(1, 1)], "a int, b int")
    assert metrics.kappa(same, "a", "b").first().kappa == 1.0
    f = metrics.frontier(spark.createDataFrame([(0.9, True), (0.9, False), (0.5, True)], "s double, g boolean"), "s", F.col("g")).orderBy(F.desc("s")).collect()
    assert [(r.accepted, r.tp, r.precision, r.recall) for r in f] == [(2, 1, 0.5, 0.5), (3, 2, 0.6667, 1.0)]
    c = spark.createDataFrame([("a", 0, 0, 0), ("b", 2, 1, 1)], "t string, tp bigint, fp bigint, fn bigint")
    assert {r.t: r.f1 for r in metrics.micro(c, "t").collect()} == {"a": 0.0, "b": 0.6667, "*": 0.6667}


def nodes(spark, rows):
    return spark.createDataFrame([(e, "Person", d, n, r, v, c) for e, d, n, r, v, c in rows], "eid string, label string, doc string, norm string, role string, emb array<float>, ctx array<string>")


def test_tiles_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((8, 6))
    rows = [(f"e{i:02d}", f"d{i % 5}", "x", None, (base[i % 8] + 0.3 * rng.standard_normal(6)).astype("f4").tolist(), []) for i in range(60)]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] != b[1] and cos(a[4], b[4]) >= 0.78}
    df = nodes(spark, rows)
    for tile in (7, 1000):
        assert {(r.a_eid, r.b_eid) for r in resolution.candidates(df, 0.78, tile=tile).collect()} == want
    new = df.where("eid < 'e05'")
    assert {(r.a_eid, r.b_eid) for r in resolution.candidates(df, 0.78, new=new, tile=7).collect()} == {p for p in want if p[0] < "e05" or p[1] < "e05"}


def test_decisions(spark):
    v = [1.0, 0.0]
    rows = [("a", "d1", "anil sharma", None, v, []), ("b", "d2", "anil k sharma", None, v, []), ("c", "d3", "g c x", None, v, ["p"]), ("d", "d4", "g s x", None, v, ["p"]), ("e", "d5", "sharma", None, v, []), ("z", "d9", "anil sharma", None, [0.0, 0.0], [])]
    got = {(r.a_eid, r.b_eid): (r.accepted, r.basis) for r in resolution.decide(resolution.candidates(nodes(spark, rows), 0.78)).collect()}
    assert got["a", "b"] == (True, "name") and not got["a", "e"][0]
    assert not any("z" in k for k in got)


def test_deduplicate(spark):
    ent = spark.createDataFrame([("Person", "p1", "Ann", 0), ("Person", "p2", "ANN", 1), ("Person", "p3", "Bob", 2), ("Person", "p4", None, 3)], "entity_type string, entity_id string, name string, ordinal int")
    known = spark.createDataFrame([("Person", "bob", "g9")], "entity_type string, name string, entity_id string")
    rel = spark.createDataFrame([("p2", "p3", "KNOWS")], "src string, dst string, type string")
    fresh, ids, rels = resolution.deduplicate(ent, known, rel)
    assert sorted(r.entity_id for r in fresh.collect()) == ["p1", "p4"]
    assert [(r.src, r.dst) for r in rels.collect()] == [("p1", "g9")]


def test_image_measures(spark):
    img = np.full((60, 80), 255, np.uint8)
    img[10:25, 10:30] = 0
    img[40:52, 50:70] = 0
    data = b"P5 80 60 255\n" + img.tobytes()
    r = {x.path: x for x in images.measure(spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"no")), ("c", None)], "path string, content binary")).collect()}
    assert r["a"].n_stains == 2 and r["a"].n_lines == 2 and r["b"].n_stains is None and r["c"].sobel_max is None
    s = images.stains(images.decode_pnm(data))[0]
    assert (s["area"], s["width"], s["height"]) == (300.0, 20.0, 15.0)


def test_running_totals_and_median_over_cut_groups(spark):
    import random
    import statistics

    from graphloom.operators import stats as S
    from graphloom.operators.running import running_totals
    from graphloom.shared import Scratch
    from pyspark.sql import functions as F

    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.8 else rnd.choice(["a", None]), i, rnd.randrange(50)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {r.i: (r.s, r.all_s) for r in running_totals(df, ["g"], [F.desc("i")], {"s": "v"}, Scratch(spark, "t")).collect()}
    for g, i, _ in rows:
        own = [x for x in rows if x[0] == g]
        assert got[i] == (sum(x[2] for x in own if x[1] >= i), sum(x[2] for x in own))
    assert running_totals(df.limit(0), ["g"], [F.desc("i")], {"s": "v"}, Scratch(spark, "t")).collect() == []
    med = {r.g: r.median for r in S.describe(df, ["v"], ["g"]).collect()}
    assert med == {g: statistics.median(x[2] for x in rows if x[0] == g) for g in ("hot", "a", None)}


def png(img, kinds, colour, palette=b""):
    """A PNG of the given filters, a row each in turn."""
    import struct
    import zlib

    h, w = img.shape[:2]
    n = 1 if img.ndim == 2 else img.shape[2]
    flat = img.reshape(h, w * n).astype(int)
    raw = b""
    for y in range(h):
        k, row, up = kinds[y % len(kinds)], flat[y], flat[y - 1] if y else np.zeros(w * n, int)
        left, corner = np.r_[np.zeros(n, int), row[:-n]], np.r_[np.zeros(n, int), up[:-n]]
        pa, pb, pc = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        guess = [0 * row, left, up, (left + up) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))][k]
        raw += bytes([k]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_round_trip():
    rng = np.random.default_rng(3)
    for n, colour in ((0, 0), (3, 2), (4, 6)):
        img = rng.integers(0, 256, (11, 7, n) if n else (11, 7)).astype(np.uint8)
        got = images.decode(png(img, (0, 1, 2, 3, 4), colour))
        assert np.array_equal(got, img[:, :, :3] if n else img)
    colours = rng.integers(0, 256, (5, 3)).astype(np.uint8)
    img = rng.integers(0, 5, (6, 6)).astype(np.uint8)
    assert np.array_equal(images.decode(png(img, (4, 1), 3, colours.tobytes())), colours[img])
    good = png(img, (0,), 0)
    for bad in (good[:20], good[:50], b"\x89PNG", png(img, (0,), 3), None, b"", b"GIF89a"):
        assert images.decode(bad) is None


def test_findings(spark):
    df = spark.createDataFrame([(1, 0, False), (2, 3, False), (3, None, True), (4, None, None)], "i int, total_stains int, wound_detected boolean")
    assert [r.f for r in df.orderBy("i").select(images.has_findings(df).alias("f")).collect()] == [False, True, True, False]
    assert not df.select("i").select(images.has_findings(df.select("i")).alias("f")).first().f
