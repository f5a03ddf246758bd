import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.operators import resolution as R

NODES = [
    ("a1", "C-1", "Ramesh Kumar Sharma", 0), ("a2", "FIR-2024-1", "Rameshkumar Sharma", 0), ("a3", "C-3", "Ramesh Kumar", 0), ("a4", "C-1", "Ramesh Kumar Sharma", 0), ("far", "C-4", "Rameshkumar Sharma", 3),
    ("b1", "C-5", "A. K. Brahoshithe", 1), ("b2", "C-6", "A. M. Brahoshithe", 1), ("b3", "C-7", "A. P. Brahoshithe", 1), ("w5", "C-5", "canal bank", 4), ("w6", "C-6", "Canal Bank", 5),
]


@pytest.fixture()
def cases(tmp_path):
    rows = [{"node_id": n, "label": "Location" if n[0] == "w" else "Person", "case_id": c, "val": v, "embedding": [float(i == e) for i in range(6)]} for n, c, v, e in NODES]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "kg_nodes.parquet")
    people = [{"person_id": "b3", "role": "Judge"}, {"person_id": "b1", "role": "accused"}]
    pq.write_table(pa.Table.from_pylist(people), tmp_path / "person_records.parquet")
    return str(tmp_path)


def test_variants_are_resolved(spark, cases):
    got = {(r.x, r.y): r.basis for r in entry.queries()["resolve_links"](spark, cases).collect()}
    assert got == {("a1", "a2"): "name", ("a2", "a4"): "name", ("a1", "a3"): "name", ("a3", "a4"): "name", ("b1", "b2"): "name+context"}
    assert {(r.x, r.y) for r in entry.queries()["resolve_incremental"](spark, cases).collect()} == {("a1", "a2"), ("a2", "a4")}
    assert {r.label: r.links for r in entry.queries()["resolve_summary"](spark, cases).collect()} == {"Person": 5}


def test_decisions_and_their_basis(spark):
    from graphloom.operators import resolution as R

    def pair(a, b, role_a="", role_b="", ctx_a=(), ctx_b=()):
        df = spark.createDataFrame([(a, b, role_a, role_b, list(ctx_a), list(ctx_b))], "a_norm string, b_norm string, a_role string, b_role string, a_ctx array<string>, b_ctx array<string>")
        r = R.decide(df).first()
        return r.accepted, r.basis, r.confidence

    assert pair("anil sharma", "anil k sharma") == (True, "name", 0.57)
    assert pair("sharma", "sharma") == (False, "ambiguous-name-no-corroboration", 0.0)
    assert pair("sharma", "sharma", "judge", "judge") == (True, "name+role", 0.75)
    assert pair("sharma", "sharma", "victim", "victim") == (False, "ambiguous-name-no-corroboration", 0.0)
    assert pair("g c mathur", "g s mathur", ctx_a=["x"], ctx_b=["x"])[:2] == (True, "name+context")
    assert pair("g c mathur", "g s mathur")[1] == "conflicting-initials-no-corroboration"
    assert pair("anil sharma", "ravi verma") == (False, "", 0.0)


def test_date_greedy_counts_false_positives(spark, tmp_path):
    pq.write_table(pa.Table.from_pylist([{"case_id": "c", "gold": {"time_events": ["3 May 2020", "2019", "June 2021"]}}, {"case_id": "d", "gold": {"time_events": None}}]), tmp_path / "gold_cases.parquet")
    events = [("e1", "seen in May 2020", None, None), ("e2", None, "2020-06-01 10:00", None), ("e3", "June 2019", None, None), ("e4", None, None, "April 2021")]
    pq.write_table(pa.Table.from_pylist([{"case_id": "c", "event_id": e, "description": x, "timestamp": t, "date": y} for e, x, t, y in events]), tmp_path / "time_events.parquet")
    got = {r.case_id: (r.tp, r.fp, r.fn) for r in entry.queries()["date_greedy"](spark, str(tmp_path)).collect()}
    assert got == {"c": (2, 2, 1), "d": (0, 0, 0)}


def shuffled_rows(spark):
    """Rows written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["resolve_links", "resolve_clusters", "resolve_incremental", "resolve_summary"])
def test_vectors_of_a_large_label_are_sent_a_few_times(spark, tmp_path, name):
    rnd, n = np.random.default_rng(4), 12_000
    x = rnd.standard_normal((n, 48)).astype("float32")
    x[1::100] = x[::100]
    rows = [{"node_id": f"n{i:05d}", "label": "Person", "case_id": f"FIR-{2020 + i % 5}-{i}", "val": f"{'abcdefgh'[i // 10 % 8] * 9} smith", "embedding": x[i]} for i in range(n)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "kg_nodes.parquet")
    pq.write_table(pa.table({"person_id": ["n00000"], "role": ["witness"]}), tmp_path / "person_records.parquet")
    before = shuffled_rows(spark)
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    assert shuffled_rows(spark) - before < 4 * n
    pairs = [(f"n{i:05d}", f"n{i + 1:05d}") for i in range(0, n, 100)]
    want = {"resolve_links": pairs, "resolve_summary": [("Person", 120)], "resolve_clusters": [(a, 2) for a, _ in pairs], "resolve_incremental": []}[name]
    assert sorted(tuple(r)[:2] for r in got) == want


@pytest.mark.parametrize("tile", [None, 60])
def test_similar_equals_all_products(spark, monkeypatch, tile):
    monkeypatch.setattr(R, "PRODUCT", (32, 50))
    rnd = np.random.default_rng(7)
    x = np.vstack([rnd.standard_normal((150, 64)), rnd.standard_normal((4, 64)).repeat(25, 0) + 0.4 * rnd.standard_normal((100, 64)), np.zeros((3, 64))]).astype("float32")
    rows = [(f"e{i:03d}", "L" if i % 9 else "M", f"d{i % 40}" if i % 50 else None, x[i].tolist()) for i in range(len(x))]
    df = spark.createDataFrame(rows, "eid string, label string, doc string, emb array<float>")
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-30)
    cos = u @ u.T
    want = {(a[0], b[0]) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and a[1] == b[1] and a[2] != b[2] and cos[i, j] >= 0.78}
    found = lambda new=None: [(r.a_eid, r.b_eid) for r in R.similar(df, 0.78, new, tile=tile).collect()]
    assert sorted(found()) == sorted(want) and len(want) > 100
    fresh = {r[0] for r in rows if r[2] in ("d3", "d21")}
    assert sorted(found(F.col("doc").isin("d3", "d21"))) == sorted(p for p in want if fresh & set(p)) == sorted(found(df.where("doc in ('d3', 'd21')")))


def test_acceptable_names_share_a_group(spark):
    rnd = random.Random(5)
    words = ["ramesh", "rameshk", "kumar", "kumaar", "sharma", "k", "m", "sharmaa"]
    names = sorted({" ".join(rnd.sample(words, rnd.randrange(1, 4))) for _ in range(40)})
    df = spark.createDataFrame([("P", n) for n in names * 2] + [("Q", "ramesh"), (None, "x y")], "label string, norm string")
    groups = {(r.label, r.norm): r.grp for r in R.name_groups(df).collect()}
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a != b], "a_norm string, b_norm string")
    named = [(r.a_norm, r.b_norm) for r in R._scored(pairs, 0.88).where("s.score >= 0.88").collect()]
    assert named and all(groups["P", a] == groups["P", b] for a, b in named)
    assert len({groups["P", n] for n in names}) > 1 and len({groups[k] for k in groups if k[0] != "P"}) == 2
    assert R.name_groups(df).count() == df.count()
    assert {r.grp for r in R.name_groups(df, most=5).where("label = 'P'").collect()} == {None}


def moved_rows(spark):
    """Rows written to shuffles and files so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["resolve_summary", "resolve_clusters", "resolve_incremental"])
def test_pairs_of_repeated_vectors_are_not_moved_one_by_one(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(R, "TOGETHER", 5_000)
    n, k = 1_200, 3
    x = np.random.default_rng(6).standard_normal((k, 48)).astype("float32")
    # two names; of the second the context speaks for every other node only
    rows = [{"node_id": f"n{i:05d}", "label": "Person", "case_id": f"FIR-{2023 + i % 4 // 2}-{i}", "val": "smith" if i % k == 2 else "anil smith", "embedding": x[i % k]} for i in range(n)]
    rows += [{"node_id": f"o{i:05d}", "label": "Person", "case_id": f"FIR-{2023 + i % 4 // 2}-{i}", "val": "Canal Bank", "embedding": None} for i in range(0, n, 2)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "kg_nodes.parquet")
    pq.write_table(pa.table({"person_id": ["n00000"], "role": ["witness"]}), tmp_path / "person_records.parquet")
    before = moved_rows(spark)
    got = entry.queries()[name](spark, str(tmp_path))
    total = got.count() if name == "resolve_incremental" else sorted(tuple(r) for r in got.collect())
    assert moved_rows(spark) - before < 20 * n
    groups = [[i for i in range(n) if i % k == g and (g < 2 or i % 2 == 0)] for g in range(k)]
    pairs = [len(g) * (len(g) - 1) // 2 for g in groups]
    old = [sum(i % 4 < 2 for i in g) for g in groups]
    assert total == {"resolve_summary": [("Person", sum(pairs))], "resolve_clusters": sorted((f"n{g[0]:05d}", len(g)) for g in groups), "resolve_incremental": sum(p - m * (m - 1) // 2 for p, m in zip(pairs, old))}[name]


def test_roles_and_context_of_the_ends(spark, tmp_path):
    nodes = [("j1", "C-1", "sharma"), ("j2", None, "sharma"), ("j3", "C-3", "sharma"), ("k1", "C-4", "verma"), ("k2", "C-5", "verma"), ("k3", "C-4", "verma"), ("k4", "C-6", "verma")]
    rows = [{"node_id": n, "label": "Person", "case_id": c, "val": v, "embedding": [1.0, 0.0] if n[0] == "j" else [0.0, 1.0]} for n, c, v in nodes] + [{"node_id": "z", "label": "Person", "case_id": "C-5", "val": " VERMA", "embedding": None}]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "kg_nodes.parquet")
    pq.write_table(pa.table({"person_id": ["j1", "j2", "j3"], "role": ["Judge", "judge", "witness"]}), tmp_path / "person_records.parquet")
    got = {(r.x, r.y): r.basis for r in entry.queries()["resolve_links"](spark, str(tmp_path)).collect()}
    # one's own value is no context, the same value of another node of the case is; k1 and k3 are of one case
    assert got == {("j1", "j2"): "name+role", ("k1", "k2"): "name+context", ("k2", "k3"): "name+context"}


def shuffled_bytes(spark):
    """Bytes written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def wide_nodes(path, n=2_000, size=512, new=20):
    """``n`` nodes of one name, two of a vector, ``new`` of them in new cases; the bytes of their vectors."""
    x = np.random.default_rng(8).standard_normal((n // 2, size)).astype("float32").repeat(2, 0)
    rows = [{"node_id": f"n{i:05d}", "label": "Person", "case_id": f"FIR-{2024 if i % (n // new) == 1 else 2020}-{i}", "val": "anil smith", "embedding": x[i]} for i in range(n)]
    pq.write_table(pa.Table.from_pylist(rows), path / "kg_nodes.parquet")
    pq.write_table(pa.table({"person_id": ["n00000"], "role": ["witness"]}), path / "person_records.parquet")
    return x.nbytes


@pytest.mark.parametrize("tile", [16_000_000, 500_000])
def test_vectors_meet_new_ones_in_one_shuffle(spark, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(R, "TILE_BYTES", tile)
    size, before = wide_nodes(tmp_path), shuffled_bytes(spark)
    # as of large tables, none but a table of blocks is sent whole
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        got = {(r.x, r.y) for r in entry.queries()["resolve_incremental"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(f"n{i:05d}", f"n{i + 1:05d}") for i in range(0, 2_000, 100)}
    assert shuffled_bytes(spark) - before < 1.5 * size


def test_no_vector_is_left_on_disk_when_groups_are_made(spark, tmp_path):
    def kept():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName(): files.apply(i).length() for i in range(files.size())}

    size, before = wide_nodes(tmp_path), kept()
    written = shuffled_bytes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        groups = entry.queries()["resolve_clusters"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled_bytes(spark) - written < 1.5 * size
    assert sum(n for f, n in kept().items() if f not in before) < 0.1 * size
    assert sorted(map(tuple, groups.collect())) == [(f"n{i:05d}", 2) for i in range(0, 2_000, 2)]


@pytest.mark.parametrize("most", [1, 4, 100])
def test_groups_equal_components(spark, most):
    """Links over blocks put together in one task, over the limit, and with a node in several blocks."""
    rnd = random.Random(9)
    for shared in (False, True):
        links = [(b, f"{'' if shared else b}v{rnd.randrange(12):02d}", f"{'' if shared else b}v{rnd.randrange(12):02d}") for b in (1, 2, 3) for _ in range(2 + 3 * b)]
        pairs = spark.createDataFrame([(b, [(min(x, y), max(x, y))]) for b, x, y in links], "blk bigint, ends array<struct<a_eid: string, b_eid: string>>").repartition(4)
        up = {}
        for _, x, y in links:
            if x != y:
                whole = up.get(x, {x}) | up.get(y, {y})
                up |= dict.fromkeys(whole, whole)
        got = [(r.node_id, r.component) for r in R.groups(pairs, most).collect()]
        assert sorted(got) == sorted((x, min(g)) for x, g in up.items())
