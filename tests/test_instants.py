import itertools
import random
from datetime import datetime, timezone

import pytest

from graphloom.operators import instants as I


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    "text, tz, order, expected",
    [
        ("2018-10-18T12:14:44Z", None, None, us(2018, 10, 18, 12, 14, 44)),
        ("20190823T234012Z", "Asia/Kolkata", "DMY", us(2019, 8, 23, 23, 40, 12)),
        ("1703459390", None, None, 1703459390_000_000),
        ("1653976776905", None, None, 1653976776905_000),
        ("05/18/24 18:02", "UTC", "MDY", us(2024, 5, 18, 18, 2)),
        ("08/05/20 22:24", "Asia/Kathmandu", "DMY", us(2020, 5, 8, 16, 39)),
        ("0304 hrs on 11/20/2018", "UTC", "MDY", us(2018, 11, 20, 3, 4)),
        ("Sunday, 7th June 2020, 7.05 a.m.", "UTC", "DMY", us(2020, 6, 7, 7, 5)),
        ("13:33 GMT+5:30, 03-Oct-2023", "UTC", "DMY", us(2023, 10, 3, 8, 3)),
        ("2 Oct 2023 00:45:19 NDT", "America/St_Johns", "MDY", us(2023, 10, 2, 3, 15, 19)),
        ("27 Feb 2018 04:52:49 CST", "America/Chicago", "MDY", us(2018, 2, 27, 10, 52, 49)),
        ("01-01-2018 08:48PM UTC", "Asia/Kathmandu", "MDY", us(2018, 1, 1, 20, 48)),
        ("May 14, 2021 14:18", "UTC", None, us(2021, 5, 14, 14, 18)),
        ("24 July 2024, 12:30 am UTC", None, None, us(2024, 7, 24, 0, 30)),
        ("2018-12-24 15:07:36.091925-0500", None, None, us(2018, 12, 24, 20, 7, 36) + 91925),
    ],
)
def test_reads(text, tz, order, expected):
    found = I.interpretations(text, tz, order)
    assert min(found, key=lambda x: x[2])[1] == expected


@pytest.mark.parametrize(
    "text, tz",
    [("2024-15-22T23:55:01", "UTC"), ("31 September 2022 15:40", "UTC"), ("2022-11-04 25:58", "UTC"), ("2018-03-11 02:11:27", "America/New_York"), ("2018-03-11 02:11:27" + " " * 200, "America/New_York"), ("2018-11-04 01:11:27", "America/New_York"), ("2020-01-01 10:00", None), ("", "UTC"), (None, "UTC"), ("evening of 1 May 2020", "UTC"), ("13 May 2018", "UTC"), ("22:47", "UTC"), ("18/05/2020 13:00 pm", "UTC"), ("05/18/2024 10:00", "UTC"), ("9" * 5000, "UTC"), ("2020-01-01 10:00", "No/Zone")],
)
def test_names_no_instant(text, tz):
    assert all(f.startswith(I.NEVER) for f, _, _ in I.interpretations(text, tz, "DMY"))


def brute(chain):
    def cost(choice):
        picked = [x[i] for x, i in zip(chain, choice)]
        return sum(x[2] for x in picked) + sum(I._step(a, b) for a, b in zip(picked, picked[1:]))

    return min(cost(c) for c in itertools.product(*[range(len(x)) for x in chain])), cost


def test_viterbi_equals_exhaustive_search():
    rnd = random.Random(3)
    for _ in range(60):
        chain = [[(rnd.choice(["numeric_DMY", "numeric_MDY", "iso"]), rnd.randrange(10**14), 0.0) for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 7))]
        best, cost = brute(chain)
        assert cost(I.viterbi(chain)) == pytest.approx(best)


def test_cut_chains_equal_unbroken_ones(spark):
    """Sources without a known date order, one holding most rows, cut over partitions."""
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        source = "hot" if rnd.random() < 0.7 else rnd.choice(["s1", "s2", None])
        d, m = rnd.randint(1, 12), rnd.randint(1, 12)
        rows.append((source, f"{i:05d}", f"k{i:05d}", f"{d:02d}/{m:02d}/2020 {rnd.randint(0, 23):02d}:00" if rnd.random() < 0.8 else f"2020-{m:02d}-{d:02d} 10:00", "UTC", None, "clash"))
    df = spark.createDataFrame(rows, "source string, seq string, record_key string, written string, tz_name string, date_order string, fmt string")
    got = {r.record_key: (r.fmt, r.instant_us) for r in I.resolve_instants(spark, df).collect()}
    for source in ("hot", "s1", "s2", None):
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (r[1], r[2]))
        chain = [I.states(I.interpretations(r[3], r[4], r[5])) for r in own]
        expected = [x[i] for x, i in zip(chain, I.viterbi(chain))]
        assert [got[r[2]] for r in own] == [(f.partition("|")[0], u) for f, u, _ in expected]


def test_empty_table_and_null_keys(spark):
    df = spark.createDataFrame([(None, None, None, "2020-01-01T00:00:00Z", None, None), ("s", None, "k", None, None, None)], "source string, seq string, record_key string, written string, tz_name string, date_order string")
    assert I.resolve_instants(spark, df).collect() == []
    assert I.resolve_instants(spark, df.limit(0)).collect() == []
    one = spark.createDataFrame([(None, None, "k", "2020-01-01T00:00:00Z", None, None)], df.schema)
    assert [r.instant_us for r in I.resolve_instants(spark, one).collect()] == [us(2020, 1, 1)]


def written(*rows):
    """(source, seq, record_key, written, tz_name, date_order) as the time-event query hands them over."""
    return [(s, f"{i:05d}", f"k{i}", w, tz, order) for i, (s, w, tz, order) in enumerate(rows)]


SCHEMA = "source string, seq string, record_key string, written string, tz_name string, date_order string"


def test_neighbours_decide_where_each_record_alone_would_not(spark):
    """A source of unknown order: greedy takes the first reading of 04/03, the way through all records the other."""
    rows = written(("s", "03/25/2020 10:00", "UTC", None), ("s", "2020-03-26 10:00", "UTC", None), ("s", "04/03/2020 10:00", "UTC", None), ("s", "04/15/2020 10:00", "UTC", None))
    got = {r.record_key: r.instant_us for r in I.resolve_instants(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    greedy = min(I.interpretations("04/03/2020 10:00", "UTC", None), key=lambda x: x[2])[1]
    assert greedy == us(2020, 3, 4, 10) and got["k2"] == us(2020, 4, 3, 10)


def test_own_order_in_a_clock_change_names_no_instant(spark):
    rows = written(("s", "03/10/2024 2:15 am", "America/New_York", "MDY"), ("s", "03/11/2024 2:15 am", "America/New_York", "MDY"))
    got = {r.record_key: r.instant_us for r in I.resolve_instants(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"k1": us(2024, 3, 11, 6, 15)}


def test_long_texts_are_read_whole(spark):
    rows = written(("s", "2020-01-01" + " " * 500 + "10:00", "UTC", None), ("s", "2020-01-01 10:00 " + "x" * 100_000, "UTC", None))
    assert [r.record_key for r in I.resolve_instants(spark, spark.createDataFrame(rows, SCHEMA)).collect()] == ["k0"]
