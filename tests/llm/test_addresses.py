from graphloom.llm import addresses


def test_parts():
    p = addresses.parts("opp. post office, Flt. 5D, 115 Shuhithufo Tce, Ridge Blk, Dunmere, Norrin - 905 142")
    assert (p["number"], p["unit"], p["street"], p["kind"], p["area"], p["pin"]) == ("115", "5d", "shuhithufo", "terrace", "ridge block", "905142")
    assert {"word": "dunmere", "alt": "dunmere"} in p["places"]
    q = addresses.parts("Shuhithufo Terr. 115/Apt 5D,\nRidge Block, Dunmere")
    assert (q["number"], q["unit"], q["street"], q["kind"]) == ("115", "5d", "shuhithufo", "terrace")
    assert addresses.parts("Eight Fogutosa Lane Apt 6B Temple Ngr., Dunmere")["number"] == "8"
    for nothing in (None, "", "Temple Nagar, Rusholt", "the river bank", "unknown", "x" * 50_000):
        assert addresses.parts(nothing) is None


def records(spark, rows):
    return spark.createDataFrame([(f"{i:03d}", a, "clash") for i, a in enumerate(rows)] + [(None, "1 A Road", "x"), ("zz", None, "x")], "record_key string, address string, town string")


def test_same_and_different_places(spark):
    base = [f"{n} Vagifonu Crescent, Garden Block, Vintapur 914121" for n in range(1, 9)] + [f"{n} Vagifonu Boulevard, Vintapur 914121" for n in range(1, 7)] + [f"{n} Vagifonu Crescent, Rusholt 925121" for n in range(1, 7)]
    rows = base + ["Plot 3 Vagifonoo Cr., Vintapur", "VINTAPUR - 914 121, GARDEN BLK, VAGIFNU CRES, HOUSE 3", "Flat 2A, 3 Vagifonu Crescent, Vintapur", "3A Vagifonu Crescent, Vintapur", "3 Vagifonu Cres, Garden Blk 914121"]
    got = {(r.record_key_a, r.record_key_b) for r in addresses.same_addresses(spark, records(spark, rows)).collect()}
    same = [f"{i:03d}" for i in (2, 20, 21, 24)]
    assert got == {(a, b) for i, a in enumerate(same) for b in same[i + 1 :]}


def test_empty_and_repeated(spark):
    assert addresses.same_addresses(spark, records(spark, [])).collect() == []
    df = records(spark, ["1 Abcdefg Road, Vintapur 914121"] * 3)
    got = addresses.same_addresses(spark, df.unionByName(df)).collect()
    assert sorted((r.record_key_a, r.record_key_b) for r in got) == [("000", "001"), ("000", "002"), ("001", "002")]


def ids(spark, rows, **kw):
    return {r.record_key: r.street_id for r in addresses.resolve(spark, records(spark, rows), **kw).collect()}


def test_beam_keeps_what_greedy_loses(spark):
    """The town that is named (a slip of the pen for another one) hardly knows the street, the district's town knows it well."""
    known = [f"{n} Vagifonu Crescent, Vintapur 914121" for n in range(1, 30)] + [f"{n} Motuhono Road, Rusholt 925121" for n in range(1, 30)]
    rows = [*known, "7 Vagifonu Crescent, Rusholt 914121"]
    odd = f"{len(known):03d}"
    assert ids(spark, rows, beam=3)[odd] == "vintapur||vagifonu|crescent"
    assert ids(spark, rows, beam=1)[odd] == "rusholt||vagifonu|crescent"


def test_a_town_without_postal_code_is_a_town(spark):
    rows = [f"{n} Vagifonu Crescent, Vintapur 914121" for n in range(1, 9)] + ["3 Vagifonu Crescent, Farawaytown", "Farawaytown, Vagifonu Cres. 3"]
    got = {(r.record_key_a, r.record_key_b) for r in addresses.same_addresses(spark, records(spark, rows)).collect()}
    assert got == {("008", "009")}


def test_localities_part_streets_and_slips_do_not(spark):
    rows = [f"{n} Vagifonu Crescent, Garden Block, Vintapur 914121" for n in range(1, 9)] + [f"{n} Vagifonu Crescent, Mill Colony, Vintapur 914122" for n in range(1, 9)]
    rows += ["3 Vagifonu Crescent, Gadren Block, Vintapur"]
    got = {(r.record_key_a, r.record_key_b) for r in addresses.same_addresses(spark, records(spark, rows)).collect()}
    assert got == {("002", "016")}


def test_no_town_and_no_kind(spark):
    rows = [f"{n} Vagifonu Crescent, Vintapur 914121" for n in range(1, 9)] + ["3 Vagifonu Crescent", "3 Vagifonu, Vintapur", "No. 110 926 107 Vagifonu Crescent"]
    got = ids(spark, rows)
    assert got["008"] == got["009"] == got["002"]
    assert addresses.parts(rows[10])["pin"] == "926107" and addresses.parts(rows[10])["number"] == "110"


def test_long_words_meet_too(spark):
    from pyspark.sql import functions as F

    from graphloom.llm.spelling import spelling_clusters

    long = "a" + "bcdefghij" * 9
    df = spark.createDataFrame([("b", long, 50), ("b", long[:40] + long[41:], 2), ("b", long[:30] + "xy" + long[30:], 2), ("b", "zz" + long + "zz", 2)], "block string, word string, n bigint").withColumn("alt", F.col("word")).withColumn("keep", F.lit(False))
    got = {r.word: r.canon for r in spelling_clusters(df).collect()}
    assert [got[w] == long for w in got] .count(True) == 3
