from graphloom.llm import names
from graphloom.llm.names import Profile, resolve_block

SCHEMA = "record_key string, name string, age int, gender string, phone string, surname string"


def groups(spark, rows):
    df = spark.createDataFrame([(f"r{i:02d}", *r, "clash") for i, r in enumerate(rows)] + [(None, "A B", None, None, None, "x"), ("z", None, None, None, None, "x")], SCHEMA)
    return {(int(r[0][1:]), int(r[1][1:])) for r in names.link_names(spark, df).collect()}


COMMON = [("Oliver Brahoshithe", None, None, None), ("Dinesh Lochizama", None, None, None), ("Brahoshithe, Harold", None, None, None), ("Lochizama, Fatima", None, None, None)]


def test_variants_of_one_person(spark):
    rows = [("Dr. William Lochizama", 40, "M", None), ("Lochizama, Bill", 41, None, None), ("W. Lochizama", 40, "Male", None), ("Wiliam L0chizama (deceased)", None, None, None), ("William Lochizama", 70, None, None), *COMMON]
    got = groups(spark, rows)
    assert {(0, 1), (0, 2), (1, 2)} <= got
    assert not {(0, 4), (1, 4), (2, 4)} & got


def test_telephones_decide(spark):
    rows = [("Gabriela Lochizama", 58, None, "080045-72675"), ("Gabi Lochizamaa", 57, None, "+00-8004572675"), ("Gabriela Lochizama", 58, None, "9999999999"), *COMMON]
    got = groups(spark, rows)
    assert (0, 1) in got and not {(0, 2), (1, 2)} & got


def test_organisations_by_lead_and_trade(spark):
    rows = [("Bretelone Freight Pvt Ltd", None, None, None), ("The Bretelone Frt (P) Ltd", None, None, None), ("Bretelone Transport Limited", None, None, None), ("Freight - Bretelone Company", None, None, None)]
    assert groups(spark, rows) == {(0, 1), (0, 3), (1, 3)}


def test_nameless_and_empty(spark):
    assert groups(spark, [("unknown", None, None, None), ("Unknown", None, None, None), ("", 3, None, None), ("N/A", None, None, None), ("two unknown persons", None, None, None)]) == set()
    assert groups(spark, []) == set()
    assert groups(spark, [("x" * 30_000, None, None, None), ("Amelia Brahoshithe", 3, "f", None)]) == set()


def test_links_across_initials(spark):
    rows = [("B. Lochizama", None, None, "8004572675"), ("Bob Lochizama", None, None, "8004572675"), ("Ted Lochizama", 30, None, None), ("Theodore Lochizama", 31, None, None), ("Nell Lochizama", 60, None, None), ("Penelope Lochizama", 60, None, None), ("Lochizama", None, None, "7004572675"), ("Gabriela Lochizama", None, None, "7004572675"), *COMMON]
    assert {(0, 1), (2, 3), (4, 5), (6, 7)} <= groups(spark, rows)


def test_a_record_is_linked_through_what_only_the_merged_profile_has(spark):
    """0 and 1 share a telephone, not the surname; 2 has the surname of 1 and the age of 0; 3 the initial only."""
    rows = [("Dinesh Lochizama", 40, "M", "8004572675"), ("Dinesh Brahoshithe", None, None, "8004572675"), ("Dinesh Brahoshithe", 41, "M", None), ("Dinesh Brahoshithe", 70, "M", None), ("D. Lochizama", 40, None, None), *COMMON]
    got = groups(spark, rows)
    assert {(0, 1), (0, 2), (1, 2), (0, 4)} <= got and not {(0, 3), (1, 3), (2, 3)} & got


def test_surnames_behind_an_alias_and_names_turned_round(spark):
    rows = [("William Lochizama alias Harold Brahoshithe", 50, None, None), ("Harold Brahoshithe", 50, None, None), ("Fatima Lochizama", None, None, "8004572675"), ("Lochizama Fatima", None, None, "8004572675"), *COMMON, ("Harold Brahoshithe", 20, None, None)]
    got = groups(spark, rows)
    assert {(0, 1), (2, 3)} <= got and not {(0, 8), (1, 8)} & got


def test_tony_is_anthony(spark):
    assert (0, 1) in groups(spark, [("Tony Lochizama", 33, "M", None), ("Anthony Lochizama", 33, "M", None), *COMMON])


def test_short_forms_are_learnt_from_telephones(spark):
    given = [(f"s{i}", f"80045726{i:02d}", w, "f", 30 + i) for i in range(5) for w in ("zubarika", "rika")] + [("s9", "8004572699", w, x, 30) for w, x in (("zubarika", "f"), ("omar", "m"))]
    df = spark.createDataFrame(given, "surname string, phone string, word string, sex string, age int")
    assert {(r.word, r.formal) for r in names.short_forms(spark, df).collect()} - {(w, f) for w, fs in names._NICK.items() for f in fs} == {("rika", "zubarika")}
    rows = [(f"{g} Surnama{c}", 30 + i, None, f"80045726{i:02d}") for i, c in enumerate("bdfgk") for g in ("Zubarika", "Rika")] + [("Zubarika Lochizama", 20, None, None), ("Rika Lochizama", 20, None, None), *COMMON]
    assert (10, 11) in groups(spark, rows)


def test_a_hot_surname_is_no_block(spark):
    """All of one surname: tasks see those of one given name or initial only."""
    rows = [(f"{g} Lochizama", 20 + 5 * (i % 10), "M", None) for g in ("Harold", "Oliver", "Dinesh", "William") for i in range(20)]
    got = groups(spark, rows)
    assert len(got) == 40 and all(rows[a] == rows[b] for a, b in got)


def test_merges_of_one_round_are_disjoint(spark):
    """One profile with a full name, one initial-only profile of each of its initials: all end in one group."""
    rows = [("Bob Lochizama", 40, None, None), ("B. Lochizama", 40, None, None), ("R. Lochizama", 40, None, None), *COMMON]
    assert {(0, 1), (0, 2), (1, 2)} <= groups(spark, rows)


def made(given, middle=(), age=None, phone=None):
    return Profile({"s"}, {given} if len(given) > 1 else (), {given[0]}, [m for m in middle if len(m) > 1], {m[0] for m in middle}, None, age, age, [phone] if phone else [], " ".join([given, *middle]))


def test_merged_profiles_rematch():
    """b matches c only through what the merge with a brought."""
    left = resolve_block([made("w", phone="1"), made("william", age=41), made("william", age=40, phone="1")])
    assert [len(p.keys) for p in left] == [3]


def test_contradicting_middle_names_stay_apart():
    left = resolve_block([made("isabella", ["anand"]), made("isabella", ["kiran"]), made("isabella", ["a"])])
    assert sorted(len(p.keys) for p in left) == [1, 2]
