from graphloom.llm import canonical


def run(spark, values, reference=None):
    ref = spark.createDataFrame(reference if reference is not None else [("1", "murder", "PC-110"), ("2", "human trafficking", "PC-313"), ("3", "vehicle theft", "PC-187"), ("4", "theft", "PC-180"), ("5", "grievous hurt", "PC-236"), ("6", "robbery", "PC-159"), ("7", "criminal breach of trust", "PC-215")], "entry_id string, name string, code string")
    rows = spark.createDataFrame([(str(i), v, "clash") for i, v in enumerate(values)], "record_key string, value string, entry_id string")
    return {values[int(r.record_key)]: r.entry_id for r in canonical.map_to_list(spark, rows, ref).collect()}


def test_spellings_orders_codes_and_wrappers(spark):
    expected = {
        "Murder": "1", "murdre": "1", "case of murder": "1", "human traf.": "2", "Trafficking of Humans": "2", "theft, vehicle": "3", "VEHICEL  THEFT (PC-187)": "3", "u/s PC-180": "4",
        "sec. 236 PC": "5", "griev. hurt": "5", "rob'y": "6", "alleged robbery - under inv.": "6", "trust, criminal breach of": "7", "homicide (murder)": "1",
    }
    assert run(spark, list(expected)) == expected


def test_unmatched_null_blank_long_and_empty(spark):
    got = run(spark, ["lost umbrella", "x" * 20000, None, "", "  ", "other"])
    assert got == {"lost umbrella": "unmatched", "x" * 20000: "unmatched", "other": "unmatched"}
    assert run(spark, ["murder"], []) == {"murder": "unmatched"}
    assert run(spark, []) == {}


def test_every_edit_up_to_k_is_found(spark):
    """The pigeonhole join against brute force: no string within the allowed edits is missed."""
    import random

    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(5, 16))) for _ in range(25)]
    allowed = lambda n: next((k for limit, k in canonical.EDITS if n <= limit), canonical.EDITS[-1][1])
    values = []
    for w in words:
        v = list(w)
        for _ in range(allowed(len(w))):
            i = rnd.randrange(len(v))
            op = rnd.randrange(3)
            if op == 0:
                v[i] = rnd.choice("abcdefg")
            elif op == 1 and len(v) > 3:
                del v[i]
            else:
                v.insert(i, rnd.choice("abcdefg"))
        values.append("".join(v))
    got = run(spark, values, [(f"{i:02d}", w, f"Z-{i}") for i, w in enumerate(words)])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for v in set(values):
        best = min(distance(v, w) for w in words if distance(v, w) <= allowed(len(w)))
        assert got[v] != "unmatched" and distance(v, words[int(got[v])]) == best


def test_repeated_rows_stay(spark):
    ref = spark.createDataFrame([("1", "murder", None)], "entry_id string, name string, code string")
    rows = spark.createDataFrame([("k", "murder"), ("k", "murder"), (None, "murder")], "record_key string, value string")
    assert [tuple(r) for r in canonical.map_to_list(spark, rows, ref).collect()] == [("k", "1")] * 2


def test_short_and_long_values_take_part(spark):
    ref = spark.createDataFrame([("1", "dv", None), ("2", "x" * 120, None), ("3", "murder", None)], "entry_id string, name string, code string")
    none = spark.createDataFrame([], "name string, alias string")
    rows = [("a", "DV case"), ("b", "x" * 118 + "yy"), ("c", "x" * 114), ("d", "q"), ("e", "murdr"), ("f", "dw")]
    got = {r.record_key: r.entry_id for r in canonical.map_to_list(spark, spark.createDataFrame(rows, "record_key string, value string"), ref, none).collect()}
    assert got == {"a": "1", "b": "2", "c": "unmatched", "d": "unmatched", "e": "3", "f": "unmatched"}


def test_abbreviations_in_any_place(spark):
    ref = spark.createDataFrame([("1", "grievous hurt", None), ("2", "criminal breach of trust", None), ("3", "robbery", None)], "entry_id string, name string, code string")
    none = spark.createDataFrame([], "name string, alias string")
    rows = [("a", "griev. hurt"), ("b", "crim. br. of trust"), ("c", "rob'y"), ("d", "grievous h'rt"), ("e", "gr. hurt")]
    got = {r.record_key: r.entry_id for r in canonical.map_to_list(spark, spark.createDataFrame(rows, "record_key string, value string"), ref, none).collect()}
    assert got == {"a": "1", "b": "2", "c": "3", "d": "1", "e": "1"}
