import random

from graphloom.llm import leakage

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "se", "ti") for b in ("dan", "fer", "gol", "hin", "jus", "pak")]


def text(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((r.doc_id, r.item_id) for r in leakage.leaks(spark, d, i, **kw).collect())


def test_whole_part_changed_and_decoys(spark):
    rnd = random.Random(3)
    items = {k: text(rnd, 60) for k in range(4)}
    filler = lambda n: " ".join(f"x{rnd.randrange(10**6)}" for _ in range(n))
    changed = list(items[1])
    for i in range(5, 60, 9):
        changed[i] = changed[i][:-1] + "zz" if i % 2 else "other"
    halves = filler(30) + " " + " ".join(items[2][:15]) + " " + filler(40) + " " + " ".join(items[2][30:46]) + " " + filler(5)
    docs = [
        (1, filler(50) + "\n" + " ".join(items[0]).upper() + ". " + filler(20)),
        (2, " ".join(changed)),
        (3, halves),
        (4, " ".join(items[3][:14]) + " " + filler(100)),  # a quotation of under two fifths
        (5, " ".join(x for k in range(4) for i in range(0, 60, 6) for x in items[k][i : i + 5])),  # turns of phrase
        (6, "-\n".join([" ".join(items[0])[:200], " ".join(items[0])[200:]])),
        (7, filler(3000) + " ".join(items[0][10:40])),
    ]
    got = run(spark, docs, [(k, " ".join(w)) for k, w in items.items()])
    assert {(1, 0), (2, 1), (3, 2), (6, 0), (7, 0)} <= set(got)
    assert not {g for g in got if g[0] == 4}


def test_a_crowded_bitmap_lets_nothing_through_wrongly(spark, monkeypatch):
    rnd = random.Random(8)
    items = [(k, " ".join(text(rnd, 40))) for k in range(6)]
    docs = [(k, items[k % 6][1]) for k in range(12)] + [(99, " ".join(text(rnd, 400)))] * 2
    whole = run(spark, docs, items)
    monkeypatch.setattr(leakage, "BITMAP", 6)
    assert run(spark, docs, items) == whole == sorted((k, k % 6) for k in range(12))


def test_shingle_hashes_tell_order_and_length_apart():
    h = leakage.shingle_hashes("a b c a b c b a c".split(), 3)
    assert len(h) == 7 and h[0] == h[3] and len(set(h.tolist())) == 6
    assert len(leakage.shingle_hashes(["a"], 3)) == 0 and leakage.shingle_hashes(["a", "b"], 2)[0] != leakage.shingle_hashes(["b", "a"], 2)[0]


def test_a_shingle_told_often_does_not_break_a_chain():
    item = [f"word{i:03d}x" for i in range(48)] + ["again", "and", "again"] * 17
    doc = item[:21] + ["changed"] + item[22:42] + ["more"] * 30 + ["again", "and", "again"] * 17
    found = leakage.chains(seeds(doc, item))
    assert max(c[1] - c[0] for c in found if c[2] < 10) >= 38


def test_places_in_very_long_items():
    item = [f"w{i}" for i in range(40_000)]
    doc = [f"d{i}" for i in range(10)] + item[39_900:]
    assert leakage.align(leakage.Item(item).matches(doc)) == (100, 10, 110, 39_900, 40_000)


def test_nulls_empty_and_short(spark):
    assert run(spark, [(1, None), (2, ""), (None, "a b c d e f g")], [(1, "a b c d e f g"), (2, None), (None, "x"), (3, "")]) == []
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c")], []) == []


def test_alignment_and_slips():
    item = leakage.Item("one two three four five six seven eight".split())
    n, a, b, s, e = leakage.align(item.matches("zero one two threee four five six seven eight nine".split()))
    assert (n, a, b, s, e) == (8, 1, 9, 0, 8)
    assert leakage.near("letter", "lettre") and leakage.near("letter", "leter") and not leakage.near("letter", "ladder") and not leakage.near("one", "on")
    assert leakage.words("The O&#39;Brien  CAFÉ gene-\nrator") == ["the", "obrien", "cafe", "generator"]


def seeds(doc, item):
    at = {}
    for q, s in enumerate(leakage.shingles(item, leakage.SEED)):
        at.setdefault(s, []).append(q)
    return [(p, q) for p, s in enumerate(leakage.shingles(doc, leakage.SEED)) for q in at.get(s, ())]


def count(doc, item):
    return leakage.contained(doc, leakage.Item(item), seeds(doc, item))


def test_a_passage_told_often_hides_no_other():
    item = [f"word{i:03d}x" for i in range(100)]
    other = [f"filler{i:04d}" for i in range(900)]
    far = [w for i in range(6) for w in (*item[:25], *other[i * 140 : (i + 1) * 140])] + item[60:78]
    assert count(far, item) == 43
    close = [w for i in range(6) for w in (*item[:25], *other[i * 40 : (i + 1) * 40])] + item[60:78]
    assert count(close, item) == 43


def test_words_put_in_all_over_the_item():
    item = [f"word{i:03d}x" for i in range(96)]
    doc = [w for i in range(0, 96, 12) for w in (*item[i : i + 12], "an", "aside", "of", "four")]
    assert count(doc, item) == 96
