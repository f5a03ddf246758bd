import random

from graphloom.llm import abuse

BAD = ["You filthy bastard, crawl back into the hole you came from.", "Tell that slut to shut up.", "Strip for me, you dirty whore, I want you naked in my bed."]
GOOD = ["The accused abused the victim in filthy language, which I do not wish to repeat.", "Genital examination reveals no injury; swabs were preserved for semen detection.", "A brindle bitch and her two pups were tied near the gate."]


def at(text, name):
    return abuse.features(text)[abuse.FEATURES.index(name)]


def test_obfuscation_is_undone():
    for w in ("b*****d", "b@st@rd", "baaaastard", "b a s t a r d", "bas​tard"):
        assert at(f"he is a {w} indeed", "insult") > 0, w
        assert at(f"he is a {w} indeed", "obfuscated") > 0, w
    assert at("exhibit 12 of 2019, item 4", "obfuscated") == 0


def test_features_of_nothing():
    assert abuse.features(None) == abuse.features("") == abuse.features(" \n") == [0.0] * len(abuse.FEATURES)
    assert len(abuse.features("a" * 200_000)) == len(abuse.FEATURES)


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rnd.random() < 0.4
        rows.append((i, " ".join([rnd.choice(GOOD) for _ in range(3)] + ([rnd.choice(BAD)] if bad else [])), "s1" if i % 2 else None, int(bad)))
    return rows


def test_held_out_accuracy_with_wrong_labels(spark):
    rows = corpus(900, 2)
    rnd = random.Random(9)
    docs = spark.createDataFrame([(*r[:3], 0.1) for r in rows], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(r[0], r[3] if rnd.random() < 0.93 else 1 - r[3]) for r in rows[:500]] + [(1, None), (10**9, 1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in abuse.score_documents(spark, docs, labels).collect()}
    assert len(got) == 900 and all(0 <= s <= 1 for s in got.values())
    held = rows[500:]
    assert sum((got[r[0]] >= 0.5) == bool(r[3]) for r in held) >= 0.98 * len(held)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "x", None), (2, None, "s"), (None, "y", "s")], "doc_id bigint, text string, source string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert sorted((r.doc_id, r.score) for r in abuse.score_documents(spark, docs, none).collect()) == [(1, 0.0), (2, 0.0)]
    assert abuse.score_documents(spark, docs.limit(0), none).collect() == []


def test_majority(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (2, 1), (3, None), (None, 1), (4, 7)], "doc_id bigint, toxic int")
    assert [(r.doc_id, r.y) for r in abuse.majority(labels, "doc_id", "toxic").collect()] == [(1, 1.0)]


def test_few_labels_still_tell_documents_apart(spark):
    rows = corpus(400, 5)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.score for r in abuse.score_documents(spark, docs, spark.createDataFrame([(r[0], r[3]) for r in rows[:40]], "doc_id bigint, toxic int")).collect()}
    assert sum((got[r[0]] >= 0.5) == bool(r[3]) for r in rows) >= 0.97 * len(rows)


def test_attacks_of_other_wording():
    for t in ("You people are subhuman.", "I will slit your throat.", "I hope they all burn.", "Drive them all out.", "Send me a nude.", "Ich werde dich umbringen.", "Te voy a matar.", "Ils sont des parasites."):
        assert at(t, "attack") > 0, t
    for t in ("The deceased was found hanging.", "He cut the rope with a knife.", "The accused hit the victim on the head."):
        assert at(t, "attack") == 0, t
    assert at("What is this?! Really?!", "punctuation") > 0


def test_isotonic_pools_violators():
    import numpy as np

    x, p = abuse.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert list(x) == [1.0, 2.0, 3.0, 4.0] and list(p) == [0.0, 0.5, 0.5, 1.0]
