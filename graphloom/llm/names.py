"""Variant spellings of people's and organisations' names: merge and rematch.

A name is cut into parts; every distinct part is led back to its usual spelling
(``spelling_clusters``), and how often a spelling stands where surnames stand tells
surnames from given names. Records that say the same make one profile. Profiles meet in
blocks, by keys of three kinds, the strongest evidence first: a telephone; a surname with a
family of given names (a name and its short forms); a surname with an initial. Two that match
are merged: the merged profile has the spellings, surnames, initials, ages and telephones of
both, re-enters the blocks of all its keys, and matching starts again with the blocks in
which something has changed, until nothing merges. So a record may be linked through a
surname or telephone that only a merged profile has.

Each round is a plan over DataFrames: keys are exploded, blocks are resolved beside each other,
the merges of a round are disjoint (a profile that merges in several blocks does so in the least
of them, the others are tried again next round), and profiles are united by one
aggregation. No task sees more than the profiles of one surname and given name, or initial.

Short forms of given names are those listed (``NICKNAMES``) and those learnt: two names
written with one surname and one telephone, of no different sex or age, often enough (``LEARNT``).

Evidence against: different telephones, different sexes, ages more than two years apart,
different given or middle names; for organisations another trade. A profile that fits
several which contradict each other stays with the clearly largest of them or alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Scratch
from .components import connected_components
from .spelling import fold, letters, plain, spelling_clusters

#: Largest difference between two written ages of one person.
AGES = 2
#: Telephones under which two given names must occur together to count as one name's forms, and their share of those of the rarer name; telephones with more names are left out.
LEARNT, LEARNT_SHARE, LEARNT_NAMES = 3, 0.2, 8

# Short and pet forms of given names.
NICKNAMES = {
    "quentin": "quint quin", "yolanda": "yoli yola", "zachary": "zack zach zac", "katharina": "kathi kati katha", "ursula": "ushi uschi ursel", "wilhelmina": "mina minnie willa", "ophelia": "phelia", "venkatesh": "venky venkat",
    "ignacio": "nacho iggy", "zubaida": "zubi", "krishnan": "kittu krish", "gabriela": "gabi gaby", "nathaniel": "nate nat nathan", "jacqueline": "jackie jacqui", "isabella": "izzy bella isa", "oliver": "ollie olly",
    "henrietta": "hettie etta", "samantha": "sammie sam", "deborah": "debbie deb", "sebastian": "bastian seb", "leonardo": "leo", "dinesh": "dinu", "penelope": "penny nell", "fatima": "fati", "harold": "hal harry",
    "balakrishna": "balu bala", "frederick": "fred freddie", "umashankar": "uma", "jonathan": "jonny jon", "gopalan": "gopi gopal", "gerald": "gerry jerry", "philippa": "pippa pip", "theresa": "terry tess tessa", "theodore": "teddy ted theo",
    "victoria": "vicky tori vic", "henry": "hank harry hal", "nicholas": "nick colin nicky", "barbara": "babs barb", "lawrence": "larry laurie", "amelia": "millie amy", "william": "bill willy will billy", "josephine": "josie jo", "albert": "bertie bert al",
    "elizabeth": "betty lizzie liz beth eliza", "lakshmi": "laxmi lachu", "benjamin": "benji ben", "francisco": "paco pancho cisco", "abhishek": "abhi", "dorothy": "dolly dot dottie", "catherine": "kitty cathy kate", "edward": "ned eddie ted ed",
    "patricia": "patsy trish pat", "subramanian": "subbu mani subra", "charles": "chuck charlie", "richard": "rick dick rich", "robert": "bob robbie rob bobby", "michael": "mick mike mikey", "alexander": "alec sandy alex", "rajendra": "rajen raju raj",
    "christopher": "chris kit", "margaret": "maggie peggy meg", "mohammed": "mohd md mohammad muhammad", "eleanor": "ellie nell nora", "anthony": "tony", "andrew": "andy drew", "joseph": "joe", "james": "jim jimmy", "john": "jack johnny", "thomas": "tom tommy", "susan": "sue susie",
}
# Titles and roles written before or after names.
TITLES = frozenset("mr mrs ms miss dr prof adv advocate insp inspector sgt sergeant justice judge shri smt sri km const constable col maj capt hon si asi pi late".split())
NAMELESS = frozenset("unknown unidentified unnamed person persons victim male female two three several man woman men women none nil na n a not known anonymous accused suspect child body someone names withheld".split())
# Legal forms and trades of organisations, with short forms.
LEGAL = frozenset("ltd limited pvt private co company corp corporation inc llp plc and sons bros p the ms".split())
TRADES = {
    "textiles": "textiles textile tex txtl", "pharmaceuticals": "pharmaceuticals pharmaceutical pharma", "industries": "industries industry inds ind", "freight": "freight frt", "construction": "construction constructions constr const", "transport": "transport tpt transp trans",
    "engineering": "engineering engg engr eng", "finance": "finance fin financial", "jewellers": "jewellers jeweller jwlrs jewels", "chemicals": "chemicals chemical chem", "security": "security sec securities", "services": "services service svcs", "electronics": "electronics electronic elec",
    "traders": "traders trading trdrs", "motors": "motors mtrs", "agency": "agency agcy agencies", "stores": "stores strs", "bank": "bank bk", "hospital": "hospital hosp", "logistics": "logistics logs", "foods": "foods food", "enterprises": "enterprises ent entp", "builders": "builders bldrs", "steel": "steel stl", "cement": "cement cem", "travels": "travels trvls", "hotels": "hotels hotel htl", "mills": "mills", "insurance": "insurance ins",
}
_TRADE = {a: k for k, v in TRADES.items() for a in v.split()}
_NICK = {}
for _full, _short in NICKNAMES.items():
    for _w in (_full, *_short.split()):
        _NICK.setdefault(_w, set()).add(_full)
KNOWN_GIVEN = sorted(_NICK)
FULL_NAMES = sorted(NICKNAMES)

_NOTE = re.compile(r"[(\[][^)\]]*[)\]]")
_ALIAS = re.compile(r"\s(?:@|alias|urf|a\.?\s?k\.?\s?a\.?)\s", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+(?:'[a-z]+)?")


def _words(text: str) -> list[str]:
    return [letters(w) if re.search("[a-z]", w) else w for w in _WORD.findall(text.replace("'", ""))]


def parse_name(name: str | None) -> dict | None:
    """{'org': bool, 'parts': [(word, place)], 'trades': [...]}; None where nobody is named.

    ``place``: 's' surname and 'g' given name by a comma, 'f' first, 'l' last, 'm' between; initials too;
    of an alias 'y' the last of several words, 'x' any other.
    """
    if not name:
        return None
    text = " ".join(plain(name).split())
    compact = re.sub(r"\(\s*p\s*\)", " p ", text)
    words = _words(re.sub(r"[.&/]", lambda m: " " if m[0] != "/" else "", compact.replace("m/s", "ms ")))
    trades = sorted({_TRADE[w] for w in words if w in _TRADE})
    formal = [w for w in words if w in LEGAL and w not in ("p", "and", "the", "ms")]
    lead = [w for w in words if w not in LEGAL and w not in _TRADE and len(w) > 2]
    if lead and (formal or trades) and (trades or text.startswith(("m/s", "the ")) or len(lead) == 1):
        return {"org": True, "parts": [(lead[0], "s")], "trades": trades}
    text = _NOTE.sub(" ", text)
    main, *also = _ALIAS.split(f" {text} ")
    halves = [[w for w in _words(h) if w not in TITLES] for h in main.split(",")]
    halves = [h for h in halves if h]
    alias = []
    for a in also:
        own = [w for w in _words(a) if w not in TITLES]
        alias += [(w, "y" if len(own) > 1 and i == len(own) - 1 else "x") for i, w in enumerate(own)]
    flat = [w for h in halves for w in h]
    if not flat or all(w in NAMELESS or w.isdigit() for w in flat):
        return None
    if len(halves) > 1:
        parts = [(w, "s") for w in halves[0]] + [(w, "g") for h in halves[1:] for w in h]
    else:
        parts = [(w, "f" if i == 0 else "l" if i == len(flat) - 1 else "m") for i, w in enumerate(flat)]
    return {"org": False, "parts": parts + alias, "trades": []}


PARSED = "record_key string, org boolean, words array<string>, alts array<string>, places array<string>, trades array<string>, sex string, age int, phone string"


def _sex(v: str | None) -> str | None:
    return v.strip()[:1].lower() if v and v.strip()[:1].lower() in ("m", "f") else None


def _phone(v: str | None) -> str | None:
    d = re.sub(r"\D", "", v or "")
    return d[-10:] if len(d) >= 7 else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())
    schema = pa.schema([("record_key", pa.string()), ("org", pa.bool_()), ("words", texts), ("alts", texts), ("places", texts), ("trades", texts), ("sex", pa.string()), ("age", pa.int32()), ("phone", pa.string())])
    for batch in batches:
        rows = []
        for k, name, age, sex, phone in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if p := parse_name(name):
                words = [w for w, _ in p["parts"]]
                rows.append({"record_key": k, "org": p["org"], "words": words, "alts": [fold(w) for w in words], "places": [x for _, x in p["parts"]], "trades": p["trades"], "sex": _sex(sex), "age": age, "phone": _phone(phone)})
        yield pa.RecordBatch.from_pylist(rows, schema)


class Profile:
    """What is known of one person: the union of the records merged into it."""

    __slots__ = ("surnames", "full", "short", "middle", "middle_short", "sex", "low", "high", "phones", "keys", "size")

    def __init__(self, surnames=(), full=(), short=(), middle=(), middle_short=(), sex=None, low=None, high=None, phones=(), key=None, size=1) -> None:
        self.surnames, self.full, self.short, self.middle, self.middle_short = set(surnames), set(full), set(short), set(middle), set(middle_short)
        self.sex, self.low, self.high, self.phones, self.keys, self.size = sex, low, high, set(phones), [key], size

    def merge(self, o: "Profile") -> None:
        self.surnames |= o.surnames
        self.full |= o.full
        self.short |= o.short
        self.middle |= o.middle
        self.middle_short |= o.middle_short
        self.sex = self.sex or o.sex
        if o.low is not None:
            self.low = o.low if self.low is None else min(self.low, o.low)
            self.high = o.high if self.high is None else max(self.high, o.high)
        self.phones |= o.phones
        self.keys += o.keys
        self.size += o.size


def turned_round(p: Profile, q: Profile) -> bool:
    """What is the surname of one is the given name of the other, both ways."""
    return bool(p.surnames & q.full and q.surnames & p.full)


def contradict(p: Profile, q: Profile) -> bool:
    """Something known of both can't be true of one person (telephones in common outweigh ages)."""
    if p.sex and q.sex and p.sex != q.sex:
        return True
    shared = bool(p.phones & q.phones)
    if p.phones and q.phones and not shared:
        return True
    if not shared and p.low is not None and q.low is not None and max(p.high, q.high) - min(p.low, q.low) > AGES:
        return True
    if shared and turned_round(p, q):
        return False
    if p.full and q.full and not p.full & q.full:
        return True
    if not (p.full and q.full) and p.short and q.short and not p.short & q.short:
        return True
    if p.middle and q.middle and not p.middle & q.middle:
        return True
    if not (p.middle and q.middle) and p.middle_short and q.middle_short and not p.middle_short & q.middle_short:
        return True
    return False


#: Kinds of evidence, the strongest first.
PHONE, GIVEN_AGE, GIVEN_MIDDLE, GIVEN, INITIAL_AGE, INITIAL_MIDDLE, INITIAL = range(7)


def evidence(p: Profile, q: Profile) -> int | None:
    """The strongest evidence that two profiles are one person, None if there is none or something is against it."""
    if contradict(p, q):
        return None
    if p.phones & q.phones:  # a telephone links records of one surname, of one given name, or with both turned round
        return PHONE if p.surnames & q.surnames or p.full & q.full or turned_round(p, q) else None
    if not p.surnames & q.surnames:
        return None
    aged = p.low is not None and q.low is not None
    middle = bool(p.middle_short & q.middle_short)
    if p.full and q.full:
        return GIVEN_AGE if aged else GIVEN_MIDDLE if middle else GIVEN
    if p.short & q.short:
        return INITIAL_AGE if aged else INITIAL_MIDDLE if middle else INITIAL
    return None


#: Levels of evidence looked for in blocks of each kind.
LEVELS = {"p": (PHONE,), "g": (GIVEN_AGE, GIVEN_MIDDLE, GIVEN), "i": (INITIAL_AGE, INITIAL_MIDDLE, INITIAL)}


def keys(p: Profile) -> Iterator[tuple]:
    """What a profile can meet others by."""
    yield from (("p", x) for x in p.phones)
    yield from (("g", x) for x in p.full)
    yield from (("i", x) for x in p.short)


def resolve_block(profiles: list[Profile], levels: tuple[int, ...] = tuple(range(7))) -> list[Profile]:
    """Merge and rematch: the profiles left when no two of them can be merged any more on evidence of ``levels``."""
    alive: dict[int, Profile] = dict(enumerate(profiles))

    # two profiles with telephones meet by telephone only, so the other keys of such a one lead to those without;
    # two with full given names don't meet by initials, so the initials of such a one lead to those without
    index: dict[tuple, set[int]] = defaultdict(set)
    changed: dict[tuple, int] = {}
    looked: dict[tuple[int, int], int] = {}
    clock = 0

    def places(i: int) -> Iterator[tuple]:
        p = alive[i]
        for k in keys(p):
            for bare in (False, True)[: 1 + (not p.phones)]:
                for initial in (False, True)[: 1 + (not p.full)]:
                    yield (*k, bare, initial)

    def enter(i: int) -> None:
        for k in places(i):
            index[k].add(i)
            changed[k] = clock

    def leave(i: int) -> None:
        for k in places(i):
            index[k].discard(i)
            changed[k] = clock

    for i in alive:
        enter(i)

    def candidates(i: int, level: int) -> list[int]:
        p = alive[i]
        names = p.phones if level == PHONE else p.full if level <= GIVEN else p.short
        kind = "p" if level == PHONE else "g" if level <= GIVEN else "i"
        at = [(kind, x, bool(p.phones) and level > PHONE, bool(p.full) and level > GIVEN) for x in names]
        # nothing it could meet has changed since it last found no one
        if (i, level) in looked and all(changed.get(k, 0) <= looked[i, level] for k in at):
            return []
        seen = set().union(*(index.get(k, ()) for k in at)) if at else set()
        seen.discard(i)
        return sorted(j for j in seen if evidence(p, alive[j]) == level)

    def choose(found: list[int]) -> int | None:
        """One of the candidates if they don't contradict each other, else the clearly largest."""
        if len(found) > 1 and any(contradict(alive[a], alive[b]) for n, a in enumerate(found) for b in found[n + 1 :]):
            by_size = sorted(found, key=lambda j: (-alive[j].size, j))
            return by_size[0] if alive[by_size[0]].size >= 2 * alive[by_size[1]].size else None
        return found[0]

    def merge(i: int, j: int) -> int:
        nonlocal clock
        i, j = min(i, j), max(i, j)
        clock += 1
        leave(i)
        leave(j)
        alive[i].merge(alive.pop(j))
        enter(i)
        for level in levels:
            looked.pop((i, level), None)
        return i

    at = 0
    while at < len(levels):
        level, merged = levels[at], False
        todo = sorted(alive)
        while todo:
            nxt = []
            for i in todo:
                if i not in alive:
                    continue
                found = candidates(i, level)
                if found and (j := choose(found) if level > PHONE else found[0]) is not None:
                    nxt.append(merge(i, j))
                    merged = True
                else:
                    looked[i, level] = clock
            todo = sorted(set(nxt))
        at = 0 if merged and at else at + 1
    return [alive[i] for i in sorted(alive)]


PROFILE = "pid bigint, surnames array<string>, full array<string>, short array<string>, middle array<string>, middle_short array<string>, sex string, low int, high int, phones array<string>, size bigint"
_COLUMNS = [c.split()[0] for c in PROFILE.split(", ")]


def _resolve(levels: tuple[int, ...]):
    """Profiles sorted by block -> (block, leader, pid) of every profile that merges in it, leaders included."""

    def merged(block: int, held: list[Profile]) -> Iterator[tuple[int, int, int]]:
        if len(held) > 1:
            for p in resolve_block(held, levels):
                if len(p.keys) > 1:
                    leader = min(p.keys)
                    yield from ((block, leader, k) for k in p.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for b, pid, surnames, full, short, middle, middle_short, sex, low, high, phones, size in zip(*(batch.column(c).to_pylist() for c in range(12))):
                if b != now and held:
                    out += merged(now, held)
                    held = []
                now = b
                held.append(Profile(surnames, full, short, middle, middle_short, sex, low, high, phones, pid, size))
            if len(out) > 50_000:
                yield rows(out)
                out = []
        out += merged(now, held)
        yield rows(out)

    def rows(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["block", "leader", "pid"])

    return run


def _listed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, f) for w, fs in _NICK.items() for f in sorted(fs)], "word string, formal string")


def short_forms(spark: SparkSession, given: DataFrame) -> DataFrame:
    """(word, formal): the full names a given name may stand for besides itself, listed and learnt.

    ``given`` has surname, phone, word, sex, age of every record with all of surname, telephone and given name.
    """
    few = given.select("surname", "phone", "word").distinct().groupBy("surname", "phone").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, LEARNT_NAMES)).select("surname", "phone")
    total = given.select("surname", "phone", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    said = given.join(few, ["surname", "phone"], "left_semi").distinct()
    other = said.select("surname", "phone", F.col("word").alias("other"), F.col("sex").alias("sex2"), F.col("age").alias("age2"))
    fits = (F.col("word") < F.col("other")) & (F.col("sex").isNull() | F.col("sex2").isNull() | (F.col("sex") == F.col("sex2"))) & (F.col("age").isNull() | F.col("age2").isNull() | (F.abs(F.col("age") - F.col("age2")) <= AGES))
    both = said.join(other, ["surname", "phone"]).where(fits).select("surname", "phone", "word", "other").distinct().groupBy("word", "other").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= LEARNT)
    both = both.join(total.withColumnRenamed("n", "n1"), "word").join(total.select(F.col("word").alias("other"), F.col("n").alias("n2")), "other").where(F.col("together") >= LEARNT_SHARE * F.least("n1", "n2"))
    longer = F.length("word") >= F.length("other")
    learnt = both.select(F.when(longer, F.col("other")).otherwise(F.col("word")).alias("word"), F.when(longer, F.col("word")).otherwise(F.col("other")).alias("formal"))
    return _listed(spark).unionByName(learnt).where("word <> formal").distinct()


def _rounds(spark: SparkSession, scratch: Scratch, profiles: DataFrame, family: DataFrame) -> DataFrame:
    """(pid, leader): every first profile's last one. ``profiles``: ``PROFILE``; ``family``: (name, family) where they differ."""
    pairs = lambda df, items: df.select("pid", F.explode("surnames").alias("s"), items).select("pid", "s", F.explode("x").alias("x"))
    surname = lambda kind, c: F.xxhash64(F.lit(kind), F.col("s"), c)

    def blocks(df: DataFrame, kind: str) -> DataFrame:
        """(pid, block) of all keys of one kind."""
        if kind == "p":
            return df.select("pid", F.explode("phones").alias("x")).select("pid", F.xxhash64(F.lit(kind), "x").alias("block"))
        if kind == "i":
            return pairs(df, F.col("short").alias("x")).select("pid", surname(kind, F.col("x")).alias("block")).distinct()
        named = pairs(df, F.col("full").alias("x")).join(family.withColumnRenamed("name", "x"), "x", "left")
        return named.select("pid", surname(kind, F.coalesce("family", "x")).alias("block")).distinct()

    current, path = scratch.write(profiles)
    ids, ids_path = scratch.write(profiles.select("pid", F.col("pid").alias("leader")))
    # the leaders of every round's merges: what has changed since a kind of block was last looked at
    changed: list[DataFrame] = []
    seen, kind = {"p": -1, "g": -1, "i": -1}, "p"
    tasks = 4 * spark.sparkContext.defaultParallelism
    after = {"p": "g", "g": "i", "i": None}
    while kind is not None:
        placed = blocks(current, kind)
        if seen[kind] >= 0:
            new = reduce(DataFrame.unionByName, changed[seen[kind] :]) if changed[seen[kind] :] else None
            if new is None:
                kind = after[kind]
                continue
            fresh = blocks(current.join(new.distinct(), "pid", "left_semi"), kind).select("block").distinct()
            placed = placed.join(fresh, "block", "left_semi")
        crowd = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block")
        members = placed.join(crowd, "block", "left_semi").join(current.select(*_COLUMNS), "pid").select("block", *_COLUMNS)
        found, found_path = scratch.write(members.repartition(tasks, "block").sortWithinPartitions("block", "pid").mapInArrow(_resolve(LEVELS[kind]), "block bigint, leader bigint, pid bigint"))
        seen[kind] = len(changed)
        if found.isEmpty():
            scratch.drop(found_path)
            kind = after[kind]
            continue
        # a profile that merges in several blocks does so in the least of them; other merges of such a one wait
        first = found.groupBy("pid").agg(F.min("block").alias("least"))
        good = found.join(first, "pid").groupBy("block", "leader").agg(F.min((F.col("block") == F.col("least")).cast("int")).alias("ok")).where("ok = 1").select("block", "leader")
        moved, moved_path = scratch.write(found.join(good, ["block", "leader"], "left_semi").select("pid", "leader"))
        keyed = current.join(moved, "pid", "left").withColumn("pid", F.coalesce("leader", "pid"))
        union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
        nxt = keyed.groupBy("pid").agg(*[union(c) for c in ("surnames", "full", "short", "middle", "middle_short")], F.max("sex").alias("sex"), F.min("low").alias("low"), F.max("high").alias("high"), union("phones"), F.sum("size").alias("size"))
        nxt, nxt_path = scratch.write(nxt)
        up = moved.select(F.col("pid").alias("leader"), F.col("leader").alias("now"))
        nxt_ids, nxt_ids_path = scratch.write(ids.join(up, "leader", "left").select("pid", F.coalesce("now", "leader").alias("leader")))
        changed.append(moved.select(F.col("leader").alias("pid")))
        for old in (path, ids_path, found_path):
            scratch.drop(old)
        current, path, ids, ids_path = nxt, nxt_path, nxt_ids, nxt_ids_path
        kind = "p"
    return ids


def name_groups(spark: SparkSession, records: DataFrame) -> DataFrame:
    """(record_key, group_id): one group for each person or organisation.

    ``records`` has ``record_key, name, age, gender, phone``; a key is taken once. Null keys
    and records that name nobody are in no group; ages, sexes and telephones may be null. A
    record like no other is a group of its own.
    """
    scratch = Scratch(spark, "names")
    keyed = records.where("record_key is not null and name is not null").dropDuplicates(["record_key"]).select("record_key", "name", F.col("age").cast("int"), "gender", "phone")
    parsed, _ = scratch.write(keyed.mapInArrow(_parse, PARSED))

    # usual spellings, and how often each stands as a surname
    each = parsed.select("record_key", "org", F.posexplode(F.arrays_zip("words", "alts", "places")).alias("i", "w")).select("record_key", "org", "i", F.col("w.words").alias("word"), F.col("w.alts").alias("alt"), F.col("w.places").alias("place"))
    block = F.when(F.col("org"), "o").otherwise("p")
    own = ~F.col("place").isin("x", "y")
    counts = each.where(F.length("word") > 1).groupBy(block.alias("block"), "word", "alt").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("place").isin("s", "l")).alias("last"), F.count_if(own).alias("m"))
    counts, _ = scratch.write(counts.withColumn("keep", F.col("word").isin(KNOWN_GIVEN)))
    canon, _ = scratch.write(spelling_clusters(counts))
    usual = canon.join(counts.select("block", "word", "m", "last"), ["block", "word"])
    role = usual.groupBy("block", "canon").agg(F.coalesce(F.try_divide(F.sum("last"), F.sum("m")), F.lit(0.0)).alias("surname"))
    usual = canon.join(role, ["block", "canon"]).select("block", "word", "canon", F.when(F.col("canon").isin(KNOWN_GIVEN), F.least("surname", F.lit(0.3))).otherwise(F.col("surname")).alias("surname"))
    named = each.withColumn("block", block).join(usual, ["block", "word"], "left")
    word = F.struct("i", F.coalesce("canon", "word").alias("canon"), F.col("word").alias("raw"), (F.coalesce("surname", F.lit(-1.0)) + F.when(F.col("place") == "s", 0.35).otherwise(0.0)).alias("surname"), "place")
    gathered = named.groupBy("record_key").agg(F.array_sort(F.collect_list(word)).alias("all"))  # the few words of one name
    gathered = gathered.withColumn("ws", F.filter("all", lambda x: ~x["place"].isin("x", "y"))).withColumn("as", F.filter("all", lambda x: x["place"].isin("x", "y")))
    best = F.aggregate("ws", F.struct(F.lit(-1).alias("i"), F.lit(-0.5).alias("s"), F.lit(None).cast("string").alias("canon")), lambda a, x: F.when((F.length(x["raw"]) > 1) & (x["surname"] >= a["s"]), F.struct(x["i"].alias("i"), x["surname"].alias("s"), x["canon"].alias("canon"))).otherwise(a))
    split_up = gathered.withColumn("b", best).where("b.canon is not null").withColumn("rest", F.filter("ws", lambda x: x["i"] != F.col("b.i")))
    behind = lambda x: (x["place"] == "y") & (x["surname"] >= 0.5)
    split_up = split_up.select(
        "record_key", F.col("b.canon").alias("surname"), F.transform(F.filter("as", behind), lambda x: x["canon"]).alias("more"), F.transform(F.filter("as", lambda x: ~behind(x) & (F.length(x["raw"]) > 1)), lambda x: x["canon"]).alias("alias"),
        F.transform("rest", lambda x: x["canon"]).alias("words"), F.transform("rest", lambda x: F.substring(x["raw"], 1, 1)).alias("raw"),
    )
    rows, _ = scratch.write(split_up.join(parsed.select("record_key", "org", "trades", "sex", "age", "phone"), "record_key"))

    # organisations: the leading word and the trade; no trade is the only one there is
    orgs = rows.where("org").select("record_key", F.col("surname").alias("lead"), F.array_join(F.array_sort("trades"), " ").alias("trade"))
    known = orgs.groupBy("lead").agg(F.count_distinct(F.when(F.col("trade") != "", F.col("trade"))).alias("n"), F.max("trade").alias("only"))
    orgs = orgs.join(known, "lead").select("record_key", F.concat_ws("|", F.lit("o"), "lead", F.when((F.col("trade") == "") & (F.col("n") == 1), F.col("only")).otherwise(F.col("trade"))).alias("group_id"))

    # people: what is said alike is one profile from the start
    people = rows.where("not org").drop("org", "trades")
    said = ["surname", "more", "words", "raw", "alias", "sex", "age", "phone"]
    people = people.withColumn("pid", F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in said]))
    people, _ = scratch.write(people)
    first = F.col("words")[0]
    given = people.where("size(words) > 0 and phone is not null").select("surname", "phone", first.alias("word"), "sex", "age").where("length(word) > 1")
    forms, _ = scratch.write(short_forms(spark, given))
    formals = forms.groupBy("word").agg(F.collect_set("formal").alias("formals"))  # the few full names of a short form
    family = connected_components(spark, forms.select(F.col("word").alias("a"), F.col("formal").alias("b"))).select(F.col("record_id").alias("name"), F.col("group_id").alias("family"))
    family, _ = scratch.write(family)
    profiles = people.groupBy("pid").agg(F.count(F.lit(1)).alias("size"), *[F.min(c).alias(c) for c in said])
    profiles = profiles.withColumn("word", F.when(F.size("words") > 0, first)).join(formals, "word", "left")
    none = F.array().cast("array<string>")
    whole = F.when(F.length("word") > 1, F.coalesce(F.when(F.size("formals") > 0, F.when(F.col("word").isin(FULL_NAMES) | ~F.col("word").isin(KNOWN_GIVEN), F.array_union("formals", F.array("word"))).otherwise(F.col("formals"))), F.array("word"))).otherwise(none)
    head = lambda c: F.substring(c, 1, 1)
    nick = profiles.select("pid", F.explode("alias").alias("word")).join(formals, "word", "left").groupBy("pid").agg(F.flatten(F.collect_set(F.coalesce("formals", F.array("word")))).alias("also"), F.collect_set(head("word")).alias("also_short"))
    profiles = profiles.withColumn("full", whole).join(nick, "pid", "left")
    tail, tail_raw = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("raw", 2, F.greatest(F.size("raw") - 1, F.lit(0)))
    have = lambda c: F.coalesce(F.col(c), none)
    profiles = profiles.select(
        "pid", F.array_union(F.array("surname"), "more").alias("surnames"), F.array_union("full", have("also")).alias("full"),
        F.array_distinct(F.filter(F.concat(F.array(head("word")), F.slice("raw", 1, 1), F.transform("full", head), have("also_short")), lambda x: x.isNotNull())).alias("short"),
        F.array_distinct(F.filter(tail, lambda x: F.length(x) > 1)).alias("middle"), F.array_distinct(F.concat(F.transform(tail, head), tail_raw)).alias("middle_short"),
        "sex", F.col("age").alias("low"), F.col("age").alias("high"), F.array_compact(F.array("phone")).alias("phones"), "size",
    )
    ids = _rounds(spark, scratch, profiles, family)
    grouped = people.select("record_key", "pid").join(ids, "pid").select("record_key", F.col("leader").cast("string").alias("group_id"))
    return grouped.unionByName(orgs)


def link_names(spark: SparkSession, records: DataFrame) -> DataFrame:
    """(record_key_a, record_key_b), the smaller first: all pairs of records that mean the same person or organisation.

    See ``name_groups`` for nulls and the like. The pairs of a group are as many as asked for, the square of its size.
    """
    at, _ = Scratch(spark, "names").write(name_groups(spark, records))
    other = at.select(F.col("record_key").alias("record_key_b"), "group_id")
    return at.withColumnRenamed("record_key", "record_key_a").join(other, "group_id").where("record_key_a < record_key_b").select("record_key_a", "record_key_b")
