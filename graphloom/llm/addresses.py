"""Address records that denote the same place, through a gazetteer built from them.

1. Every address is cut into its parts: number, unit, street with its kind, locality,
   town words, postal code.
2. The gazetteer: a town is what most addresses of a postal district call it, or, where
   addresses without a code name a place no district is called by, that place itself; words that
   stand in many districts are regions. Locality and street spellings are clustered within
   their town; each (town, locality, street, kind) with support gets a street identifier and
   the number of addresses it was seen with.
3. Each way of writing (street, kind, locality, town words, district; however many records share
   it) is resolved by a beam search over the gazetteer: hypotheses of towns, then of streets in
   them, then of kinds and localities, scored, and cut to the best ``BEAM`` after every step.
   A town that is named but hardly knows the street can lose to the district's own.
4. Addresses are joined on street identifier, number and unit.

Parts are found row by row, gazetteer and resolution are joins on towns and spellings;
nothing is broadcast or collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Scratch
from .spelling import fold, letters, plain, spelling_clusters

#: Hypotheses kept a step of the beam search.
BEAM = 3

# Kinds of streets and what they are written as.
KINDS = {
    "street": "street str st strt", "road": "road rd raod", "lane": "lane ln lne la", "avenue": "avenue ave av aven avn", "boulevard": "boulevard blvd bvd boul blv",
    "square": "square sq sqr", "terrace": "terrace terr tce ter", "crescent": "crescent cres cr crs crescnt", "court": "court ct crt", "drive": "drive dr drv", "close": "close cl", "place": "place pl",
    "highway": "highway hwy", "alley": "alley aly", "row": "row", "path": "path", "way": "way", "parade": "parade pde", "marg": "marg", 
}
# Second words of locality names and their short forms.
AREAS = {"nagar": "nagar ngr", "colony": "colony col clny", "block": "block blk", "extension": "extension ext extn", "sector": "sector sec", "enclave": "enclave encl", "vihar": "vihar", "layout": "layout", "park": "park", "township": "township"}
UNITS = ("apartment", "apt", "apartmnt", "flat", "flt", "unit", "suite", "ste", "f", "room", "rm")
# Short forms within names of towns.
TOWN_WORDS = {"fls": "falls", "up": "upper", "jn": "junction", "jct": "junction", "pt": "port", "n": "new", "o": "old", "st": "saint", "ght": "ghat"}

NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
_NUMBER = re.compile(rf"\b(?:{'|'.join(NUMBERS)})\b")

_KIND = {a: k for k, v in KINDS.items() for a in v.split()}
_AREA = {a: k for k, v in AREAS.items() for a in v.split()}
_PIN = re.compile(r"(?:\bpin(?:code)?\b[\s.:\-]*)?(?<!\d)(\d{3})(\d{3})(?!\d)")
_PIN_APART = re.compile(r"(?:\bpin(?:code)?\b[\s.:\-]*)?(?<!\d)(\d{3})\s(\d{3})(?!\d)(?!\s\d{3}(?!\d))")
_LEAD = re.compile(r"^\s*(?:(?:near|behind|opp\.?|opposite|next to|beside|adjacent to)\s[^,\d]*,|residence (?:at|of)\s|c/o\s[^,\d]*,|at\s)\s*")
_UNIT = re.compile(r"(?<![a-z])(?:apartment|apartmnt|apt|flat|flt|unit|suite|ste|room|rm)\.?\s*(?:no\.?\s*)?#?\s*(\d+\s?[a-z]?|[a-z]\s?\d*)(?![a-z0-9])|(?<![a-z0-9])f\s?-\s?(\d+[a-z]?)(?![a-z0-9])")
_HOUSE = re.compile(r"(?:(?<![a-z])(?:house(?:\s*no)?|h\.?\s?no|door\s*no|plot(?:\s*no)?|no|number)\.?\s*|#\s*)(\d+\s?[a-z]?)(?![a-z0-9])")
_BARE = re.compile(r"(?<![a-z0-9#/\-])(\d{1,4}[a-z]?)(?![a-z0-9])")


def _slip(a: str, b: str) -> bool:
    """One edit or swap of neighbours apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


def _known(word: str, table: dict[str, str]) -> str | None:
    if word in table:
        return table[word]
    if len(word) >= 4:
        for full in dict.fromkeys(table.values()):
            if len(full) >= 5 and _slip(word, full):
                return full
    return None


def parts(text: str | None) -> dict | None:
    """number, unit, street, kind, area, pin, named places and their words of one address; None without a street and number."""
    if not text:
        return None
    t = " ".join(plain(text).split())
    t = re.sub(r"(?<=[a-z])[01]+(?=[a-z])", lambda m: letters(m[0]), t)
    t = _NUMBER.sub(lambda m: str(NUMBERS.index(m[0]) + 1), _LEAD.sub("", t))
    pin = None
    if m := _PIN.search(t) or _PIN_APART.search(t):
        pin, t = m[1] + m[2], t[: m.start()] + " , " + t[m.end() :]
    unit = ""
    if m := _UNIT.search(t):
        unit = re.sub(r"\s", "", m[1] or m[2])
        t = t[: m.start()] + " , " + t[m.end() :]
    number = None
    if m := _HOUSE.search(t) or _BARE.search(t):
        number = re.sub(r"\s", "", m[1])
        t = t[: m.start()] + " , " + t[m.end() :]
    if number is None:
        return None
    phrases = [re.findall(r"[a-z]+", p.replace("'", "")) for p in re.split(r"[,;/\-]", t)]
    street = kind = area = None
    places, named = [], []
    for words in phrases:
        i = 0
        loose: list[str] = []
        while i < len(words):
            nxt = words[i + 1] if i + 1 < len(words) else None
            if nxt and area is None and len(words[i]) >= 3 and (a := _known(nxt, _AREA)) and words[i] not in _KIND:
                area = f"{fold(words[i])} {a}"
                i += 2
            elif nxt and street is None and len(words[i]) >= 3 and (k := _known(nxt, _KIND)) and not _known(words[i], _AREA):
                street, kind = words[i], k
                i += 2
            else:
                loose.append(words[i])
                i += 1
        loose = [TOWN_WORDS.get(w, w) for w in loose if w not in ("pin", "no", "house", "door", "plot", "hno", "h")]
        if loose:
            named.append(" ".join(loose))
            places += [{"word": " ".join(loose[i:j]), "alt": " ".join(map(fold, loose[i:j]))} for i in range(len(loose)) for j in range(i + 1, min(len(loose), i + 3) + 1)]
    if street is None:  # no kind is written; what stands first may be a street the gazetteer knows
        street = next((w for w in named[:1] if re.fullmatch("[a-z]{4,}", w)), None)
        if street is None:
            return None
        named = named[1:]
    return {"number": number.lstrip("0") or "0", "unit": unit, "street": street, "alt": fold(street), "kind": kind, "area": area, "pin": pin, "named": named, "places": places}


PARTS = "record_key string, number string, unit string, street string, alt string, kind string, area string, pin string, named array<string>, places array<struct<word:string,alt:string>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string()) for n in ("record_key", "number", "unit", "street", "alt", "kind", "area", "pin")] + [("named", pa.list_(pa.string())), ("places", pa.list_(pa.struct([("word", pa.string()), ("alt", pa.string())])))])
    for batch in batches:
        rows = [{"record_key": k, **p} for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (p := parts(t))]
        yield pa.RecordBatch.from_pylist(rows, schema)


#: Score of a town by its word, by the postal district, by nothing but being named; of a street as written and as clustered.
BY_WORD, BY_PIN, UNKNOWN, WRITTEN, CLUSTERED = 3.0, 2.0, 1.0, 1.0, 0.7
#: Score of a gazetteer entry's support, full at so many addresses; of a locality that agrees or not; of a kind that isn't written.
SUPPORT, FULL, AREA, NO_KIND = 1.5, 20, 1.0, -0.5
#: A locality of a street counts as another one from this share of its best supported one on.
SHARE = 0.25


def _gazetteer_towns(scratch: Scratch, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(district, town) and (word, town): what places are called, by postal district and in words."""
    district = F.substring("pin", 1, 3)
    seen = found.where("pin is not null").select(district.alias("district"), F.explode(F.array_distinct("places.word")).alias("word")).groupBy("district", "word").agg(F.count(F.lit(1)).alias("n"))
    share = seen.withColumn("all", F.sum("n").over(W.partitionBy("word")))  # one row a district
    common = share.where("n >= 0.6 * all and n >= 2").withColumn("top", F.max("n").over(W.partitionBy("district"))).where("n >= 0.7 * top")
    towns, _ = scratch.write(common.groupBy("district").agg(F.max_by("word", F.struct(F.length("word"), "n", "word")).alias("town"), F.max("n").alias("n")))
    loose = found.select(F.explode(F.array_distinct("places")).alias("p")).groupBy(F.col("p.word").alias("word"), F.col("p.alt").alias("alt")).agg(F.count(F.lit(1)).alias("n"))
    named = towns.groupBy("town").agg(F.sum("n").alias("m")).select(F.col("town").alias("word"), F.lit(True).alias("keep"))
    vocabulary = loose.join(named, "word", "left").select(F.lit("").alias("block"), "word", "alt", "n", F.coalesce("keep", F.lit(False)).alias("keep"))
    canon, _ = scratch.write(spelling_clusters(vocabulary).select("word", "canon"))
    known = canon.join(named.select(F.col("word").alias("canon")), "canon", "left_semi").select("word", F.col("canon").alias("town"))
    # places no district is called by: whole phrases of addresses without a code, but for words that stand in several districts
    regions = share.groupBy("word").agg(F.max("n").alias("n"), F.max("all").alias("all")).where("n < 0.6 * all").join(canon, "word").select("canon").distinct()
    own = found.where("pin is null").select(F.explode("named").alias("word")).distinct().join(canon, "word").join(known.select("word"), "word", "left_anti").join(regions, "canon", "left_anti").select("word", F.col("canon").alias("own"))
    own, _ = scratch.write(own)
    return towns.select("district", "town"), known.select("word", "town", F.lit(None).cast("string").alias("own")).unionByName(own.select("word", F.lit(None).cast("string").alias("town"), "own"))


def resolve(spark: SparkSession, records: DataFrame, beam: int = BEAM) -> DataFrame:
    """(record_key, street_id, number, unit) of every record that gives a street and number and can be placed.

    ``records`` has ``record_key, address``; a key is taken once. Null keys, null or empty
    addresses and those without street or number give no row, nor do those that name no
    town and whose street several towns have or none.
    """
    scratch = Scratch(spark, "addresses")
    keyed = records.where(F.col("record_key").isNotNull() & F.col("address").isNotNull()).select("record_key", "address").dropDuplicates(["record_key"])
    found, _ = scratch.write(keyed.mapInArrow(_parse, PARTS))
    by_pin, by_word = _gazetteer_towns(scratch, found)
    words = found.select("record_key", F.explode(F.array_distinct(F.concat("places.word", "named"))).alias("word")).join(by_word, "word")
    words = words.groupBy("record_key").agg(F.array_sort(F.collect_set("town")).alias("w_towns"), F.max_by("town", F.when(F.col("town").isNotNull(), F.struct(F.length("word"), "town"))).alias("w_town"), F.max_by("own", F.when(F.col("own").isNotNull(), F.struct(F.length("word"), "own"))).alias("own"))
    placed = found.withColumn("district", F.substring("pin", 1, 3)).join(by_pin.withColumnRenamed("town", "p_town"), "district", "left").join(words, "record_key", "left")
    written = ["street", "alt", "kind", "area", "w_town", "w_towns", "p_town", "own"]
    none = F.array().cast("array<string>")
    placed = placed.select("record_key", "number", "unit", "street", "alt", "kind", "area", "w_town", F.coalesce("w_towns", none).alias("w_towns"), "p_town", F.when(F.col("w_town").isNull() & F.col("p_town").isNull(), F.col("own")).alias("own"))
    placed, _ = scratch.write(placed.withColumn("way", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in written])))
    ways, _ = scratch.write(placed.groupBy("way").agg(F.count(F.lit(1)).alias("m"), *[F.min(c).alias(c) for c in written]))

    # localities and streets: spellings clustered within their town
    sure = ways.withColumn("town", F.coalesce("w_town", "p_town", "own")).where("town is not null")
    spelt = lambda word, alt: sure.where(F.col(word).isNotNull()).groupBy(F.col("town").alias("block"), F.col(word).alias("word"), alt.alias("alt")).agg(F.sum("m").alias("n")).withColumn("keep", F.lit(False))
    canon, _ = scratch.write(spelling_clusters(spelt("street", F.col("alt")), sound=2).select(F.col("block").alias("town"), F.col("word").alias("street"), "canon"))
    areas, _ = scratch.write(spelling_clusters(spelt("area", F.col("area")), sound=2).select(F.col("block").alias("town"), F.col("word").alias("area"), F.col("canon").alias("locality")))
    counted = sure.where("kind is not null").join(canon, ["town", "street"]).join(areas, ["town", "area"], "left").groupBy("town", "canon", "kind", "locality").agg(F.sum("m").alias("n"))
    street = W.partitionBy("town", "canon", "kind")  # one row a locality of one street
    entries = counted.withColumn("all", F.sum("n").over(street)).withColumn("top", F.max(F.when(F.col("locality").isNotNull(), F.col("n"))).over(street))
    entries = entries.where(F.col("top").isNull() | (F.col("locality").isNotNull() & (F.col("n") >= SHARE * F.col("top"))))
    entries = entries.select("town", "canon", F.col("kind").alias("e_kind"), F.col("locality").alias("e_locality"), "n", "all", F.concat_ws("|", "town", F.coalesce("locality", F.lit("")), "canon", "kind").alias("street_id"))
    entries, _ = scratch.write(entries)

    def cut(hypotheses: DataFrame, *order: str) -> DataFrame:
        return hypotheses.withColumn("r", F.row_number().over(W.partitionBy("way").orderBy(F.desc("score"), *order))).where(F.col("r") <= beam).drop("r")

    # towns
    score = lambda t: F.when(F.array_contains("w_towns", t), BY_WORD).otherwise(0.0) + F.when(t == F.col("p_town"), BY_PIN).otherwise(0.0) + F.when(t == F.col("own"), UNKNOWN).otherwise(0.0) + F.when(t == F.col("w_town"), 0.1).otherwise(0.0)
    towns = ways.select("way", "street", "kind", "area", "w_towns", "w_town", "p_town", "own", F.explode(F.array_distinct(F.array_compact(F.concat("w_towns", F.array("p_town", "own"))))).alias("town"))
    towns = towns.withColumn("score", score(F.col("town"))).select("way", "street", "kind", "area", "town", "score")
    # a way without any town: the one town that has the street, if it is one
    only = canon.join(entries.select("town", "canon", F.col("e_kind").alias("kind")).distinct(), ["town", "canon"]).groupBy("street", "kind").agg(F.min("town").alias("town"), F.max("town").alias("other")).where("town = other").drop("other")
    lost = ways.where("size(w_towns) = 0 and p_town is null and own is null").select("way", "street", "kind", "area").join(only, ["street", "kind"]).select("way", "street", "kind", "area", "town", F.lit(0.0).alias("score"))
    step = cut(towns.unionByName(lost), "town")
    # streets
    step = step.join(canon, ["town", "street"]).withColumn("score", F.col("score") + F.when(F.col("canon") == F.col("street"), WRITTEN).otherwise(CLUSTERED))
    step = cut(step.join(areas, ["town", "area"], "left"), "town", "canon")
    # kinds and localities; another kind than the written one is another street
    step = step.join(entries, ["town", "canon"]).where(F.col("kind").isNull() | (F.col("kind") == F.col("e_kind")))
    near = F.when(F.col("locality") == F.col("e_locality"), AREA).when(F.col("locality").isNotNull() & F.col("e_locality").isNotNull(), -AREA).otherwise(0.0)
    support = SUPPORT * F.least(F.lit(1.0), F.log1p(F.col("all").cast("double")) / F.log1p(F.lit(float(FULL)))) + F.log1p("n") / 1000
    step = step.withColumn("score", F.col("score") + F.when(F.col("kind").isNull(), NO_KIND).otherwise(0.0) + near + support)
    best = cut(step, "street_id").groupBy("way").agg(F.max_by("street_id", F.struct("score", "street_id")).alias("street_id"))
    return placed.join(best, "way").select("record_key", "street_id", "number", "unit")


def same_addresses(spark: SparkSession, records: DataFrame) -> DataFrame:
    """(record_key_a, record_key_b), the smaller first: records of one street identifier, number and unit.

    All pairs of a place are stated, as asked for; see ``resolve`` for nulls and the like.
    """
    scratch = Scratch(spark, "addresses")
    at, _ = scratch.write(resolve(spark, records))
    other = at.select(F.col("record_key").alias("other"), "street_id", "number", "unit")
    return at.join(other, ["street_id", "number", "unit"]).where("record_key < other").select(F.col("record_key").alias("record_key_a"), F.col("other").alias("record_key_b"))
