"""Text functions as column expressions; Arrow UDFs only where no built-in has the meaning."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Titles and roles that name normalisation removes, as patterns.
HONORIFICS = ("j", "jj", "mr", "mrs", "ms", "dr", "md", "smt", "sri", "shri", "justice", "hon'?ble", "inspector", "sub-?inspector", "si", "asi", "constable", "the", "late", "deceased", "accused", "appellant", "respondent", "petitioner", "plaintiff", "defendant")
# Titles that evaluation removes.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "sir", "smt", "justice", "hon'ble", "shri")
# Placeholders that name nobody and nothing.
GENERIC = ("weapon", "vehicle", "unknown", "n/a", "na", "none", "person", "victim", "suspect", "accused", "object", "item", "")
# Words a keyword search leaves out.
STOP_WORDS = tuple(
    """a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought
    of in to for with on at from by about as into through during before after above below between out off over under again further then
    once here there when where why how all each every both few more most other some such no nor not only own same so than too very
    and but or if while what which who whom this that these those i me my we our you your he him his she her it its they them
    their show find get tell list give many""".split()
)
# Keywords of criminal matters, and how many of a judgment's first characters are searched.
CRIMINAL = ("murder", "homicide", "assault", "robbery", "theft", "kidnapping", "rape", "dowry", "fir", "ipc", "crpc", "accused", "convicted", "acquitted", "culpable homicide", "criminal conspiracy", "section 302", "section 307", "section 376", "section 420", "section 498")
OPENING = 3000
# Category -> words that point to it.
CRIME_CATEGORIES = {
    "murder": ("murder", "homicide", "killing", "killed", "honour killing"), "rape": ("rape", "gang rape", "gang-rape", "sexual assault"), "poisoning": ("poison",), "kidnapping": ("kidnap", "abduct"),
    "robbery": ("robbery", "robbed", "loot"), "assault": ("assault",), "arson": ("arson", "set ablaze", "set on fire", "burned the body", "burnt"), "serial killing": ("serial",),
}
# Role -> the word that points to it, first match wins.
ROLES = (("victim", "victim"), ("accused", "accused"), ("witness", "witness"), ("officer", "officer"), ("forensic_analyst", "forensic"))
# Cities that places are compared by; words of place names that don't tell places apart.
CITIES = ("delhi", "mumbai", "kozhikode", "ghaziabad", "noida", "kolkata")
PLACE_STOP = ("the", "of", "a", "an", "near", "at", "in", "district", "region", "new", "and")
# Names known to be borne by different people of different cases.
COLLISIONS = ("ajay kumar",)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def name_normalise(c: Column, person: Column | None = None) -> Column:
    """Lower case, anything but letters and digits to single spaces; of persons (all, if not told) honorifics and roles removed first."""
    low = F.lower(F.trim(c))
    bare = F.regexp_replace(low, rf"\b({'|'.join(HONORIFICS)})\b", " ")
    return collapse(F.regexp_replace(bare if person is None else F.when(person, bare).otherwise(low), "[^a-z0-9 ]", " "))


def eval_normalise(c: Column) -> Column:
    """Lower case, titles with their dots and the space after them removed, single spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), rf"\b({'|'.join(TITLES)})\.?\s*", ""), r"\s+", " ")


def is_generic(c: Column) -> Column:
    return c.isin(*GENERIC)


def is_identifier(c: Column) -> Column:
    return c.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def document_prefix(c: Column) -> Column:
    """The document part of an entity id: ``FIR-1_person_2`` -> ``FIR-1``."""
    return F.regexp_replace(c, "_[^_]*_[0-9]+$", "")


def keywords(c: Column, limit: int = 8) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9\-]+)"), 1)
    return F.slice(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)), 1, limit)


def html_strip(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def bracket_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\[[^\]]*\]", "")


def safe_id(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9A-Za-z_.\-]", "_")


def csv_guard(c: Column) -> Column:
    """Cells a spreadsheet would run as a formula get a quote in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def category_by_prefix(c: Column) -> Column:
    return F.when(c.startswith("C"), "cylinder").when(c.startswith("HP"), "puck").otherwise("other")


def crime_categories(c: Column) -> Column:
    """The categories a text points to, in order of name."""
    low = F.lower(c)
    return F.array_sort(F.array_compact(F.array(*[F.when(low.rlike("|".join(words)), name) for name, words in CRIME_CATEGORIES.items()])))


def primary_crime(categories: Column) -> Column:
    return F.when(F.array_contains(categories, "murder"), "murder").otherwise(F.coalesce(F.array_min(categories), F.lit("none")))


def role_normalise(c: Column) -> Column:
    """The role a text points to, else the text in lower case, 'unknown' for none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F
    for role, word in ROLES:
        out = out.when(low.contains(word), role)
    bare = F.trim(low)
    return out.otherwise(F.when(bare == "", "unknown").otherwise(bare))


def keyword_hits(c: Column, words: tuple[str, ...] = CRIMINAL) -> Column:
    low = F.lower(c)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def is_criminal(text: Column, title: Column) -> Column:
    """At least two of the keywords in a judgment's opening or its title."""
    return keyword_hits(F.concat_ws(" ", F.substring(text, 1, OPENING), F.coalesce(title, F.lit("")))) >= 2


def city(c: Column) -> Column:
    """The first of ``CITIES`` a place names, '' if none."""
    out = F
    for name in CITIES:
        out = out.when(F.lower(c).contains(name), name)
    return out.otherwise("")


def place_tokens(c: Column) -> Column:
    """Words of more than two letters that tell places apart."""
    words = F.split(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*PLACE_STOP)))


def same_place(gold: Column, found: Column) -> Column:
    """Both name something, and one's words are among the other's."""
    g, e = place_tokens(gold), place_tokens(found)
    return (F.size(g) > 0) & (F.size(e) > 0) & (subset(g, e) | subset(e, g))


def should_link(label: Column, a: Column, b: Column, score: Column) -> Column:
    """Whether two values mean one thing by rule: a score of 0.9 for places and crime types, else equal names but for ``COLLISIONS``."""
    bare = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s*\[.*?\]", "")))
    clash = F.lit(False)
    for name in COLLISIONS:
        clash = clash | ((label == "Person") & bare(a).contains(name) & bare(b).contains(name))
    return F.when(clash, False).when(label.isin("CrimeType", "Location"), score >= 0.9).otherwise(bare(a) == bare(b))


def split_places(c: Column) -> Column:
    """Sentences of a location text, the part after a colon, those of more than five characters."""
    pieces = F.transform(F.split(c, "[.;]"), lambda p: F.trim(F.regexp_replace(p, "^[^:]*:", "")))
    return F.filter(pieces, lambda p: F.length(p) > 5)


def titled_person(c: Column) -> Column:
    """A titled name up to the comma, else the first two words."""
    titled = F.regexp_extract(c, r"\b((?:Mr|Mrs|Ms|Dr|Shri|Smt)\.? [^,.]+)", 1)
    return F.when(titled != "", F.trim(titled)).otherwise(F.array_join(F.slice(F.split(F.trim(c), " "), 1, 2), " "))


# Headings that open the facts of a judgment and those that end them.
FACTS_OPEN = r"(?:FACTS?\s+(?:OF\s+THE\s+)?CASE|FACTUAL\s+BACKGROUND|BRIEF\s+FACTS|PROSECUTION\s+(?:CASE|STORY)|CASE\s+OF\s+THE\s+PROSECUTION)\s*[:\-.]?\s*\n"
FACTS_CLOSE = r"\n\s*(?:ARGUMENTS?|SUBMISSIONS?|CONTENTIONS?|ISSUES?|QUESTIONS?\s+(?:OF|FOR)|DISCUSSION|ANALYSIS|REASONING|FINDINGS?|CONCLUSION|JUDGMENT|ORDER)\s*[:\-.]?\s*\n"
FACTS_INLINE = r"(?:\d+\.\s+)?(?:The\s+)?(?:brief\s+)?facts\s+(?:of\s+the\s+case\s+)?(?:are|in\s+brief)[:\s]+([\s\S]{200,3000}?)(?:\n\s*\d+\.|\n\s*(?:It\s+is|The\s+learned|We\s+have))"


def facts_section(c: Column) -> Column:
    """The facts of a judgment, if longer than 200 characters: from their heading to the next one, or after "facts are"; else 3 000 characters from the first long line on."""
    headed = F.trim(F.regexp_extract(c, rf"(?i){FACTS_OPEN}([\s\S]+?)(?={FACTS_CLOSE})", 1))
    inline = F.trim(F.regexp_extract(c, rf"(?i){FACTS_INLINE}", 1))
    lines = F.split(c, "\n")
    long = F.filter(F.transform(lines, lambda line, i: F.when((F.length(F.trim(line)) > 100) & ~F.trim(line).startswith("("), i)), lambda i: i.isNotNull())
    rest = F.array_join(F.slice(lines, F.coalesce(F.try_element_at(long, F.lit(1)), F.lit(0)) + 1, F.size(lines)), "\n")
    return F.when(F.length(headed) > 200, headed).when(F.length(inline) > 200, inline).when(F.length(rest) > 200, F.trim(F.substring(rest, 1, 3000))).otherwise("")


def node_text(label: Column, name: Column, props: Column, fields: int = 25, length: int = 2000) -> Column:
    """``Label: name | k=v; ...`` with underscores as spaces."""
    entries = F.slice(F.filter(F.array_sort(F.map_entries(props)), lambda e: e["value"].isNotNull() & (e["value"] != "") & (F.length(e["value"]) <= 600)), 1, fields)
    body = F.array_join(F.transform(entries, lambda e: F.concat(F.regexp_replace(e["key"], "_", " "), F.lit("="), e["value"])), "; ")
    return F.substring(F.concat(label, F.lit(": "), F.coalesce(name, F.lit("")), F.when(body != "", F.concat(F.lit(" | "), body)).otherwise("")), 1, length)


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity of two strings; null where either is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """Upper bound of ``seq_ratio`` from the lengths alone: prunes before the UDF."""
    return 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))


def category_matches(values: DataFrame, entries: DataFrame, floor: float = 0.7) -> DataFrame:
    """(v, name): values and entries of which one contains the other, or that share a word, or whose ratio is ``floor`` or more.

    Case is ignored and anything but letters and digits is space. Every value meets every
    entry, so ``entries`` must be a list of bounded size. Empty texts match nothing.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "))
    words = lambda c: F.filter(F.split(c, " +"), lambda w: w != "")
    p = values.withColumn("w", plain(F.col("v"))).where("w <> ''").crossJoin(F.broadcast(entries.withColumn("e", plain(F.col("name"))).where("e <> ''")))
    p = p.withColumn("hit", F.col("w").contains(F.col("e")) | F.col("e").contains(F.col("w")) | F.arrays_overlap(words("w"), words("e")))
    # only what isn't decided and could reach the floor is compared
    open_ = F.when(~F.col("hit") & (ratio_bound(F.col("w"), F.col("e")) >= floor), F.col("w"))
    return p.withColumn("ratio", seq_ratio(open_, F.col("e"))).where(F.col("hit") | (F.col("ratio") >= floor)).select("v", "name").distinct()


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def name_score(a: Column, b: Column, ratio: Column) -> Column:
    """STRUCT(score, min_tokens, subset, conflict) of two normalised names.

    A name of two or more words contained in the other scores at least 0.95; initials
    (words of at most two letters) of which neither set contains the other conflict.
    """
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    ia, ib = F.filter(ta, lambda w: F.length(w) <= 2), F.filter(tb, lambda w: F.length(w) <= 2)
    inside = subset(ta, tb) | subset(tb, ta)
    least = F.least(F.size(ta), F.size(tb))
    score = F.when(inside & (least >= 2), F.greatest(ratio, F.lit(0.95))).otherwise(ratio)
    conflict = (F.size(ia) > 0) & (F.size(ib) > 0) & ~subset(ia, ib) & ~subset(ib, ia)
    return F.struct(score.alias("score"), least.alias("min_tokens"), inside.alias("subset"), conflict.alias("conflict"))


def match_confidence(score: Column, overlap: Column, role: Column) -> Column:
    return 0.6 * score + 0.25 * F.least(overlap, F.lit(1.0)) + 0.15 * role


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def round4(c: Column) -> Column:
    """Half up at four decimals, alike in any engine."""
    return F.floor(c * 10000 + 0.5) / 10000
