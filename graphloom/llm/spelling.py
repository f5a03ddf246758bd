"""Spellings of the same word gathered under the one written most often.

Two words of at most two edits share a word left of each by at most two deletions, and of
two long ones one holds a third of the other, at most two places off (pigeonhole). So
each distinct word is joined with itself on these by equality, and pairs are
verified with the built-in ``levenshtein``. A rare word goes to the nearest word that is
clearly more frequent; two frequent words stay apart however alike they look. The work
is on distinct words, which grow far slower than records.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Scratch

#: A word goes to another that occurs at least this many times as often.
RATIO = 4
#: Letters up to which words meet by what two deletions leave, and one; longer ones meet by thirds.
TWO, ONE = 24, 64

_FOLDS = ((re.compile("ph"), "f"), (re.compile("oo"), "u"), (re.compile("ee"), "i"), (re.compile("au"), "o"), (re.compile("w"), "v"), (re.compile("j(?=[ei])"), "g"), (re.compile(r"(.)\1+"), r"\1"))


def plain(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def fold(word: str) -> str:
    """A word with usual spellings of one sound made alike (ph/f, oo/u, ee/i, au/o, w/v, soft g/j, doubled letters) and look-alike digits read as letters."""
    w = word.replace("0", "o").replace("1", "l")
    for pattern, to in _FOLDS:
        w = pattern.sub(to, w)
    return w


def _deleted(column: str) -> str:
    """SQL: all words left of ``column`` by one deletion."""
    return f"transform(sequence(1, length({column})), i -> concat(substring({column}, 1, i - 1), substring({column}, i + 1)))"


def _thirds(c: str) -> str:
    """SQL: the three segments of ``c`` with its length."""
    return f"transform(sequence(0, 2), i -> concat_ws('#', '', length({c}), i, substring({c}, cast(floor(length({c}) * i / 3) as int) + 1, cast(floor(length({c}) * (i + 1) / 3) - floor(length({c}) * i / 3) as int))))"


def _places(c: str) -> str:
    """SQL: what of ``c`` can be a segment of a word two edits away, by that word's length."""
    at = f"transform(sequence(greatest(0, cast(floor(n * i / 3) as int) - 2), cast(floor(n * i / 3) as int) + 2), q -> concat_ws('#', '', n, i, substring({c}, q + 1, cast(floor(n * (i + 1) / 3) - floor(n * i / 3) as int))))"
    return f"flatten(transform(sequence(length({c}) - 2, length({c}) + 2), n -> flatten(transform(sequence(0, 2), i -> {at}))))"


def letters(word: str) -> str:
    """A word with look-alike digits read as letters."""
    return word.replace("0", "o").replace("1", "l")


# Letters that sound alike to many writers, as (pattern, replacement) in this order.
SOUNDS = (("tch", "ch"), ("th", "t"), ("sh", "s"), ("c([^h]|$)", "k$1"), ("g", "j"), ("z", "s"))


def _sound(c: str) -> str:
    for pattern, to in SOUNDS:
        c = f"regexp_replace({c}, '{pattern}', '{to}')"
    return c


def spelling_clusters(words: DataFrame, ratio: int = RATIO, rare: int = 2, full: int = 7, sound: int | None = None) -> DataFrame:
    """(block, word, canon) for every distinct ``(block, word)`` of ``words`` with ``block STRING, word STRING, alt STRING, n BIGINT, keep BOOLEAN``.

    ``alt`` is the word's ``fold``; words are as far apart as the nearer of both forms.
    Words of ``full`` letters or more may differ by two edits, of five or more by one (or
    a swap of neighbours), shorter ones by none; words of one ``alt`` differ by none.
    How often a word is seen is counted over all words of its ``alt``. With ``sound``, words that
    sound alike by ``SOUNDS`` join where one is seen ``sound`` times as often.
    ``keep`` marks words that stand for themselves. Words of another block never meet. Two
    words both seen at most ``rare`` times may join at one edit, the smaller leading. Null
    blocks or words give no row.
    """
    base = words.where("block is not null and word is not null").groupBy("block", "word").agg(F.sum("n").alias("n"), F.max(F.coalesce("keep", F.lit(False))).alias("keep"), F.min(F.coalesce("alt", "word")).alias("alt"))

    def keys(c: str, deep: str) -> str:
        one = _deleted(c)
        two = f"flatten(transform({one}, x -> {_deleted('x')}))"
        return f"case when {deep} and length({c}) between {full} and {TWO} then concat(array({c}), {one}, {two}) when length({c}) between 5 and {ONE} then concat(array({c}), {one}) else array({c}) end"

    def hashed(deep: str, thirds) -> str:
        both = f"case when alt = word then {keys('word', deep)} else concat({keys('word', deep)}, {keys('alt', deep)}) end"
        both = f"case when length(word) > {TWO} then concat({both}, {thirds('word')}, {thirds('alt')}) when length(word) > {TWO - 3} then concat({both}, {_thirds('word')}, {_thirds('alt')}) else {both} end"
        return f"explode(array_distinct(transform({both}, x -> xxhash64(x)))) k"

    base = base.withColumn("s", F.expr(_sound("alt") if sound else "alt")).withColumn("t", F.sum("n").over(W.partitionBy("block", "alt")))  # the spellings of one sound
    # few bytes, but hundreds of keys a word: not to be left to one task
    base = base.repartition(4 * words.sparkSession.sparkContext.defaultParallelism, "block", "word")
    # only a word seen often enough to draw others over two edits needs its keys of two deletions
    left = base.where("not keep and length(word) >= 4").selectExpr("block", "word", "alt", "s", "n", "t", hashed("true", _places))
    right = base.where("length(word) >= 4").selectExpr("block", "word as other", "alt as other_alt", "s as other_s", "n as m", "t as u", hashed(f"t >= {ratio if sound is None else min(ratio, sound)}", _thirds))
    ahead = "(m > n or (m = n and other < word))"
    alike = f"(s = other_s and u >= {sound} * t)" if sound else "false"
    pairs = left.join(right, ["block", "k"]).where(f"word <> other and (u >= {ratio} * t or (alt = other_alt and {ahead}) or {alike} or (t <= {rare} and u <= {rare * ratio} and alt <> other_alt and (u > t or (u = t and other < word))))")
    pairs = pairs.select("block", "word", "alt", "n", "t", "other", "other_alt", "m", "u", F.expr(alike).alias("alike")).distinct()

    def distance(a: str, b: str) -> str:
        d = f"levenshtein({a}, {b}, 2)"
        return f"case when {d} = 2 and array_sort(split({a}, '')) = array_sort(split({b}, '')) then 1 when {d} < 0 then 9 when {d} = 2 and least(length({a}), length({b})) < {full} then 9 when {d} = 1 and least(length({a}), length({b})) < 4 then 9 else {d} end"

    scored = pairs.withColumn("d", F.expr(f"case when alike then 1 else least({distance('word', 'other')}, {distance('alt', 'other_alt')}) end"))
    fits = scored.where(f"d <= 1 or (d = 2 and u >= {ratio} * t)")
    best = fits.groupBy("block", "word").agg(F.expr("min_by(other, struct(d, -u, -m, other))").alias("to"))
    best, _ = Scratch(words.sparkSession, "spelling").write(best)  # read three times
    for _ in range(2):  # what a word goes to may itself go on
        best = best.join(best.select("block", F.col("word").alias("to"), F.col("to").alias("then")), ["block", "to"], "left").select("block", "word", F.coalesce("then", "to").alias("to"))
    step = base.select("block", "word").join(best, ["block", "word"], "left").select("block", "word", F.coalesce("to", "word").alias("canon"))
    return step
