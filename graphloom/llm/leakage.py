"""Evaluation items inside documents: a prefix-filtered set join with exact verification.

A shingle is ``SHINGLE`` words. The shingles of an item are ordered by rarity, the
number of documents of the whole corpus they occur in. A document that holds the
required part of an item shares at least a fraction ``OVERLAP`` of its shingles, so it
must share one of the rarest ``n - ceil(OVERLAP n) + 1``: the item's prefix. What the prefix
leaves out are an item's commonest shingles, those of turns of phrase that stand in a large part of
the corpus. Documents are joined with items by equality on prefix shingles; candidates too
short for the required part are left out, and so are those that share fewer shingles, or shared
shingles in places that bound the passages below it.
What remains is verified by aligning document and item, word by word, in windows of
the item's size around the shared places, all of them; the two best coherent passages count.

The corpus is read once, whatever the number of items: a bitmap of ``BITMAP`` bits, marked where
the hash of a shingle of any item falls, goes to the tasks, and of a document only its shingles
that hit a marked bit are joined. A bitmap never misses a shingle; what it lets
through needlessly the join removes. Items and documents meet in joins only, never on the driver.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Scratch

#: Words of a shingle for candidates; words of the seeds passages are chained from.
SHINGLE, SEED = 5, 3
#: Part of an item's shingles that survive in a document holding the required part of its words, changed in places.
OVERLAP = 0.06
#: Bits (as a power of two) of the bitmap of item shingles: what is sent to every task is an eighth of 2 ** BITMAP bytes, whatever the items.
BITMAP = 26
#: A passage counts from this many matching words on; shorter ones are turns of phrase.
PASSAGE = 12
#: Words the seeds of a passage cover at least.
SEEDS = 6
#: Part of an item's words its seeds must cover before it is aligned.
SEEDED = 0.28

_BREAK = re.compile(r"(?<=\w)[-‐‑­]\s*\n\s*(?=\w)")
_WORD = re.compile(r"\w+")
_DROP = dict.fromkeys(map(ord, "​‌‍⁠﻿­'’‘`ʼ"))


def words(text: str | None) -> list[str]:
    """Comparable words: entities resolved, hyphenation undone, no case, accents, apostrophes or layout."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text:
        text = _BREAK.sub("", text)
    if text.isascii():
        text = text.replace("'", "").replace("`", "").lower()
    else:
        text = "".join(c for c in unicodedata.normalize("NFKD", text.translate(_DROP).lower()) if not unicodedata.combining(c))
    return _WORD.findall(text)


def shingles(w: list[str], k: int) -> list[str]:
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])


def deletions(word: str) -> set[str]:
    """The word and what is left of it by one deletion; words of one slip of the pen share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) >= 4 else {word}


def near(a: str, b: str) -> bool:
    """Equal, or one slip of the pen apart (edit or swap of neighbours) in words of four letters or more."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


class Item:
    """One item's words, and which of its words a written word may stand for."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        order = np.array(words)
        self.rows = {w: order == w for w in set(words)}
        self.none = np.zeros(len(words), bool)
        self.slips: dict[str, list[str]] = {}
        for w in sorted(self.rows):
            for d in deletions(w):
                self.slips.setdefault(d, []).append(w)

    def matches(self, doc: list[str]) -> list[np.ndarray]:
        """For each word of the document, where it agrees with the item's words; equal words share one array."""
        rows: dict[str, np.ndarray] = {}
        for w in doc:
            if w not in rows:
                if (row := self.rows.get(w)) is None:
                    slips = {x for d in deletions(w) if d in self.slips for x in self.slips[d] if near(w, x)}
                    row = np.logical_or.reduce([self.rows[x] for x in slips]) if slips else self.none
                rows[w] = row
        return [rows[w] for w in doc]


#: A cell of the alignment is one number: score and, among equal scores, matching words.
_SCORE = 1 << 31


def _sweep(agree: list[np.ndarray], n: int, local: bool, wanted: int | None = None) -> tuple[int, int, int]:
    """(best cell, words of the document, of the item up to it); not ``local``: from the very first words on, until ``wanted`` is reached."""
    slope = 2 * _SCORE * np.arange(n + 1, dtype=np.int64)
    prev = np.zeros(n + 1, np.int64) if local else -slope
    best = (0, 0, 0)
    gains: dict[int, np.ndarray] = {}  # by row, for equal words share one; of long items only while in use
    for i, row in enumerate(agree, 1):
        if (gain := gains.get(id(row))) is None:
            gain = np.where(row, _SCORE + 1, -2 * _SCORE)
            if n <= 4096:
                gains[id(row)] = gain
        now = np.empty(n + 1, np.int64)
        now[0] = 0 if local else -2 * _SCORE * i
        np.maximum(prev[:-1] + gain, prev[1:] - 2 * _SCORE, out=now[1:])
        now = np.maximum.accumulate(now + slope) - slope
        if local:
            now[now < _SCORE] = 0
        j = int(now.argmax())
        if now[j] > best[0]:
            best = (int(now[j]), i, j)
            if wanted is not None and best[0] >= wanted:
                break
        prev = now
    return best


def align(agree: list[np.ndarray], least: int = 1) -> tuple[int, int, int, int, int]:
    """Best local alignment (match 1, change or gap -2): (matching words, document from, to, item from, to); zeros where fewer than ``least`` match."""
    n = len(agree[0]) if len(agree) else 0
    value, i, j = _sweep(agree, n, True)
    if value % _SCORE < least:
        return 0, 0, 0, 0, 0
    # where it began: the same way back from its end
    turned = {id(r): r[:j][::-1] for r in agree[:i]}
    _, di, dj = _sweep([turned[id(r)] for r in agree[:i][::-1]], j, False, value)
    return value % _SCORE, i - di, i, j - dj, j


def chains(hits: list[tuple[int, int]]) -> list[list[int]]:
    """Seeds (document place, item place) chained where both run on with few words between: [from, to, item from, to, covered].

    The end of every chain is kept by its diagonal (document less item place), so whatever
    else begins in between, a seed finds the nearest chain it goes on.
    """
    out: list[list[int]] = []
    ends: dict[int, list[int]] = {}
    for p, q in sorted(hits):
        fits = [c for d in range(p - q - 3, p - q + 4) if (c := ends.get(d)) and 0 < p - c[1] <= 8 and 0 < q - c[3] <= 8]
        if fits:
            c = min(fits, key=lambda c: (p - c[1] + q - c[3], c[0]))
            if ends.get(c[1] - c[3]) is c:
                del ends[c[1] - c[3]]
            c[4] += min(SEED, q - c[3])
            c[1], c[3] = p, q
        else:
            c = [p, p, q, q, SEED]
            out.append(c)
        ends[p - q] = c
    return out


def contained(doc: list[str], item: Item, hits: list[tuple[int, int]]) -> int:
    """Matching words of the two best coherent passages, 0 if their seeds cover too little of the item.

    Every chain that no passage holds yet is aligned, the longest first. Where the best alignment
    near it is another passage, that one's words are taken out and the rest is aligned again.
    """
    found, size = sorted(chains(hits), key=lambda c: -c[4]), len(item.words)
    # of all seeds, for a passage with words put in between falls into many chains
    covered = len({x for _, q in hits for x in range(q, min(q + SEED, size))})
    if max(covered, sum(c[4] for c in found[:2])) < SEEDED * size:
        return 0
    passages: list[tuple[int, int, int, int, int]] = []
    for c in found:
        if c[4] < min(SEEDS, size):
            break
        if any(p[1] <= c[0] < p[2] and p[3] <= c[2] < p[4] for p in passages):
            continue
        lo, hi = max(0, c[0] - c[2] - 4), min(len(doc), c[1] + size - c[3] + 4)
        agree = item.matches(doc[lo:hi])
        while (got := align(agree, min(PASSAGE, size)))[0] >= min(PASSAGE, size):
            n, a, b, s, e = got
            if (p := (n, a + lo, b + lo, s, e)) not in passages:
                passages.append(p)
            if a + lo <= c[0] < b + lo and s <= c[2] < e:
                break
            agree[a:b] = [item.none] * (b - a)
    # words of the item that two passages share count once
    best = max((p[0] for p in passages), default=0)
    return max([best, *(p[0] + q[0] - max(0, min(p[4], q[4]) - max(p[3], q[3])) for i, p in enumerate(passages) for q in passages[i + 1 :])])


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


_ODD = np.array([xxhash.xxh64_intdigest(f"place {i}") | 1 for i in range(SHINGLE)], np.uint64)


def shingle_hashes(w: list[str], k: int) -> np.ndarray:
    """64-bit hashes of the runs of ``k`` words, one a place."""
    if len(w) < k:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_word_hash, w), np.uint64, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out += h[i : len(w) - k + 1 + i] * _ODD[i]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64)


@lru_cache(maxsize=512)
def _item(text: str) -> tuple[Item, dict[str, list[int]], frozenset]:
    w = text.split(" ")
    seeds: dict[str, list[int]] = {}
    for q, s in enumerate(shingles(w, SEED)):
        seeds.setdefault(s, []).append(q)
    return Item(w), seeds, frozenset(shingles(w, SHINGLE))


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", part: float = 0.4) -> DataFrame:
    """(doc_id, item_id, matched, item_words): documents holding at least ``part`` of an item's words in one or two passages.

    Null keys and null or empty texts match nothing, items of the same text match alike, a
    repeated row is reported once, other columns aren't read, and an empty table on
    either side gives an empty result. Items shorter than a shingle count as one shingle.
    """
    scratch = Scratch(spark, "leakage")
    doc_kind, item_kind = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, matched int, item_words int"

    def read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, w) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (w := words(t))]
            hashes = [np.unique(shingle_hashes(w, min(SHINGLE, len(w)))) for _, w in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.column(0).type), pa.array([" ".join(r[1]) for r in rows], pa.string()), pa.array([len(r[1]) for r in rows], pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], names=["item_id", "item", "size", "hashes"]
            )

    wanted = items.where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).select(item_key, text).mapInArrow(read_items, f"item_id {item_kind}, item string, size int, hashes array<bigint>")
    wanted, _ = scratch.write(wanted.dropDuplicates(["item_id", "item"]).withColumn("v", F.xxhash64("item_id", "item")))
    of_items = wanted.select("v", "size", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    lengths = sorted(r.k for r in wanted.select(F.least(F.col("size"), F.lit(SHINGLE)).alias("k")).distinct().collect())  # at most SHINGLE rows
    if not lengths:
        return spark.createDataFrame([], schema)
    slot = F.shiftrightunsigned("h", 64 - BITMAP)
    marked = of_items.groupBy(F.shiftright(slot, 3).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(h, {64 - BITMAP}) & 7 as int))")).cast("short").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP - 3), np.uint8)  # as many rows at most
    bitmap[marked.column("at").to_numpy()] = marked.column("bits").to_numpy()
    shared, shift = spark.sparkContext.broadcast(bitmap), np.uint64(64 - BITMAP)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            kept = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(t)
                h = np.concatenate([shingle_hashes(w, n) for n in lengths]) if w else np.zeros(0, np.int64)
                at = (h.view(np.uint64) >> shift).astype(np.int64)
                hit = h[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                if len(hit):
                    kept.append((k, " ".join(w), len(w), np.unique(hit)))
            cols = list(zip(*kept)) if kept else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int64()))], names=["doc_id", "words", "length", "hits"])

    # the texts are read once; what shares no shingle with any item ends here
    source = docs.where(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).select(doc_key, text)
    sharing, _ = scratch.write(source.mapInArrow(sieve, f"doc_id {doc_kind}, words string, length int, hits array<bigint>").withColumn("u", F.xxhash64("doc_id", "words")))
    hits, _ = scratch.write(sharing.select("u", "length", F.explode("hits").alias("h")).join(of_items.select("h").distinct(), "h", "left_semi").distinct())
    rarity = hits.groupBy("h").agg(F.count(F.lit(1)).alias("docs"))
    # the prefix of every item: all but its commonest shingles
    ranked = of_items.join(rarity, "h").withColumn("r", F.row_number().over(W.partitionBy("v").orderBy(F.desc("docs"), F.desc("h"))))
    marked = ranked.select("h", "v", "size", "n", (F.col("r") >= F.ceil(OVERLAP * F.col("n"))).alias("prefix"))
    # pairs that share a prefix shingle, and so many shingles in all that the required part can be there
    common = hits.join(marked, "h").where(F.col("length") >= part * F.col("size")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"), F.max("prefix").alias("prefix"), F.max("n").alias("n"))
    candidates = common.where(F.col("prefix") & (F.col("c") >= OVERLAP * F.col("n"))).select("u", "v")
    pairs = candidates.join(wanted.select("v", "item_id", "item"), "v").join(sharing.select("u", "doc_id", "words").dropDuplicates(["u"]), "u")
    # few bytes, but seconds of work: not to be left to one task; the pairs of one document stand together
    pairs = pairs.repartition(8 * spark.sparkContext.defaultParallelism, "u", "v").sortWithinPartitions("u", "v").select("doc_id", "words", "item_id", "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, w, own = None, [], {}
        for batch in batches:
            rows = []
            for k, t, i, x in zip(*(batch.column(c).to_pylist() for c in range(4))):
                item, seeds, five = _item(x)
                if t != last:  # pairs of one document mostly stand together
                    last, w, own = t, t.split(" "), {}
                size = len(item.words)
                length = min(SHINGLE, size)
                if length not in own:
                    own[length] = set(shingles(w, length))
                if len(five & own[length]) < OVERLAP * len(five):
                    continue
                found = [(p, q) for p, s in enumerate(shingles(w, min(SEED, size))) for q in seeds.get(s, ())]
                n = contained(w, item, found)
                if n >= part * size:
                    rows.append((k, i, n, size))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], batch.column(2).type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "matched", "item_words"])

    return pairs.mapInArrow(verify, schema)
