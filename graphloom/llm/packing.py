"""Documents into sequences of fixed capacity by best-two-fit.

Token counts come from a public tokenizer. A document longer than the capacity is
cut into full sequences and a remainder; no other document is cut. The items left
are packed in groups of about ``GROUP`` drawn by hash, each by one task: bins are
filled greedily with the largest item that fits, then the bin's smallest item is
exchanged for two unpacked ones if they fill the widened gap more tightly. A group
wastes at most part of its last bins, so the loss by grouping is below one bin in
thousands, and no task ever sees more than one group.
"""

from __future__ import annotations

import base64
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Scratch

#: Items a packing task takes on.
GROUP = 50_000
#: Rank file of the tokenizer, and the published split pattern that belongs to it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document with a key; null texts count 0. Whole texts are encoded."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint")


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item positions. Each size is in 1..capacity; the order of equal sizes is kept."""
    stacks: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        stacks.setdefault(sizes[i], []).append(i)
    lengths = sorted(stacks)

    def take(n: int) -> int:
        i = stacks[n].pop()
        if not stacks[n]:
            del stacks[n]
            lengths.pop(bisect_right(lengths, n) - 1)
        return i

    def put(n: int, i: int) -> None:
        if n not in stacks:
            stacks[n] = []
            insort(lengths, n)
        stacks[n].append(i)

    bins = []
    while lengths:
        held, gap = [], capacity
        while lengths and gap and (at := bisect_right(lengths, gap)):
            n = lengths[at - 1]
            held.append((n, take(n)))
            gap -= n
        if gap and len(held) > 1 and lengths:
            least = held[-1][0]  # sizes were taken in falling order
            room, best = gap + least, None
            j = bisect_right(lengths, room - 1) - 1
            while j >= 0:
                a = lengths[j]
                if 2 * a <= (best[0] if best else least):
                    break  # the smaller of two isn't greater than a
                k = bisect_right(lengths, min(a, room - a)) - 1
                if k >= 0:
                    b = lengths[k]
                    if b == a and len(stacks[a]) < 2:
                        k -= 1
                        b = lengths[k] if k >= 0 else 0
                    if b and a + b > (best[0] if best else least):
                        best = (a + b, a, b)
                        if a + b == room:
                            break
                j -= 1
            if best:
                n, i = held.pop()
                put(n, i)
                held += [(x, take(x)) for x in best[1:]]
        bins.append([i for _, i in held])
    return bins


def pack(spark: SparkSession, docs: DataFrame, key: str, text: str, capacity: int = 2048, path: str = TOKENIZER, group: int = GROUP) -> DataFrame:
    """(sequence_id, position, doc_id, start_token, n_tokens): which tokens of which document stand where.

    Every document with at least one token is placed wholly; one with more than
    ``capacity`` tokens is cut every ``capacity`` tokens. Null keys, null and empty texts
    give no row, repeated rows are placed repeatedly, an empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    scratch = Scratch(spark, "packing")
    kind = docs.schema[key].dataType.simpleString()
    counts, _ = scratch.write(token_counts(docs, key, text, path).where("n_tokens > 0"))
    n = counts.where(F.col("n_tokens") % capacity != 0).count()
    groups = max(1, round(n / group))
    # long documents alone are numbered, so that repeated rows get sequences of their own
    long = counts.where(F.col("n_tokens") >= capacity).withColumn("copy", F.row_number().over(W.partitionBy("doc_id").orderBy("n_tokens")))
    whole = long.select("doc_id", "copy", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_tokens") / capacity) - 1)).alias("i"))
    whole = whole.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("i").cast("string"), F.lit("-"), F.col("copy").cast("string")).alias("sequence_id"), F.lit(0).alias("position"), "doc_id", (F.col("i") * capacity).alias("start_token"), F.lit(capacity).cast("bigint").alias("n_tokens"))
    rest = counts.where(F.col("n_tokens") % capacity != 0).select((F.col("n_tokens") - F.col("n_tokens") % capacity).alias("start_token"), (F.col("n_tokens") % capacity).alias("n"), "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(groups)).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group -> their places."""

        def fill(g: int, rows: list) -> Iterator[pa.RecordBatch]:
            out = [(f"g{g}-{b}", p, *rows[i][:2], rows[i][2]) for b, held in enumerate(best_two_fit([r[2] for r in rows], capacity)) for p, i in enumerate(held)]
            for i in range(0, len(out), 50_000):
                cols = list(zip(*out[i : i + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], doc_type), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["sequence_id", "position", "doc_id", "start_token", "n_tokens"])

        now, rows, doc_type = None, [], pa.string()
        for batch in batches:
            doc_type = batch.column(1).type
            for g, d, s, k in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if g != now and rows:
                    yield from fill(now, rows)
                    rows = []
                now = g
                rows.append((d, s, k))
        if rows:
            yield from fill(now, rows)

    placed = rest.repartition(min(groups, 4 * spark.sparkContext.defaultParallelism), "g").sortWithinPartitions("g", "doc_id", "start_token").select("g", "doc_id", "start_token", "n").mapInArrow(run, f"sequence_id string, position int, doc_id {kind}, start_token bigint, n_tokens bigint")
    return whole.unionByName(placed)
