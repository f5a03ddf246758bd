"""Non-destructive cross-document resolution of graph nodes by vectors, names and context."""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cosine, is_generic, jaccard, match_confidence, name_normalise, name_score, seq_ratio
from ..shared import Scratch

# Label -> property that names a node of it; roles that recur across cases and identify with a name.
RESOLVABLE = {"Person": "name", "Location": "name", "Weapon": "type", "Vehicle": "type", "CrimeType": "name"}
DISTINCTIVE_ROLES = ("officer", "forensic_analyst", "judge", "examiner")


#: Rows of a tile of nearest neighbours; bytes of the vectors of a tile of pairs.
TILE, TILE_BYTES = 2_000, 16_000_000
#: Rows by columns of one product; leading numbers of a vector from which its products are bounded first.
PRODUCT, LEAD = (1_024, 8_192), 32
#: Found pairs put together by what is said of their ends at once; the most of them in one row.
TOGETHER, ROW = 262_144, 8_192
#: Distinct names of a label up to which each is compared with each before any vector is.
NAMES = 1_000
#: Links of a block that one task puts together; it holds an entry for each node of them.
LINKS = 1_000_000


def _products(x: np.ndarray, a: np.ndarray, b: np.ndarray | None, floor: float):
    """(i, j) of rows of ``a`` and ``b`` (if None: of ``a`` and what comes after in ``a``'s whole order) whose product may reach ``floor``.

    ``x`` has unit rows. The leading numbers and the length of the rest bound a product from above (Cauchy and
    Schwarz); where that leaves out little, the whole product is taken.
    """
    low = np.float32(floor - 2e-7 * (x.shape[1] + 8))
    bound = np.hstack([x[:, :LEAD], np.linalg.norm(x[:, LEAD:], axis=1, keepdims=True)]) if x.shape[1] > LEAD + 8 else x
    rows, order = a, (a if b is None else b)
    for s in range(0, len(rows), PRODUCT[0]):
        i = rows[s : s + PRODUCT[0]]
        for c in range(s if b is None else 0, len(order), PRODUCT[1]):
            j = order[c : c + PRODUCT[1]]
            p, q = np.nonzero(bound[i] @ bound[j].T >= low)
            if bound is not x and len(p) > 0.02 * len(i) * len(j):
                p, q = np.nonzero(x[i] @ x[j].T >= low)
            if b is None:
                after = q + c > p + s
                p, q = p[after], q[after]
            yield i[p], j[q]


def similar(nodes: DataFrame, floor: float = 0.78, new: DataFrame | Column | None = None, block: list[str] | None = None, tile: int | None = None) -> DataFrame:
    """(a_eid, b_eid, cos): pairs of one label and different documents with cosine of at least ``floor``; of ``new`` (rows by eid, or a condition) against all if given.

    ``nodes``: eid, label, doc, emb; eid is unique. Exact: a block (label and the columns of ``block``)
    is cut into tiles of ``TILE_BYTES`` (of ``tile`` rows if given) and every two tiles of it are multiplied in
    one task, so no task holds more than two tiles, however large the block. Each row is
    sent to as many tasks as its block has tiles: give ``block`` columns where labels are large.
    """

    def multiply(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        out = list(_pairs(t, floor))
        first, second, cos = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"a_eid": t.column("eid").take(first).cast(pa.string()), "b_eid": t.column("eid").take(second).cast(pa.string()), "cos": pa.array(cos, pa.float64())})

    return _sent(_placed(nodes, new, block, tile), "doc", "emb").groupBy("blk", "ti", "tj").applyInArrow(multiply, "a_eid string, b_eid string, cos double")


def _placed(nodes: DataFrame, new: DataFrame | Column | None, block: list[str] | None, tile: int | None, *rest: str) -> DataFrame:
    """Rows with a vector, their block, its number of tiles (the first ``news`` hold the new rows) and their own tile; ``rest``: further columns kept."""
    held = nodes.where("emb is not null")
    if isinstance(new, DataFrame):
        held = held.join(new.select("eid", F.lit(True).alias("fresh")), "eid", "left")
    else:
        held = held.withColumn("fresh", F.lit(True) if new is None else new)
    rows = held.select("eid", "doc", "emb", F.xxhash64("label", *(block or [])).alias("blk"), F.coalesce("fresh", F.lit(False)).alias("fresh"), *rest)
    parts = lambda n: n / tile if tile else n * F.least(F.max(F.size("emb")) * 4, F.lit(TILE_BYTES)) / TILE_BYTES
    of = lambda n: F.when(n > 0, F.greatest(F.ceil(parts(n)), F.lit(1))).otherwise(0).cast("int")
    sizes = rows.groupBy("blk").agg(of(F.count_if("fresh")).alias("news"), of(F.count_if(~F.col("fresh"))).alias("olds"))
    # written, so that its size is known and no vector is shuffled to meet it where it is small
    sizes = Scratch(nodes.sparkSession, "tiles").write(sizes)[0] if block else F.broadcast(sizes)
    sizes = sizes.where("news > 0").select("blk", "news", (F.col("news") + F.col("olds")).alias("tiles"))
    mine = lambda n: F.pmod(F.xxhash64("eid"), n).cast("int")
    return rows.join(sizes, "blk").withColumn("mine", F.when(F.col("fresh"), mine(F.col("news"))).otherwise(F.col("news") + mine(F.col("tiles") - F.col("news"))))


def _sent(placed: DataFrame, *rest: str) -> DataFrame:
    """Each row once for every two tiles that it takes part in: of two that hold no new row, none."""
    last = F.when(F.col("fresh"), F.col("tiles")).otherwise(F.col("news")) - 1
    return placed.withColumn("with", F.explode(F.sequence(F.lit(0), last))).select("blk", F.least("mine", "with").alias("ti"), F.greatest("mine", "with").alias("tj"), "mine", "eid", "fresh", *rest)


def _pairs(t: pa.Table, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the smaller eid, rows of the greater, cosines) of the pairs of two tiles, some at a time."""
    emb = t.column("emb").combine_chunks()
    flat = emb.flatten().to_numpy(zero_copy_only=False)
    lengths = emb.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of one block differ in length")
    raw = flat.reshape(len(t), -1)
    norm = np.concatenate([np.linalg.norm(raw[s : s + 8_192].astype(np.float64), axis=1, keepdims=True) for s in range(0, len(raw), 8_192)])
    unit = lambda i: np.divide(raw[i].astype(np.float64), norm[i], out=np.zeros((len(i), raw.shape[1])), where=norm[i] > 0)
    x = np.concatenate([unit(np.arange(s, min(s + 8_192, len(raw)))).astype(np.float32) for s in range(0, len(raw), 8_192)])
    mine, fr, ti, tj = (t.column(c).to_numpy() for c in ("mine", "fresh", "ti", "tj"))
    # numbers in place of texts: equal for equal documents, in the order of eid
    doc = _codes(t.column("doc"))[0]
    rank = np.empty(len(t), np.int64)
    rank[pc.sort_indices(t.column("eid")).to_numpy()] = np.arange(len(t))
    fr = fr.astype(bool)
    if ti[0] == tj[0]:
        # new rows first: each meets what comes after it
        order, fresh = np.argsort(~fr, kind="stable"), int(fr.sum())
        runs = [(order[:fresh], None), (order[:fresh], order[fresh:])]
    else:
        a, b = np.flatnonzero(mine == ti[0]), np.flatnonzero(mine != ti[0])
        runs = [(a[fr[a]], b), (a[~fr[a]], b[fr[b]])]
    for a, b in runs:
        for i, j in _products(x, a, b, floor):
            for s in range(0, len(i), 65_536):
                p, q = i[s : s + 65_536], j[s : s + 65_536]
                keep = doc[p] != doc[q]
                p, q = p[keep], q[keep]
                cos = np.einsum("ij,ij->i", unit(p), unit(q))
                keep = cos >= floor
                p, q, cos = p[keep], q[keep], cos[keep]
                swap = rank[p] > rank[q]
                yield np.where(swap, q, p), np.where(swap, p, q), cos


def _met(t: pa.Table) -> pa.Table:
    """The rows with a vector, each with doc and said of the row without one that has its eid and sign."""
    vectors, words = t.filter(pc.is_valid(t.column("emb"))), t.filter(pc.is_null(t.column("emb")))
    if len(vectors) != len(words):
        raise ValueError("a node's vector and words were not read alike")
    by = lambda x: pc.sort_indices(x.select(["eid", "sign"]), [("eid", "ascending"), ("sign", "ascending")]).to_numpy()
    at = np.empty(len(vectors), np.int64)
    at[by(vectors)] = by(words)
    words = words.select(["doc", "said"]).take(at).combine_chunks()
    return vectors.drop_columns(["doc", "said", "sign"]).append_column("doc", words.column("doc")).append_column("said", words.column("said"))


def _codes(c: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each text (-1 for null), and the texts by number."""
    d = c.combine_chunks().dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _stars(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least of its component, node) of every node but the least: what links the nodes that the pairs link."""
    nodes, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    i, j, low = at[: len(p)], at[len(p) :], np.arange(len(nodes))
    while len(i):
        np.minimum.at(low, np.maximum(i, j), np.minimum(i, j))
        while (low[low] != low).any():
            low = low[low]
        i, j = low[i], low[j]
        i, j = i[i != j], j[i != j]
    other = low != np.arange(len(nodes))
    return nodes[low[other]], nodes[other]


def alike(nodes: DataFrame, facts: DataFrame, key: str, floor: float = 0.78, new: DataFrame | Column | None = None, block: list[str] | None = None, tile: int | None = None, give: str = "pairs") -> DataFrame:
    """The pairs of ``similar`` as rows for ``decide`` (blk: a number of their block, a_label, a_norm, a_role, a_ctx, the same of b, ratio) that hold many pairs each.

    ``nodes``: eid, label, doc, norm, emb and ``key``, by which ``facts`` has ``told`` (array of w, only: a value, and
    the one node that has it if no other does) and ``roles`` (map of node to role). Pairs of whose ends the same is said
    are decided alike, so they are one row as far as one task finds them together; no pair is written or shuffled.
    ``give``: 'pairs' has ``ends`` (array of a_eid, b_eid); 'count' their number ``n``; 'stars' ``ends`` that link
    the same nodes by fewer pairs.
    """
    placed = _placed(nodes, new, block, tile, "label", "norm", key).withColumn("sign", F.hash("doc", "label", "norm", "emb"))
    told = F.transform(F.filter("told", lambda x: x["only"].isNull() | (x["only"] != F.col("eid"))), lambda x: x["w"])
    ctx = F.array_sort(F.coalesce(told, F.array().cast("array<string>")))
    said = F.to_json(F.struct("label", "norm", F.try_element_at("roles", F.col("eid")).alias("role"), ctx.alias("ctx")))
    place, none = ["blk", "news", "tiles", "mine", "eid", "fresh", "sign"], F.lit(None)
    # a vector is shuffled once, to its tasks; what is said of its node comes to meet it there
    # in a row of its own, written before, so that the shuffles by ``key`` are gone by then
    words, _ = Scratch(nodes.sparkSession, "words").write(placed.drop("emb").join(facts, key, "left").select(*place, "doc", said.alias("said")), clear=True)
    both = placed.select(*place, none.cast("string").alias("doc"), none.cast("string").alias("said"), "emb").unionByName(words.withColumn("emb", none.cast(nodes.schema["emb"].dataType)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _met(pa.Table.from_batches(list(batches)))
        said, texts = _codes(t.column("said"))
        blk, eid, norms, known = t.column("blk")[0].as_py(), t.column("eid").combine_chunks().cast(pa.string()), [json.loads(x)["norm"] for x in texts.to_pylist()], {}

        def ratio(a: str, b: str) -> float:
            if (a, b) not in known:
                known[a, b] = 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
            return known[a, b]

        def rows(held: list[tuple]) -> pa.RecordBatch:
            p, q = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            if give == "stars":
                kinds, at = np.unique(said[p] * len(texts) + said[q], return_inverse=True)
                p, q = _stars(at * len(t) + p, at * len(t) + q)
                kind, p, q = kinds[p // len(t)], p % len(t), q % len(t)
            else:
                kind = said[p] * len(texts) + said[q]
            order = np.argsort(kind, kind="stable")
            kind, p, q = kind[order], p[order], q[order]
            starts = np.union1d(np.flatnonzero(np.diff(kind, prepend=-1)), np.arange(0, len(kind), ROW))
            a, b = kind[starts] // len(texts), kind[starts] % len(texts)
            ends = [*starts.tolist(), len(kind)]
            columns = {"blk": pa.array(np.full(len(starts), blk), pa.int64()), "a_said": texts.take(pa.array(a)), "b_said": texts.take(pa.array(b)), "ratio": pa.array([ratio(norms[i], norms[j]) for i, j in zip(a.tolist(), b.tolist())], pa.float64())}
            if give == "count":
                columns["n"] = pa.array(np.diff(ends), pa.int64())
            else:
                columns["ends"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([eid.take(pa.array(p)), eid.take(pa.array(q))], ["a_eid", "b_eid"]))
            return pa.RecordBatch.from_pydict(columns)

        held, n = [], 0
        for p, q, _ in _pairs(t, floor):
            held.append((p, q))
            n += len(p)
            if n >= TOGETHER:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    found = _sent(both, "sign", "doc", "said", "emb").groupBy("blk", "ti", "tj").applyInArrow(multiply, "blk bigint, a_said string, b_said string, ratio double, " + ("n bigint" if give == "count" else "ends array<struct<a_eid: string, b_eid: string>>"))
    kind = "label string, norm string, role string, ctx array<string>"
    read = found.withColumns({p: F.from_json(f"{p}_said", kind) for p in ("a", "b")})
    return read.select("blk", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("a", "b") for c in ("label", "norm", "role", "ctx")], "ratio", "n" if give == "count" else "ends")


def _linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blk, x, y) of links of whole blocks in turn or mixed -> (blk, least of those linked to y, y), y each of them but the least."""
    blocks: dict[int, dict[str, str]] = {}

    def top(up: dict[str, str], x: str) -> str:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for batch in batches:
        for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            up = blocks.setdefault(k, {})
            if (a := top(up, a)) != (b := top(up, b)):
                up[max(a, b)] = min(a, b)
    for k, up in blocks.items():
        # nodes of one group together, so that a written table of them compresses
        below = sorted((x, y) for y in list(up) if (x := top(up, y)) != y)
        for s in range(0, len(below), 65_536):
            x, y = zip(*below[s : s + 65_536])
            yield pa.RecordBatch.from_pydict({"blk": pa.array([k] * len(x), pa.int64()), "x": pa.array(x, pa.string()), "y": pa.array(y, pa.string())})


def groups(pairs: DataFrame, most: int = LINKS) -> DataFrame:
    """(node_id, component): the smallest eid each node is linked to by the ``ends`` of ``pairs`` (of ``alike``).

    The links of each task are reduced to at most one a node and written, which ends the shuffles of vectors. No pair lies in two blocks,
    so a block of up to ``most`` such links is put together in one task; only larger ones go through ``graph.components``, and all do if a node lies in
    several blocks, as repeated ids of different names may.
    """
    from .graph import components

    spark, kind = pairs.sparkSession, "blk bigint, x string, y string"
    scratch = Scratch(spark, "links")
    links, _ = scratch.write(pairs.select("blk", F.explode("ends").alias("e")).select("blk", "e.*").mapInArrow(_linking, kind), clear=True)
    large = [r.blk for r in links.groupBy("blk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("blk").collect()]
    inside = ~F.col("blk").isin(large) if large else F.lit(True)
    whole, _ = scratch.write(links.where(inside).groupBy("blk").applyInArrow(_linking, kind), clear=True)
    found = whole.select(F.col("y").alias("node_id"), F.col("x").alias("component")).unionByName(whole.select("blk", F.col("x").alias("component")).distinct().select(F.col("component").alias("node_id"), "component"))
    if large:
        found = found.unionByName(components(spark, links.where(~inside).select("x", "y")))
    if not found.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return components(spark, whole.unionByName(links.where(~inside)).select("x", "y"))
    return found


def beside(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with what ``nodes`` says of both ends."""
    rest = [c for c in nodes.columns if c not in ("emb", "eid")]
    side = lambda p: nodes.select(F.col("eid").alias(f"{p}_eid"), *[F.col(c).alias(f"{p}_{c}") for c in rest])
    return found.join(side("a"), "a_eid").join(side("b"), "b_eid")


def candidates(nodes: DataFrame, floor: float = 0.78, new: DataFrame | None = None, block: list[str] | None = None, tile: int | None = None) -> DataFrame:
    """``similar`` pairs of ``nodes`` (eid, label, doc, norm, role, emb, ctx) beside their columns."""
    return beside(similar(nodes, floor, new, block, tile), nodes)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, tile: int = TILE) -> DataFrame:
    """(q, key, cos): the ``k`` other rows of highest cosine for each query, ties by key. Exact.

    Queries and rows are cut into tiles by number; every tile of one meets every tile of the
    other in one task, which passes on the best ``k`` of each query.
    """
    from pyspark.sql import Window as W

    # an upper bound of each side's tiles from its size
    parts = lambda df: max(1, -(-df.count() // tile))
    nq, nr = parts(queries), parts(rows)
    place = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    side = lambda df, mine, other, n, m, ask: df.select(F.lit(ask).alias("ask"), F.col(key).alias("key"), F.col(vector).alias("emb"), place(n).alias(mine), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)).select("ask", "key", "emb", "tq", "tr")
    both = side(queries, "tq", "tr", nq, nr, True).unionByName(side(rows, "tr", "tq", nr, nq, False))
    kind = rows.schema[key].dataType.simpleString()

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["emb"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        ask, keys = pdf["ask"].to_numpy(bool), pdf["key"].to_numpy()
        pool, out = keys[~ask], []
        cos = np.round(x[ask] @ x[~ask].T, 9)
        for q, c in zip(keys[ask], cos):
            at = np.lexsort((pool, -c))[: k + 1]
            at = at[pool[at] != q][:k]
            out.append(pd.DataFrame({"q": q, key: pool[at], "cos": c[at]}))
        return pd.concat(out) if out else pd.DataFrame({"q": keys[:0], key: keys[:0], "cos": np.zeros(0)})

    found = both.groupBy("tq", "tr").applyInPandas(best, f"q {kind}, {key} {kind}, cos double")
    w = W.partitionBy("q").orderBy(F.desc("cos"), key)
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _scored(pairs: DataFrame, name_threshold: float) -> DataFrame:
    """``pairs`` of a_norm, b_norm with their name score as ``s``; of their ``ratio`` where they have it."""
    if "ratio" in pairs.columns:
        return pairs.withColumn("s", name_score(F.col("a_norm"), F.col("b_norm"), F.col("ratio")))
    short = 2.0 * F.least(F.length("a_norm"), F.length("b_norm")) >= name_threshold * F.greatest(F.length("a_norm") + F.length("b_norm"), F.lit(1))
    words = lambda c: F.split(F.col(c), " ")
    inside = (F.size(F.array_except(words("a_norm"), words("b_norm"))) == 0) | (F.size(F.array_except(words("b_norm"), words("a_norm"))) == 0)
    # the ratio is only computed where its bound reaches the threshold or the name may count as contained
    scored = pairs.withColumn("ratio", F.coalesce(seq_ratio(F.when(short | inside, F.col("a_norm")), F.col("b_norm")), F.lit(0.0)))
    return scored.withColumn("s", name_score(F.col("a_norm"), F.col("b_norm"), F.col("ratio")))


def name_groups(nodes: DataFrame, name_threshold: float = 0.88, most: int = NAMES) -> DataFrame:
    """``nodes`` (label, norm, ...) with ``grp``: names of a label that reach the threshold, directly or by way of others, share it.

    So no pair that ``decide`` accepts lies in two groups. A label of more than ``most`` distinct names is one group.
    """
    from .graph import components

    spark = nodes.sparkSession
    scratch = Scratch(spark, "names")
    names, _ = scratch.write(nodes.select("label", "norm").distinct())
    few, _ = scratch.write(names.groupBy("label").agg(F.count(F.lit(1)).alias("names")).where(F.col("names") <= most).select("label"))
    held = names.join(few, "label")
    side = lambda p: held.select("label", F.col("norm").alias(f"{p}_norm"))
    # the ratio depends on the order of the two
    pairs = _scored(side("a").join(side("b"), "label").where("a_norm <> b_norm"), name_threshold).where(F.col("s.score") >= name_threshold)
    key = lambda c: F.concat("label", F.lit("\n"), c)
    linked = components(spark, pairs.select(key("a_norm").alias("x"), key("b_norm").alias("y")))
    alike, _ = scratch.write(held.withColumn("node_id", key("norm")).join(linked, "node_id").select("label", "norm", "component"))
    out = nodes.join(few.withColumn("few", F.lit(True)), "label", "left").join(alike, ["label", "norm"], "left")
    return out.withColumn("grp", F.when(F.col("few"), F.coalesce("component", key("norm")))).drop("few", "component")


def decide(pairs: DataFrame, name_threshold: float = 0.88) -> DataFrame:
    """Name score, context overlap, decision, confidence and its basis for candidate pairs.

    Accepted: a name score of the threshold. A name that says little (of one word, or with initials
    in conflict) also needs shared context or a distinctive role in common. The basis is
    'name', with '+context' and '+role' where these speak for it, else why not.
    """
    scored = _scored(pairs, name_threshold).withColumn("overlap", jaccard(F.col("a_ctx"), F.col("b_ctx")))
    same_role = F.coalesce((F.col("a_role") == F.col("b_role")) & (F.col("a_role") != ""), F.lit(False))
    distinctive = same_role & F.col("a_role").isin(*DISTINCTIVE_ROLES)
    vague = (F.col("s.min_tokens") < 2) | F.col("s.conflict")
    named, backed = F.col("s.score") >= name_threshold, distinctive | (F.col("overlap") > 0)
    reason = F.when(~named, "").when(F.col("s.conflict"), "conflicting-initials-no-corroboration").otherwise("ambiguous-name-no-corroboration")
    basis = F.concat(F.lit("name"), F.when(F.col("overlap") > 0, "+context").otherwise(""), F.when(distinctive, "+role").otherwise(""))
    scored = scored.withColumn("accepted", named & (~vague | backed))
    confidence = F.round(match_confidence(F.col("s.score"), F.col("overlap"), same_role.cast("double")), 3)
    return scored.withColumn("confidence", F.when(F.col("accepted"), confidence).otherwise(0.0)).withColumn("basis", F.when(F.col("accepted"), basis).otherwise(reason))


def prepare(nodes: DataFrame, value: str) -> DataFrame:
    """Nodes with a normalised name that says something; titles and roles are only taken off persons."""
    named = nodes.withColumn("norm", name_normalise(F.col(value), F.col("label") == "Person"))
    return named.where(F.col("norm").isNotNull() & ~is_generic(F.col("norm")))


def deduplicate(entities: DataFrame, known: DataFrame, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(new entities, id map, remapped relations): the first of a batch by type and lower-case name, unless the graph has it."""
    from pyspark.sql import Window as W

    named = entities.withColumn("k", F.lower("name"))
    w = W.partitionBy("entity_type", F.coalesce("k", "entity_id")).orderBy("ordinal")
    first = named.withColumn("keep_id", F.first("entity_id").over(w)).withColumn("rn", F.row_number().over(w))
    have = known.select("entity_type", F.lower("name").alias("k"), F.col("entity_id").alias("known_id")).dropDuplicates(["entity_type", "k"])
    all_ = first.join(have, ["entity_type", "k"], "left").withColumn("new_id", F.coalesce("known_id", "keep_id"))
    ids = all_.select(F.col("entity_id").alias("old_id"), "new_id")
    fresh = all_.where("rn = 1 and known_id is null").select("entity_type", "entity_id", "name", "ordinal")
    if relations is None:
        return fresh, ids, None
    from .graph import remap

    return fresh, ids, remap(relations, ids)
