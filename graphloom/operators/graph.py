"""Traversal, lookup and upsert over node and edge frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Scratch

INTERNAL = ("embedding", "embed_text")


def strip_internal(props: Column, names: tuple[str, ...] = INTERNAL) -> Column:
    return F.map_filter(props, lambda k, v: ~k.isin(*names))


def undirected(edges: DataFrame) -> DataFrame:
    """(x, y): every edge both ways, once."""
    return edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(edges.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct()


#: Rows of a frontier up to which it is sent to all executors instead of shuffling the edges.
BROADCAST_ROWS = 200_000


def reach(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(node_id, hops) of all nodes within ``depth`` undirected hops of ``start.node_id``, with the fewest hops.

    Level-synchronous: each level joins the frontier with the edges and leaves out what is
    known. A level is written down and counted, so no level is computed twice, and a small
    frontier meets the edges in a broadcast join that leaves them where they are; a large
    one in a shuffle join. Repeated edges do no harm.
    """
    scratch = Scratch(start.sparkSession, "reach")
    # edges may be a view over large tables: it is computed once
    one, _ = scratch.write(edges.select(F.col("src").alias("x"), F.col("dst").alias("y")))
    both = one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y")))
    seen, _ = scratch.write(start.select("node_id").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        n = frontier.count()
        if not n:
            break
        near = frontier.select(F.col("node_id").alias("x"))
        ahead = both.join(F.broadcast(near) if n <= BROADCAST_ROWS else near, "x").select(F.col("y").alias("node_id")).distinct()
        frontier, _ = scratch.write(ahead.join(seen.select("node_id"), "node_id", "left_anti").withColumn("hops", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def induced(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """The edges both of whose ends are among ``node_ids.node_id``."""
    ids = node_ids.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


#: Rows of either side of a common value that meet in one task, and rows of one side that are written in turn.
PAIR_TILE, PAIR_RUN = 4_096, 512


def equal_pairs(new: DataFrame, rows: DataFrame, keys: list[str], tile: int = PAIR_TILE, run: int = PAIR_RUN) -> DataFrame:
    """``new`` joined with ``rows`` on equal ``keys``; the other columns of the two differ in name.

    For values so common that the pairs outnumber the rows by far. Both sides of a value are cut
    into tiles and each two tiles meet in a task of their own, so no value is one task. A
    task pairs every row of its tile of ``rows`` with a short run of ``new``, then with the next
    run: one column of a written result stands still while the other repeats, so few distinct values
    lie in a file and their repetitions compress.
    """
    spark = new.sparkSession
    rest = lambda df: [c for c in df.columns if c not in keys]
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    tiles = lambda n: F.ceil(F.col(n) / tile).cast("int")
    sizes, _ = Scratch(spark, "pairs").write(count(new, "n").join(count(rows, "m"), keys).select(*keys, tiles("n").alias("nt"), tiles("m").alias("mt"), (F.col("n").cast("double") * F.col("m")).alias("pairs")))
    total = sizes.agg(F.sum("pairs")).first()[0] or 0
    parts = int(min(20_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // tile**2)))
    place = lambda df, n, seed: F.pmod(F.xxhash64(F.lit(seed), *rest(df)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    runs = new.join(sizes, keys).withColumn("i", place(new, F.col("nt"), 0)).withColumn("r", place(new, F.lit(-(-tile // run)), 1)).groupBy(*keys, "mt", "i", "r").agg(F.collect_list(F.struct(*rest(new))).alias("run")).withColumn("j", every("mt"))
    ends = rows.join(sizes, keys).withColumn("j", place(rows, F.col("mt"), 0)).withColumn("i", every("nt"))
    on = [*keys, "i", "j"]
    met = runs.select(*on, "run").repartition(parts, *on).hint("merge").join(ends.select(*on, *rest(rows)).repartition(parts, *on), on)
    return met.select(*keys, *rest(rows), F.inline("run"))


def prefer(frames: list[DataFrame], key: str) -> DataFrame:
    """Per key the rows of the first frame that has any."""
    ranked = None
    for i, f in enumerate(frames):
        f = f.withColumn("priority", F.lit(i))
        ranked = f if ranked is None else ranked.unionByName(f)
    w = W.partitionBy(key).orderBy("priority")
    return ranked.withColumn("r", F.rank().over(w)).where("r = 1").drop("r", "priority")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def upsert_nodes(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge on (label, key): properties given overwrite, others stay, nulls never overwrite.

    ``updates`` may hold several rows a key; later ``ordinal`` wins property by property.
    """
    clean = updates.where(F.col("key").isNotNull() & F.col("label").rlike("^[A-Za-z_][A-Za-z0-9_]*$")).withColumn("props", F.map_filter("props", lambda k, v: v.isNotNull()))
    kv = clean.select("label", "key", "ordinal", F.explode_outer("props").alias("k", "v")).groupBy("label", "key", "k").agg(F.max_by("v", "ordinal").alias("v"))
    new = kv.groupBy("label", "key").agg(F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("new_props"))
    both = existing.join(new, ["label", "key"], "full_outer")
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_from_entries(F.array_union(F.filter(F.map_entries(F.coalesce("props", empty)), lambda e: ~F.map_contains_key(F.coalesce("new_props", empty), e["key"])), F.map_entries(F.coalesce("new_props", empty))))
    return both.select("label", "key", merged.alias("props"), F.col("props").isNull().alias("created"))


def upsert_edges(existing: DataFrame, updates: DataFrame, nodes: DataFrame, by_props: bool = True) -> DataFrame:
    """Edges after a merge: both ends must exist; identity is (src, type, props, dst), or (src, type, dst) with the last props."""
    ids = nodes.select("node_id").distinct()
    valid = updates.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    all_edges = existing.withColumn("ordinal", F.lit(-1)).unionByName(valid, allowMissingColumns=True)
    if by_props:
        return all_edges.withColumn("h", F.sha2(F.to_json("props"), 256)).groupBy("src", "type", "dst", "h").agg(F.first("props").alias("props")).drop("h")
    return all_edges.groupBy("src", "type", "dst").agg(F.max_by("props", "ordinal").alias("props"))


def unique_violations(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with ends replaced through ``ids`` (old_id, new_id)."""
    a, b = ids.select(F.col("old_id").alias("src"), F.col("new_id").alias("a")), ids.select(F.col("old_id").alias("dst"), F.col("new_id").alias("b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "type")


def components(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(node_id, component): the smallest id each node is linked to, by alternating large and small stars.

    ``pairs`` has x, y. Each round is two joins by vertex; lineage is cut by tables in the
    shared folder. A vertex of huge degree is aggregated to its minimum before any join.
    """
    scratch = Scratch(spark, "stars")
    # equal sums of the edges' hashes and equal counts: nothing has changed
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    current, path = scratch.write(pairs.where("x is not null and y is not null and x <> y").select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("u")).distinct())
    before = digest(current)
    while True:
        # large star: greater neighbours go to the smallest neighbour
        sym = current.unionByName(current.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = sym.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = sym.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: smaller neighbours go to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        nxt, nxt_path = scratch.write(small)
        after = digest(nxt)
        scratch.drop(path)
        current, path = nxt, nxt_path
        if after == before:
            break
        before = after
    members = current.select(F.col("v").alias("node_id"), F.col("u").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node_id"), "component").distinct())
