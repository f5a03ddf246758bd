"""Groups from pairwise matches: union-find on a two-dimensional grid.

Vertices are hashed into ``B`` blocks; an edge belongs to the cell (block of one
end, block of the other). Each round every cell runs a local union-find and
reports, for each of its vertices, the smallest vertex it is connected to inside
the cell. A vertex is reported by at most the 2B-1 cells of its row and column;
they exchange these representatives: the smallest becomes the vertex's parent,
parents are followed until they are stable, and the other representatives are tied
to them by new edges. A vertex that has a parent leaves the
graph, so every round shrinks it, and the rounds end when no edge is left. The
parents are then followed back from the last round to the first.

A vertex with a third of all edges is spread over the B cells of its row, and a cell
that holds more than ``CELL_EDGES`` all the same is cut by the hash of its edges into so
many parts that none does. What is exchanged for a vertex is a row a part, reduced
to the smallest before it is shuffled, whatever its degree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Scratch

#: Edges a cell should hold; the grid has ceil(sqrt(edges / CELL_EDGES)) blocks a side.
CELL_EDGES = 100_000


class UnionFind:
    """Components of the edges added so far; the smaller root wins, paths are halved on the way."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def add(self, u, v) -> None:
        ru, rv = self.find(u), self.find(v)
        if ru < rv:
            self.parent[rv] = ru
        elif rv < ru:
            self.parent[ru] = rv


def local_components(a: list, b: list) -> dict:
    """Vertex -> smallest vertex connected to it by these edges."""
    found = UnionFind()
    for u, v in zip(a, b):
        found.add(u, v)
    return {x: found.find(x) for x in list(found.parent)}


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges sorted by cell -> (vertex, representative) of each cell, representatives themselves left out.

    Edges are taken up as they come; what is held is one entry a vertex of one cell.
    """

    def done(found: UnionFind) -> Iterator[pa.RecordBatch]:
        v, rep = [], []
        for x in list(found.parent):
            if (r := found.find(x)) != x:
                v.append(x)
                rep.append(r)
                if len(v) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()), pa.array(rep, pa.string())], names=["v", "rep"])
                    v, rep = [], []
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()), pa.array(rep, pa.string())], names=["v", "rep"])

    cell, found = None, UnionFind()
    for batch in batches:
        for c, u, v in zip(*(batch.column(n).to_pylist() for n in ("cell", "u", "v"))):
            if c != cell and cell is not None:
                yield from done(found)
                found = UnionFind()
            cell = c
            found.add(u, v)
    yield from done(found)


def _stable(scratch: Scratch, parents: DataFrame) -> tuple[DataFrame, str]:
    """Every vertex's parent followed to one that has none, by doubling."""
    current, path = scratch.write(parents)
    while True:
        up = current.select(F.col("v").alias("parent"), F.col("parent").alias("above"))
        nxt, nxt_path = scratch.write(current.join(up, "parent", "left").select("v", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        scratch.drop(path)
        if nxt.where("moved").limit(1).count() == 0:
            return nxt.select("v", "parent"), nxt_path
        current, path = nxt.select("v", "parent"), nxt_path


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", cell_edges: int = CELL_EDGES) -> DataFrame:
    """(record_id, group_id) for every vertex of ``edges`` that has another vertex in its group.

    ``group_id`` is the smallest vertex of the group by string comparison. Direction,
    repetition and order of edges don't matter; self-pairs and edges with a null end
    link nothing. An empty table gives an empty result. Other columns aren't read.
    """
    scratch = Scratch(spark, "components")
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    pairs = edges.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    current, path = scratch.write(pairs)
    rounds: list[DataFrame] = []
    while (n := current.count()) > 0:
        blocks = max(1, math.ceil(math.sqrt(n / cell_edges)))
        block = lambda c: F.pmod(F.xxhash64(F.lit(len(rounds)), c), F.lit(blocks))  # noqa: B023, E731
        celled = current.select((block("u") * blocks + block("v")).alias("cell"), "u", "v")
        # cells over the limit, as those of a hub's row are, in parts
        full = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_edges).cast("int").alias("parts")).where("parts > 1")
        if not full.isEmpty():
            part = F.coalesce(F.pmod(F.xxhash64("u", "v"), F.col("parts")), F.lit(0))
            celled = celled.join(full, "cell", "left").select(F.xxhash64("cell", part).alias("cell"), "u", "v")
        local, local_path = scratch.write(celled.repartition(4 * spark.sparkContext.defaultParallelism, "cell").sortWithinPartitions("cell").mapInArrow(_cells, "v string, rep string"))
        parents, _ = _stable(scratch, local.groupBy("v").agg(F.min("rep").alias("parent")))
        rounds.append(parents)
        rest = local.join(parents, "v").select("parent", "rep").where(F.col("rep") != F.col("parent")).distinct()
        root_of_rep = parents.select(F.col("v").alias("rep"), F.col("parent").alias("root"))
        rest = rest.join(root_of_rep, "rep", "left").select("parent", F.coalesce("root", "rep").alias("rep")).where(F.col("rep") != F.col("parent"))
        ahead, ahead_path = scratch.write(rest.select(F.least("parent", "rep").alias("u"), F.greatest("parent", "rep").alias("v")).distinct())
        scratch.drop(path)
        scratch.drop(local_path)
        current, path = ahead, ahead_path
    if not rounds:
        return spark.createDataFrame([], "record_id string, group_id string")
    label = rounds[-1].select("v", F.col("parent").alias("root"))
    for parents in reversed(rounds[:-1]):
        later = label.select(F.col("v").alias("parent"), "root")
        label = parents.join(later, "parent", "left").select("v", F.coalesce("root", "parent").alias("root")).unionByName(label)
    label, _ = scratch.write(label)
    members = label.select(F.col("v").alias("record_id"), F.col("root").alias("group_id"))
    return members.unionByName(members.select(F.col("group_id").alias("record_id"), "group_id").distinct())
