"""Clauses to DataFrames.

A row of the running frame has one STRUCT column a variable: nodes carry node_id,
label, key, name and props, relationships edge_id, src, dst and type. A pattern is a
chain of equi-joins; a property or label given in the pattern filters the scan below
its join; relationships bound in one MATCH differ pairwise. Variable-length patterns are
breadth-first levels with set semantics. Grouping keys are the items without aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch
from .guard import is_destructive
from .parser import CypherError, Match, Node, Projection, Rel, Unwind, parse

#: Rows a query without LIMIT returns at most, unless the caller says otherwise.
DEFAULT_LIMIT = 50
COLUMNS = ("node_id", "label", "key", "name", "props")


@dataclass
class Graph:
    """Nodes (node_id, label, key, name, props) and edges (src, dst, type)."""

    nodes: DataFrame
    edges: DataFrame


AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


def aggregated(e) -> bool:
    if isinstance(e, tuple):
        return (e[0] == "fn" and e[1] in AGGREGATES) or any(aggregated(x) for x in e[1:])
    if isinstance(e, (list, dict)):
        return any(aggregated(x) for x in (e.values() if isinstance(e, dict) else e))
    return False


class Compiler:
    def __init__(self, graph: Graph, params: dict) -> None:
        self.g, self.params, self.n = graph, params, 0

    def fresh(self) -> str:
        self.n += 1
        return f"_c{self.n}"

    # expressions
    def col(self, e: tuple, local: dict[str, Column] | None = None) -> Column:
        local = local or {}
        c = lambda x: self.col(x, local)
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "param":
            v = self.params[e[1]]
            return F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
        if kind == "var":
            return local[e[1]] if e[1] in local else F.col(f"`{e[1]}`")
        if kind == "prop":
            base = c(e[1])
            if e[1][0] == "var" and e[1][1] not in local and e[1][1] in self.entities:
                known = self.entities[e[1][1]]
                return base.getField(e[2]) if e[2] in known else base.getField("props").getItem(e[2]) if "props" in known else F.lit(None)
            return base.getItem(e[2])
        if kind == "op":
            return self.operator(e[1], c(e[2]), e[3], c)
        if kind == "not":
            return ~c(e[1])
        if kind == "neg":
            return -c(e[1])
        if kind == "is_null":
            return c(e[1]).isNotNull() if e[2] else c(e[1]).isNull()
        if kind == "list":
            return F.array(*[c(x) for x in e[1]])
        if kind == "map":
            return F.struct(*[c(v).alias(k) for k, v in e[1].items()])
        if kind == "index":
            i = c(e[2])
            return F.try_element_at(c(e[1]), (F.when(i < 0, i).otherwise(i + 1)).cast("int"))
        if kind == "slice":
            x = c(e[1])
            start = c(e[2]).cast("int") if e[2] else F.lit(0)
            stop = F.least(c(e[3]).cast("int"), F.size(x)) if e[3] else F.size(x)
            return F.slice(x, start + 1, F.greatest(stop - start, F.lit(0)))
        if kind == "case":
            out = None
            for cond, value in e[2]:
                test = c(e[1]) == c(cond) if e[1] else c(cond)
                out = F.when(test, c(value)) if out is None else out.when(test, c(value))
            return out.otherwise(c(e[3])) if e[3] else out
        if kind == "comp":
            x = c(e[2])
            if e[3]:
                x = F.filter(x, lambda v: self.col(e[3], {**local, e[1]: v}))
            return F.transform(x, lambda v: self.col(e[4], {**local, e[1]: v})) if e[4] else x
        if kind == "quant":
            test = lambda v: self.col(e[4], {**local, e[2]: v})
            return {"any": lambda: F.exists(c(e[3]), test), "none": lambda: ~F.exists(c(e[3]), test), "all": lambda: F.forall(c(e[3]), test)}[e[1]]()
        if kind == "project":
            base, fields = c(e[1]), []
            for k, v in e[2]:
                if k == "all":
                    fields += [base.getField(x).alias(x) for x in COLUMNS]
                elif k == "own":
                    fields.append(self.col(("prop", e[1], v), local).alias(v))
                else:
                    fields.append(c(v).alias(k))
            return F.struct(*fields)
        if kind == "fn":
            return self.function(e, c)
        raise CypherError(f"cannot compile {kind}")

    def operator(self, sign: str, a: Column, right: tuple, c) -> Column:
        b = c(right)
        return {
            "AND": lambda: a & b, "OR": lambda: a | b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
            "+": lambda: a + b if right[0] != "list" else F.concat(a, b), "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: a % b,
            "IN": lambda: F.array_contains(b, a), "CONTAINS": lambda: F.contains(a, b), "STARTS": lambda: F.startswith(a, b), "ENDS": lambda: F.endswith(a, b), "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
        }[sign]()

    def function(self, e: tuple, c) -> Column:
        _, name, distinct, args = e
        if name == "count":
            if not args or args[0] == ("star",):
                return F.count(F.lit(1))
            x = c(args[0])
            if args[0][0] == "var" and args[0][1] in self.entities:
                x = x.getField("node_id" if "node_id" in self.entities[args[0][1]] else "edge_id")
            return F.count_distinct(x) if distinct else F.count(x)
        if name == "collect":
            return F.array_sort(F.collect_set(c(args[0])) if distinct else F.collect_list(c(args[0])))
        if name in ("sum", "avg", "min", "max"):
            return getattr(F, name if not (distinct and name == "sum") else "sum_distinct")(c(args[0]))
        x = [c(a) for a in args]
        simple = {
            "tolower": lambda: F.lower(x[0]), "toupper": lambda: F.upper(x[0]), "tostring": lambda: x[0].cast("string"), "tointeger": lambda: F.expr("bigint").cast("bigint") if not x else x[0].cast("double").cast("bigint"), "tofloat": lambda: x[0].cast("double"),
            "coalesce": lambda: F.coalesce(*x), "size": lambda: F.size(x[0]), "length": lambda: F.length(x[0]), "trim": lambda: F.trim(x[0]), "abs": lambda: F.abs(x[0]), "round": lambda: F.round(x[0]), "head": lambda: F.try_element_at(x[0], F.lit(1)), "last": lambda: F.try_element_at(x[0], F.lit(-1)),
            "labels": lambda: F.array(x[0].getField("label")), "type": lambda: x[0].getField("type"), "keys": lambda: F.array_sort(F.map_keys(x[0].getField("props"))), "properties": lambda: x[0].getField("props"),
            "elementid": lambda: x[0].getField("node_id"), "id": lambda: x[0].getField("node_id"), "startnode": lambda: F.struct(x[0].getField("src").alias("node_id")), "endnode": lambda: F.struct(x[0].getField("dst").alias("node_id")),
            "substring": lambda: F.substring(x[0], args[1][1] + 1, args[2][1] if len(args) > 2 else 2**31 - 1), "replace": lambda: F.replace(x[0], x[1], x[2]), "split": lambda: F.split(x[0], args[1][1]), "range": lambda: F.sequence(x[0], x[1]),
        }
        if name not in simple:
            raise CypherError(f"unknown function {name}")
        return simple[name]()

    # patterns
    def scan(self, node: Node) -> DataFrame:
        df = self.g.nodes
        if node.label:
            df = df.where(F.col("label") == node.label)
        for k, v in node.props.items():
            df = df.where((F.col(k) if k in COLUMNS else F.col("props").getItem(k)) == self.col(v))
        return df.select(F.struct(*COLUMNS).alias(node.var), F.col("node_id").alias(f"{node.var}__id"))

    def edges(self, rel: Rel, var: str) -> DataFrame:
        df = self.g.edges
        if rel.types:
            df = df.where(F.col("type").isin(*rel.types))
        pick = lambda a, b: df.select(F.col(a).alias(f"{var}__a"), F.col(b).alias(f"{var}__b"), F.struct(F.concat_ws("|", "src", "type", "dst").alias("edge_id"), "src", "dst", "type").alias(var))
        if rel.direction == ">":
            return pick("src", "dst")
        if rel.direction == "<":
            return pick("dst", "src")
        return pick("src", "dst").unionByName(pick("dst", "src").where(f"{var}__a <> {var}__b"))

    def hops(self, rel: Rel, var: str, start: DataFrame, column: str) -> DataFrame:
        """(var__a, var__b) of all distinct pairs low..high hops apart, from the starts at hand; without ``high`` until nothing new is reached.

        Edges and levels are written down, and from ``low`` on a level goes on from its new
        pairs only: what is reached again was left before.
        """
        scratch = Scratch(start.sparkSession, "hops")
        one, _ = scratch.write(self.edges(Rel(None, rel.types, rel.direction), "h").select("h__a", "h__b").distinct())
        level, _ = scratch.write(start.select(F.col(column).alias(f"{var}__a")).distinct().withColumn("at", F.col(f"{var}__a")))
        low = 1 if rel.low is None else rel.low
        found = level if low == 0 else None
        seen, d = None, 0
        while rel.high is None or d < rel.high:
            d += 1
            ahead = level.join(one, level["at"] == one["h__a"]).select(f"{var}__a", F.col("h__b").alias("at")).distinct()
            if seen is not None:
                ahead = ahead.join(seen, [f"{var}__a", "at"], "left_anti")
            level, _ = scratch.write(ahead)
            if level.isEmpty():
                break
            if d >= max(1, low):
                seen = level if seen is None else seen.unionByName(level)
        if seen is not None:
            found = seen if found is None else found.unionByName(seen)
        found = level.limit(0) if found is None else found
        return found.distinct().withColumnRenamed("at", f"{var}__b")

    def match(self, frame: DataFrame | None, clause: Match) -> DataFrame:
        before = dict(self.entities)
        df = frame
        if clause.optional and frame is not None:
            keyed = [v for v in before if before[v]]
            df = frame
            anchors = [f"{v}__id" for v in keyed if f"{v}__id" in df.columns]
            df = df.select(*anchors, *keyed).dropDuplicates(anchors)
        rels: list[str] = []
        for pattern in clause.patterns:
            df = self.chain(df, pattern, rels)
        for i, a in enumerate(rels):
            for b in rels[i + 1 :]:
                df = df.where(F.col(a).getField("edge_id") != F.col(b).getField("edge_id"))
        if clause.where is not None:
            df = df.where(self.col(clause.where))
        if clause.optional and frame is not None:
            shared = [f"{v}__id" for v in before if f"{v}__id" in df.columns]
            new = [c for c in df.columns if c not in frame.columns]
            out = frame.join(df.select(*shared, *new), shared, "left")
            return out
        return df

    def chain(self, df: DataFrame | None, pattern: list, rels: list[str]) -> DataFrame:
        first: Node = pattern[0]
        df = self.bind(df, first)
        at = first.var
        for rel, node in zip(pattern[1::2], pattern[2::2]):
            var = rel.var or self.fresh()
            if rel.low is None:
                e = self.edges(rel, var)
                df = df.join(e, F.col(f"{at}__id") == F.col(f"{var}__a")).drop(f"{var}__a")
                self.entities[var] = ("edge_id", "src", "dst", "type")
                rels.append(var)
            else:
                e = self.hops(rel, var, df, f"{at}__id")
                df = df.join(e, F.col(f"{at}__id") == F.col(f"{var}__a")).drop(f"{var}__a")
            if node.var in self.entities and f"{node.var}__id" in df.columns:
                df = df.where(F.col(f"{node.var}__id") == F.col(f"{var}__b")).drop(f"{var}__b")
            else:
                df = df.join(self.scan(node), F.col(f"{var}__b") == F.col(f"{node.var}__id")).drop(f"{var}__b")
                self.entities[node.var] = COLUMNS
            at = node.var
        return df

    def bind(self, df: DataFrame | None, node: Node) -> DataFrame:
        if node.var in self.entities and df is not None and f"{node.var}__id" in df.columns:
            for k, v in node.props.items():
                df = df.where(self.col(("prop", ("var", node.var), k)) == self.col(v))
            return df.where(F.col(node.var).getField("label") == node.label) if node.label else df
        self.entities[node.var] = COLUMNS
        s = self.scan(node)
        return s if df is None else df.crossJoin(s) if not df.columns else df.join(s)

    # clauses
    def project(self, df: DataFrame, p: Projection, limit: int | None) -> DataFrame:
        items = [(("var", v), v) for v in self.entities] if p.star else p.items
        grouped = any(aggregated(e) for e, _ in items)
        kept = {name: self.entities.get(e[1]) for e, name in items if e[0] == "var"}
        ids = [(f"{e[1]}__id", f"{name}__id") for e, name in items if e[0] == "var" and f"{e[1]}__id" in df.columns]
        if grouped:
            keys = [(e, n) for e, n in items if not aggregated(e)]
            flat = df.select(*df.columns, *[self.col(e).alias(f"_k{i}") for i, (e, _) in enumerate(keys)])
            # structs of nodes hold maps, which can't be grouped by: group by their ids
            by, back = [], []
            for i, (e, n) in enumerate(keys):
                if e[0] == "var" and f"{e[1]}__id" in df.columns:
                    by.append(F.col(f"{e[1]}__id").alias(f"{n}__id"))
                    back.append(F.first(f"_k{i}").alias(n))
                else:
                    by.append(F.col(f"_k{i}").alias(n))
            out = flat.groupBy(*by).agg(*back, *[self.col(e).alias(n) for e, n in items if aggregated(e)])
        else:
            out = df.select(*[self.col(e).alias(n) for e, n in items], *[F.col(a).alias(b) for a, b in ids])
            if p.distinct:
                out = out.dropDuplicates([f"{n}__id" if f"{n}__id" in out.columns else n for _, n in items])
        sort = None
        if p.order:
            scope = dict(self.entities)
            outer = self.entities
            self.entities = {**{k: v for k, v in kept.items() if v}, **({} if grouped else scope)}
            names = {n for _, n in items}
            text = {str(e): n for e, n in items}
            fix = lambda e: ("var", text[str(e)]) if str(e) in text else e
            cols = []
            missing = []
            for e, down in p.order:
                e = fix(e)
                if not grouped and not p.distinct and e[0] == "prop" and e[1][0] == "var" and e[1][1] not in names:
                    missing.append((self.col(e), f"_o{len(missing)}"))
                    e = ("var", missing[-1][1])
                c = self.col(e)
                cols.append(c.desc_nulls_first() if down else c.asc_nulls_last())
            if missing:
                out = df.select(*[self.col(e).alias(n) for e, n in items], *[F.col(a).alias(b) for a, b in ids], *[c.alias(n) for c, n in missing])
            sort = cols
            self.entities = outer
        if sort:
            out = out.orderBy(*sort)
        if p.skip:
            out = out.offset(int(self.value(p.skip)))
        if p.limit:
            out = out.limit(int(self.value(p.limit)))
        elif p.final and limit is not None:
            out = out.limit(limit)
        self.entities = {n: k for n, k in kept.items() if k}
        if p.where is not None:
            out = out.where(self.col(p.where))
        return out.drop(*[c for c in out.columns if c.startswith("_o")])

    def value(self, e: tuple):
        return self.params[e[1]] if e[0] == "param" else e[1]

    def part(self, clauses: list, limit: int | None) -> DataFrame:
        df, self.entities = None, {}
        if not clauses or not (isinstance(clauses[-1], Projection) and clauses[-1].final):
            clauses = [*clauses, Projection([], False, [], None, None, None, True, star=True)]
        for clause in clauses:
            if isinstance(clause, Match):
                df = self.match(df, clause)
            elif isinstance(clause, Unwind):
                base = df if df is not None else self.g.nodes.sparkSession.range(1).select()
                df = base.select(*base.columns, F.explode(self.col(clause.expr)).alias(clause.var))
            else:
                df = self.project(df, clause, limit)
        return df.drop(*[c for c in df.columns if c.endswith("__id")])


def run(graph: Graph, query: str, params: dict | None = None, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """The result of a reading query; ``limit`` is put on queries that state none (None: no limit).

    Raises ``CypherError`` for what can't be read, and for queries that delete or drop.
    """
    if is_destructive(query):
        raise CypherError("queries that delete or drop are refused")
    compiler = Compiler(graph, params or {})
    out = None
    keep_all = True
    for clauses, every in parse(query):
        df = compiler.part(clauses, limit)
        out = df if out is None else out.unionByName(df)
        if out is not df and not keep_all:
            out = out.distinct()
        keep_all = every
    return out
