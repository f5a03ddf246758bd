"""Shared inlining: nested JSON documents to related flat tables.

1. ``objects`` parses every document once and gives one row per object in it: the names and
   positions on the way to it and its own values. The rows are written down; nothing after
   this reads JSON.
2. ``schema_graph`` is the graph of element names in these rows: which element occurs
   below which, and whether it occurs repeatedly.
3. ``relation_plan`` applies the shared-inlining rule to that graph: an element
   gets a table of its own if it is repeated, shared by several parents or
   recursive; every other element is inlined into its nearest ancestor that has
   a table. The document itself is the table ''.
4. ``relations`` gives the rows of all tables: an object whose element has a table, with its key
   (the path inside the document), the table and key of its parent row, and the objects
   inlined into it. ``flat_table`` spreads one table's values over columns.

An element may stand as an array of objects, as a single object, as an object
keyed by numbers, or as any of these written as a JSON string; all four read
alike. Steps 2 and 3 work on the names alone, so what reaches the driver
is bounded by the number of distinct names (``MAX_NAMES``; more is an error), not by the data.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch

#: Distinct (parent, child) names above which a layout counts as unbounded (objects used as dictionaries).
MAX_NAMES = 10_000


def _reject(token: str):
    raise ValueError(token)


def parse_json(text: str | None):
    """The value, or None where the text isn't valid JSON (NaN and Infinity aren't)."""
    if text is None:
        return None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    try:
        return json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None


def unwrap(value):
    """A JSON string holding an object or array stands for what it holds."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        inner = parse_json(value)
        if inner is None:
            return value
        value = inner
    return value


def _number(key: str) -> int | None:
    return int(key) if key.isdecimal() and key.isascii() else None


def items(value) -> tuple[list[tuple[int, dict]], bool]:
    """(position, object) pairs of an element's value, and whether it is written as several."""
    value = unwrap(value)
    if isinstance(value, list):
        return [(i, x) for i, x in ((i, unwrap(x)) for i, x in enumerate(value)) if isinstance(x, dict)], True
    if isinstance(value, dict):
        if value and all(_number(k) is not None for k in value):
            ordered = [unwrap(x) for _, x in sorted(value.items(), key=lambda kv: int(kv[0]))]
            return [(i, x) for i, x in enumerate(ordered) if isinstance(x, dict)], True
        return ([(0, value)] if value else []), False
    return [], False


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def walk(doc: dict) -> Iterator[tuple[list[str], list[int], bool, dict]]:
    """(names, positions, whether written as several, own values) of the document and every object in it, parents first."""
    stack: list[tuple[dict, list[str], list[int], bool]] = [(doc, [], [], False)]
    while stack:
        obj, names, places, many = stack.pop()
        values, below = {}, []
        for key, x in obj.items():
            x = unwrap(x)
            found, several = items(x)
            if found:
                below += [(y, [*names, key], [*places, i], several) for i, y in found]
            elif not isinstance(x, dict):
                values[key] = _text(x)
        yield names, places, many, values
        stack += reversed(below)


OBJECTS = "doc_key string, names array<string>, places array<int>, several boolean, vals map<string,string>"


def objects(df: DataFrame, key: str, payload: str) -> DataFrame:
    """One row per object of every document: ``OBJECTS``; the document itself has no names.

    Rows with a null key, a null payload or invalid JSON give nothing; a document that is an
    array stands below the name ''. Other columns of ``df`` aren't read. Documents are
    taken as they come: deduplicate deliveries first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_key", pa.string()), ("names", pa.list_(pa.string())), ("places", pa.list_(pa.int32())), ("several", pa.bool_()), ("vals", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = parse_json(text) if k is not None else None
                doc = {"": doc} if isinstance(doc, list) else doc
                if isinstance(doc, dict):
                    for names, places, many, values in walk(doc):
                        rows.append({"doc_key": k, "names": names, "places": places, "several": many, "vals": list(values.items())})
                        if len(rows) == 20_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    return df.select(F.col(key).cast("string"), F.col(payload)).mapInArrow(run, OBJECTS)


def schema_graph(found: DataFrame) -> list[tuple[str, str, bool]]:
    """Edges (parent, child, repeated) of the element graph over ``objects``; the root is ''.

    An empty table gives an empty graph. More than ``MAX_NAMES`` edges are an error: objects are used as dictionaries.
    """
    parent, child = F.try_element_at("names", F.lit(-2)), F.element_at("names", -1)
    edges = found.where(F.size("names") > 0).select(F.coalesce(parent, F.lit("")).alias("parent"), child.alias("child"), "several").groupBy("parent", "child").agg(F.max("several").alias("several"))
    rows = edges.limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError("objects are used as dictionaries: too many distinct element names")
    return sorted((r.parent, r.child, r.several) for r in rows)


def relation_plan(edges: Iterable[tuple[str, str, bool]]) -> dict[str, str]:
    """Element name -> why it has a table ('repeated', 'shared', 'recursive'); names left out are inlined."""
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    several: set[str] = set()
    for parent, child, many in edges:
        parents.setdefault(child, set()).add(parent)
        children.setdefault(parent, set()).add(child)
        if many:
            several.add(child)

    def recursive(name: str) -> bool:
        seen: set[str] = set()
        stack = list(children.get(name, ()))
        while stack:
            x = stack.pop()
            if x == name:
                return True
            if x not in seen:
                seen.add(x)
                stack.extend(children.get(x, ()))
        return False

    plan = {}
    for name in sorted(parents):
        if recursive(name):
            plan[name] = "recursive"
        elif name in several:
            plan[name] = "repeated"
        elif len(parents[name]) > 1:
            plan[name] = "shared"
    return plan


def path_of(names: Column, places: Column) -> Column:
    """``organ_findings[1].samples[0]``: the key of a row inside its document."""
    return F.array_join(F.zip_with(names, places, lambda n, i: F.concat(n, F.lit("["), i.cast("string"), F.lit("]"))), ".")


RELATION = "doc_key string, element string, path string, parent_element string, parent_path string, position int, vals map<string,string>, inlined array<struct<names:array<string>,vals:map<string,string>>>"


def relations(found: DataFrame, plan: Iterable[str], roots: Iterable[str] | None = None) -> DataFrame:
    """The rows of all tables, after the plan: ``RELATION``.

    ``(doc_key, path)`` is the row's key and ``(doc_key, parent_path)`` its foreign key into
    ``parent_element``; both are '' for the document itself. ``inlined`` holds the objects
    that have no table of their own, by the names between the row and them. ``roots``:
    only what lies at or below one of these names is kept and paths begin there, a root
    without a table standing inside the row of the document.
    """
    tables, top = sorted(set(plan)), sorted(set(roots)) if roots is not None else None
    rows = found
    if top is not None:
        rows = rows.withColumn("from", F.expr(f"coalesce(array_min(filter(transform(names, (n, i) -> if(n in ({_quoted(top)}), i, null)), i -> i is not null)), if(size(names) = 0, 0, -1))")).where("from >= 0")
        rows = rows.withColumn("names", F.expr("slice(names, from + 1, greatest(size(names) - from, 0))")).withColumn("places", F.expr("slice(places, from + 1, greatest(size(places) - from, 0))"))
    tabled = f"n in ({_quoted(tables)})" if tables else "false"
    # where the object itself, and where its parent's row, ends in the list of names; 0 is the document
    rows = rows.withColumn("at", F.expr(f"coalesce(array_max(filter(transform(names, (n, i) -> if({tabled}, i + 1, null)), i -> i is not null)), 0)"))
    rows = rows.withColumn("above", F.expr(f"coalesce(array_max(filter(transform(slice(names, 1, greatest(at - 1, 0)), (n, i) -> if({tabled}, i + 1, null)), i -> i is not null)), 0)"))
    upto = lambda n: path_of(F.expr(f"slice(names, 1, {n})"), F.expr(f"slice(places, 1, {n})"))
    name = lambda n: F.expr(f"case when {n} = 0 then '' else names[{n} - 1] end")
    rows = rows.select("doc_key", name("at").alias("element"), upto("at").alias("path"), name("above").alias("parent_element"), upto("above").alias("parent_path"), F.expr("case when at = 0 then 0 else places[at - 1] end").alias("position"), "vals", F.expr("slice(names, at + 1, size(names) - at)").alias("rest"))
    plain = ("doc_key", "element", "path", "parent_element", "parent_path", "position")
    inlined = F.expr("filter(collect_list(if(size(rest) > 0, named_struct('names', rest, 'vals', vals), null)), x -> x is not null)")
    # one object's singletons: as many as the graph has names between two tables
    return rows.groupBy(*plain).agg(F.expr("max_by(if(size(rest) = 0, vals, null), if(size(rest) = 0, 1, null))").alias("vals"), inlined.alias("inlined"))


def _quoted(names: Iterable[str]) -> str:
    return ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names)


def flat_table(rows: DataFrame, element: str) -> DataFrame:
    """One table of ``relations``: its keys and a STRING column per value seen (``dimensions.length_cm`` for an inlined one)."""
    part = rows.where(F.col("element") == element)
    all_vals = F.aggregate(
        "inlined", F.coalesce("vals", F.create_map().cast("map<string,string>")),
        lambda a, x: F.map_concat(a, F.transform_keys(x["vals"], lambda k, _: F.concat(F.array_join(x["names"], "."), F.lit("."), k))),
    )
    part = part.withColumn("all", all_vals)
    columns = sorted(r[0] for r in part.select(F.explode(F.map_keys("all"))).distinct().limit(MAX_NAMES + 1).collect())
    if len(columns) > MAX_NAMES:
        raise ValueError("objects are used as dictionaries: too many distinct value names")
    return part.select("doc_key", "path", "parent_element", "parent_path", "position", *[F.col("all").getItem(c).alias(c) for c in columns])


def shared_inlining(df: DataFrame, key: str, payload: str, roots: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Element name -> its flat table, from the layout found in the documents themselves; '' is the documents' own table."""
    found, _ = Scratch(df.sparkSession, "nested").write(objects(df, key, payload))
    plan = relation_plan(schema_graph(found))
    rows = relations(found, plan, roots)
    return {name: flat_table(rows, name) for name in ("", *plan)}


def latest(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key, that of the greatest ``order``; rows with a null key are left out."""
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.coalesce(F.col(order), F.lit("0001-01-01").cast("timestamp_ntz"))).alias("r"))
    return picked.select(key, *[F.col("r").getField(c).alias(c) for c in columns])
