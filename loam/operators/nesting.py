"""Deeply nested JSON to related flat tables by shared inlining.

1. ``schema_graph`` reads every record and counts, for each path, what kinds of values stand there. Repetition, lone
   objects in place of arrays and JSON held in JSON strings are resolved here, so that the graph shows the content.
2. ``table_plan`` analyses the graph: a path becomes a table if it is repeated, if its key recurs below itself
   (recursion: the nested occurrences go to the same table) or if several parents share the same element shape.
   Everything else is a singleton and is inlined into its nearest ancestor that is a table.
3. ``shred`` emits one row for each element: its table, its own key, its parent's key, its place in the array and the
   inlined values. ``tables`` projects these into typed tables with foreign keys.

Nulls, empty texts and text that is not complete JSON yield no rows. Elements that are not objects yield no rows but
keep their place. A repeated input row yields its rows once. In paths ``.``, ``[``, ``]`` and ``%`` of a key are written as
%2E, %5B, %5D and %25. An object with more than ``MAX_KEYS`` distinct keys over all records is a map, whose keys are data:
it stays one JSON value, whole. A key column named like an output column does not clash: only ``key`` and ``json`` are read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.scratch import written

ROOT = "$"
GRAPH_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())])
ROW_SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("node_path", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("values", T.MapType(T.StringType(), T.StringType())),
    ]
)
#: The schema graph without what is below maps is the one thing that reaches the driver.
MAX_KEYS = 1_000


def content(value):
    """``value``, or what it holds if it is a string with a JSON object or array in it, any number of times."""
    while isinstance(value, str):
        head = value.lstrip()[:1]
        if head not in ("{", "[", '"') or not head:
            return value
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            return value
        if head == '"' and not isinstance(inner, (dict, list, str)):
            return value
        if isinstance(inner, str) and not inner.lstrip().startswith(("{", "[", '"')):
            return value
        value = inner
    return value


def parsed(text: str | None):
    """The record of a JSON text; None if it is missing, incomplete or no object."""
    if not text:
        return None
    try:
        record = content(json.loads(text))
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _kind(value) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(value)]


def escaped(key: str) -> str:
    """A key as a step of a path."""
    return key.replace("%", "%25").replace(".", "%2E").replace("[", "%5B").replace("]", "%5D") if any(c in key for c in "%.[]") else key


def _walk_kinds(record: dict, counts: Counter) -> None:
    stack = [(ROOT, record)]
    while stack:
        path, value = stack.pop()
        value = content(value)
        kind = _kind(value)
        counts[path, kind] += 1
        if kind == "object":
            stack += [(f"{path}.{escaped(k)}", v) for k, v in value.items()]
        elif kind == "array":
            stack += [(path + "[]", v) for v in value]


def schema_graph(df: DataFrame, json_col: str) -> DataFrame:
    """(path, kind, n): how often each kind of value stands at each path, over all records of ``df``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        made = lambda: pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["path", "kind", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (record := parsed(text)) is not None:
                    _walk_kinds(record, counts)
            if len(counts) > 100_000:  # maps
                yield made()
                counts = Counter()
        yield made()

    return df.select(F.col(json_col).cast("string")).mapInArrow(count, GRAPH_SCHEMA).groupBy("path", "kind").agg(F.sum("n").alias("n"))


def schema_of(df: DataFrame, json_col: str, most: int = MAX_KEYS) -> tuple[list[tuple[str, str, int]], set[str]]:
    """(the schema graph without what is below maps, the paths of the maps)."""
    graph = written(schema_graph(df, json_col), "schema")
    parent = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)
    maps = {r[0].replace("[]", "") for r in graph.where(F.col("path").contains(".")).groupBy(parent.alias("p")).agg(F.countDistinct("path").alias("n")).where(F.col("n") > most).select("p").collect()}  # each has more than ``most`` paths
    # only the topmost ones count; what is below them is data
    top = {m for m in maps if not any(m.startswith(o + ".") for o in maps)}
    plain = F.regexp_replace("path", r"\[\]", "")
    for m in top:
        graph = graph.where(~plain.startswith(m + "."))
    return [(r["path"], r["kind"], r["n"]) for r in graph.collect()], top


def table_plan(graph: list[tuple[str, str, int]], declared: Iterable[str] = (), maps: Iterable[str] = ()) -> dict[str, str]:
    """Element path -> table for the paths that get tables. ``graph``: rows (path, kind, n); ``maps`` get none.

    A lone object at a path that is an array elsewhere counts as that array's element, so both spellings of the path
    are given. Only arrays with at least one object among their elements are tables; arrays of plain values stay
    inlined as JSON. ``declared``: paths (``$.a.b``) known to be arrays of objects even where these data only have
    lone objects there.
    """
    kinds: dict[str, set[str]] = {}
    shapes: dict[str, set[str]] = {}
    for path, kind, _ in graph:
        plain = path.replace("[]", "")
        kinds.setdefault(path, set()).add(kind)
        if kind == "object" and plain not in maps:
            shapes.setdefault(plain, set())
    for path in kinds:
        above, _, key = path.replace("[]", "").rpartition(".")
        if above in shapes:
            shapes[above].add(key)
    repeated = {p.replace("[]", "") for p, ks in kinds.items() if p.endswith("[]") and "object" in ks} | {p for p in declared if p in shapes}
    plan: dict[str, str] = {}
    by_key: dict[str, list[str]] = {}
    for path in sorted(shapes, key=lambda p: (p.count("."), p)):
        key = path.rpartition(".")[2]
        if path in repeated:
            by_key.setdefault(key, []).append(path)
    for path in sorted(shapes, key=lambda p: (p.count("."), p)):
        parts = path.split(".")
        key = parts[-1]
        # recursive: an element of the same name and half the same keys stands above
        tops = (".".join(parts[: i + 1]) for i in range(1, len(parts) - 1) if parts[i] == key)
        above = next((t for t in tops if 2 * len(shapes[path] & shapes.get(t, set())) >= len(shapes[path])), None)
        if above is not None:  # recursive: the occurrences below go to the table of the topmost one
            plan[above] = plan.get(above, above)
            plan[path] = plan[above]
        elif path in repeated:
            twin = next((p for p in by_key[key] if p in plan and p != path and shapes[p] == shapes[path]), None)
            plan[path] = plan[twin] if twin else path
    return plan


def _emit(record: dict, plan: dict[str, str], maps: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """(table, node_path, parent_path, position, values) of the record and of everything below it."""
    stack = [(ROOT, "", record, ROOT, None, None)]
    while stack:
        path, at, obj, table, parent, place = stack.pop()
        values: dict[str, str] = {}
        todo = [(path, at, "", obj)]
        below = []
        while todo:
            base, where, prefix, o = todo.pop()
            for k, v in o.items():
                step = escaped(k)
                v, p, w = content(v), f"{base}.{step}", f"{where}.{step}" if where else step
                if p in plan:
                    for i, x in enumerate(v if isinstance(v, list) else [v]):
                        if isinstance(x := content(x), dict):
                            below.append((p, f"{w}[{i}]", x, plan[p], at, i))
                elif isinstance(v, dict) and p not in maps:
                    todo.append((p, w, f"{prefix}{step}.", v))
                elif v is not None:
                    values[prefix + step] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        yield table, at, parent, place, values
        stack += below[::-1]


def shred(df: DataFrame, key_col: str, json_col: str, plan: dict[str, str] | None = None) -> DataFrame:
    """One row for each element of each table: table, id, node_path, parent_path, position (0-based), values.

    The record itself is the row of table ``$`` with node_path ''. ``parent_path`` is the foreign key: with ``id`` it
    names the row of the nearest ancestor that is a table.
    """
    plan = plan if plan is not None else plan_of(df, json_col)
    maps, tables_ = frozenset(getattr(plan, "maps", ())), dict(plan)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            out: list[list] = [[] for _ in types]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (record := parsed(text)) is None:
                    continue
                for table, at, parent, place, values in _emit(record, tables_, maps):
                    for column, value in zip(out, (table, key, at, parent, place, list(values.items()))):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=ROW_SCHEMA.names)
                    out = [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=ROW_SCHEMA.names)

    return df.select(F.col(key_col).cast("string"), F.col(json_col).cast("string")).mapInArrow(rows, ROW_SCHEMA)


class Plan(dict):
    """Element path -> table; ``maps``: the paths whose objects stay one value."""

    maps: frozenset[str] = frozenset()


def _planned(graph, maps, declared: Iterable[str] = ()) -> Plan:
    plan = Plan(table_plan(graph, declared, maps))
    plan.maps = frozenset(maps)
    return plan


def plan_of(df: DataFrame, json_col: str, declared: Iterable[str] = ()) -> Plan:
    """The table plan from the schema graph of the whole of ``df``."""
    return _planned(*schema_of(df, json_col), declared)


def tables(df: DataFrame, key_col: str, json_col: str) -> dict[str, DataFrame]:
    """Table name -> DataFrame(id, row_key, parent_key, position, one column for each inlined value)."""
    rows, maps = schema_of(df, json_col)
    plan = _planned(rows, maps)
    graph = [{"path": p, "kind": "map" if k == "object" and p.replace("[]", "") in maps else k} for p, k, _ in rows]
    kinds: dict[tuple[str, str], set[str]] = {}
    for r in graph:
        plain = r["path"].replace("[]", "")
        if r["path"] == ROOT or plain in plan or (r["path"].endswith("[]") and r["kind"] != "object"):
            continue
        owner = max((p for p in [ROOT, *plan] if plain.startswith(p + ".")), key=len, default=ROOT)
        if r["kind"] not in ("null", "object"):
            kinds.setdefault((plan.get(owner, ROOT), plain[len(owner) + 1 :]), set()).add(r["kind"])
    rows = written(shred(df, key_col, json_col, plan).dropDuplicates(["id", "node_path"]), "shredded")  # for all tables at once
    fixed = [F.col("id").alias("_id"), F.col("node_path").alias("_row"), F.col("parent_path").alias("_parent"), F.col("position").alias("_position")]
    out = {}
    for table in sorted({ROOT, *plan.values()}):
        columns = [_typed(name, ks).alias(name) for (t, name), ks in sorted(kinds.items()) if t == table]
        out[table] = rows.where(F.col("table") == table).select(*fixed, *columns)
    return out


def _typed(name: str, kinds: set[str]) -> Column:
    value = F.col("values")[F.lit(name)]
    if kinds <= {"integer"}:
        return F.expr(f"try_cast({_quoted(name)} as bigint)")
    if kinds <= {"integer", "number"}:
        return F.expr(f"try_cast({_quoted(name)} as double)")
    if kinds <= {"boolean"}:
        return F.expr(f"try_cast({_quoted(name)} as boolean)")
    return value


def _quoted(name: str) -> str:
    text = re.sub(r"(['\\])", r"\\\1", name)
    return f"`values`['{text}']"
