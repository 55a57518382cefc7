"""Nested JSON to flat, linked tables by shared inlining.

1. *Schema graph.*  Every record's own schema is computed in the JVM
   (``schema_of_variant``), distinct schemas are turned into edges on the executors, and
   only the distinct edges reach the driver.  Member names that are data are folded to one
   wildcard there, so the edges are bounded by the schema: names that look like ids
   (:data:`ID_NAME`) and all members of an object with more than ``WIDE`` of them.  More
   than ``EDGES`` different edges are an error, not a cut.
2. *Analysis.*  Objects are grouped into element types: equal element names, or key
   sets that are alike.  An element type becomes a table if it is the root, stands in an
   array, is shared by several parents, or is recursive; every other object is a singleton
   descendant and is inlined as columns of the table above it.  Leaves that repeat, or
   that are a scalar in some records and an array in others, become value tables.
   The payload may be parsed beforehand (:func:`documents`), so that the graph and all tables
   share one parse.
3. *Population.*  A table's rows come from one pass over the parsed record: the arrays
   along each of its root paths are expanded inside the row and exploded once.  Each row
   gets ``node_id`` (record id and steps) and the foreign key ``parent_id``, the
   ``node_id`` of the table row above it.

Defined results: a payload that is not well-formed JSON, null or empty gives no rows; a
payload that is a JSON string holding JSON is read as the JSON inside; missing, null and
empty parts give no rows; leaves keep their JSON text, so a number and the same digits as
a string stay different; columns of the input other than the key and the payload are not
looked at, so their names cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

EACH = "[]"
ANY = "*"
Path = tuple[str, ...]
#: Names with four digits or more, or a long run of hexadecimal digits, are data.
ID_NAME = re.compile(r"(?:.*\d){4}|.*[0-9a-fA-F-]{16}")
#: Members from which an object is a map, and most different edges of a collection.
WIDE, EDGES = 64, 50_000


def parsed(col: Column) -> Column:
    """The payload as a variant; null if it is not well-formed.  Text in text is unwrapped."""
    outer = F.try_parse_json(col)
    return F.coalesce(F.try_parse_json(F.try_variant_get(outer, "$", "string")), outer)


def documents(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with ``payload`` parsed, without the rows whose payload cannot be read.

    The parsed value is put behind an explode so that it is computed once a row.
    """
    others = [c for c in df.columns if c != payload]
    return df.select(*others, F.explode(F.array(parsed(F.col(payload)))).alias(payload)).where(F.col(payload).isNotNull())


def _parsed_once(df: DataFrame, payload: str) -> DataFrame:
    return df if isinstance(df.schema[payload].dataType, VariantType) else documents(df, payload)


def _read_type(text: str, at: int) -> tuple[dict | list | str, int]:
    """A ``schema_of_variant`` type from position ``at``: dict, one-element list or scalar name."""
    if text.startswith("OBJECT<", at):
        at, members = at + 7, {}
        while text[at] != ">":
            if text[at] == "`":
                end = text.index("`:", at)
                name, at = text[at + 1 : end], end + 2
            else:
                end = text.index(":", at)
                name, at = text[at:end], end + 1
            members[name], at = _read_type(text, at + 1)
            if text.startswith(", ", at):
                at += 2
        return members, at + 1
    if text.startswith("ARRAY<", at):
        inner, at = _read_type(text, at + 6)
        return [inner], at + 1
    end, depth = at, 0
    while end < len(text) and (depth or text[end] not in ",>"):
        depth += (text[end] == "(") - (text[end] == ")")
        end += 1
    return text[at:end], end


def _edges(shape: dict | list | str, path: Path) -> Iterator[tuple[Path, str]]:
    if isinstance(shape, dict):
        yield path, "object"
        wide = len(shape) > WIDE
        for name, inner in shape.items():
            yield from _edges(inner, (*path, ANY if wide or ID_NAME.fullmatch(name) else name))
    elif isinstance(shape, list):
        yield path, "array"
        yield from _edges(shape[0], (*path, EACH))
    elif shape not in ("VOID", "VARIANT"):
        yield path, "scalar"


_TOKEN = re.compile(r"(OBJECT<|ARRAY<)|(>)|(?:`([^`]*)`|([^`<>,: ()][^`<>,:()]*)):|([A-Z_]+(?:\(\d+,\d+\))?)")


def _scan(text: str, seen: set[tuple[str, str]]) -> bool:
    """Adds the edges of a type to ``seen`` in one pass over its tokens; false if an object is a map and needs :func:`_edges`."""
    frames: list[list] = []
    at = ""
    for token in _TOKEN.finditer(text):
        opens, closes, quoted, plain, scalar = token.groups()
        if scalar:
            if scalar not in ("VOID", "VARIANT"):
                seen.add((at, "scalar"))
        elif opens:
            seen.add((at, "object" if opens[0] == "O" else "array"))
            frames.append([at, 0])
            if opens[0] == "A":
                at = f"{at}\x1f{EACH}" if at else EACH
        elif closes:
            at = frames.pop()[0]
        else:
            frame = frames[-1]
            frame[1] += 1
            if frame[1] > WIDE:
                return False
            name = plain if quoted is None else quoted
            name = ANY if ID_NAME.fullmatch(name) else name
            at = f"{frame[0]}\x1f{name}" if frame[0] else name
    return True


def _edge_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[tuple[str, str]] = set()
    for batch in batches:
        for text in batch["shape"]:
            own: set[tuple[str, str]] = set()
            if not _scan(text, own):
                own = {("\x1f".join(path), kind) for path, kind in _edges(_read_type(text, 0)[0], ())}
            seen |= own
    yield pd.DataFrame(sorted(seen), columns=["path", "kind"])


@dataclass
class Relation:
    """A table of the flat schema."""

    name: str
    paths: list[Path] = field(default_factory=list)
    columns: dict[str, Path] = field(default_factory=dict)
    above: dict[Path, int] = field(default_factory=dict)
    values: bool = False


@dataclass
class SchemaGraph:
    """Element paths of a collection and the tables derived from them."""

    kinds: dict[Path, set[str]]
    relations: dict[str, Relation]


def infer(df: DataFrame, payload: str, alike: float = 0.6, least: int = 4) -> SchemaGraph:
    """The schema graph of a JSON column and its tables.

    Objects whose key sets have a Jaccard similarity of ``alike`` and at least ``least``
    keys together are one element type, whatever they are called.
    """
    shapes = _parsed_once(df.select(payload), payload).select(F.schema_of_variant(payload).alias("shape")).distinct()
    found = shapes.mapInPandas(_edge_batches, "path string, kind string").distinct().limit(EDGES + 1).collect()
    if len(found) > EDGES:
        raise ValueError(f"more than {EDGES} different paths: member names are data that does not look like ids")
    kinds: dict[Path, set[str]] = defaultdict(set)
    for row in found:
        kinds[tuple(row["path"].split("\x1f")) if row["path"] else ()].add(row["kind"])
    return SchemaGraph(dict(kinds), _relations(kinds, alike, least))


def _relations(kinds: dict[Path, set[str]], alike: float, least: int) -> dict[str, Relation]:
    members_of: dict[Path, set[str]] = defaultdict(set)
    for q in kinds:
        if q and q[-1] != EACH:
            members_of[q[:-1]].add(q[-1])
    objects = {p: members_of[p] for p, k in kinds.items() if "object" in k}
    parent = {p: p for p in objects}

    def root(p: Path) -> Path:
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    def element(p: Path) -> str:
        return next((x for x in reversed(p) if x not in (EACH, ANY)), "document")

    def same(p: Path, q: Path) -> bool:
        a, b = objects[p], objects[q]
        named = element(p) == element(q) and (p[-1] == EACH) == (q[-1] == EACH) and bool(a & b)
        return named or len(a | b) >= least and len(a & b) >= alike * len(a | b)

    for p, q in combinations(sorted(objects), 2):
        if p and q and same(p, q):
            parent[root(q)] = root(p)
    types: dict[Path, list[Path]] = defaultdict(list)
    for p in objects:
        types[root(p)].append(p)

    relations: dict[str, Relation] = {}
    owner: dict[Path, Relation] = {}
    for members in sorted(types.values(), key=lambda m: min((len(p), p) for p in m)):
        names = {element(p) for p in members}
        repeated = any(p[-1:] in ((EACH,), (ANY,)) for p in members)
        shared = len({p[: len(p) - (p[-1:] == (EACH,))] for p in members}) > 1
        recursive = any(p != q and q[: len(p)] == p for p in members for q in members)
        if () in members or repeated or shared or recursive:
            shallow = min(members, key=lambda p: (len(p), p))
            name = names.pop() if len(names) == 1 else f"{element(shallow[:-1])}_item"
            while name in relations:
                name += "_"
            relations[name] = Relation(name, _widen(members))
            owner.update(dict.fromkeys(members, relations[name]))

    for path, kind in sorted(kinds.items()):
        if not path or path[-1] == EACH or not kind & {"scalar", "array"}:
            continue
        if path[-1] == ANY and "scalar" in kind:  # a map of scalars
            name = f"{next((x for x in reversed(path) if x not in (EACH, ANY)), 'document')}_values"
            values = relations.setdefault(name, Relation(name, values=True))
            above = next(path[:n] for n in range(len(path) - 1, -1, -1) if path[:n] in owner)
            values.paths = sorted({*values.paths, *((*p, *path[len(above) :]) for p in owner[above].paths)})
            continue
        above = next(path[:n] for n in range(len(path) - 1, -1, -1) if path[:n] in owner)
        rest = path[len(above) :]
        if "array" in kind and "scalar" in kinds.get((*path, EACH), set()):
            values = relations.setdefault(f"{path[-1]}_values", Relation(f"{path[-1]}_values", values=True))
            values.paths = sorted({*values.paths, *((*p, *rest) for p in owner[above].paths)})
        elif "array" not in kind:
            owner[above].columns.setdefault(".".join(rest), rest)
    for relation in relations.values():
        for path in relation.paths:
            relation.above[path] = max((len(p) for r in relations.values() if not r.values for p in r.paths if len(p) < len(path) and _covers(p, path)), default=0)
    return relations


def _covers(pattern: Path, path: Path) -> bool:
    return all(a == b or ANY in (a, b) and EACH not in (a, b) for a, b in zip(pattern, path, strict=False))


def _widen(members: list[Path]) -> list[Path]:
    """Three or more sibling members of one type, or any beside a wildcard, written as one path with a wildcard key."""
    groups: dict[Path, list[Path]] = defaultdict(list)
    for p in members:
        groups[p if p[-1:] in ((), (EACH,)) else p[:-1]].append(p)
    return sorted({(*above, ANY) if len(group) > 2 or (*above, ANY) in group else p for above, group in groups.items() for p in group})


def _member(node: Column, name: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(node, f"$['{quoted}']", "variant")


def _reach(nodes: list[Column], steps: list[Column], path: Path, near: dict[str, list[int | Column]]) -> Column:
    """Array of ``(steps, <inherited>, node)`` for every place ``path`` reaches below the last of ``nodes``.

    ``near`` has, for each inherited member, the depths of ``nodes`` that may hold it and
    columns that were taken beforehand, nearest first.
    """
    node = nodes[-1]
    if not path:
        taken = [F.coalesce(*[n if isinstance(n, Column) else F.try_variant_get(nodes[n], f"$.{name}", "string") for n in where], F.lit(None).cast("string")).alias(name) for name, where in near.items()]
        return F.when(node.isNotNull(), F.array(F.struct((F.array(*steps) if steps else F.array().cast("array<string>")).alias("steps"), *taken, node.alias("node"))))
    step, rest = path[0], path[1:]
    if step == EACH:
        items = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda x, i: F.struct(x.alias("x"), i.cast("string").alias("i")))
        deep = F.transform(items, lambda e: _reach([*nodes, e["x"]], [*steps, e["i"]], rest, near))
    elif step == ANY:
        entries = F.map_entries(F.try_variant_get(node, "$", "map<string,variant>"))
        deep = F.transform(entries, lambda e: _reach([*nodes, e["value"]], [*steps, e["key"]], rest, near))
    else:
        return _reach([*nodes, _member(node, step)], [*steps, F.lit(step)], rest, near)
    return F.flatten(F.filter(deep, lambda x: x.isNotNull()))


def _under(reached: Column, above: int, inherit: list[str]) -> Column:
    """Places with the number of steps that lead to the table row above them."""
    return F.transform(reached, lambda e: F.struct(F.lit(above).alias("above"), e["steps"], *(e[x] for x in inherit), e["node"]))


def populate(df: DataFrame, graph: SchemaGraph, name: str, record: str, payload: str, inherit: list[str] | None = None) -> DataFrame:
    """The rows of one table of the flat schema, from one pass over the payload.

    ``record``, ``steps`` (member names and array positions from the root), ``node_id``,
    ``parent_id`` and one text column for each inlined leaf; value tables have ``value``
    instead.  ``inherit`` names members to take, as text, from the nearest row that has
    them: the row itself, else the one above it and so on.
    """
    relation, inherit = graph.relations[name], inherit or []
    rows = _parsed_once(df.select(record, payload), payload).select(F.col(record).alias("record"), F.col(payload).alias("root"))
    taken: dict[Path, str] = {}
    near: dict[Path, dict[str, list[int | Column]]] = {}
    for path in relation.paths:
        near[path] = {}
        for member in inherit:
            where: list[int | Column] = []
            for depth in range(len(path), -1, -1):
                holders = [p for p in graph.kinds if len(p) == depth + 1 and p[-1] == member and _covers(path[:depth], p)]
                if holders and not {EACH, ANY} & set(path[:depth]):
                    where.append(F.col(taken.setdefault((*path[:depth], member), f"taken_{len(taken)}")))
                elif holders:
                    where.append(depth)
            near[path][member] = where
    rows = rows.select("*", *[F.try_variant_get(_deep(F.col("root"), p[:-1]), f"$.{p[-1]}", "string").alias(c) for p, c in taken.items()])
    fields = ",".join(f"`{x}`:string" for x in inherit)
    none = F.array().cast(f"array<struct<above:int,steps:array<string>,{fields}{',' * bool(fields)}node:variant>>")
    parts = [none]
    for path in relation.paths:
        reached = _reach([F.col("root")], [], path, near[path])
        parts.append(F.coalesce(_under(reached, relation.above[path], inherit), none))
    found = rows.select("record", F.inline(F.concat(*parts)))
    base = [
        "record", "steps",
        F.concat_ws("/", "record", "steps").alias("node_id"),
        F.concat_ws("/", "record", F.slice("steps", F.lit(1), F.col("above"))).alias("parent_id"),
        *inherit,
    ]
    if relation.values:
        return found.select(*base, F.explode(listed(F.col("node"))).alias("value"))
    objects = found.where(F.startswith(F.schema_of_variant("node"), F.lit("OBJECT")))
    leaves = [F.to_json(_deep(F.col("node"), path)).alias(column) for column, path in sorted(relation.columns.items()) if column not in inherit]
    return objects.select(*base, *leaves)


def _deep(node: Column, path: Path) -> Column:
    for step in path:
        node = _member(node, step)
    return node


def listed(node: Column) -> Column:
    """A leaf that is one text or an array of texts, as an array of texts without nulls."""
    many = F.try_variant_get(node, "$", "array<string>")
    one = F.try_variant_get(node, "$", "string")
    return F.array_compact(F.when(F.startswith(F.schema_of_variant(node), F.lit("ARRAY")), many).otherwise(F.array(one)))
