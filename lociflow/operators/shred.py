"""Shredding of deeply nested JSON: an adjacency table of nodes, then entity tables that keep parent-child links."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.runtime import ship, spool

_JSON_BLANKS = " \t\n\r"
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_STRING = re.compile(r'"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"')
_SPACE = re.compile(r"[ \t\n\r]*")


class Incomplete(ValueError):
    """Not complete JSON."""


def events(text: str) -> list[tuple]:
    """The nodes of a JSON text in document order: (kind, parent number, key or position, scalar).

    kind is o(bject), a(rray), s(tring), n(umber), b(oolean) or z (null). It is iterative, so the depth of nesting is
    bounded by memory alone, and it keeps keys that occur twice.
    """
    out: list[tuple] = []
    stack: list[list] = []  # [node number, is object, next position]
    i, n = _SPACE.match(text, 0).end(), len(text)
    label: str | int | None = None
    while True:
        # a value
        if i >= n:
            raise Incomplete
        c = text[i]
        parent = stack[-1][0] if stack else -1
        if c in "{[":
            out.append(("o" if c == "{" else "a", parent, label, None))
            stack.append([len(out) - 1, c == "{", 0])
            i = _SPACE.match(text, i + 1).end()
            if i < n and text[i] == ("}" if c == "{" else "]"):
                stack.pop()
                i += 1
            else:
                i, label = _next_label(text, i, stack[-1])
                continue
        elif c == '"':
            m = _STRING.match(text, i)
            if not m:
                raise Incomplete
            raw = m.group()
            out.append(("s", parent, label, json.loads(raw) if "\\" in raw else raw[1:-1]))
            i = m.end()
        elif m := _NUMBER.match(text, i):
            out.append(("n", parent, label, m.group()))
            i = m.end()
        else:
            for word, kind in (("true", "b"), ("false", "b"), ("null", "z")):
                if text.startswith(word, i):
                    out.append((kind, parent, label, None if kind == "z" else word))
                    i += len(word)
                    break
            else:
                raise Incomplete
        # what follows a value
        while True:
            i = _SPACE.match(text, i).end()
            if not stack:
                if i != n:
                    raise Incomplete
                return out
            c = text[i : i + 1]
            if c == ",":
                i, label = _next_label(text, _SPACE.match(text, i + 1).end(), stack[-1])
                break
            if c != ("}" if stack[-1][1] else "]"):
                raise Incomplete
            stack.pop()
            i += 1


def _next_label(text: str, i: int, top: list) -> tuple[int, str | int]:
    if not top[1]:
        top[2] += 1
        return i, top[2] - 1
    m = _STRING.match(text, i)
    if not m:
        raise Incomplete
    raw = m.group()
    i = _SPACE.match(text, m.end()).end()
    if text[i : i + 1] != ":":
        raise Incomplete
    return _SPACE.match(text, i + 1).end(), json.loads(raw) if "\\" in raw else raw[1:-1]


class _Object(list):
    """The pairs of an object, in order; keys may occur twice."""


class _Number(str):
    """A number as it is written."""


def _no_constant(name: str) -> None:
    raise ValueError(name)  # NaN and Infinity are no JSON


_DECODER = json.JSONDecoder(object_pairs_hook=_Object, parse_float=_Number, parse_int=_Number, parse_constant=_no_constant)


def parsed(text: str):
    """The value of a JSON text: objects as lists of pairs, numbers as written. Nesting deeper than the interpreter allows
    goes through events(), which knows no depth."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        pass
    except ValueError as error:
        raise Incomplete from error
    made: list = []
    for kind, up, key, scalar in events(text):
        value = _Object() if kind == "o" else [] if kind == "a" else _Number(scalar) if kind == "n" else scalar == "true" if kind == "b" else scalar
        if up >= 0:
            made[up].append((key, value) if type(made[up]) is _Object else value)
        made.append(value)
    return made[0]


def _read_in_place(text: str):
    """What a string holds that is itself JSON text of an object or a list; else the string."""
    if text.lstrip(_JSON_BLANKS)[:1] in ("{", "["):
        try:
            return parsed(text)
        except Incomplete:
            return text
    return text


def _whole(text: str) -> str:
    """A text without halves of surrogate pairs, which escapes may spell and no encoding takes."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def nodes(payload: str | None, objects_only: bool = False) -> list[tuple]:
    """Adjacency rows (node, parent, owner, label, ordinal, kind, scalar, path, entity) of a payload.

    node numbers rise from 0, the whole payload, in document order; parent is the node around it and owner the nearest
    object around it, -1 for none. A key gives a label, a list position an ordinal. path joins keys and
    positions by '/'; entity is the path without positions. A string that is itself JSON text of an object or a list is
    read in place, under its own path. A null payload, or one that is not complete JSON, has none. With `objects_only`
    other nodes are passed through, but leave no row; the numbers then differ from those of a full shredding.
    """
    if payload is None:
        return []
    try:
        value = parsed(payload)
    except Incomplete:
        return []
    out: list[tuple] = []
    number = -1
    stack = [(value, -1, -1, None, None, "", "")]
    while stack:
        v, parent, owner, label, place, path, entity = stack.pop()
        number += 1
        if type(v) is str:
            v = _read_in_place(v)
        t = type(v)
        if t is _Object:
            out.append((number, parent, owner, label, place, "o", None, path, entity))
            below = []
            for k, c in v:
                if objects_only and type(c) not in (_Object, list) and (type(c) is not str or c.lstrip(_JSON_BLANKS)[:1] not in ("{", "[")):
                    continue
                k = _whole(k)
                below.append((c, number, number, k, None, f"{path}/{k}" if path else k, f"{entity}/{k}" if entity else k))
            stack += reversed(below)
        elif t is list:
            if not objects_only:
                out.append((number, parent, owner, label, place, "a", None, path, entity))
            stack += reversed([(c, number, owner, None, k, f"{path}/{k}" if path else str(k), entity) for k, c in enumerate(v)])
        elif not objects_only:
            kind = "n" if t is _Number else "s" if t is str else "b" if t is bool else "z"
            scalar = None if v is None else ("true" if v else "false") if t is bool else _whole(v)
            out.append((number, parent, owner, label, place, kind, scalar, path, entity))
    return out


_FIELDS = pa.schema(
    [("node", pa.int32()), ("parent", pa.int32()), ("owner", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("path", pa.string()), ("entity", pa.string())]
)


def adjacency(df: DataFrame, id_col: str, payload_col: str, objects_only: bool = False) -> DataFrame:
    """Rows (id, node, parent, owner, label, ordinal, kind, scalar, path, entity): the nodes of each payload, see nodes().

    A payload is parsed in its own row, no shuffle; a row given twice comes out twice. Only two columns are read.
    """
    ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("__id"), F.col(payload_col).alias("__payload"))
    id_type = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                b = batch.slice(start, 256)
                at, rows = [], []
                for i, payload in enumerate(b.column(1).to_pylist()):
                    found = nodes(payload, objects_only)
                    at += [i] * len(found)
                    rows += found
                cols = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FIELDS)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], [id_col, *_FIELDS.names])

    ddl = "node int, parent int, owner int, label string, ordinal int, kind string, scalar string, path string, entity string"
    return source.mapInArrow(run, f"`{id_col}` {id_type}, {ddl}")


def object_links(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Rows (id, parent_path, node_path), each once: every object of a payload but the whole payload, with the nearest
    object around it (the empty string for the whole payload or none).

    Objects join their owners in the adjacency table. Repeated rows are made one before the join.
    """
    objects = adjacency(df, id_col, payload_col, objects_only=True).select(id_col, "node", "owner", "path")
    objects = spool(objects.dropDuplicates([id_col, "node", "path"]), "objects")  # both sides of the join: parsed once
    owners = objects.select(F.col(id_col).alias("__i"), F.col("node").alias("__n"), F.col("path").alias("__p"))
    joined = objects.join(owners, (objects[id_col] == owners["__i"]) & (objects["owner"] == owners["__n"]), "left")
    return (
        joined.where("node <> 0")
        .select(id_col, F.coalesce("__p", F.lit("")).alias("parent_path"), F.col("path").alias("node_path"))
        .distinct()
    )


def entity_table(adj: DataFrame, id_col: str, entity: str, columns: list[str]) -> DataFrame:
    """The objects at `entity` (keys joined by '/', positions left out) as a flat table: (id, node, owner, path, one
    column for each scalar child named in `columns`).

    A bare object where others have a list of objects is one row like each of theirs. Where a child is an object or a
    list, or missing, or null, its column is null. Of keys that occur twice in an object the last counts.
    """
    objects = adj.where((F.col("kind") == "o") & (F.col("entity") == entity)).select(id_col, "node", "owner", "path").distinct()
    scalars = adj.where(F.col("kind").isin("s", "n", "b") & F.col("label").isin(columns)).select(
        F.col(id_col).alias("__i"), F.col("parent").alias("__p"), "label", F.struct("node", "scalar").alias("value")
    )
    joined = objects.join(scalars, (objects[id_col] == scalars["__i"]) & (objects["node"] == scalars["__p"]), "left")
    picks = [F.max(F.when(F.col("label") == c, F.col("value")))["scalar"].alias(c) for c in columns]
    return joined.groupBy(id_col, "node", "owner", "path").agg(*picks)


def entity_pivot(adj: DataFrame, id_col: str, at: Column, first: tuple[str, ...] = ()) -> DataFrame:
    """The objects whose entity (column `entity`) fulfils `at`, as a flat table: (id, node, owner, path, entity, then one
    column for each key that has a scalar or null in any of them; `first` in front, there even if no object has it).

    The keys come from the adjacency table; they are distinct labels, sent to the driver. A key that is spelled like a
    column before it, case aside, gets a number behind it. Cells are null as in entity_table(); the child object or list
    in their place has a row or rows in the tables of children and list values. A scalar's home is its entity less its
    label, so objects and scalars meet in one aggregation without a join.
    """
    scalar = F.col("kind").isin("s", "n", "b", "z") & F.col("label").isNotNull()
    home = F.when(F.col("kind") == "o", F.col("entity")).when(scalar, F.expr("substring(entity, 1, length(entity) - length(label) - 1)"))
    rows = adj.withColumn("entity", home).where("entity is not null").where(at)
    is_object = F.col("kind") == "o"
    only = lambda c: F.when(is_object, F.col(c)).alias(c)
    rows = spool(rows.select(id_col, "node", "parent", only("owner"), "label", "kind", "scalar", only("path"), only("entity")), "entity")  # read twice, parsed once
    found = sorted(r[0] for r in rows.where("kind <> 'o'").select("label").distinct().collect())
    names, used = {}, {id_col.lower(), "node", "owner", "path", "entity"}
    for label in [*first, *[x for x in found if x not in first]]:
        name, k = label, 1
        while name.lower() in used or not name:
            k += 1
            name = f"{label}_{k}"
        used.add(name.lower())
        names[label] = name
    home = F.max(F.when(is_object, F.struct("node", "owner", "path", "entity"))).alias("home")
    cells = F.collect_list(F.when(~is_object, F.struct("node", "label", "scalar")))
    key = F.when(is_object, F.col("node")).otherwise(F.col("parent"))
    each = rows.groupBy(id_col, key.alias("__key")).agg(home, F.array_sort(F.array_distinct(cells)).alias("cells")).where("home is not null")
    flat = each.select(id_col, "home.*", "cells")
    id_type = adj.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {id_type}, node int, owner int, path string, entity string" + "".join(f", `{n.replace('`', '``')}` string" for n in names.values())
    labels = list(names)

    def pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(labels, pa.string())
        for b in batches:
            cells = b.column(5)
            of = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False))
            inner = cells.flatten()
            number = pc.fill_null(pc.index_in(inner.field("label"), value_set=wanted), -1).to_numpy(zero_copy_only=False)
            cols = []
            for k in range(len(labels)):
                at = np.flatnonzero(number == k)
                place = np.full(b.num_rows, -1, np.int64)
                place[of[at]] = at  # cells come in order: of a key that occurs twice the last counts
                cols.append(inner.field("scalar").take(pa.array(place, mask=place < 0)))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *cols], [id_col, "node", "owner", "path", "entity", *names.values()])

    return flat.mapInArrow(pivot, ddl)


def values(adj: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, node_path, kind, scalar), each once: all scalars and nulls of a payload by their place."""
    return adj.where(F.col("kind").isin("s", "n", "b", "z")).select(id_col, F.col("path").alias("node_path"), "kind", "scalar").distinct()


def list_values(adj: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, node, parent, owner, ordinal, kind, scalar, path, entity), each once: the scalars that stand in lists."""
    return adj.where(F.col("ordinal").isNotNull() & F.col("kind").isin("s", "n", "b", "z")).select(id_col, "node", "parent", "owner", "ordinal", "kind", "scalar", "path", "entity").distinct()
