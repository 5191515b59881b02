"""Documents from tables of nodes: each definition's trees are put together again from its rows, and set into its frame."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions.remembered import Remembered
from quarry.functions.tree import BODIES, FAMILY, FIELDS, LITERALS, UNKNOWN
from quarry.sources.documents import UNREADABLE, definitions_of, portions

from .migrate import COMPACT, document_text, put_together

#: Columns of a node that its JSON is made of, and those with its place.
TOLD = ("family", "kind", "name", "fqn", "lit_text", "attrs", "info")
NEEDED = ("doc_id", "module", "section", "def_name", "def_ord", "node_id", "parent_id", "role", *TOLD)


#: JSON as texts have it, written compactly; attributes and the like often occur again.
COMPACTED = Remembered(lambda text: (COMPACT(json.loads(text)), 8 * len(text)), 1 << 20)
quoted = json.encoder.encode_basestring


def node_text(family: str, kind: str, name: str | None, fqn: str | None, lit_text: str | None, attrs: str | None, info: str | None, children: list[tuple[str, str]]) -> str:
    """The JSON of a node of version 4 from what its row tells and that of its children, (role, JSON) in order."""
    if kind in LITERALS:
        text = LITERALS[kind] is str or kind == "DecimalLiteral" and lit_text[:1] != '"'
        return f'{{"{kind}":{{"value":{quoted(lit_text) if text else COMPACT(json.loads(lit_text))}}}}}'
    if kind == UNKNOWN:
        return COMPACTED[info]
    out = ""
    for field, lead, form, shape in FORMS[family][kind]:
        if form == "node":
            for role, x in children:
                if role == field:
                    out += lead + x + ","
                    break
            continue
        if form == "name":
            told = name
        elif form == "fqname":
            told = fqn
        elif form == "info":
            out += lead + (COMPACTED[info] if info else "null") + ","
            continue
        else:
            made = _many(family, field, shape, children)
            out += f"{lead}{made}," if made is not None else ""
            continue
        out += f"{lead}{'null' if told is None else quoted(told)},"
    return f'{{"{kind}":{{{out}"attrs":{COMPACTED[attrs] if attrs else "{}"}}}}}'


def _form(field: str, shape: str) -> str:
    if shape in FAMILY or shape == "literal":
        return "node"
    if shape in ("name", "fqname"):
        return shape
    return "fqname" if field == "externalName" else "info" if shape in ("reason", "info", "text") else "many"


#: The fields of each kind as a text has them: name, its text, the form of what it holds, and its shape.
FORMS = {family: {kind: [(f, f'"{f}":', _form(f, shape), shape + "?" * may_lack) for f, _, shape, may_lack in fields] for kind, fields in kinds.items()} for family, kinds in FIELDS.items()}


def _many(family: str, field: str, shape: str, children: list[tuple[str, str]]) -> str | None:
    """The JSON of a field that may hold several nodes; None if it has none and may be missing."""
    if shape[-1] in "*?" or shape == "cases":
        mine = [x for role, x in children if role == field]
        if shape == "cases":
            mine = [f"[{a},{b}]" for a, b in zip(mine[::2], mine[1::2], strict=True)]
        return f"[{','.join(mine)}]" if mine or shape[-1] != "?" or family == "type" else None
    after, lead = len(field) + 1, f"{field}."
    return _named(shape, [(role[after:], x) for role, x in children if role.startswith(lead)])


def _object(members: dict[str, str]) -> str:
    return f"{{{','.join([f'{quoted(name)}:{x}' for name, x in members.items()])}}}"


def _named(shape: str, parts: list[tuple[str, str]]) -> str:
    """The JSON of a field whose parts have names."""
    if shape.endswith(" fields"):
        return _object(dict(parts))
    if shape == "updates":
        return f"[{','.join([f'[{quoted(name)},{x}]' for name, x in parts])}]"
    if shape == "definition":
        return inner_text(parts)
    named: dict[str, list[tuple[str, str]]] = {}
    for role, x in parts:
        name, _, part = role.partition(".")
        named.setdefault(name, []).append((part, x))
    return f"[{','.join([f'[{quoted(name)},{inner_text(mine)}]' for name, mine in named.items()])}]"


def inner_text(parts: list[tuple[str, str]]) -> str:
    """A let's definition: with types where it had an output type, else its body alone."""
    found = dict(parts)
    if "outputType" not in found:
        return _object({"body": found["body"]})
    given = _object({role[11:]: f'{{"type":{x}}}' for role, x in parts if role.startswith("inputTypes.")})
    return _object({"inputTypes": given, "outputType": found["outputType"], "body": found["body"]})


def framed(body: Any, trees: Iterable[Any]) -> Any:
    """A definition's JSON of version 4 with its trees, in the order of a walk, in place of those it had."""
    rest = iter(trees)
    kind = next(iter(body)) if len(body) == 1 else None
    if kind == "TypeAliasDefinition":
        return {kind: body[kind] | {"typeExp": next(rest)}}
    if kind == "CustomTypeDefinition":
        held = body[kind]["constructors"]
        wrapped = isinstance(held, dict) and "access" in held and "value" in held
        listed = held["value"] if wrapped else held
        args = lambda given: [[n, next(rest)] for n, _ in given]
        made = {n: args(a) for n, a in listed.items()} if isinstance(listed, dict) else [c | {"args": args(c["args"])} if isinstance(c, dict) else [c[0], args(c[1])] for c in listed]
        return {kind: body[kind] | {"constructors": held | {"value": made} if wrapped else made}}
    if kind == "IncompleteTypeDefinition":
        return {kind: body[kind] | {"partialTypeExp": x for x in islice(rest, 1)}}
    inner = body[kind] if kind in BODIES else body
    given = {n: (t | {"type": next(rest)} if isinstance(t, dict) and "type" in t else next(rest)) for n, t in (inner.get("inputTypes") or {}).items()}
    out = inner | ({"inputTypes": given} if "inputTypes" in inner else {})
    if inner.get("outputType") is not None:
        out = out | {"outputType": next(rest)}
    if kind in BODIES and kind != "ExpressionBody":
        return {kind: out}
    if kind == "ExpressionBody":
        return {kind: out | {"body": next(rest)}}
    held = inner["body"]
    wrap = next(iter(held)) if isinstance(held, dict) and len(held) == 1 and next(iter(held)) in BODIES else None
    if wrap is None:
        return out | {"body": next(rest)}
    return out if wrap != "ExpressionBody" else out | {"body": {wrap: held[wrap] | {"body": next(rest)}}}


def filled(body: Any, trees: list[str]) -> str:
    """``framed`` as a text, from the trees' texts: they are set in for marks, which are longer than any like them in the frame."""
    length = 0
    while True:
        length, used = length + 1, []
        marks = (used.append(n) or f"{chr(0) * length}{n}" for n in range(len(trees)))
        pieces = re.split(rf'"(?:\\u0000){{{length}}}(\d+)"', COMPACT(framed(body, marks)))
        if len(pieces) == 2 * len(used) + 1:
            return "".join([trees[int(x)] if i % 2 else x for i, x in enumerate(pieces)])


def assembled(nodes: DataFrame, defs: DataFrame) -> DataFrame:
    """``defs`` (of version 4) with ``converted``, their JSON made anew from ``nodes``, and ``diagnostic``.

    Nodes and frame of a definition meet in one task, in the order of a walk from its end, so that every node finds its
    children finished: a group is as large as one definition, and one shuffle serves trees of any depth. A definition
    that was unreadable keeps its error as diagnostic, one whose nodes don't fill its frame has one of its own. Nodes
    without a definition are left out.
    """
    key = ["doc_id", "module", "section", "def_name", "def_ord"]
    frame = defs.select("doc_id", "module", F.col("family").alias("section"), F.col("name").alias("def_name"), F.col("ord").alias("def_ord"), F.lit(-1).alias("node_id"), F.struct(*defs.columns).alias("frame"))
    rows = nodes.select(*key, *[c for c in NEEDED if c not in key]).unionByName(frame, allowMissingColumns=True)
    rows = rows.repartition(*key).sortWithinPartitions(*key, F.desc("node_id"))
    schema = T.StructType([*defs.schema.fields, T.StructField("converted", T.StringType()), T.StructField("diagnostic", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, {}
        for b in batches:
            out = []
            for row in b.to_pylist():
                mine = tuple(row[k] for k in key)
                if mine != now:
                    now, waiting = mine, {}
                if row["node_id"] >= 0:
                    tree = node_text(*(row[c] for c in TOLD), waiting.pop(row["node_id"], [])[::-1])
                    waiting.setdefault(row["parent_id"], []).append((row["role"], tree))
                    continue
                held = row["frame"]
                converted, why = None, held["error"]
                if why is None:
                    try:
                        converted = filled(json.loads(held["body"]), [x for _, x in waiting.get(None, [])[::-1]])
                    except (StopIteration, KeyError, TypeError, ValueError) as e:
                        why = f"nodes don't fill the definition: {type(e).__name__}"
                out.append(held | {"converted": converted, "diagnostic": why})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def documents_of(docs: DataFrame, nodes: DataFrame, defs: DataFrame) -> DataFrame:
    """``(doc_id, content, diagnostics)``: documents of version 4 with the trees that ``nodes`` holds now, as after ``map_attributes``."""
    return put_together(docs, assembled(nodes, defs), True)


def trees_in(rows: list[tuple]) -> dict[int, list[str]]:
    """The texts of the trees of each definition, by its number, from a document's nodes as ``nodes.HELD`` has them, in the order of a walk, roots below -1."""
    waiting: dict[tuple, list[tuple[str, str]]] = {}
    for k, me, parent, role, family, kind, name, fqn, lit_text, attrs, info in reversed(rows):
        tree = node_text(family, kind, name, fqn, lit_text, attrs, info, waiting.pop((k, me), [])[::-1])
        above = (k, parent)
        if above in waiting:
            waiting[above].append((role, tree))
        else:
            waiting[above] = [(role, tree)]
    return {k: [x for _, x in trees[::-1]] for (k, parent), trees in waiting.items() if parent < 0}


def _rows(nodes: pa.ListArray) -> list[tuple]:
    """The nodes of all documents of a batch; a node without a parent has -1."""
    plainly = lambda x: x.fill_null(-1).to_numpy() if pa.types.is_integer(x.type) else x.to_numpy(zero_copy_only=False)
    return list(zip(*(plainly(x).tolist() for x in nodes.flatten().flatten()), strict=True))


def _document(package: str | None, defs: list[tuple], rows: list[tuple]) -> tuple[str | None, list[str]]:
    broken = None
    try:
        trees = trees_in(rows)
    except UNREADABLE as e:
        trees, broken = {}, e
    made = []
    for k, (module, at, module_access, family, _, name, access, _, doc, body) in enumerate(defs):
        converted = why = None
        try:
            if broken is not None:
                raise broken
            converted = filled(body, trees.get(k, []))
        except (StopIteration, *UNREADABLE) as e:
            why = f"nodes don't fill the definition: {type(e).__name__}"
        made.append((module, at, module_access, family, name, access, doc, converted, why))
    return document_text(package, made, True)


def documents_in(docs: DataFrame, *held: str) -> DataFrame:
    """``docs`` of version 4, with ``package`` and ``raw``, where each of the columns ``held`` of nodes, as ``nodes.held`` and
    ``nodes.map_held`` give them, is now the document made from it: struct<content, diagnostics> as ``documents_of`` has them.

    Nodes and frames meet in the row of their document, so nothing is shuffled, and two rows with one doc_id are two documents.
    """
    made = T.StructType.fromDDL("content string, diagnostics array<string>")
    schema = T.StructType([T.StructField(f.name, made) if f.name in held else f for f in docs.schema.fields])
    arrow = to_arrow_schema(schema)

    def of_texts(b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list[dict]] = {c: [] for c in held}
        rows = {c: iter(_rows(b.column(c))) for c in held}
        sizes = {c: b.column(c).value_lengths().to_pylist() for c in held}
        for i, (package, raw) in enumerate(zip(b.column("package").to_pylist(), b.column("raw").to_pylist(), strict=True)):
            try:
                defs, why = list(definitions_of(raw)), None
            except UNREADABLE as e:
                defs, why = [], [f": {type(e).__name__}: {e}"]
            for c in held:
                mine = list(islice(rows[c], sizes[c][i] or 0))
                content, diagnostics = _document(package, defs, mine) if why is None else (None, why)
                out[c].append({"content": content, "diagnostics": diagnostics})
        columns = [pa.array(out[f.name], f.type) if f.name in held else b.column(f.name) for f in arrow]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (of_texts(b) for whole in batches for b in portions(whole))

    return docs.mapInArrow(run, schema)
