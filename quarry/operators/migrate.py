"""Migration of whole documents between the dialects: definitions are rewritten one by one and put together by grouping."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import plain
from quarry.functions.remembered import Remembered
from quarry.functions.tree import definition_of, faults_of, rewrite, text_of
from quarry.sources.documents import UNREADABLE, controlled, definitions_of, named, portions


Rewrite = Callable[[Any, str, bool], Any]


def definition_in(body: Any, to_v4: bool, rewrite: Rewrite = rewrite) -> Any:
    """A type or value definition in the other dialect. Raises ValueError for what it can't say, and for malformed definitions.

    Names of inputs keep their order; a classic input's own attributes are not kept.
    """
    return _upward(body, rewrite) if to_v4 else _downward(body, rewrite)


def _upward(body: Any, rewrite: Rewrite) -> dict:
    if isinstance(body, list):
        kind, parameters, inner = body[0], [text_of(p) for p in body[1]], body[2]
        if kind == "TypeAliasDefinition":
            return {kind: {"typeParams": parameters, "typeExp": rewrite(inner, "type", True)}}
        if kind != "CustomTypeDefinition":
            raise ValueError(f"{kind} is no definition")
        access, listed = controlled(inner)
        made = [{"name": text_of(n), "args": [[text_of(a), rewrite(t, "type", True)] for a, t in args]} for n, args in listed]
        return {kind: {"typeParams": parameters, "constructors": {"access": access, "value": made}}}
    given = {text_of(i[0]): {"type": rewrite(i[-1], "type", True)} for i in body["inputTypes"]}
    return {"ExpressionBody": {"inputTypes": given, "outputType": rewrite(body["outputType"], "type", True), "body": rewrite(body["body"], "value", True)}}


def _downward(body: dict, rewrite: Rewrite) -> Any:
    kind, inner = next(iter(body.items()))
    if kind == "TypeAliasDefinition":
        return [kind, [p.split("-") for p in inner["typeParams"]], rewrite(inner["typeExp"], "type", False)]
    if kind == "CustomTypeDefinition":
        access, listed = controlled(inner["constructors"])
        made = [(c["name"], c["args"]) for c in listed] if isinstance(listed, list) else list(listed.items())
        args = lambda given: [[a.split("-"), rewrite(t, "type", False)] for a, t in given]
        return [kind, [p.split("-") for p in inner["typeParams"]], {"access": access, "value": [[n.split("-"), args(given)] for n, given in made]}]
    if kind != "ExpressionBody":
        raise ValueError(f"{kind} can't be said in the classic dialect")
    given = [[n.split("-"), {}, rewrite(t["type"] if isinstance(t, dict) and "type" in t else t, "type", False)] for n, t in named(inner["inputTypes"])]
    return {"inputTypes": given, "outputType": rewrite(inner["outputType"], "type", False), "body": rewrite(inner["body"], "value", False)}


#: JSON as documents are written: no blanks, characters as they are.
COMPACT = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def converted_in(body: Any, family: str, to_v4: bool) -> tuple[str | None, str | None]:
    """JSON of a definition in the other dialect, or why there is none: all its faults, or what the dialect can't say. Plain definitions go the short way."""
    try:
        if not definition_of(body, family).faults:
            return COMPACT(definition_in(body, to_v4, plain.rewrite)), None
    except plain.ODD:
        pass
    try:
        if faults := faults_of(body, family):
            return None, "; ".join(map(" ".join, faults))
        return COMPACT(definition_in(body, to_v4)), None
    except UNREADABLE as e:
        return None, str(e) or type(e).__name__


def definitions_in(defs: DataFrame, to_v4: bool) -> DataFrame:
    """``defs`` with ``converted`` (JSON in the other dialect) and ``diagnostic``: why there is none, also for unreadable documents."""
    schema = T.StructType([*defs.schema.fields, T.StructField("converted", T.StringType()), T.StructField("diagnostic", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, why = [], []
            for body, family, error in zip(*(b.column(c).to_pylist() for c in ("body", "family", "error")), strict=True):
                try:
                    converted, diagnostic = (None, None) if body is None else converted_in(json.loads(body), family, to_v4)
                except UNREADABLE as e:
                    converted, diagnostic = None, str(e) or type(e).__name__
                done.append(converted)
                why.append(diagnostic or error)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string()), pa.array(why, pa.string())], names=schema.names)

    return defs.mapInArrow(run, schema)


def _text(c: Column) -> Column:
    """A JSON string."""
    return F.get(F.regexp_extract_all(F.to_json(F.struct(c.alias("x"))), F.lit(r'(?s)^\{"x":(.*)\}$'), F.lit(1)), 0)


def _name(name: Column, to_v4: bool) -> Column:
    return _text(name) if to_v4 else F.to_json(F.split(name, "-"))


def _path(path: Column, to_v4: bool) -> Column:
    return _text(path) if to_v4 else F.to_json(F.transform(F.split(path, "/"), lambda p: F.split(p, "-")))


def migrated(docs: DataFrame, defs: DataFrame, to_v4: bool) -> DataFrame:
    """``(doc_id, content, diagnostics)`` for each of ``docs``: the document in the other dialect, or what stands in its way.

    A malformed definition stands in the way too: its faults are told with their JSON paths. ``defs`` are the definitions of ``docs``. A document with a definition that the other dialect can't say, or that can't
    be read, has no content. Dependencies' specifications are not carried over. A definition is rewritten alone.
    """
    return put_together(docs, definitions_in(defs, to_v4), to_v4)


def migrated_in(docs: DataFrame, to_v4: bool) -> DataFrame:
    """``docs``, with ``package`` and ``raw``, and ``content`` and ``diagnostics`` of each, as ``migrated`` gives them.

    A text is read, rewritten and written where it lies, without a shuffle, and two rows with one doc_id are two documents.
    What was made of texts that occur again is taken again (see ``remembered``).
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("content", T.StringType()), T.StructField("diagnostics", T.ArrayType(T.StringType()))])

    def made(key: tuple[str | None, str | None]) -> tuple[tuple[str | None, list[str]], int]:
        package, raw = key
        try:
            defs = [(module, at, module_access, family, name, access, doc, *converted_in(body, family, to_v4)) for module, at, module_access, family, _, name, access, _, doc, body in definitions_of(raw)]
            out = document_text(package, defs, to_v4)
        except UNREADABLE as e:
            out = None, [utf8(f": {type(e).__name__}: {e}")]
        return out, 2 * (len(raw or "") + len(out[0] or "") + sum(map(len, out[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(made)
        for whole in batches:
            for b in portions(whole):
                told = [known[key] for key in zip(b.column("package").to_pylist(), b.column("raw").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in told], pa.string()), pa.array([why for _, why in told], pa.list_(pa.string()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def put_together(docs: DataFrame, rows: DataFrame, to_v4: bool) -> DataFrame:
    """``(doc_id, content, diagnostics)`` of ``docs`` from definitions with ``converted`` and ``diagnostic``: modules, then documents, are
    put together by two groupings, whose groups are as large as one document, and met with ``docs`` in a sorted join: texts
    made in tasks are larger than Spark foresees, so neither side may be sent whole."""
    colon, comma = F.lit(":" if to_v4 else ","), F.lit(",")
    begin, end = (F.lit(c) for c in ("{}" if to_v4 else "[]"))
    pair = lambda key, value: F.concat(key, colon, value) if to_v4 else F.concat(F.lit("["), key, comma, value, F.lit("]"))
    joined = lambda parts: F.concat(begin, F.array_join(parts, ","), end)
    doc = F.concat(F.lit('"doc":'), F.coalesce(_text(F.col("doc")), F.lit('""')), comma)
    inner = F.when(F.lit(to_v4) & F.col("doc").isNull(), F.col("converted")).otherwise(F.concat(F.lit("{"), doc, F.lit('"value":'), F.col("converted"), F.lit("}")))
    entry = pair(_name(F.col("name"), to_v4), F.concat(F.lit('{"access":"'), "access", F.lit('","value":'), inner, F.lit("}")))

    of = lambda family: F.array_sort(F.collect_list(F.when((F.col("family") == family) & F.col("converted").isNotNull(), F.struct("ord", entry.alias("text")))))
    why = F.collect_list(F.when(F.col("diagnostic").isNotNull(), F.concat_ws(": ", F.concat_ws("#", "module", "name"), "diagnostic")))
    modules = rows.groupBy("doc_id", "module", "module_ord", "module_access").agg(of("type").alias("types"), of("value").alias("values"), why.alias("why"))
    content = F.concat(F.lit('{"access":"'), "module_access", F.lit('","value":{"types":'), joined(F.col("types.text")), F.lit(',"values":'), joined(F.col("values.text")), F.lit("}}"))
    modules = modules.withColumn("text", pair(_path(F.col("module"), to_v4), content))
    whole = modules.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("module_ord", "text"))).alias("m"), F.array_sort(F.flatten(F.collect_list("why"))).alias("diagnostics"))
    package, listed = _path(F.coalesce("package", F.lit("")), to_v4), joined(F.coalesce(F.col("m.text"), F.array().cast("array<string>")))
    if to_v4:
        text = F.concat(F.lit('{"formatVersion":"4.0.0","distribution":{"Library":{"packageName":'), package, F.lit(',"dependencies":{},"def":{"modules":'), listed, F.lit("}}}}"))
    else:
        text = F.concat(F.lit('{"formatVersion":3,"distribution":["Library",'), package, F.lit(',[],{"modules":'), listed, F.lit("}]}"))
    out = docs.select("doc_id", "package").join(whole.hint("merge"), "doc_id", "left").withColumn("diagnostics", F.coalesce("diagnostics", F.array().cast("array<string>")))
    return out.select("doc_id", F.when(F.size("diagnostics") == 0, text).alias("content"), "diagnostics")


def utf8(text: str | None) -> str | None:
    """Text that Arrow can hold: half a surrogate pair is written as JSON escapes it."""
    return text if text is None or text.isascii() else text.encode("utf-8", "backslashreplace").decode()


def document_text(package: str | None, defs: Iterable[tuple], to_v4: bool) -> tuple[str | None, list[str]]:
    """Content and diagnostics of one document, as ``put_together`` gives them, from its definitions in order:
    (module, module_ord, module_access, family, name, access, doc, converted, diagnostic)."""
    begin, end = "{}" if to_v4 else "[]"
    pair = lambda key, value: f"{key}:{value}" if to_v4 else f"[{key},{value}]"
    path = lambda p: COMPACT(p if to_v4 else [n.split("-") for n in p.split("/")])
    modules: dict[tuple, tuple[list[str], list[str]]] = {}
    why: list[str] = []
    for module, at, module_access, family, name, access, doc, converted, diagnostic in defs:
        if diagnostic is not None:
            why.append(f"{'#'.join(p for p in (module, name) if p is not None)}: {diagnostic}")
        held = modules.setdefault((at, module, module_access), ([], []))
        if converted is None or name is None:
            continue
        inner = converted if to_v4 and doc is None else f'{{"doc":{COMPACT(doc or "")},"value":{converted}}}'
        held[family == "value"].append(pair(COMPACT(name if to_v4 else name.split("-")), f'{{"access":"{access}","value":{inner}}}'))
    if why:
        return None, sorted(map(utf8, why))
    listed = ",".join(
        pair(path(module), f'{{"access":"{access}","value":{{"types":{begin}{",".join(types)}{end},"values":{begin}{",".join(values)}{end}}}}}') for (_, module, access), (types, values) in modules.items() if module is not None
    )
    named = path(package or "")
    if to_v4:
        return utf8(f'{{"formatVersion":"4.0.0","distribution":{{"Library":{{"packageName":{named},"dependencies":{{}},"def":{{"modules":{{{listed}}}}}}}}}}}'), []
    return utf8(f'{{"formatVersion":3,"distribution":["Library",{named},[],{{"modules":[{listed}]}}]}}'), []
