"""The adjacency table of documents (one row per node) and the questions asked of it."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import plain
from quarry.functions.remembered import Remembered
from quarry.functions.tree import FAMILY, definition_of, faults_of, rewrite, rows_of
from quarry.sources.documents import UNREADABLE, arrow_schema, by_text, definitions_of, portions, record_batch

NODE = (
    "doc_id long, module string, def_name string, def_ord int, node_id int, parent_id int, role string, ord int, depth int, family string, kind string, "
    "name string, fqn string, lit_type string, lit_text string, attrs string, info string, path string, last int, section string"
)


def trees_of(body, family: str) -> Iterator[tuple]:
    """The node rows of a definition: those of its trees one after another."""
    at = 0
    for role, path, part, kind in definition_of(body, family).children:
        rows = rows_of(part, kind, role, path)
        for row in rows:
            yield (row[0] + at, None if row[1] is None else row[1] + at, *row[2:14], row[14] + at)
        at += len(rows)


def _held(body, family: str) -> list[tuple]:
    """What ``trees_of`` tells of nodes, without places in the text: by the short way where trees are plain."""
    try:
        at = 0
        out: list[tuple] = []
        for role, _, part, kind in definition_of(body, family).children:
            rows = plain.rows_of(part, kind, role)
            out += rows if at == 0 else [(row[0] + at, None if row[1] is None else row[1] + at, *row[2:]) for row in rows]
            at += len(rows)
        return out
    except plain.ODD:
        return [(*row[:3], *row[5:9], *row[10:13]) for row in trees_of(body, family)]


def shredded(docs: DataFrame, schema: str, rows: Callable[[list[tuple]], Iterable[tuple]]) -> DataFrame:
    """``rows`` of each document's definitions, (module, access, family, ord, name, nodes), after its doc_id; unreadable documents have none."""

    def of_text(raw: str) -> list[tuple]:
        try:
            return list(rows([(module, access, family, k, name, list(trees_of(body, family))) for module, _, _, family, k, name, access, _, _, body in definitions_of(raw)]))
        except UNREADABLE:
            return []

    return by_text(docs, schema, of_text)


def _kinds(defs: list[tuple]) -> Iterator[tuple]:
    return ((*key, n) for key, n in Counter((row[5], row[6]) for *_, nodes in defs for row in nodes).items())


def _depths(defs: list[tuple]) -> Iterator[tuple]:
    return ((module, name, len(nodes), max(row[4] for row in nodes), sum(row[6] == "Variable" for row in nodes)) for module, _, _, _, name, nodes in defs if nodes)


def _shapes(defs: list[tuple]) -> Iterator[tuple]:
    for module, access, family, _, name, nodes in defs:
        # Of a value its expression counts, not the types it is annotated with; attributes never count.
        told = [row[2:11] for row in nodes if family == "type" or row[5] != "type"]
        yield module, family, name, access, hashlib.sha256(json.dumps(told).encode()).hexdigest()


def shapes(docs: DataFrame) -> DataFrame:
    """``(doc_id, module, family, name, access, shape)``: a digest of each definition's tree in order; equal trees, equal digests."""
    return shredded(docs, "doc_id long, module string, family string, name string, access string, shape string", _shapes)


#: Kinds of nodes whose fqn may say something.
NAMING = tuple(sorted({kind for kinds in FAMILY.values() for kind, fields in kinds.items() if {"fqname", "externalName"} & set(fields)}))


def shred(docs: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """``ir_nodes`` of ``documents``: parents before children, order kept in ``ord``; unreadable documents have no nodes.

    node_id numbers a definition's nodes in the order of a walk and ``last`` is the last number below a node, so a node lies
    below another exactly if its number is between that one's and its last. path is the JSON path in the definition. Where
    ``kinds`` are given, nodes of other kinds stay in their task.
    """
    told = None if kinds is None else frozenset(kinds)

    def rows(defs: list[tuple]) -> Iterator[tuple]:
        return ((module, name, k, *row, family) for module, _, family, k, name, nodes in defs for row in nodes if told is None or row[6] in told)

    return shredded(docs, NODE, rows)


#: What a node held beside its document tells: the number of its definition in the text, and what its JSON is made of.
HELD = "def int, node_id int, parent_id int, role string, family string, kind string, name string, fqn string, lit_text string, attrs string, info string"


def held(docs: DataFrame) -> DataFrame:
    """``docs`` with ``nodes``, an array of the nodes of each document in the order of ``shred``; unreadable documents have none.

    Nodes stay in the row of their document, so what changes them is a projection, and putting them together again
    (``encode.documents_in``) needs no shuffle. An array is as large as its document.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("nodes", T.ArrayType(T.StructType.fromDDL(HELD)))])
    own = arrow_schema(HELD)

    def of_text(raw: str) -> list[tuple]:
        try:
            found = [(family, body) for _, _, _, family, _, _, _, _, _, body in definitions_of(raw)]
            return [(k, *row) for k, (family, body) in enumerate(found) for row in _held(body, family)]
        except UNREADABLE:
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole):
                rows, ends = [], [0]
                for raw in b.column("raw").to_pylist():
                    rows += of_text(raw)
                    ends.append(len(rows))
                nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), record_batch(rows, own).to_struct_array())
                yield pa.RecordBatch.from_arrays([*b.columns, nodes], names=schema.names)

    return docs.mapInArrow(run, schema)


def kind_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, family, kind, n)``, counted per document before anything leaves its task, then per doc_id."""
    return shredded(docs, "doc_id long, family string, kind string, n long", _kinds).groupBy("doc_id", "family", "kind").agg(F.sum("n").alias("n"))


def depth_profile(docs: DataFrame) -> DataFrame:
    """``(doc_id, module, def_name, n_nodes, max_depth, n_variables)`` of each definition with nodes."""
    return shredded(docs, "doc_id long, module string, def_name string, n_nodes long, max_depth int, n_variables long", _depths)


def map_attributes(nodes: DataFrame, by_kind: dict[str, Callable[[Column], Column]], otherwise: Callable[[Column], Column] = lambda a: a) -> DataFrame:
    """Nodes with new ``attrs``, structure unchanged: a projection, by the node's kind where one is given."""
    return nodes.withColumn("attrs", _mapped(F.col("kind"), F.col("attrs"), by_kind, otherwise))


def _mapped(kind: Column, attrs: Column, by_kind: dict[str, Callable[[Column], Column]], otherwise: Callable[[Column], Column]) -> Column:
    out = F
    for k, f in by_kind.items():
        out = out.when(kind == k, f(attrs))
    return out.otherwise(otherwise(attrs)) if by_kind else otherwise(attrs)


def map_held(nodes: Column, by_kind: dict[str, Callable[[Column], Column]], otherwise: Callable[[Column], Column] = lambda a: a) -> Column:
    """``map_attributes`` of nodes that their document holds."""
    return F.transform(nodes, lambda n: n.withField("attrs", _mapped(n["kind"], n["attrs"], by_kind, otherwise)))


def incomplete(nodes: DataFrame) -> DataFrame:
    """``(doc_id, module, def_name, node_id, kind, reason, detail)`` of holes and natives: the tag of a reason or hint, and what it says."""
    tag = F.coalesce(F.get(F.json_object_keys(F.coalesce(F.get_json_object("info", "$.hint"), F.col("info"))), 0), F.regexp_extract("info", '^"(.*)"$', 1))
    return nodes.where(F.col("kind").isin("Hole", "Native")).select("doc_id", "module", "def_name", "node_id", "kind", tag.alias("reason"), F.col("info").alias("detail"))


def unresolved(nodes: DataFrame, defs: DataFrame, package: str) -> DataFrame:
    """References into ``package`` that no definition of the document answers: an anti-join on document and name."""
    known = defs.where("error IS NULL").select("doc_id", F.concat(F.lit(f"{package}:"), "module", F.lit("#"), "name").alias("fqn")).distinct()
    used = nodes.where(F.startswith("fqn", F.lit(f"{package}:"))).select("doc_id", "fqn").distinct()
    return used.join(known.hint("merge"), ["doc_id", "fqn"], "left_anti")


def closure(edges: DataFrame, rounds: int = 16) -> DataFrame:
    """``(a, b, hops)``: all b reachable from a over ``edges(a, b)``, with the least number of steps.

    Paths double: after round n the pairs hold all least paths of up to 2^n steps, for a least path of up to 2^(n+1) steps
    is two of them, the first as long as a round allows or all there is. Only such joins are made: paths of the longest kind
    with all, so there are as many rounds as the logarithm of the longest path. Each round's pairs are written once. It
    ends when a round finds no path longer than those it has; more rounds than ``rounds`` raise an error.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct().withColumn("hops", F.lit(1)).checkpoint()
    for n in range(rounds):
        longest = 1 << n
        far = pairs.where(F.col("hops") == longest).select("a", F.col("b").alias("via"))
        more = far.join(pairs.select(F.col("a").alias("via"), "b", "hops"), "via").select("a", "b", (F.col("hops") + longest).alias("hops"))
        new = pairs.unionByName(more).groupBy("a", "b").agg(F.min("hops").alias("hops")).checkpoint()
        if new.where(F.col("hops") > longest).isEmpty():
            return new
        pairs = new
    raise ValueError(f"paths of more than {1 << rounds} steps")


#: A name as it should be: in Spark, and names that surely are.
KEBAB, SAFE = "^[a-z0-9-]+$", re.compile("[a-z0-9-]+")
FAULT = "doc_id long, module string, family string, name string, path string, code string, detail string"


def faults(defs: DataFrame) -> DataFrame:
    """What is malformed in ``definitions``, as ``(doc_id, module, family, name, path, code, detail)``, path a JSON path in the definition.

    Codes: unknown_kind, missing_field, arity and wrong_shape of nodes and definitions of either dialect; unreadable for a
    document without any. Definitions are checked one by one where they lie, all their faults are told.
    """
    schema = arrow_schema(FAULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, module, family, name, body, error in zip(*(b.column(c).to_pylist() for c in ("doc_id", "module", "family", "name", "body", "error")), strict=True):
                if error is not None:
                    out.append((doc, None, None, None, "$", "unreadable", error))
                    continue
                try:
                    out += [(doc, module, family, name, *fault) for fault in faults_of(json.loads(body), family)]
                except UNREADABLE as e:
                    out.append((doc, module, family, name, "$", "unreadable", f"{type(e).__name__}: {e}"))
            yield record_batch(out, schema)

    return defs.select("doc_id", "module", "family", "name", "body", "error").mapInArrow(run, FAULT)


def incomplete_definitions(defs: DataFrame) -> DataFrame:
    """``(doc_id, module, def_name, node_id, kind, reason, detail)`` as ``incomplete`` gives, for definitions of version 4 without an
    expression: native, external and incomplete bodies, and incomplete types. node_id is null; JVM functions alone."""
    told = {"NativeBody": "hint", "ExternalBody": "targetPlatform", "IncompleteBody": "reason", "IncompleteTypeDefinition": "incompleteness"}
    at = lambda path: F.coalesce(F.get_json_object("body", f"$.{path}"), F.get_json_object("body", f"$.body.{path}"))
    kind, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for body, field in told.items():
        here = at(body).isNotNull()
        kind, detail = F.when(here, body).otherwise(kind), F.when(here, at(f"{body}.{field}")).otherwise(detail)
    rows = defs.where("error IS NULL").select("doc_id", "module", F.col("name").alias("def_name"), F.lit(None).cast("int").alias("node_id"), kind.alias("kind"), detail.alias("detail")).where("kind IS NOT NULL")
    tag = lambda text: F.coalesce(F.get(F.json_object_keys(text), 0), text)
    hole = F.get_json_object("detail", "$.Hole")  # an incomplete type may name the reason of a hole
    return rows.withColumn("reason", F.when(hole.isNotNull(), F.concat(F.lit("Hole."), tag(hole))).otherwise(tag(F.col("detail")))).select("doc_id", "module", "def_name", "node_id", "kind", "reason", "detail")


def faults_in(docs: DataFrame) -> DataFrame:
    """``faults`` of all definitions of ``documents``, found where a text is read, without a table of definitions between."""
    return by_text(docs, FAULT, _faults)


def _faults(raw: str) -> list[tuple]:
    try:
        found = [(module, family, name, body, json.dumps(body)) for module, _, _, family, _, name, _, _, _, body in definitions_of(raw)]
    except UNREADABLE as e:
        return [(None, None, None, "$", "unreadable", f"{type(e).__name__}: {e}")]
    out: list[tuple] = []
    for module, family, name, body, _ in found:
        try:
            out += [(module, family, name, *fault) for fault in faults_of(body, family)]
        except UNREADABLE as e:
            out.append((module, family, name, "$", "unreadable", f"{type(e).__name__}: {e}"))
    return out


def findings_in(docs: DataFrame) -> DataFrame:
    """``findings`` of ``documents``, each read once and judged alone where it lies: nothing is shuffled, and two rows with one doc_id
    are two documents."""

    def of_text(raw: str) -> list[tuple]:
        subject = lambda *parts: "#".join(p for p in parts if p is not None)
        try:
            defs = [(module, family, name, body, json.dumps(body)) for module, _, _, family, _, name, _, _, _, body in definitions_of(raw)]
        except UNREADABLE as e:
            return [("unreadable", f"{type(e).__name__}: {e}", None)]
        out = [("duplicate", subject(module, name), None) for (module, _, name), n in Counter(d[:3] for d in defs).items() if n > 1]
        out += [("name", subject(module, name), name) for module, _, name, _, _ in defs if name is not None]
        try:
            out += [("hole", x, None) for x in {subject(module, name) for module, family, name, body, _ in defs if any(row[6] == "Hole" for row in trees_of(body, family))}]
        except UNREADABLE:
            pass
        told = [(code, " ".join([subject(module, name), path]), None) for module, _, name, path, code, _ in _faults(raw)]
        return [x for x in out if x[0] != "name" or not SAFE.fullmatch(x[2])] + told

    rows = by_text(docs, "doc_id long, code string, subject string, name string", of_text)
    return rows.where((F.col("code") != "name") | (F.col("name").isNotNull() & ~F.rlike("name", F.lit(KEBAB)))).select("doc_id", "code", "subject")


def findings(nodes: DataFrame, defs: DataFrame) -> DataFrame:
    """Our validation rules, as ``(doc_id, code, subject)``: names defined twice, names that aren't kebab, holes, malformed definitions."""
    good = defs.where("error IS NULL")
    twice = good.groupBy("doc_id", "module", "family", "name").count().where("count > 1").select("doc_id", F.lit("duplicate").alias("code"), F.concat_ws("#", "module", "name").alias("subject"))
    names = good.where(~F.rlike("name", F.lit(KEBAB))).select("doc_id", F.lit("name").alias("code"), F.concat_ws("#", "module", "name").alias("subject"))
    holes = nodes.where("kind = 'Hole'").select("doc_id", F.lit("hole").alias("code"), F.concat_ws("#", "module", "def_name").alias("subject")).distinct()
    broken = defs.where("error IS NOT NULL").select("doc_id", F.lit("unreadable").alias("code"), F.col("error").alias("subject"))
    malformed = faults(good).select("doc_id", "code", F.concat_ws(" ", F.concat_ws("#", "module", "name"), "path").alias("subject"))
    return twice.unionByName(names).unionByName(holes).unionByName(broken).unionByName(malformed)


def converted(trees: DataFrame, family: str, to_v4: bool) -> DataFrame:
    """``trees`` with ``converted`` (JSON of the other dialect) and ``diagnostic`` (why there is none) for its column ``body``."""
    schema = T.StructType([*trees.schema.fields, T.StructField("converted", T.StringType()), T.StructField("diagnostic", T.StringType())])

    def made(body: str) -> tuple[tuple[str | None, str | None], int]:
        try:
            done = json.dumps(rewrite(json.loads(body), family, to_v4)), None
        except UNREADABLE as e:
            done = None, str(e) or type(e).__name__
        return done, 2 * (len(body or "") + len(done[0] or done[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(made)
        for b in batches:
            told = [known[body] for body in b.column("body").to_pylist()]
            done, why = [x for x, _ in told], [x for _, x in told]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string()), pa.array(why, pa.string())], names=schema.names)

    return trees.mapInArrow(run, schema)
