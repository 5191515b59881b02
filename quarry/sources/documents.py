"""Documents as tables: scans of files, version detection, and the modules, types, values and dependencies of each document."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.remembered import Remembered
from quarry.functions.tree import text_of

#: Which files hold source text of a language.
EXTENSIONS = {"gleam": ("gleam",), "elm": ("elm",), "python": ("py",)}


def files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """``(path, content)`` of all files under ``path`` (or several) whose name matches, each whole."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def source_files(spark: SparkSession, path: str, language: str) -> DataFrame:
    """Source files of a language; an unknown one raises ValueError."""
    if language not in EXTENSIONS:
        raise ValueError(f"unknown language {language!r}")
    return files(spark, path, "*.{" + ",".join(EXTENSIONS[language]) + "}")


def version_of(content: Column) -> Column:
    """struct<raw, major> of a document's version: v4 for a number of at least 4 or a text that begins with 4, else classic; null without one."""
    found = F.from_json(content, "formatVersion variant")["formatVersion"]
    raw, kind = F.try_variant_get(found, "$", "string"), F.schema_of_variant(found)
    new = F.when(kind == "STRING", F.startswith(raw, F.lit("4"))).otherwise(F.coalesce(F.try_variant_get(found, "$", "double") >= 4, F.lit(False)))
    return F.struct(raw.alias("raw"), F.when(raw.isNotNull(), F.when(new, "v4").otherwise("classic")).alias("major"))


def target_version(alias: Column) -> Column:
    """v4 or classic for the names a user may give, whatever their case; null for others."""
    a = F.lower(alias)
    return F.when(a.isin("latest", "v4", "4"), "v4").when(a.isin("classic", "v3", "3", "v2", "2", "v1", "1"), "classic")


def documents(found: DataFrame, *keep: str) -> DataFrame:
    """``(doc_id, path, dialect, version_raw, version_major, kind, package, raw)`` of ``files``, and their columns ``keep``; no shuffle, JVM functions alone.

    A document is of version 4 if its version says so and its distribution is a tagged object, else classic if that is a
    tagged list, whatever the version. Dialect null marks a file that is neither: not JSON, without version, of another shape.
    """
    at = lambda p: F.get_json_object("content", p)
    version, wrapper = version_of(F.col("content")), F.get(F.json_object_keys(at("$.distribution")), 0)
    raw, listed = version["raw"], at("$.distribution[0]")
    dialect = F.when((version["major"] == "v4") & wrapper.isNotNull(), "v4").when(raw.isNotNull() & listed.isNotNull(), "classic")
    classic_package = F.from_json(at("$.distribution[1]"), "array<array<string>>")
    package = F.coalesce(at("$.distribution.Library.packageName"), at("$.distribution.Specs.packageName"), at("$.distribution.Application.packageName"),
        F.array_join(F.transform(classic_package, lambda w: F.array_join(w, "-")), "/"))
    return found.select(
        F.xxhash64("path").alias("doc_id"), "path", dialect.alias("dialect"), raw.alias("version_raw"),
        F.regexp_extract(raw, r"^(\d+)", 1).try_cast("int").alias("version_major"), F.coalesce(wrapper, listed).alias("kind"), package.alias("package"), F.col("content").alias("raw"), *keep,
    )


def literals(json_text: Column) -> Column:
    """struct<kind, value> of a literal in any of its forms: an object with or without ``value``, or a tagged pair."""
    key = F.coalesce(F.get(F.json_object_keys(json_text), 0), F.get_json_object(json_text, "$[0]"))
    body = F.coalesce(*[F.coalesce(F.get_json_object(json_text, f"$.{k}.value"), F.get_json_object(json_text, f"$.{k}")) for k in ("BoolLiteral", "CharLiteral", "StringLiteral", "IntegerLiteral", "WholeNumberLiteral", "FloatLiteral", "DecimalLiteral")], F.get_json_object(json_text, "$[1]"))
    return F.struct(F.when(key == "WholeNumberLiteral", "IntegerLiteral").otherwise(key).alias("kind"), body.alias("value"))


def definitions_of(raw: str) -> Iterator[tuple]:
    """(module, module_ord, module_access, family, ord, name, access, def_kind, doc, body) of a document of either dialect.

    Order is that of the text; entries without a name and a body are left out; body is as parsed. Raises ValueError for other shapes.
    """
    parsed = json.loads(raw)
    body = parsed.get("distribution") if isinstance(parsed, dict) else None
    if isinstance(body, dict) and body:
        inner = next(iter(body.values()))
        definition = inner.get("def") or inner.get("spec") or {}
    elif isinstance(body, list) and len(body) == 4 and str(body[0]).lower() == "library":
        definition = body[3]
    else:
        raise ValueError("no distribution")
    for m, (path, module) in enumerate(named(definition.get("modules", []))):
        access, content = controlled(module)
        for family in ("types", "values"):
            for k, (name, entry) in enumerate(named(content.get(family, []) if isinstance(content, dict) else [])):
                own, value = controlled(entry)
                doc = None
                if isinstance(value, dict) and set(value) == {"doc", "value"}:
                    doc, value = value["doc"], value["value"]
                kind = value[0] if isinstance(value, list) and value else next(iter(value)) if isinstance(value, dict) and len(value) == 1 else "ValueDefinition"
                yield text_of(path), m, access, family[:-1], k, text_of(name), own, str(kind), doc, value


#: What a document or tree that can't be read may raise; a text of too many levels among them.
UNREADABLE = (ValueError, TypeError, AttributeError, KeyError, IndexError, RecursionError)


def named(entries: Any) -> list[tuple[Any, Any]]:
    if isinstance(entries, dict):
        return list(entries.items())
    return [(e[0], e[1]) if isinstance(e, list) and len(e) == 2 else (e["name"], e.get("def") or e.get("spec")) for e in entries if isinstance(e, dict) and "name" in e or isinstance(e, list) and len(e) == 2]


def controlled(entry: Any) -> tuple[str, Any]:
    """Access and content; whatever isn't marked private is public."""
    if isinstance(entry, dict) and "access" in entry:
        return ("Private" if str(entry["access"]).lower() == "private" else "Public"), entry.get("value")
    if isinstance(entry, list) and len(entry) == 2 and str(entry[0]) in ("Public", "Private", "public", "private"):
        return str(entry[0]).title(), entry[1]
    return "Public", entry


DEFINITION = "doc_id long, module string, module_ord int, module_access string, family string, ord int, name string, access string, def_kind string, doc string, body string, error string"


#: Documents whose rows a task holds at a time, and bytes of text where rows are made of all of it.
DOCUMENTS, TEXT = 64, 4 << 20


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of documents in parts of at most ``DOCUMENTS``, and of at most ``TEXT`` bytes of ``raw`` unless one alone has more."""
    begin = held = 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(batch.column("raw")), 0).to_pylist()):
        if at > begin and (at - begin == DOCUMENTS or held + size > TEXT):
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def record_batch(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def by_text(docs: DataFrame, schema: str, rows: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """``schema``'s doc_id and ``rows`` of each document's text: a text is read once and leaves its task as rows alone.

    ``rows`` depend on the text alone, so the rows of texts that a task saw lately are taken again (see ``remembered``).
    Batches of a few documents keep what a task holds small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(schema)
        own = pa.schema(list(arrow)[1:])

        def made(raw: str) -> tuple[pa.RecordBatch, int]:
            batch = record_batch(rows(raw), own)
            return batch, batch.nbytes + 2 * len(raw or "")

        known = Remembered(made)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS):
                ids, texts = (whole.column(i).slice(at, DOCUMENTS) for i in (0, 1))
                parts = [known[raw] for raw in texts.to_pylist()]
                of = pa.array([i for i, part in enumerate(parts) for _ in range(part.num_rows)], pa.int64())
                columns = [c.combine_chunks() for c in pa.Table.from_batches(parts, own).columns]
                yield pa.RecordBatch.from_arrays([ids.take(of), *columns], schema=arrow)

    return docs.select("doc_id", "raw").mapInArrow(run, schema)


def _definitions(raw: str) -> list[tuple]:
    try:
        return [(*row, json.dumps(body), None) for *row, body in definitions_of(raw)]
    except UNREADABLE as e:
        return [(*[None] * 10, f"{type(e).__name__}: {e}")]


def definitions(docs: DataFrame) -> DataFrame:
    """A row for each type and value definition of ``documents``; a document that can't be read gives one row with ``error``."""
    return by_text(docs, DEFINITION, _definitions)


def dependencies(docs: DataFrame) -> DataFrame:
    """``(doc_id, ord, dependency)``: packages that documents of either dialect depend on, in order."""
    new = F.json_object_keys(F.coalesce(*[F.get_json_object("raw", f"$.distribution.{k}.dependencies") for k in ("Library", "Specs", "Application")]))
    old = F.from_json(F.get_json_object("raw", "$.distribution[2]"), "array<array<string>>")
    path = lambda x: F.array_join(F.transform(F.from_json(x[0], "array<array<string>>"), lambda w: F.array_join(w, "-")), "/")
    return docs.select("doc_id", F.posexplode(F.coalesce(new, F.transform(old, path))).alias("ord", "dependency"))


def entry_points(docs: DataFrame) -> DataFrame:
    """``(doc_id, ord, name, kind, target, doc)`` of applications."""
    found = F.from_json(F.get_json_object("raw", "$.distribution.Application.entryPoints"), "map<string, struct<target:string,kind:string,doc:string>>")
    rows = docs.select("doc_id", F.posexplode(F.map_entries(found)).alias("ord", "e"))
    return rows.select("doc_id", "ord", F.col("e.key").alias("name"), "e.value.kind", "e.value.target", "e.value.doc")


def constructors(defs: DataFrame) -> DataFrame:
    """``(doc_id, module, type_name, ord, name, access, n_args)`` of custom types of version 4, the constructors with or without access."""
    at = "$.CustomTypeDefinition.constructors"
    listed = F.from_json(F.get_json_object("body", f"{at}.value"), "array<struct<name:string,args:array<string>>>")
    plain = F.transform(F.map_entries(F.from_json(F.get_json_object("body", at), "map<string, array<string>>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("args")))
    rows = defs.where("def_kind = 'CustomTypeDefinition'").select("doc_id", "module", F.col("name").alias("type_name"), F.coalesce(F.get_json_object("body", f"{at}.access"), F.lit("Public")).alias("access"), F.posexplode(F.coalesce(listed, plain)).alias("ord", "c"))
    return rows.select("doc_id", "module", "type_name", "ord", "c.name", "access", F.size("c.args").alias("n_args"))


def inputs(defs: DataFrame) -> DataFrame:
    """``(doc_id, module, value_name, ord, name, type)``: parameters of value definitions of version 4, types as JSON."""
    found = F.from_json(F.coalesce(*[F.get_json_object("body", f"$.{k}.inputTypes") for k in ("ExpressionBody", "NativeBody", "ExternalBody", "IncompleteBody")]), "map<string, string>")
    rows = defs.where("family = 'value'").select("doc_id", "module", F.col("name").alias("value_name"), F.posexplode(F.map_entries(found)).alias("ord", "e"))
    return rows.select("doc_id", "module", "value_name", "ord", F.col("e.key").alias("name"), F.coalesce(F.get_json_object("e.value", "$.type"), F.col("e.value")).alias("type"))


def decorations(found: DataFrame) -> DataFrame:
    """``(target, decorations)`` of ``*.deco.json`` files: JSON with ``target`` and ``decorations``; of several for one target the last path wins."""
    rows = found.where(F.endswith("path", F.lit(".deco.json"))).select("path", F.get_json_object("content", "$.target").alias("target"), F.get_json_object("content", "$.decorations").alias("decorations"))
    return rows.where("target IS NOT NULL").groupBy("target").agg(F.max_by("decorations", "path").alias("decorations"))


def has_decorator(decorations: Column, kind: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(decorations), kind), F.lit(False))


def modules_of_tree(found: DataFrame, root: str) -> DataFrame:
    """``(module, package)`` of a source tree of JSON files: every ``src/**/*.json`` but the package file is a public module,
    named by its path with dots; the package's name comes from the file ``root`` in the tree, else it is unknown-package."""
    inside = F.regexp_extract("path", r"/src/(.+)\.json$", 1)
    name = found.where(F.endswith("path", F.lit(f"/{root}"))).select(F.get_json_object("content", "$.name").alias("n")).agg(F.first("n", True).alias("n"))
    rows = found.where((inside != "") & ~F.rlike("path", F.lit(r"/Package\.json$"))).select(F.translate(inside, "/", ".").alias("module"))
    return rows.join(F.broadcast(name)).select("module", F.coalesce("n", F.lit("unknown-package")).alias("package"), F.lit("Public").alias("access"))


def notebook_cells(found: DataFrame) -> DataFrame:
    """``(path, ord, id, cell_type, source)`` of notebooks; a notebook without cells gives none."""
    cells = F.from_json(F.get_json_object("content", "$.cells"), "array<struct<id:string,cell_type:string,source:string>>")
    cell = found.select("path", F.posexplode(cells).alias("ord", "c"))
    lines = F.array_join(F.from_json("c.source", "array<string>"), "")  # a source is a list of lines or one text
    source = F.when(F.startswith("c.source", F.lit("[")), F.coalesce(lines, F.col("c.source"))).otherwise(F.col("c.source"))
    return cell.select("path", "ord", F.coalesce("c.id", F.col("ord").cast("string")).alias("id"), "c.cell_type", source.alias("source"))


def json_lines(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``line``: the other columns of each row as one JSON object, null fields left out; ``.select("line").write.text``
    makes JSON Lines."""
    return rows.select(*keep, F.to_json(F.struct(*[c for c in rows.columns if c not in keep])).alias("line"))


def write_tree(defs: DataFrame, path: str) -> None:
    """One JSON line per definition under ``module=.../family=...``, in a definition's order."""
    ordered = defs.where("error IS NULL").repartition("module", "family").sortWithinPartitions("module", "family", "ord")
    ordered.select("module", "family", "ord", "name", "access", "def_kind", "body").write.mode("overwrite").partitionBy("module", "family").json(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tree`` wrote; lines that can't be read come with ``_corrupt_record``."""
    return spark.read.schema("module string, family string, ord int, name string, access string, def_kind string, body string, _corrupt_record string").json(path)


def last_wins(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Insertion into an ordered map: a key keeps its first position and its last value."""
    w = Window.partitionBy(*key)
    first = F.min(order).over(w)
    latest = F.row_number().over(w.orderBy(F.desc(order)))
    return rows.select(*key, first.alias("position"), F.col(value), latest.alias("__n")).where("__n = 1").drop("__n")
