"""Documents whose trees vary with the row: nesting, lets, recursion, records, modules and faults come from columns.

The same SQL text makes them in Spark and in DuckDB, in either dialect, so that a query's expected rows are written from
the columns as well. Of a row's number k depend how many lets, recursive lets and applications are nested, how many
fields the record inside has, how many modules a document holds, and what is wrong with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import documents

LETS, RECURSIONS, CALLS, FIELDS, MODULES, FAULT = "k % 4", "k % 3", "(1 + k % 5)", "k % 4", "(1 + k % 2)", "k % 9"

#: How nodes around a body begin and end, in each dialect.
CLASSIC = {
    "let": ('["LetDefinition",{},["v"],{"inputTypes":[[["p","q"],{},["Unit",{}]]],"outputType":["Variable",{},["t"]],"body":["Variable",{},["p","q"]]},', "]"),
    "recursion": ('["LetRecursion",{},[[["g"],{"inputTypes":[],"outputType":["Unit",{}],"body":["Variable",{},["g"]]}]],', "]"),
    "call": ('["Apply",{"n":1},["Reference",{},[[["shop"]],[["m"]],["f"]]],', "]"),
}
V4 = {
    "let": ('{"LetDefinition":{"name":"v","definition":{"inputTypes":{"p-q":{"type":{"Unit":{"attrs":{}}}}},"outputType":{"Variable":{"name":"t","attrs":{}}},"body":{"Variable":{"name":"p-q","attrs":{}}}},"body":', ',"attrs":{}}}'),
    "recursion": ('{"LetRecursion":{"bindings":[["g",{"inputTypes":{},"outputType":{"Unit":{"attrs":{}}},"body":{"Variable":{"name":"g","attrs":{}}}}]],"body":', ',"attrs":{}}}'),
    "call": ('{"Apply":{"function":{"Reference":{"fqname":"shop:m#f","attrs":{}}},"argument":', ',"attrs":{"extensions":{"n":1}}}}'),
}
#: What stands in a record's field in place of its number, by FAULT, classic: code and path below the number's place.
FAULTS = {
    1: ('["Bogus",{},["x"]]', "unknown_kind", ""), 2: ('["Apply",{},["Unit",{}]]', "arity", ""), 3: ('["Literal",{},["WholeNumberLiteral","x"]]', "wrong_shape", "[2]"),
    4: ('["Reference",{},[[["shop"]]]]', "wrong_shape", "[2]"), 5: ('["Tuple",{},{"a":1}]', "wrong_shape", "[2]"), 6: ('["IfThenElse",{},["Unit",{}],["Nope",{}],["Unit",{}]]', "unknown_kind", "[3]"),
}


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def joined(*parts: str) -> str:
    return " || ".join(parts)


def repeated(part: str, n: str) -> str:
    return f"repeat({part}, CAST({n} AS INT))"


def record(classic: bool, inside: str | None = None) -> str:
    """The record: its fields hold k; ``inside`` (SQL) stands in place of the first."""
    number = joined(text('["Literal",{},["WholeNumberLiteral",' if classic else '{"Literal":{"literal":{"IntegerLiteral":{"value":'), "CAST(k AS STRING)", text("]]" if classic else '}},"attrs":{}}}'))
    field = lambda i, value: joined(text(f'[["f{i}"],' if classic else f'"f{i}":'), value, text("]" if classic else ""))
    fields = joined(field(0, inside or number), *[f"CASE WHEN {FIELDS} >= {i} THEN {joined(text(','), field(i, number))} ELSE '' END" for i in (1, 2, 3)])
    return joined(text('["Record",{},[' if classic else '{"Record":{"fields":{'), fields, text("]]" if classic else '},"attrs":{}}}'))


def body(classic: bool, inside: str | None = None, calls: str = CALLS) -> str:
    """SQL text of a value's tree over the column k."""
    form, around = CLASSIC if classic else V4, (("let", LETS), ("recursion", RECURSIONS), ("call", calls))
    return joined(*[repeated(text(form[kind][0]), n) for kind, n in around], record(classic, inside), *[repeated(text(form[kind][1]), n) for kind, n in reversed(around)])


def document(classic: bool, tree: str) -> str:
    """SQL text of a document: a value in each of one or two modules."""
    if classic:
        value = joined(text('{"inputTypes":[[["x"],{},["Unit",{}]]],"outputType":["Unit",{}],"body":'), tree, text("}"))
        module = lambda n: joined(text(f'[[["{n}"]],{{"access":"Public","value":{{"types":[],"values":[[["go"],{{"access":"Public","value":{{"doc":"","value":'), value, text("}}]]}}]"))
        return joined(text('{"formatVersion":3,"distribution":["Library",[["shop"]],[],{"modules":['), module("m"), f"CASE WHEN {MODULES} = 2 THEN {joined(text(','), module('n'))} ELSE '' END", text("]}]}"))
    value = joined(text('{"ExpressionBody":{"inputTypes":{"x":{"type":{"Unit":{"attrs":{}}}}},"outputType":{"Unit":{"attrs":{}}},"body":'), tree, text("}}"))
    module = lambda n: joined(text(f'"{n}":{{"access":"Public","value":{{"types":{{}},"values":{{"go":{{"access":"Public","value":{{"doc":"","value":'), value, text("}}}}}"))
    return joined(text('{"formatVersion":"4.0.0","distribution":{"Library":{"packageName":"shop","dependencies":{},"def":{"modules":{'), module("m"), f"CASE WHEN {MODULES} = 2 THEN {joined(text(','), module('n'))} ELSE '' END", text("}}}}}"))


def faulty() -> str:
    """SQL text of what stands in the record's first field: a fault by FAULT, else the number."""
    number = joined(text('["Literal",{},["WholeNumberLiteral",'), "CAST(k AS STRING)", text("]]"))
    return f"CASE {FAULT} {' '.join(f'WHEN {n} THEN {text(t)}' for n, (t, _, _) in FAULTS.items())} ELSE {number} END"


#: DuckDB's table of the rows that documents grow from.
ROWS = "(SELECT p_partkey AS k FROM part)"


def texts(spark: SparkSession, sf_dir: str, content: str, table: str = "part", key: str = "p_partkey") -> DataFrame:
    """``(path, content)``: a text for every row of a table, made by the SQL text ``content`` from its key k; spread before any work."""
    keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("k"))
    rows = keys.repartition(max(spark.sparkContext.defaultParallelism, keys.count() // 2000), "k")
    return rows.select(F.col("k").cast("string").alias("path"), F.expr(content).alias("content"))


def corpus(spark: SparkSession, sf_dir: str, content: str, table: str = "part", key: str = "p_partkey") -> DataFrame:
    """A document for every part, or row of another table, numbered by its key."""
    return documents.documents(texts(spark, sf_dir, content, table, key)).withColumn("doc_id", F.col("path").cast("long"))
