"""Functions registered with a session, for queries written in SQL: names, documents as table functions, and externals."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import names

#: SQL functions: name -> parameters, result, expression. The patterns are those of ``names``.
SCALARS = {
    "ir_words": ("name STRING", "ARRAY<STRING>", f"regexp_extract_all(name, r'{names.V4_WORD}', 0)"),
    "ir_kebab": ("name STRING", "STRING", "lower(array_join(ir_words(name), '-'))"),
    "ir_snake": ("name STRING", "STRING", "lower(array_join(ir_words(name), '_'))"),
    "ir_title": ("name STRING", "STRING", "array_join(transform(ir_words(name), w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), '')"),
    "ir_package": ("fqname STRING", "STRING", "CASE WHEN contains(fqname, ':') THEN substring_index(fqname, ':', 1) END"),
    "ir_module": ("fqname STRING", "STRING", "CASE WHEN contains(fqname, '#') THEN substring_index(substring_index(fqname, '#', 1), ':', -1) END"),
    "ir_local": ("fqname STRING", "STRING", "CASE WHEN contains(fqname, '#') THEN substring_index(fqname, '#', -1) END"),
}


@udtf(returnType="module string, section string, def_name string, node_id int, parent_id int, role string, depth int, family string, kind string, name string, fqn string, path string")
class Nodes:
    """The nodes of one document's text; none for null and for what can't be read."""

    def eval(self, raw: str) -> Iterator[tuple]:
        from quarry.operators.nodes import trees_of
        from quarry.sources.documents import UNREADABLE, definitions_of

        try:
            found = [(m, f, n, list(trees_of(body, f))) for m, _, _, f, _, n, _, _, _, body in definitions_of(raw)] if raw is not None else []
        except UNREADABLE:
            found = []
        for module, family, name, rows in found:
            for r in rows:
                yield module, family, name, r[0], r[1], r[2], r[4], r[5], r[6], r[7], r[8], r[13]


@udtf(returnType="module string, section string, def_name string, path string, code string, detail string")
class Faults:
    """What is malformed in one document's text; one row with code unreadable for what can't be read, none for null."""

    def eval(self, raw: str) -> Iterator[tuple]:
        from quarry.functions.tree import faults_of
        from quarry.sources.documents import UNREADABLE, definitions_of

        if raw is None:
            return
        try:
            found = [(m, f, n, *fault) for m, _, _, f, _, n, _, _, _, body in definitions_of(raw) for fault in faults_of(body, f)]
        except UNREADABLE as e:
            found = [(None, None, None, "$", "unreadable", f"{type(e).__name__}: {e}")]
        yield from found


TABLES = {"ir_nodes": Nodes, "ir_faults": Faults}


def register(spark: SparkSession) -> dict[str, str]:
    """Register all functions for this session's SQL, anew where they are there; gives name -> scalar or table.

    Table functions are called laterally: ``FROM docs, LATERAL ir_nodes(raw) n``. Each call reads one document's text, in
    Arrow batches of Python workers; scalars are SQL expressions that Catalyst sees through.
    """
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, table in TABLES.items():
        spark.udtf.register(name, table)
    return {n: "scalar" for n in SCALARS} | {n: "table" for n in TABLES}


def register_external(spark: SparkSession, name: str, function: Callable, returns: str) -> str:
    """Register an external: a Python function of pandas Series, called in Arrow batches; gives the name for SQL and the compiler."""
    from pyspark.sql.functions import pandas_udf

    spark.udf.register(name, pandas_udf(function, returns))
    return name


def describe(spark: SparkSession) -> list[str]:
    """What is registered, as JSON Lines of name, kind, parameters and result: the capabilities of this library's extension."""
    scalars = [{"name": n, "kind": "scalar", "parameters": p, "returns": r} for n, (p, r, _) in SCALARS.items()]
    tables = [{"name": n, "kind": "table", "parameters": "raw STRING", "returns": t.returnType if isinstance(t.returnType, str) else t.returnType.simpleString()} for n, t in TABLES.items()]
    return [json.dumps(x) for x in [*scalars, *tables]]
