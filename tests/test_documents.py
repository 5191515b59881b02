import json

import pytest
from pyspark.sql import functions as F

from quarry.functions.tree import rewrite, rows_of
from quarry.operators import compare, migrate, nodes, source_text
from quarry.plans import logic
from quarry.sources import documents

CLASSIC = {"formatVersion": 3, "distribution": ["Library", [["shop"]], [], {"modules": [[[["orders"]], {"access": "Public", "value": {"types": [], "doc": None, "values": [
    [["double", "it"], {"access": "private", "value": {"doc": "twice", "value": {"inputTypes": [[["n"], {}, ["Variable", {}, ["a"]]]], "outputType": ["Unit", {}],
        "body": ["Apply", {}, ["Reference", {}, [[["shop"]], [["orders"]], ["add"]]], ["Tuple", {}, [["Literal", {}, ["WholeNumberLiteral", 2]], ["Variable", {}, ["n"]]]]]}}}]]}}]]}]}


def found(spark, **texts):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in texts.items()], "path string, content string")


def test_documents_of_both_dialects(spark):
    rows = {r["path"]: r for r in documents.documents(found(spark, new=logic.document(), old=CLASSIC, bad="{", other={"name": "x"})).collect()}
    assert [(rows[k]["dialect"], rows[k]["kind"], rows[k]["package"]) for k in ("new", "old")] == [("v4", "Library", "depot"), ("classic", "Library", "shop")]
    assert rows["bad"]["dialect"] is None and rows["other"]["dialect"] is None


def test_definitions_keep_order_and_report_what_is_unreadable(spark):
    defs = documents.definitions(documents.documents(found(spark, new=logic.document(), old=CLASSIC, bad="{", text="[1]"))).collect()
    assert [r["name"] for r in sorted((r for r in defs if r["family"] == "value" and r["module"] == "parcels"), key=lambda r: r["ord"])] == list(logic.DEFINITIONS)
    assert sum(r["error"] is not None for r in defs) == 2
    old = next(r for r in defs if r["name"] == "double-it")
    assert (old["access"], old["module_access"]) == ("Private", "Public")


def test_nodes_of_both_dialects(spark):
    n = nodes.shred(documents.documents(found(spark, old=CLASSIC)))
    kinds = {r["kind"]: r["count"] for r in n.groupBy("kind").count().collect()}
    assert kinds == {"Apply": 1, "Reference": 1, "Tuple": 1, "Literal": 1, "WholeNumberLiteral": 1, "Variable": 2, "Unit": 1}
    assert n.where("kind = 'Reference'").first()["fqn"] == "shop:orders#add"


def count(tree):
    """Nodes by brute force: every object with one known key."""
    from quarry.functions.tree import LITERALS, PATTERNS, VALUES

    if isinstance(tree, dict):
        return sum(k in (*VALUES, *PATTERNS, *LITERALS) and isinstance(v, dict) for k, v in tree.items() if len(tree) == 1) + sum(count(v) for v in tree.values())
    return sum(map(count, tree)) if isinstance(tree, list) else 0


@pytest.mark.parametrize("name", list(logic.DEFINITIONS))
def test_walk_keeps_every_node_and_rewriting_is_reversible(name):
    tree = logic.DEFINITIONS[name]
    rows = list(rows_of(tree, "value"))
    assert len(rows) == count(tree) and [r[0] for r in rows] == list(range(len(rows)))
    assert all(r[1] is None or r[1] < r[0] for r in rows)
    if name == "ship":  # holds natives
        return
    classic = rewrite(tree, "value", False)
    assert isinstance(classic, list) and rewrite(classic, "value", True) == tree
    assert len(list(rows_of(classic, "value"))) == len(rows)


def test_only_v4_cannot_go_down():
    with pytest.raises(ValueError, match="Hole"):
        rewrite({"Hole": {"reason": "Draft", "attrs": {}}}, "value", False)


def test_deep_trees_do_not_recurse():
    tree = logic.var("x")
    for _ in range(3000):
        tree = logic.call(logic.var("f"), tree)
    assert len(list(rows_of(tree, "value"))) == 6001


def test_what_is_too_deep_becomes_a_row(spark):
    deep = '{"formatVersion": 4, "distribution": {"Library": {"def": ' + "[" * 100_000 + "]" * 100_000 + "}}}"
    tree = {"Unit": {"attrs": {}}}
    for _ in range(3000):
        tree = logic.call(logic.var("f"), tree)
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(100_000)
    body = json.dumps(tree)
    sys.setrecursionlimit(limit)
    docs = documents.documents(found(spark, new=logic.document())).select("doc_id", "raw").union(spark.createDataFrame([(1, deep)], "doc_id long, raw string"))
    defs = documents.definitions(docs)
    assert [r["error"][:14] for r in defs.where("error IS NOT NULL").collect()] == ["RecursionError"] and defs.count() == len(logic.DEFINITIONS) + 2
    assert nodes.kind_counts(docs).where("doc_id = 1").count() == 0 < nodes.shred(docs).count()
    out = nodes.converted(spark.createDataFrame([(body,), ('{"Unit": {"attrs": {}}}',)], "body string"), "value", False).collect()
    assert [r["diagnostic"] is None for r in out] == [False, True]


def test_detection_by_type_and_by_decoding(spark):
    v = lambda text: spark.range(1).select(documents.version_of(F.lit(text)).alias("v")).first()["v"]["major"]
    cases = {'"5"': "classic", "5": "v4", '"4.1"': "v4", "4": "v4", "3": "classic", '"40"': "v4", "4.0": "v4", "true": "classic"}
    assert {k: v('{"formatVersion": ' + k + "}") for k in cases} == cases and v("{}") is None and v("no JSON") is None
    new = {"formatVersion": 4, "distribution": ["Library", [], [], {"modules": []}]}
    rows = {r["path"]: r["dialect"] for r in documents.documents(found(spark, new=new, none={"formatVersion": 3, "distribution": {"Library": {}}})).collect()}
    assert rows == {"new": "classic", "none": None}


def test_tables_of_documents(spark):
    app = {"formatVersion": "4.0.0", "distribution": {"Application": {"packageName": "a", "dependencies": {"x/y": {}, "z": {}}, "def": {"modules": {}}, "entryPoints": {"main": {"target": "a:m#f", "kind": "Main"}}}}}
    docs = documents.documents(found(spark, app=app, new=logic.document(), old=CLASSIC))
    assert sorted(r["dependency"] for r in documents.dependencies(docs).collect()) == ["lang/sdk", "x/y", "z"]
    assert [tuple(r)[1:] for r in documents.entry_points(docs).collect()] == [(0, "main", "Main", "a:m#f", None)]
    assert sorted((r["name"], r["n_args"], r["access"]) for r in documents.constructors(documents.definitions(docs)).collect()) == [("air", 1, "Public"), ("ground", 0, "Public")]
    up = migrate.definitions_in(documents.definitions(docs).where("doc IS NOT NULL"), True).select("doc_id", "module", "family", "name", "def_kind", F.col("converted").alias("body"))
    assert [(r["value_name"], r["ord"], r["name"], r["type"]) for r in documents.inputs(up).collect()] == [("double-it", 0, "n", '{"Variable":{"name":"a","attrs":{}}}')]


def test_attributes_are_mapped_and_nothing_else(spark):
    n = nodes.shred(documents.documents(found(spark, new=logic.document())))
    out = nodes.map_attributes(n, {"Native": lambda a: F.lit('{"native":1}')}, lambda a: F.coalesce(a, F.lit("{}")))
    assert {(r["kind"] == "Native", r["attrs"]) for r in out.collect()} == {(True, '{"native":1}'), (False, "{}")}
    assert out.drop("attrs").exceptAll(n.drop("attrs")).count() == 0
    assert {tuple(r) for r in nodes.incomplete(n).select("kind", "reason").collect()} == {("Native", "Arithmetic")}


def test_decorations(spark):
    deco = documents.decorations(found(spark, **{"a.deco.json": {"target": "t", "decorations": {"x": 1}}, "b.deco.json": {"target": "t", "decorations": {"y": None}}, "c.json": {"target": "u"}}))
    rows = deco.select("target", documents.has_decorator(F.col("decorations"), "x").alias("x"), documents.has_decorator(F.col("decorations"), "y").alias("y")).collect()
    assert [tuple(r) for r in rows] == [("t", False, True)]


def test_prefixes_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "abc"), (1, "abc"), (1, "b"), (2, None), (2, "")], "k long, t string")
    got = compare.longest_prefix(rows, spark.createDataFrame([("a",), ("ab",), ("x",), ("ab",)], "p string"), "t", "p").collect()
    assert sorted((r["k"], r["t"] or "", r["p"] or "") for r in got) == [(1, "abc", "ab"), (1, "abc", "ab"), (1, "b", ""), (2, "", ""), (2, "", "")]
    assert compare.longest_prefix(rows, spark.createDataFrame([], "p string"), "t", "p").count() == 5


def test_long_literals_in_source(spark):
    texts = ['fn a() { "' + "x" * 1_000_000 + '" }', 'fn a() { "' + '\\"' * 300_000 + '" }', 'fn a() { "' + "y" * 300_000, "fn a() { " + '"\n" ' * 50_000 + "}"]
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "path int, content string")
    got = {r["path"]: (r["n_tokens"], r["n_values"], r["balanced"]) for r in source_text.counted(files).collect()}
    assert got[0] == got[1] == (7, 1, True) and got[2] == (7, 1, False) and got[3] == (50_006, 1, True)


def test_unresolved_and_findings(spark):
    doc = logic.document()
    doc["distribution"]["Library"]["def"]["modules"]["parcels"]["value"]["values"]["Bad Name"] = {"access": "Public", "value": {"ExpressionBody": {"body": {"Hole": {"reason": {"Draft": {}}, "attrs": {}}}}}}
    docs = documents.documents(found(spark, d=doc))
    defs, n = documents.definitions(docs), nodes.shred(docs)
    missing = {r["fqn"] for r in nodes.unresolved(n, defs, "depot").collect()}
    assert "depot:parcels#check" not in missing and "depot:parcels#lt-int" in missing
    assert {r["code"] for r in nodes.findings(n, defs).collect()} == {"name", "hole"}


def test_files_trees_and_notebooks(spark, tmp_path):
    (tmp_path / "src/a").mkdir(parents=True)
    (tmp_path / "src/a/b.json").write_text("{}")
    (tmp_path / "src/Package.json").write_text("{}")
    (tmp_path / "package.json").write_text('{"name": "mine"}')
    tree = documents.modules_of_tree(documents.files(spark, str(tmp_path), "*.json"), "package.json")
    assert [tuple(r) for r in tree.collect()] == [("a.b", "mine", "Public")]
    (tmp_path / "x.gleam").write_text("fn a() {}\n")
    assert documents.source_files(spark, str(tmp_path), "gleam").count() == 1
    with pytest.raises(ValueError, match="unknown"):
        documents.source_files(spark, str(tmp_path), "cobol")
    cells = documents.notebook_cells(found(spark, n={"cells": [{"id": "c1", "cell_type": "code", "source": ["a\n", "b"]}]}, empty={"x": 1}, one={"cells": [{"cell_type": "raw", "source": "[x"}]})).collect()
    assert [tuple(c) for c in cells] == [("n", 0, "c1", "code", "a\nb"), ("one", 0, "0", "raw", "[x")]


def test_tree_round_trip(spark, tmp_path):
    defs = documents.definitions(documents.documents(found(spark, d=logic.document())))
    documents.write_tree(defs, str(tmp_path / "t"))
    back = documents.read_tree(spark, str(tmp_path / "t"))
    got = back.collect()
    assert len(got) == defs.count() and all(r["_corrupt_record"] is None and r["module"] == "parcels" for r in got)


def test_merges(spark):
    m = spark.range(1).select(compare.merged_map(F.expr("map('a', 1)"), F.expr("map('a', 2, 'b', 3)"))).first()[0]
    assert m == {"a": 1, "b": 3}


def test_closure_of_a_cycle(spark):
    from quarry.plans.queries import _checkpoint_dir

    _checkpoint_dir(spark)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    assert nodes.closure(edges).count() == 9
    with pytest.raises(ValueError, match="steps"):
        nodes.closure(spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long"), rounds=2)


def test_files_of_several_lines_are_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(logic.document(("fee",)), indent=2))
    rows = documents.files(spark, str(tmp_path), "*.json")
    assert rows.count() == 1 and documents.documents(rows).first()["package"] == "depot"
