import json

import pytest
from pyspark.sql import functions as F

from quarry.functions.tree import faults_of, read, rewrite, rows_of
from quarry.operators import encode, migrate, nodes, structure
from quarry.plans import logic
from quarry.sources import documents

UNIT = ["Unit", {}]


def value(body):
    return {"inputTypes": [], "outputType": UNIT, "body": body}


@pytest.mark.parametrize(("body", "want"), [
    (["Apply", {}, ["Bogus", {}, ["x"]], UNIT], [("$.body[2]", "unknown_kind")]), (["Apply", {}, UNIT], [("$.body", "arity")]), (["Unit", {}, 1], [("$.body", "arity")]), (["Unit"], [("$.body", "arity")]),
    (["Literal", {}, ["WholeNumberLiteral", True]], [("$.body[2]", "wrong_shape")]), (["Literal", {}, ["CharLiteral", "ab"]], [("$.body[2]", "wrong_shape")]), ({"Apply": {"function": {"Unit": {}}}}, [("$.body.Apply.argument", "missing_field")]),
    ({"Variable": {"name": ""}}, [("$.body.Variable.name", "wrong_shape")]), ({"Reference": {"fqname": "a#b"}}, [("$.body.Reference.fqname", "wrong_shape")]), ({"Unit": {}, "Tuple": {}}, [("$.body", "unknown_kind")]), (7, [("$.body", "unknown_kind")]),
    ({"Record": {"fields": {"a": {"Unit": {}}, "b": 1}}}, [("$.body.Record.fields.b", "unknown_kind")]), ({"Hole": {"reason": "Why"}}, [("$.body.Hole.reason", "wrong_shape")]), ({"Native": {"fqname": "a:b#c", "info": {"hint": "Arithmetic"}}}, []),
    (["PatternMatch", {}, UNIT, [[["WildcardPattern", {}], UNIT], [["Nope", {}], UNIT], ["x"]]], [("$.body[3][1][0]", "unknown_kind"), ("$.body[3][2]", "wrong_shape")]),
    (["LetDefinition", {}, ["x"], {"inputTypes": []}, UNIT], [("$.body[3]", "missing_field")]), (["LetRecursion", {}, [[["f"], value(["No", {}])]], UNIT], [("$.body[2][0][1].body", "unknown_kind")]),
    (["unit", {}], []), (["Lambda", {}, ["VariablePattern", {}, ["x"]], ["Variable", {}, ["x"]]], []), (["UpdateRecord", {}, UNIT, [[["a"], UNIT], [[], UNIT]]], [("$.body[3][1]", "wrong_shape")]),
])
def test_faults_of_values(body, want):
    found = faults_of(value(body), "value")
    assert sorted(f[:2] for f in found) == sorted(want)
    if want:
        with pytest.raises(ValueError):
            migrate.definition_in(value(body), isinstance(body, list))


@pytest.mark.parametrize(("body", "want"), [
    (["TypeAliasDefinition", [["a"]], UNIT], []), (["TypeAliasDefinition", [["a"]]], [("$", "arity")]), (["Other", [], UNIT], [("$", "unknown_kind")]), ({"TypeAliasDefinition": {"typeParams": []}}, [("$.TypeAliasDefinition.typeExp", "missing_field")]),
    (["CustomTypeDefinition", [], {"access": "Public", "value": [[["a"], [[["x"], UNIT], ["y"]]]]}], [("$[2].value[0].args[1]", "wrong_shape")]), ({"IncompleteTypeDefinition": {"typeParams": [], "incompleteness": {"Hole": "Draft"}}}, []),
    ({"IncompleteTypeDefinition": {"typeParams": [], "incompleteness": "Later"}}, [("$.IncompleteTypeDefinition.incompleteness", "wrong_shape")]), (["TypeAliasDefinition", [], ["Record", {}, [{"name": ["a"], "tpe": UNIT}, 3]]], [("$[2][2][1]", "wrong_shape")]), (None, [("$", "unknown_kind")]),
])
def test_faults_of_types(body, want):
    assert [f[:2] for f in faults_of(body, "type")] == want


@pytest.mark.parametrize("name", list(logic.DEFINITIONS))
def test_the_sample_program_has_no_faults(name):
    assert faults_of({"body": logic.DEFINITIONS[name]}, "value") == []


def test_inner_definitions_are_migrated():
    inner = {"inputTypes": [[["p"], {}, UNIT]], "outputType": ["Variable", {}, ["t"]], "body": ["Variable", {}, ["p"]]}
    let, recursive = ["LetDefinition", {}, ["x"], inner, UNIT], ["LetRecursion", {}, [[["f", "g"], inner]], UNIT]
    new = {"inputTypes": {"p": {"type": {"Unit": {"attrs": {}}}}}, "outputType": {"Variable": {"name": "t", "attrs": {}}}, "body": {"Variable": {"name": "p", "attrs": {}}}}
    assert rewrite(let, "value", True)["LetDefinition"]["definition"] == new and rewrite(recursive, "value", True)["LetRecursion"]["bindings"] == [["f-g", new]]
    for tree in (let, recursive):
        assert rewrite(rewrite(tree, "value", True), "value", False) == tree
    objects = ["LetRecursion", {}, [{"name": ["f", "g"], "def": inner}], UNIT]
    assert rewrite(objects, "value", True) == rewrite(recursive, "value", True)
    wrapped = {"LetDefinition": {"name": "x", "definition": {"body": {"NativeBody": {"hint": "Arithmetic"}}}, "body": {"Unit": {}}}}
    with pytest.raises(ValueError, match="NativeBody"):
        rewrite(wrapped, "value", False)


def test_unknown_nodes_have_rows():
    rows = rows_of(["Apply", {}, ["Bogus", {}, ["x"]], UNIT], "value")
    assert [(r[6], r[1]) for r in rows] == [("Apply", None), ("unknown", 0), ("Unit", 0)] and json.loads(rows[1][12]) == ["Bogus", {}, ["x"]]
    assert read(UNIT, "value").faults == []


def documents_of(spark, *texts):
    df = spark.createDataFrame([(str(i), t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "path string, content string")
    docs = documents.documents(df).withColumn("doc_id", F.col("path").cast("long"))
    return docs, documents.definitions(docs)


EVERY = {"Tuple": {"elements": [
    {"Hole": {"reason": {"Draft": {}}, "tpe": {"Unit": {"attrs": {}}}, "attrs": {}}}, {"External": {"externalName": "e", "targetPlatform": "jvm", "attrs": {"x": 1}}}, {"Constructor": {"fqname": "a:b#c", "attrs": {}}},
    {"LetRecursion": {"bindings": [["f", {"body": {"Unit": {"attrs": {}}}}], ["g", {"inputTypes": {"p": {"type": {"ExtensibleRecord": {"variable": "r", "fields": {"q": {"Function": {"arg": {"Unit": {"attrs": {}}}, "result": {"Tuple": {"elements": [], "attrs": {}}}, "attrs": {}}}}, "attrs": {}}}}}, "outputType": {"Unit": {"attrs": {}}}, "body": {"List": {"items": [], "attrs": {}}}}]], "body": {"Unit": {"attrs": {}}}, "attrs": {}}},
    *[{"Literal": {"literal": {kind: {"value": v}}, "attrs": {}}} for kind, v in (("BoolLiteral", True), ("CharLiteral", "é"), ("StringLiteral", "1"), ("IntegerLiteral", -5), ("FloatLiteral", 2.5), ("DecimalLiteral", "1.50"))],
    {"Lambda": {"pattern": {"UnitPattern": {"attrs": {}}}, "body": {"Unit": {"attrs": {}}}, "attrs": {}}},
], "attrs": {}}}


def test_documents_come_back_from_nodes(spark):
    whole = logic.document()
    held = whole["distribution"]["Library"]["def"]["modules"]["parcels"]["value"]
    held["values"]["every"] = {"access": "Public", "value": {"inputTypes": {"a": {"type": {"Variable": {"name": "t", "attrs": {}}}}}, "outputType": {"Unit": {"attrs": {}}}, "body": {"ExpressionBody": {"body": EVERY}}}}
    held["values"]["bare"] = {"access": "Private", "value": {"inputTypes": {}, "outputType": {"Unit": {"attrs": {}}}, "body": {"NativeBody": {"hint": {"Arithmetic": {}}}}}}
    held["types"]["alias"] = {"access": "Public", "value": {"TypeAliasDefinition": {"typeParams": ["t"], "typeExp": {"Record": {"fields": {"f": {"Variable": {"name": "t", "attrs": {}}}}, "attrs": {}}}}}}
    docs, defs = documents_of(spark, whole, "{")
    tree = nodes.shred(docs)
    bodies = {r["name"]: (json.loads(r["body"]), json.loads(r["converted"])) for r in encode.assembled(tree, defs).where("error IS NULL").collect()}
    assert set(bodies) == {*logic.DEFINITIONS, "every", "bare", "speed", "alias"} and all(a == b for a, b in bodies.values())
    lost = encode.assembled(tree.where("def_name <> 'every' OR depth > 0"), defs).where("name = 'every'").first()
    assert lost["converted"] is None and "don't fill" in lost["diagnostic"]
    told = {r["doc_id"]: r for r in encode.documents_of(docs, tree, defs).collect()}
    assert told[0]["content"] and told[1]["content"] is None and len(told[1]["diagnostics"]) == 1


def test_differences_have_places(spark):
    old, new = (json.loads(json.dumps(logic.document(("fee", "zone")))) for _ in range(2))
    values = new["distribution"]["Library"]["def"]["modules"]["parcels"]["value"]["values"]
    values["zone"]["value"]["ExpressionBody"]["body"]["Lambda"]["attrs"] = {"seen": 1}  # attributes don't count
    lam = values["fee"]["value"]["ExpressionBody"]["body"]["Lambda"]["body"]["Lambda"]
    lam["body"]["PatternMatch"]["subject"] = {"Variable": {"name": "other", "attrs": {}}}
    left, right = (structure.digests(documents_of(spark, d)[0]) for d in (old, new))
    rows = structure.differences(left, right).collect()
    assert [(r["name"], r["diff"], r["path"], r["was"], r["now"]) for r in rows] == [("fee", "changed", "$.ExpressionBody.body.Lambda.body.Lambda.body.PatternMatch.subject", "Variable", "Variable")]
    assert structure.differences(left, left).isEmpty() and structure.differences(left.limit(0), left).isEmpty()


def test_places_of_nodes(spark):
    docs, _ = documents_of(spark, logic.document(("ship",)))
    tree = nodes.shred(docs).where("section = 'value'")
    lets, variables = tree.where("kind = 'LetDefinition'"), tree.where("kind = 'Variable'")
    near = {r["variable_path"]: r["let_path"] for r in structure.innermost(lets, variables, {"path": "let_path"}, {"path": "variable_path"}).collect()}
    for r in variables.collect():
        around = [x["path"] for x in lets.collect() if r["path"].startswith(x["path"] + ".")]
        assert near.get(r["path"]) == max(around, key=len, default=None)
    step = tree.select("path", structure.steps(F.col("path")).alias("s")).where("kind = 'Native'").first()
    assert step["s"].startswith("body/body/body/body/body/body")
