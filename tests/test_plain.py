"""The short way says what the general one says, and what it can't take it leaves."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry import plans
from quarry.functions import plain, tree
from quarry.operators import encode, migrate, nodes
from quarry.plans import logic
from quarry.sources import documents

from .test_strict import EVERY, UNIT, documents_of

SF = "/root/testdata/sf0.001"
PLAIN = [x for x in EVERY["Tuple"]["elements"] if next(iter(x)) not in tree.ONLY_V4]
WRAPPED = {"LetDefinition": {"name": "x-y", "definition": {"ExpressionBody": {"inputTypes": {"p": {"Reference": {"fqname": "a:b#c"}}}, "outputType": {"Unit": {}}, "body": {"Variable": {"name": "p"}}}}, "body": {"Unit": {}}}}
CLASSIC = ["Lambda", {"a": 1}, ["VariablePattern", {}, ["x", "y"]], ["UpdateRecord", [], ["Variable", None, ["x"]], [[["f"], ["Literal", {}, ["WholeNumberLiteral", 3]]], [["g"], ["Reference", {}, [[["a"], ["b", "c"]], [], ["d"]]]]]]]
ODD = [
    {"Variable": {"name": ""}}, {"Apply": {"function": {"Unit": {}}}}, {"Unit": {}, "Tuple": {}}, ["Unit", {}, 1], ["unit", {}], ["Variable", {}, [["a"]]], ["Variable", {}, "a"], 7, None, "a",
    ["Literal", {}, ["WholeNumberLiteral", True]], ["Literal", {}, ["CharLiteral", "ab"]], ["LetDefinition", {}, ["x"], {"inputTypes": []}, UNIT], ["PatternMatch", {}, UNIT, [["ab"]]], {"Hole": {"reason": "Draft"}}, ["Tuple", {}, {"a": 1}], ["Tuple", {}, None],
]


@pytest.mark.parametrize("x", [*PLAIN, *logic.DEFINITIONS.values(), WRAPPED])
def test_plain_trees(x):
    held = lambda rows: [(*row[:3], *row[5:9], *row[10:13]) for row in rows]
    defs = json.loads(json.dumps(x))
    assert nodes._held({"body": defs}, "value") == held(nodes.trees_of({"body": defs}, "value"))
    try:
        classic = tree.rewrite(defs, "value", False)
    except ValueError:
        with pytest.raises(plain.ODD):
            plain.rewrite(defs, "value", False)
    else:
        assert plain.rewrite(defs, "value", False) == classic and plain.rewrite(classic, "value", True) == tree.rewrite(classic, "value", True)
        assert plain.rows_of(defs, "value", "body") == held(tree.rows_of(defs, "value", "body"))


def test_classic_forms():
    assert plain.rewrite(CLASSIC, "value", True) == tree.rewrite(CLASSIC, "value", True)
    more = {"Variable": {"name": "a", "more": 1}}
    assert plain.rewrite(more, "value", False) == tree.rewrite(more, "value", False)
    with pytest.raises(plain.ODD):
        plain.rows_of(more, "value", "body")


@pytest.mark.parametrize("x", ODD)
def test_what_is_odd_is_left(x):
    for to_v4 in (True, False):
        with pytest.raises(plain.ODD):
            plain.rewrite(x, "value", to_v4)
    assert nodes._held({"body": x}, "value") == [(*row[:3], *row[5:9], *row[10:13]) for row in nodes.trees_of({"body": x}, "value")]


def texts():
    whole = logic.document()
    held = whole["distribution"]["Library"]["def"]["modules"]["parcels"]["value"]
    held["values"]["every"] = {"access": "private", "value": {"doc": "a \"b\"\u0001\n", "value": {"body": {"ExpressionBody": {"body": EVERY}}, "outputType": {"Unit": {"attrs": {}}}, "inputTypes": {"a": {"type": {"Variable": {"name": "\u0000" + "0", "attrs": {}}}}, "\u0000" + "0": {"Unit": {}}}}}}
    held["values"]["bare"] = {"access": "Private", "value": {"inputTypes": {}, "body": {"NativeBody": {"hint": {"Arithmetic": {}}}}}}
    held["values"]["odd"] = {"access": "Public", "value": {"body": {"Bogus": {"x": [1, "é"]}}}}
    held["types"]["sum"] = {"access": "Public", "value": {"CustomTypeDefinition": {"typeParams": [], "constructors": {"access": "Public", "value": [{"name": "c", "args": [["x", {"Unit": {}}]]}, ["d", []]]}}}}
    held["types"]["later"] = {"access": "Public", "value": {"IncompleteTypeDefinition": {"typeParams": [], "incompleteness": "Draft", "partialTypeExp": {"Unit": {}}}}}
    broken = json.loads(json.dumps(whole))
    broken["distribution"]["Library"]["def"]["modules"]["parcels"]["value"]["types"]["sum"]["value"]["CustomTypeDefinition"]["constructors"]["value"] += [{"name": "e", "args": [["x"]]}]
    return [whole, broken, {"formatVersion": "4.0.0", "distribution": {"Library": {"packageName": "a/b", "def": {"modules": {}}}}}, "{", '{"formatVersion":4}']


def migrations():
    whole = texts()
    classic = ["Tuple", {}, [tree.rewrite(x, "value", False) for x in PLAIN]]
    value = lambda name, body, doc="": [name, {"access": "private", "value": {"doc": doc, "value": {"inputTypes": [[["x"], {"lost": 1}, UNIT]], "outputType": UNIT, "body": body}}}]
    sums = [[["s"], {"access": "Public", "value": {"doc": "", "value": ["CustomTypeDefinition", [["a"]], {"access": "Private", "value": [[["c"], [[["x"], ["Variable", {}, ["a"]]]]]]}]}}]]
    old = lambda *values: {"formatVersion": 3, "distribution": ["Library", [["a", "b"], ["c"]], [], {"modules": [[[["m"], ["n"]], {"access": "public", "value": {"types": sums, "values": list(values)}}], [[["none"]], {"access": "public", "value": {"types": [], "values": []}}]]}]}
    good, bad = old(value(["f", "g"], classic, 'a "b"'), value(["f", "g"], CLASSIC), value([], UNIT)), old(value(["f"], ["Bogus", {}]), value(["g"], ["Tuple", {}, [["Unit"], None]]))
    del whole[0]["distribution"]["Library"]["def"]["modules"]["parcels"]["value"]["values"]["every"]
    return [*whole, good, bad, {"formatVersion": "4.0.0", "distribution": {"Library": {"def": {"modules": {"a/b-c": {"value": {"types": {}, "values": {"x": {"value": {"inputTypes": {"p": {"Unit": {}}}, "outputType": "t", "body": CLASSIC}}}}}}}}}}]


def test_portions_hold_little_text():
    sizes = [10] * 70 + [documents.TEXT - 5, 10, documents.TEXT * 2, 1]
    batch = pa.RecordBatch.from_pydict({"raw": ["x" * n for n in sizes] + [None]})
    parts = list(documents.portions(batch.slice(0)))
    assert [p.num_rows for p in parts] == [64, 6, 1, 1, 1, 2] and pa.Table.from_batches(parts).to_batches()[0].schema == batch.schema
    assert [x for p in parts for x in p.column("raw").to_pylist()] == batch.column("raw").to_pylist() and list(documents.portions(batch.slice(0, 0))) == []


@pytest.mark.parametrize("to_v4", [True, False])
def test_documents_are_migrated_where_they_lie(spark, to_v4):
    docs, defs = documents_of(spark, *migrations())
    whole = {r["doc_id"]: (r["content"], r["diagnostics"]) for r in migrate.migrated(docs, defs, to_v4).collect()}
    got = {r["doc_id"]: (r["content"], r["diagnostics"]) for r in migrate.migrated_in(docs.select("doc_id", "package", "raw"), to_v4).collect()}
    assert got == whole and len(got[6][1]) == 3 - to_v4 and (got[5][0] is not None) == to_v4
    if to_v4:
        assert json.loads(got[5][0])["distribution"]["Library"]["packageName"] == "a-b/c"


def test_definitions_are_converted_alike():
    for x in [*PLAIN, *logic.DEFINITIONS.values(), WRAPPED, CLASSIC, *ODD]:
        for to_v4 in (True, False):
            body = {"inputTypes": [], "outputType": UNIT, "body": x} if to_v4 else {"ExpressionBody": {"inputTypes": {}, "outputType": {"Unit": {}}, "body": x}}
            faults = "; ".join(map(" ".join, tree.faults_of(body, "value")))
            try:
                want = (None, faults) if faults else (migrate.definition_in(body, to_v4), None)
            except documents.UNREADABLE as e:
                want = None, str(e) or type(e).__name__
            text, why = migrate.converted_in(body, "value", to_v4)
            assert (text and json.loads(text), why) == want


def test_documents_are_made_where_they_lie(spark):
    """What nodes held beside their documents give is what tables of nodes give by shuffles."""
    docs, _ = documents_of(spark, *texts())
    docs = docs.select("doc_id", "package", "raw").withColumn("raw", F.when(F.col("doc_id") != 4, F.col("raw")))
    shred, by = nodes.shred(docs), {"Apply": lambda a: F.lit('{"seen": [1]}'), "Unit": lambda a: F.lit(None).cast("string")}
    defs = documents.definitions(docs)
    made = encode.documents_in(nodes.held(docs).withColumn("other", nodes.map_held(F.col("nodes"), by)), "nodes", "other").collect()
    for c, table in (("nodes", shred), ("other", nodes.map_attributes(shred, by))):
        whole = {r["doc_id"]: (r["content"], r["diagnostics"]) for r in encode.documents_of(docs, table, defs).collect()}
        got = {r["doc_id"]: (r[c]["content"], r[c]["diagnostics"]) for r in made}
        assert {i: (x and json.loads(x), why) for i, (x, why) in got.items()} == {i: (x and json.loads(x), why) for i, (x, why) in whole.items()}
        assert got[0][0] and got[1][0] is None and got[2][0] and [len(got[i][1]) for i in range(5)] == [0, 1, 0, 1, 1]


@pytest.mark.parametrize("name", ["encode_documents", "migrate_grown", "migrate_documents", "migrate_refuses", "cannot_downgrade"])
def test_texts_are_not_shuffled(spark, name):
    """Keys alone are spread before any text is made; documents then stay in their task."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
