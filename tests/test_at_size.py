"""What keeps queries in proportion to their input: texts are read once, and little of them leaves a task."""

import json
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest

from quarry import plans
from quarry.functions.remembered import Remembered
from quarry.operators import compare, nodes, source_text, structure
from quarry.plans import logic
from quarry.sources import documents, tree_sink
from quarry.streaming import machine

SF = "/root/testdata/sf0.001"


def docs_of(spark, *texts):
    return documents.documents(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string").coalesce(1))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "passes"), [("subtree_differences", 2), ("definition_diff", 2), ("validation_findings", 1), ("malformed_nodes", 1), ("incomplete_definitions", 2)])
def test_texts_are_read_once(spark, name, passes):
    assert plan(plans.QUERIES[name](spark, SF)).count("MapInArrow") == passes


def test_texts_that_occur_again_are_not_read_again(spark):
    text, read = json.dumps(logic.document()), spark.sparkContext.accumulator(0)
    docs = docs_of(spark, *[text] * 150, "{", None)

    def rows(raw):
        read.add(1)
        return [(raw,)] if raw else []

    found = documents.by_text(docs, "doc_id long, raw string", rows).collect()
    assert len(found) == 151 and len({r["doc_id"] for r in found}) == 151 and read.value <= 3


def test_what_is_remembered_is_bounded():
    made = []
    held = Remembered(lambda k: (made.append(k) or k * 2, 10), most=25)
    assert [held[k] for k in "abacd"] == ["aa", "bb", "aa", "cc", "dd"] and made == list("abcd") and len(held) <= 2
    assert Remembered(lambda k: (k, 99), most=25)["x"] == "x"


def test_only_kinds_asked_for_leave_their_task(spark):
    docs = docs_of(spark, json.dumps(logic.document()))
    whole, some = nodes.shred(docs), nodes.shred(docs, ("Native",))
    assert sorted(some.collect()) == sorted(whole.where("kind = 'Native'").collect()) and some.count() == 2
    assert nodes.shred(docs, nodes.NAMING).where("fqn IS NOT NULL").count() == whole.where("fqn IS NOT NULL").count()


def test_findings_and_faults_of_texts_are_those_of_tables(spark):
    whole = logic.document()
    values = whole["distribution"]["Library"]["def"]["modules"]["parcels"]["value"]["values"]
    values["Bad_Name"] = values["fee"] | {"value": {"ExpressionBody": {"inputTypes": {}, "outputType": {"Unit": {}}, "body": {"Hole": {"reason": {"Draft": {}}}}}}}
    values["odd"] = {"access": "Public", "value": {"ExpressionBody": {"body": {"Nope": {}}}}}
    values["line\n"] = values["zone"]
    twice = '{"formatVersion":3,"distribution":["Library",[["p"]],[],{"modules":[[[["m"]],{"access":"public","value":{"types":[],"values":[%s]}}]]}]}' % ",".join(['[["go"],{"access":"public","value":{"outputType":["Unit",{}],"body":["Unit",{}]}}]'] * 2)
    docs = docs_of(spark, json.dumps(whole), twice, "{", None)
    defs = documents.definitions(docs)
    assert sorted(nodes.faults_in(docs).collect()) == sorted(nodes.faults(defs).collect())
    told = sorted(nodes.findings_in(docs).collect())
    assert told == sorted(nodes.findings(nodes.shred(docs), defs).collect()) and {r["code"] for r in told} == {"duplicate", "name", "hole", "unreadable", "unknown_kind"}


def test_differences_of_modules_and_of_subtrees(spark):
    left = spark.createDataFrame([(1, "m", "value", "a", "Public", "x"), (1, "m", "value", "b", "Public", "x"), (1, "gone", "type", "t", "Public", "x"), (1, "gone", "type", "u", "Public", "x")], "doc_id long, module string, family string, name string, access string, shape string")
    right = spark.createDataFrame([(1, "m", "value", "a", "Private", "y"), (1, "m", "type", "c", "Public", "x"), (2, "new", "type", "t", "Public", "x")], left.schema)
    got = {tuple(r) for r in compare.definition_diff(left, right).collect()}
    assert got == {(1, "m", "a", "access"), (1, "m", "a", "value_body"), (1, "m", "b", "missing_value"), (1, "m", "c", "extra_type"), (1, "gone", None, "missing_module"), (2, "new", None, "extra_module")}

    row = lambda path, up, kind, own, digest, name="go": (1, "m", "value", name, path, up, kind, own, digest)
    schema = "doc_id long, module string, family string, name string, path string, parent_path string, kind string, own string, digest string"
    left = spark.createDataFrame([row("$", None, "A", "a", "1"), row("$.x", "$", "B", "b", "2"), row("$.x.y", "$.x", "C", "c", "3"), row("$", None, "A", "a", "1", "alone")], schema)
    right = spark.createDataFrame([row("$", None, "A", "a", "9"), row("$.z", "$", "B", "b", "2"), row("$.z.y", "$.z", "C", "c", "3"), row("$.n", "$", "D", "d", "4"), row("$.n.i", "$.n", "D", "d", "5")], schema)
    got = sorted(tuple(r)[4:] for r in structure.differences(left, right).collect())
    assert got == [("extra", "$.n", None, None, "D"), ("missing", "$.x", None, "B", None), ("moved", "$.z", "$.x", None, "B")]


def test_tokens_of_many_files_are_dealt_by_their_number(spark):
    files = spark.range(20_000).selectExpr("CAST(id AS STRING) AS path", "'a b' AS content")
    assert ", 10), REPARTITION_BY_NUM" in plan(source_text.token_table(files))


def test_pending_messages_are_held_in_blocks():
    class Handle:
        timers, lists = [], []

        def getValueState(self, *_):
            return None

        def getListState(self, *_):
            return SimpleNamespace(appendList=self.lists.extend)

        def registerTimer(self, at):
            self.timers.append(at)

    fold, handle = machine.Fold(machine.PROJECT, 1), Handle()
    fold.init(handle)
    n = machine.BLOCK + 5
    fold.handleInputRows((1,), iter([pd.DataFrame({"at": range(7, n + 7), "seq": range(n), "message": ["open", None] * (n // 2) + ["open"]})]), None)
    assert handle.timers == [8] and len(handle.lists) == 2
    held = [tuple(r) for (block,) in handle.lists for r in json.loads(block)]
    assert len(held) == n and held[:2] == [(7, 0, "open"), (8, 1, None)]


def test_commit_reads_a_list_a_task(tmp_path):
    writer = tree_sink.TreeWriter(str(tmp_path), tree_sink.PACKAGES, True)
    rows = [{"package": f"p{i}", "module": "m", "family": "value", "ord": 0, "name": "go", "access": "Public", "doc": None, "body": "{}"} for i in (0, 1, 0)]
    rows[2] |= {"name": "again"}
    done = writer.write(iter([pa.RecordBatch.from_pylist(rows)]))
    assert len([f for f in tmp_path.rglob("*") if f.is_file() and "tree" not in f.parts]) == 1
    writer.commit([done, None])
    held = {p: json.loads((tmp_path / tree_sink.PACKAGES / p / "m/module.json").read_text())["values"] for p in ("p0", "p1")}
    assert held == {"p0": ["go", "again"], "p1": ["go"]} and not (tmp_path / "_temporary").exists()
