import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import registered
from quarry.operators import source_text
from quarry.operators.compiler import Compiler, Unsupported
from quarry.plans import logic
from quarry.sources import documents, remote, tree_sink

PIECES = ["pub fn", " x1", "\n", "\t", "\"a\\\"b\nc\" ", "//// doc\n", "/// d\n", "// c\n", "<=.", "<-", "..", "1.5", "12", "99999999999999999999", "_ ", "_u", "Ab", "é", "😀", "$", "\"", "->", "|>", "#(", ")", "^", "\r\n", "\\"]


def lexed(text):
    """Brute force: the longest of the forms at each place, lines and columns by counting."""
    forms = [(k, re.compile(p.replace("*+", "*"))) for k, p in source_text.FORMS.items()]
    marks = sorted((*source_text.OPERATORS, *source_text.PUNCTUATION), key=len, reverse=True)
    at, out = 0, []
    while at < len(text):
        if text[at] in " \t\r\n":
            at += 1
            continue
        kind, end = "error", at + 1
        found = next(((k, m.end()) for k, p in forms if (m := p.match(text, at))), None)
        mark = next((m for m in marks if text.startswith(m, at)), None)
        if found:
            kind, end = found
            word = text[at:end]
            kind = "keyword" if word in source_text.KEYWORDS else "error" if kind == "int" and int(word) > 2**63 - 1 else kind
        elif mark:
            kind, end = "operator" if mark in source_text.OPERATORS else "punctuation", at + len(mark)
        before = text[:at]
        out.append((kind, text[at:end], at, end, before.count("\n") + 1, at - (before.rfind("\n") + 1) + 1))
        at = end
    return out


def test_tokens_equal_brute_force(spark):
    r = random.Random(5)
    texts = {str(i): "".join(r.choice(PIECES) for _ in range(r.randrange(40))) for i in range(300)} | {"empty": "", "blank": " \n\t"}
    rows = spark.createDataFrame([*texts.items(), ("null", None)], "path string, content string")
    got = {}
    for t in source_text.token_table(rows).orderBy("path", "ord").collect():
        got.setdefault(t["path"], []).append((t["kind"], t["text"], t["start"], t["end"], t["line"], t["column"]))
    assert got == {k: lexed(t) for k, t in texts.items() if lexed(t)}


def test_long_files_take_linear_time(spark):
    piece = "pub fn a(x) { \"s\" + 1.5 } // c\n"
    text = piece * ((1 << 20) // len(piece))
    began = time.time()
    rows = source_text.token_table(spark.createDataFrame([("a", text), ("b", '"' * (1 << 20))], "path string, content string"))
    assert rows.groupBy("path").agg(F.max("line"), F.max("end")).count() == 2
    last = rows.where("path = 'a'").orderBy(F.desc("ord")).first()
    assert last["line"] == text.count("\n") and time.time() - began < 60


def test_lexical_errors(spark):
    rows = source_text.token_table(spark.createDataFrame([("a", "let x\n  = $ \"open")], "path string, content string"))
    assert [tuple(r) for r in source_text.lexical_errors(rows).orderBy("start_line", "start_col").collect()] == [("a", "PARSE_ERROR", "unexpected $", 2, 5, 2, 6), ("a", "PARSE_ERROR", 'unexpected "', 2, 7, 2, 8)]


def test_registered_functions(spark):
    assert registered.register(spark)["ir_nodes"] == "table" and len(registered.describe(spark)) == 9
    registered.register(spark)  # once more does no harm
    assert tuple(spark.sql("SELECT ir_kebab('FooBar_baz'), ir_snake('fooBar'), ir_title('foo-bar'), ir_package('a:b#c'), ir_module('a:b#c'), ir_local('a:b#c'), ir_local('x'), ir_kebab(NULL)").first()) == ("foo-bar-baz", "foo_bar", "FooBar", "a", "b", "c", None, None)
    spark.createDataFrame([(1, json.dumps(logic.document(("fee",)))), (2, "{"), (3, None)], "id long, raw string").createOrReplaceTempView("told")
    assert [tuple(r) for r in spark.sql("SELECT id, n.kind, count(*) AS n FROM told, LATERAL ir_nodes(raw) n WHERE n.kind = 'Lambda' GROUP BY ALL").collect()] == [(1, "Lambda", 2)]
    assert [(r["id"], r["code"]) for r in spark.sql("SELECT id, f.code FROM told, LATERAL ir_faults(raw) f").collect()] == [(2, "unreadable")]


def test_externals_are_registered_functions(spark):
    registered.register_external(spark, "tripled", lambda s: s * 3, "long")
    node = {"Apply": {"function": {"External": {"externalName": "triple", "targetPlatform": "python", "attrs": {}}}, "argument": logic.var("x"), "attrs": {}}}
    c = Compiler(externals={("triple", "python"): ("tripled", 1)})
    assert [r[0] for r in spark.range(3).select(c.compile(node, {"x": F.col("id")})).collect()] == [0, 3, 6]
    with pytest.raises(Unsupported):
        Compiler().compile(node, {"x": F.col("id")})


def found(spark, **texts):
    docs = documents.documents(spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()], "path string, content string"))
    return docs, documents.definitions(docs)


def told(rows, *columns):
    return sorted(tuple(r[c] if c != "body" else json.dumps(json.loads(r[c])) for c in columns) for r in rows.collect())


def test_trees_of_files_round_trip(spark, tmp_path):
    at, columns = f"file://{tmp_path / 'tree'}", ("package", "module", "family", "ord", "name", "access", "body")
    docs, defs = found(spark, a=logic.document(), b=logic.document(("zone",), "other/pack"))
    tree_sink.write_documents(docs, defs, at)
    want = told(defs.join(docs.select("doc_id", "package"), "doc_id"), *columns)
    assert told(tree_sink.read_documents(spark, at), *columns) == want
    assert not (tmp_path / "tree/_temporary").exists() and json.loads((tmp_path / "tree/format.json").read_text())["packageName"] == "depot"
    (tmp_path / "tree/.dist/pkg/depot/parcels/values/stray.value.json").write_text("{}")  # no manifest lists it
    docs, defs = found(spark, c=logic.document(("fee", "zone"), "third"))
    tree_sink.write_documents(docs, defs.where("name <> 'zone'"), at, "append")
    tree_sink.write_documents(docs, defs.where("name = 'zone'"), at, "append")
    assert [r[3:5] for r in told(tree_sink.read_documents(spark, at).where("package = 'third' AND family = 'value'"), *columns)] == [(0, "fee"), (1, "zone")]
    assert tree_sink.read_documents(spark, at).count() == len(want) + 3
    tree_sink.write_documents(docs, defs, at)
    assert {r["package"] for r in tree_sink.read_documents(spark, at).collect()} == {"third"}


def test_failed_jobs_leave_no_listed_file(spark, tmp_path):
    at = f"file://{tmp_path / 'tree'}"
    docs, defs = found(spark, a=logic.document())
    broken = defs.withColumn("body", F.when(F.col("name") == "zone", "{").otherwise(F.col("body")))
    with pytest.raises(Exception):  # noqa: B017
        tree_sink.write_documents(docs, broken, at)
    assert not (tmp_path / "tree/_temporary").exists() and not (tmp_path / "tree/.dist").exists()


def test_references_of_any_length(spark):
    n = 1 << 20
    texts = ["a" * n + "@main.git", "github:" + "o" * n + "/r/" + "x/" * 1000 + "@v1", "gist:" + "g" * n + "#f", "https://h/" + "a" * n + ".git", "git@h:" + "a@" * (n // 2) + ".git", "x:" * n + ".git", "https://" + "a" * n + "#" + "b" * n, "./l" * n]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", remote.parse(F.col("s")).alias("p"), remote.cache_path("r", F.col("s")).alias("c"), remote.may_fetch(F.col("s"), ["h*"], [], ["o"]).alias("m")).collect()
    assert [r["p"]["kind"] for r in rows] == ["git", "github", "gist", "git", "git", "git", "http", "local"] and all(r["c"] for r in rows)
    assert rows[0]["p"]["ref"] == "main.git" and rows[1]["p"]["ref"] == "v1"
    small = ["git@h:o/r.git@main.git", "https://u@h/r.git", "https://u@h/r.git/sub/x@v2.git", "@x.git", "a@b://c.git", "https://x.github.io/r.git"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(t,) for t in small], "s string").select(remote.parse(F.col("s"))).collect()]
    assert [(g[1], g[5], g[7]) for g in got] == [("git@h:o/r.git@main.git", None, None), ("https://u", "h/r.git", None), ("https://u@h/r.git", "v2.git", "sub/x"), ("@x.git", None, None), ("a@b://c.git", None, None), ("https://x.github.io/r.git", None, None)]
