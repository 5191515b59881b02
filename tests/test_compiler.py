import pytest
from pyspark.sql import functions as F

from quarry.operators.compiler import Compiler, Unsupported
from quarry.plans import logic


def run(spark, node, **env):
    return spark.range(1).select(logic.compiler().compile(node, env).alias("x")).first()["x"]


def parcel(grams, declared, layers):
    return F.struct(F.lit(grams).cast("long").alias("grams"), F.lit(declared).alias("declared"), F.lit(layers).cast("long").alias("layers"))


def ship(spark, parcel, speed, region, hops):
    return logic.compiler().apply(spark.range(1), logic.SHIP, [parcel, speed, F.lit(region), F.lit(hops).cast("long")], "r").first()["r"]


def test_parcel_rules(spark):
    fee = lambda s, k: run(spark, logic.call("fee", logic.var("s"), logic.var("k")), s=s, k=F.lit(k))
    ground, air, courier = logic.SPEED.build("ground", []), logic.SPEED.build("air", [F.lit(2.0)]), lambda n: logic.SPEED.build("courier", [F.lit(4.0), F.lit(n)])
    assert (fee(ground, 2.0), fee(air, 2.0), fee(courier(3), 2.0), fee(courier(4), 2.0)) == (4.25, 4.5, 4.0, 6.0)
    issues = run(spark, logic.call("check", logic.var("p")), p=parcel(30_001, False, 1))
    assert [(x["tag"], x["grams"], x["layers"]) for x in issues] == [("overweight", 30_001, None), ("undeclared", None, None), ("fragile", None, 1)]
    assert run(spark, logic.call("check", logic.var("p")), p=parcel(30_000, True, 2)) == []
    sent = ship(spark, parcel(800, True, 1), ground, "EUROPE", 2)
    assert (sent["tag"], sent["fee"], sent["zone"], sent["issues"]) == ("sent", 3.75, "near", None)
    held = ship(spark, parcel(29_900, False, 3), ground, "ASIA", 0)
    assert (held["tag"], held["first"], [x["tag"] for x in held["issues"]]) == ("held", "overweight", ["overweight", "undeclared"])
    assert tuple(run(spark, logic.call("spread", logic.lit(7), logic.lit(4)))) == (4, 7, 3, -4)


def test_lists_tuples_records_lambdas(spark):
    v = logic.var
    head = {"HeadTailPattern": {"head": logic.named("h"), "tail": logic.named("t"), "attrs": {}}}
    node = logic.case(logic.items(logic.lit(1), logic.lit(2)), (logic.EMPTY, logic.lit(0)), (head, v("h")))
    assert run(spark, node) == 1
    pair = {"Tuple": {"elements": [logic.lit(1), logic.lit("b")], "attrs": {}}}
    assert run(spark, logic.field(pair, "1")) == "b"
    split = {"Destructure": {"pattern": {"TuplePattern": {"elements": [logic.named("a"), logic.WILD], "attrs": {}}}, "value": pair, "body": v("a"), "attrs": {}}}
    assert run(spark, split) == 1
    record = {"Record": {"fields": {"x": logic.lit(1), "y": logic.lit(2)}, "attrs": {}}}
    new = {"UpdateRecord": {"record": record, "updates": [["x", logic.lit(5)]], "attrs": {}}}
    assert tuple(run(spark, new)) == (5, 2)
    assert run(spark, logic.call({"FieldFunction": {"name": "y", "attrs": {}}}, record)) == 2
    twice = logic.fn("f x", logic.call(v("f"), logic.call(v("f"), v("x"))))
    assert run(spark, logic.call(twice, logic.call("addint", logic.lit(3)), logic.lit(1))) == 7
    literal = logic.case(v("n"), ({"LiteralPattern": {"literal": {"IntegerLiteral": {"value": 1}}, "attrs": {}}}, logic.lit("one")), (logic.WILD, logic.lit("more")))
    assert run(spark, literal, n=F.lit(1).cast("long")) == "one" and run(spark, literal, n=F.lit(2).cast("long")) == "more"


def test_arithmetic_edges(spark):
    call = lambda op, a, b: run(spark, logic.call(op, logic.lit(a), logic.lit(b)))
    assert (call("divint", 7, -2), call("remainderint", 7, -2), call("divint", 1, 0), call("divfloat", 1.0, 0.0)) == (-3, 1, None, None)


@pytest.mark.parametrize("node", [{"Hole": {}}, logic.var("nobody"), logic.ref("nothing"), {"LetRecursion": {}}, {"Literal": {"literal": {"IntegerLiteral": {"value": 1 << 63}}}}, logic.call(logic.lit(1), logic.lit(1))])
def test_what_has_no_column_is_refused(spark, node):
    with pytest.raises(Unsupported):
        logic.compiler().compile(node, {})


def test_recursion_is_refused(spark):
    with pytest.raises(Unsupported, match="recursion"):
        Compiler([], {"f": logic.ref("f")}).compile(logic.ref("f"), {})


def test_no_case_fails_the_row(spark):
    with pytest.raises(Exception, match="no case"):
        run(spark, logic.case(logic.var("p"), (logic.of("ground"), logic.lit(1))), p=logic.SPEED.build("air", [F.lit(1.0)]))
