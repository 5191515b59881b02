"""A sample program in the intermediate representation: what parcels cost, why they are held, and where they go."""

from __future__ import annotations

from typing import Any

from quarry.operators.compiler import Compiler, Sum

PACKAGE = "depot:parcels"


def var(name: str) -> dict:
    return {"Variable": {"name": name, "attrs": {}}}


def lit(value: Any) -> dict:
    kind = "BoolLiteral" if isinstance(value, bool) else "IntegerLiteral" if isinstance(value, int) else "FloatLiteral" if isinstance(value, float) else "StringLiteral"
    return {"Literal": {"literal": {kind: {"value": value}}, "attrs": {}}}


def ref(name: str) -> dict:
    return {"Reference": {"fqname": f"{PACKAGE}#{name}", "attrs": {}}}


def make(tag: str, *args: dict) -> dict:
    return call({"Constructor": {"fqname": f"{PACKAGE}#{tag}", "attrs": {}}}, *args)


def call(function: dict | str, *args: dict) -> dict:
    out = ref(function) if isinstance(function, str) else function
    for a in args:
        out = {"Apply": {"function": out, "argument": a, "attrs": {}}}
    return out


def field(value: dict, name: str) -> dict:
    return {"Field": {"value": value, "name": name, "attrs": {}}}


def items(*values: dict) -> dict:
    return {"List": {"items": list(values), "attrs": {}}}


def let(name: str, value: dict, body: dict) -> dict:
    return {"LetDefinition": {"name": name, "definition": {"body": value}, "body": body, "attrs": {}}}


def when(condition: dict, yes: dict, no: dict) -> dict:
    return {"IfThenElse": {"condition": condition, "thenBranch": yes, "elseBranch": no, "attrs": {}}}


def case(subject: dict, *cases: tuple[dict, dict]) -> dict:
    return {"PatternMatch": {"subject": subject, "cases": [list(c) for c in cases], "attrs": {}}}


WILD = {"WildcardPattern": {"attrs": {}}}
EMPTY = {"EmptyListPattern": {"attrs": {}}}


def named(name: str) -> dict:
    return {"AsPattern": {"pattern": WILD, "name": name, "attrs": {}}}


def of(tag: str, *args: dict) -> dict:
    return {"ConstructorPattern": {"fqname": f"{PACKAGE}#{tag}", "args": list(args), "attrs": {}}}


def fn(params: str, body: dict) -> dict:
    for name in reversed(params.split()):
        body = {"Lambda": {"pattern": named(name), "body": body, "attrs": {}}}
    return body


def tup(*values: dict) -> dict:
    return {"Tuple": {"elements": list(values), "attrs": {}}}


def record(**fields: dict) -> dict:
    return {"Record": {"fields": fields, "attrs": {}}}


def updated(value: dict, **fields: dict) -> dict:
    return {"UpdateRecord": {"record": value, "updates": [list(f) for f in fields.items()], "attrs": {}}}


def split(pattern: dict, value: dict, body: dict) -> dict:
    return {"Destructure": {"pattern": pattern, "value": value, "body": body, "attrs": {}}}


def pair(*patterns: dict) -> dict:
    return {"TuplePattern": {"elements": list(patterns), "attrs": {}}}


def exactly(value: Any) -> dict:
    return {"LiteralPattern": {"literal": lit(value)["Literal"]["literal"], "attrs": {}}}


def first(head: dict, tail: dict) -> dict:
    return {"HeadTailPattern": {"head": head, "tail": tail, "attrs": {}}}


def getter(name: str) -> dict:
    return {"FieldFunction": {"name": name, "attrs": {}}}


def native(name: str) -> dict:
    return {"Native": {"fqname": f"{PACKAGE}#{name}", "info": {"hint": {"Arithmetic": {}}}, "attrs": {}}}


SPEED = Sum({"ground": (), "air": ("surcharge",), "courier": ("base", "stops")}, {"surcharge": "double", "base": "double", "stops": "bigint"})
ISSUE = Sum({"overweight": ("grams",), "undeclared": (), "fragile": ("layers",)}, {"grams": "bigint", "layers": "bigint"})
ISSUES = "array<struct<tag:string,grams:bigint,layers:bigint>>"
OUTCOME = Sum({"sent": ("fee", "zone"), "held": ("first", "issues")}, {"fee": "double", "zone": "string", "first": "string", "issues": ISSUES})

FEE = fn("speed kilos", case(
    var("speed"),
    (of("ground"), call("add-float", lit(3.25), call("mult-float", var("kilos"), lit(0.5)))),
    (of("air", named("extra")), call("add-float", var("extra"), call("mult-float", var("kilos"), lit(1.25)))),
    (of("courier", named("base"), named("stops")), when(call("gt-int", var("stops"), lit(3)), call("mult-float", var("base"), lit(1.5)), var("base"))),
))
#: A parcel is a record of grams, declared, layers; what is wrong with it, in this order.
CHECK = fn("parcel", call(
    "concatenate",
    when(call("gt-int", field(var("parcel"), "grams"), lit(30_000)), items(make("overweight", field(var("parcel"), "grams"))), items()),
    call(
        "concatenate",
        when(call("not", field(var("parcel"), "declared")), items(make("undeclared")), items()),
        case(field(var("parcel"), "layers"), (exactly(0), items(make("fragile", lit(0)))), (exactly(1), items(make("fragile", lit(1)))), (WILD, items())),
    ),
))
ZONE = fn("region hops", case(
    tup(var("region"), var("hops")),
    (pair(WILD, exactly(0)), lit("local")),
    (pair(exactly("EUROPE"), named("h")), when(call("lt-eq-int", var("h"), lit(2)), lit("near"), lit("far"))),
    (WILD, lit("overseas")),
))
#: A wrapped parcel weighs 200 g and has a layer more.
WRAPPED = fn("parcel", updated(var("parcel"), grams=call("add-int", field(var("parcel"), "grams"), lit(200)), layers=call("add-int", call(getter("layers"), var("parcel")), lit(1))))
SHIP = fn("parcel speed region hops", let("wrapped", call("pipe", var("parcel"), ref("wrapped")), let("issues", call("check", var("wrapped")), case(
    var("issues"),
    (EMPTY, make("sent", call("fee", var("speed"), call(native("kilos-of"), field(var("wrapped"), "grams"))), call("zone", var("region"), var("hops")))),
    (first(named("worst"), WILD), make("held", call(native("label-of"), var("worst")), var("issues"))),
))))
#: Least and most of two numbers, swapped where need be, and their distance.
SPREAD = fn("a b", split(
    pair(named("low"), named("high")), when(call("lt-int", var("a"), var("b")), tup(var("a"), var("b")), tup(var("b"), var("a"))),
    record(low=var("low"), high=var("high"), apart=call("sub-int", var("high"), var("low")), down=call("negate", var("low"))),
))

DEFINITIONS = {"fee": FEE, "check": CHECK, "zone": ZONE, "wrapped": WRAPPED, "ship": SHIP, "spread": SPREAD}
NATIVES = {"kilos-of": lambda grams: grams.cast("double") / 1000.0, "label-of": lambda issue: issue.getField("tag")}


def compiler() -> Compiler:
    return Compiler([SPEED, ISSUE, OUTCOME], DEFINITIONS, NATIVES)


def document(names: tuple[str, ...] = tuple(DEFINITIONS), package: str = "depot") -> dict:
    """Some of the definitions as a document of version 4."""
    text = {"Reference": {"fqname": "lang/sdk:basics#float", "args": [], "attrs": {}}}
    values = {name: {"access": "Private" if name == "spread" else "Public", "value": {"ExpressionBody": {"inputTypes": {}, "outputType": {"Unit": {"attrs": {}}}, "body": DEFINITIONS[name]}}} for name in names}
    types = {"speed": {"access": "Public", "value": {"CustomTypeDefinition": {"typeParams": [], "constructors": {"ground": [], "air": [["surcharge", text]]}}}}}
    return {"formatVersion": "4.0.0", "distribution": {"Library": {"packageName": package, "dependencies": {"lang/sdk": {"modules": {}}}, "def": {"modules": {"parcels": {"access": "Public", "value": {"types": types, "values": values}}}}}}}
