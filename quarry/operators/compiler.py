"""Expressions of the intermediate representation compiled to columns, so that Catalyst plans them.

Compilation happens on the driver and depends on the expression alone; nothing runs per row in Python. Sum types are
structs of a tag and the union of their constructors' fields, tuples structs of _1, _2, ...; functions exist during
compilation only. Externals are functions registered with the session, called by name. What has no meaning as a column
(holes, unknown externals, recursion) raises Unsupported, never gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.tree import text_of


class Unsupported(ValueError):
    """An expression that has no column."""


def _div(a: Column, b: Column) -> Column:
    """Whole division towards zero; null for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a, b))


#: Fixed names of the binary operators and two negations, as they are lowered, and what they are on columns. The 23rd binary
#: operator, ``pipe``, applies its second argument to its first (``on_reference``).
OPERATORS: dict[str, Callable[..., Column]] = {
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "eq": lambda a, b: a.eqNullSafe(b), "noteq": lambda a, b: ~a.eqNullSafe(b),
    "ltint": lambda a, b: a < b, "ltfloat": lambda a, b: a < b, "lteqint": lambda a, b: a <= b, "lteqfloat": lambda a, b: a <= b,
    "gtint": lambda a, b: a > b, "gtfloat": lambda a, b: a > b, "gteqint": lambda a, b: a >= b, "gteqfloat": lambda a, b: a >= b,
    "addint": lambda a, b: a + b, "addfloat": lambda a, b: a + b, "subint": lambda a, b: a - b, "subfloat": lambda a, b: a - b,
    "multint": lambda a, b: a * b, "multfloat": lambda a, b: a * b, "divint": _div, "divfloat": lambda a, b: F.try_divide(a, b),
    "remainderint": lambda a, b: F.when(b != 0, a % b), "concatenate": lambda a, b: F.concat(a, b), "negate": lambda a: -a, "not": lambda a: ~a,
}
ARITY = {"negate": 1, "not": 1}


@dataclass(frozen=True)
class Sum:
    """A sum type: constructors with their fields in order, and the Spark type of each field; field names are shared by type."""

    constructors: dict[str, tuple[str, ...]]
    types: dict[str, str] = field(default_factory=dict)

    def build(self, tag: str, args: list[Column]) -> Column:
        given = dict(zip(self.constructors[tag], args, strict=True))
        return F.struct(F.lit(tag).alias("tag"), *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in self.types.items()])


class Compiler:
    """``sums`` gives the sum types, ``definitions`` named values (bodies of this representation), ``natives`` functions;
    ``externals`` tells for an external's name and platform the registered SQL function and its number of arguments."""

    def __init__(self, sums: list[Sum] = (), definitions: dict[str, Any] | None = None, natives: dict[str, Callable[..., Column]] | None = None, externals: dict[tuple[str, str], tuple[str, int]] | None = None) -> None:
        self.by_tag = {tag: s for s in sums for tag in s.constructors}
        self.definitions, self.natives, self.externals = definitions or {}, natives or {}, externals or {}
        self.open: list[str] = []

    def compile(self, node: Any, env: dict[str, Any]) -> Any:
        """A Column, or a function of one argument."""
        if not (isinstance(node, dict) and len(node) == 1):
            raise Unsupported(f"no expression: {str(node)[:80]}")
        kind, body = next(iter(node.items()))
        how = getattr(self, f"on_{kind.lower()}", None)
        if how is None:
            raise Unsupported(kind)
        return how(body, env)

    def on_literal(self, body: dict, env: dict) -> Column:
        return literal(body["literal"])

    def on_variable(self, body: dict, env: dict) -> Any:
        if body["name"] not in env:
            raise Unsupported(f"unbound {body['name']}")
        return env[body["name"]]

    def on_reference(self, body: dict, env: dict) -> Any:
        name = text_of(body["fqname"]).rpartition("#")[2]
        if name in self.definitions:
            if name in self.open:
                raise Unsupported(f"recursion through {name}")
            self.open.append(name)
            try:
                return self.compile(self.definitions[name], {})
            finally:
                self.open.pop()
        plain = name.replace("-", "")
        if plain == "pipe":
            return lambda value: lambda function: function(value)
        if plain in OPERATORS:
            return curried(OPERATORS[plain], ARITY.get(plain, 2))
        if name in self.natives:
            f = self.natives[name]
            return curried(f, f.__code__.co_argcount)
        raise Unsupported(f"unknown {name}")

    def on_native(self, body: dict, env: dict) -> Any:
        """A native function by its name: one of the table given, or an operator."""
        return self.on_reference({"fqname": body["fqname"]}, env)

    def on_external(self, body: dict, env: dict) -> Any:
        """A function of another platform: the one registered for its name and platform."""
        found = self.externals.get((body["externalName"], body["targetPlatform"]))
        if found is None:
            raise Unsupported(f"unknown external {body['externalName']} of {body['targetPlatform']}")
        name, arity = found
        call = lambda *args: F.call_function(name, *args)
        return curried(call, arity) if arity else call()

    def on_constructor(self, body: dict, env: dict) -> Any:
        tag = text_of(body["fqname"]).rpartition("#")[2]
        if tag in ("true", "false"):
            return F.lit(tag == "true")
        if tag not in self.by_tag:
            raise Unsupported(f"unknown constructor {tag}")
        build = lambda *args: self.by_tag[tag].build(tag, list(args))
        n = len(self.by_tag[tag].constructors[tag])
        return curried(build, n) if n else build()

    def on_tuple(self, body: dict, env: dict) -> Column:
        return F.struct(*[self.compile(e, env).alias(f"_{i}") for i, e in enumerate(body["elements"], 1)])

    def on_list(self, body: dict, env: dict) -> Column:
        return F.array(*[self.compile(e, env) for e in body["items"]])

    def on_record(self, body: dict, env: dict) -> Column:
        return F.struct(*[self.compile(v, env).alias(k) for k, v in body["fields"].items()])

    def on_field(self, body: dict, env: dict) -> Column:
        name = body["name"]
        return self.compile(body["value"], env).getField(f"_{int(name) + 1}" if name.isdigit() else name)

    def on_fieldfunction(self, body: dict, env: dict) -> Callable:
        return lambda record: record.getField(body["name"])

    def on_apply(self, body: dict, env: dict) -> Any:
        f = self.compile(body["function"], env)
        if not callable(f) or isinstance(f, Column):
            raise Unsupported("applied what is no function")
        return f(self.compile(body["argument"], env))

    def on_lambda(self, body: dict, env: dict) -> Callable:
        def call(argument: Any) -> Any:
            _, bound = self.match(body["pattern"], argument)
            return self.compile(body["body"], env | bound)

        return call

    def on_letdefinition(self, body: dict, env: dict) -> Any:
        inner = body["definition"].get("body", body["definition"])
        return self.compile(body["body"], env | {body["name"]: self.compile(inner, env)})

    def on_destructure(self, body: dict, env: dict) -> Any:
        _, bound = self.match(body["pattern"], self.compile(body["value"], env))
        return self.compile(body["body"], env | bound)

    def on_ifthenelse(self, body: dict, env: dict) -> Column:
        return F.when(self.compile(body["condition"], env), self.compile(body["thenBranch"], env)).otherwise(self.compile(body["elseBranch"], env))

    def on_patternmatch(self, body: dict, env: dict) -> Column:
        """The first case that matches; if none does, the row's evaluation fails."""
        subject, out = self.compile(body["subject"], env), None
        for pattern, result in body["cases"]:
            test, bound = self.match(pattern, subject)
            value = self.compile(result, env | bound)
            if test is None:
                return value if out is None else out.otherwise(value)
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(F.raise_error(F.lit("no case matches")))

    def on_updaterecord(self, body: dict, env: dict) -> Column:
        record = self.compile(body["record"], env)
        for name, value in body["updates"]:
            record = record.withField(name, self.compile(value, env))
        return record

    def on_unit(self, body: dict, env: dict) -> Column:
        return F.lit(True)

    def match(self, pattern: Any, subject: Any) -> tuple[Column | None, dict[str, Any]]:
        """When the pattern holds (None: always) and what it binds."""
        kind, body = next(iter(pattern.items()))
        if kind in ("WildcardPattern", "UnitPattern"):
            return None, {}
        if kind == "AsPattern":
            test, bound = self.match(body["pattern"], subject)
            return test, bound | {body["name"]: subject}
        if kind == "LiteralPattern":
            return subject.eqNullSafe(literal(body["literal"])), {}
        if kind == "TuplePattern":
            return self.all_of(None, [(p, subject.getField(f"_{i}")) for i, p in enumerate(body["elements"], 1)])
        if kind == "ConstructorPattern":
            tag = text_of(body["fqname"]).rpartition("#")[2]
            if tag in ("true", "false"):
                return (subject if tag == "true" else ~subject), {}
            names = self.by_tag[tag].constructors[tag]
            return self.all_of(subject.getField("tag") == tag, [(p, subject.getField(n)) for n, p in zip(names, body["args"], strict=True)])
        if kind == "EmptyListPattern":
            return F.size(subject) == 0, {}
        if kind == "HeadTailPattern":
            return self.all_of(F.size(subject) >= 1, [(body["head"], F.get(subject, 0)), (body["tail"], F.slice(subject, 2, F.greatest(F.size(subject) - 1, F.lit(0))))])
        raise Unsupported(kind)

    def all_of(self, test: Column | None, parts: list[tuple[Any, Any]]) -> tuple[Column | None, dict[str, Any]]:
        bound: dict[str, Any] = {}
        for pattern, subject in parts:
            more, names = self.match(pattern, subject)
            bound |= names
            test = more if test is None else test if more is None else test & more
        return test, bound

    def apply(self, df: DataFrame, node: Any, inputs: list[Column], name: str) -> DataFrame:
        """``df`` with the column ``name``: the function ``node`` of ``inputs``. Values of lets that head the body become columns
        of their own meanwhile, so that what uses them twice does not repeat their expressions."""
        env, steps, before = {}, iter(inputs), df.columns
        while "Lambda" in node and (argument := next(steps, None)) is not None:
            _, bound = self.match(node["Lambda"]["pattern"], argument)
            env, node = env | bound, node["Lambda"]["body"]
        while "LetDefinition" in node:
            let = node["LetDefinition"]
            value = self.compile(let["definition"].get("body", let["definition"]), env)
            if isinstance(value, Column):
                df = df.withColumn(f"__let_{len(df.columns)}", value)
                value = df[df.columns[-1]]
            env, node = env | {let["name"]: value}, let["body"]
        return df.withColumn(name, self.compile(node, env)).select(*[c for c in before if c != name], name)


def curried(f: Callable[..., Column], n: int, given: tuple = ()) -> Callable:
    return lambda a: f(*given, a) if len(given) + 1 == n else curried(f, n, (*given, a))


def literal(node: dict) -> Column:
    kind, body = next(iter(node.items()))
    value = body.get("value") if isinstance(body, dict) else body
    if kind == "DecimalLiteral":
        digits = value.partition(".")[2]
        return F.lit(value).cast(f"decimal(38,{min(len(digits), 38)})")
    if kind in ("IntegerLiteral", "WholeNumberLiteral"):
        if not -(1 << 63) <= value < 1 << 63:
            raise Unsupported(f"{value} needs more than 64 bits")
        return F.lit(value).cast("long")
    return F.lit(float(value)).cast("double") if kind == "FloatLiteral" else F.lit(value)
