"""The short way for plain nodes: walks by functions that the table of node shapes gives for each kind.

Plain is what has all its parts, none of another shape or of the other dialect. Whatever isn't raises one of ``ODD`` and is
left to ``tree``, which says the same of plain nodes, takes every form, and tells faults.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from .tree import FAMILY, FIELDS, FQNAME, LITERALS, ONLY_CLASSIC, ONLY_V4, classic_fqname, down, up

ODD = (ValueError, TypeError, AttributeError, KeyError, IndexError, RecursionError)
#: The types that a literal's value has exactly.
EXACT = {kind: frozenset(wanted if isinstance(wanted, tuple) else (wanted,)) for kind, wanted in LITERALS.items()}


class NotPlain(ValueError):
    pass


def plain(true: bool) -> None:
    if not true:
        raise NotPlain


def inner_parts(x: dict) -> tuple[dict, Any]:
    """An inner definition of version 4 and its body's value."""
    if len(x) == 1 and "ExpressionBody" in x:
        x = x["ExpressionBody"]
        return x, x["body"]
    body = x["body"]
    return x, body["ExpressionBody"]["body"] if len(body) == 1 and "ExpressionBody" in body else body


def type_in(t: Any) -> Any:
    return t["type"] if type(t) is dict and "type" in t else t


def _inside(x: dict, role: str) -> Iterator[tuple[str, Any, str]]:
    x, body = inner_parts(x)
    for n, t in (x.get("inputTypes") or {}).items():
        yield f"{role}inputTypes.{n}", type_in(t), "type"
    if x.get("outputType") is not None:
        yield f"{role}outputType", x["outputType"], "type"
    yield f"{role}body", body, "value"


def _children(field: str, v: Any, shape: str) -> list[tuple[str, Any, str]]:
    if shape == "definition":
        return list(_inside(v, f"{field}."))
    if shape.endswith(" fields"):
        plain(type(v) is dict and all(v))
        return [(f"{field}.{n}", x, shape[:-7]) for n, x in v.items()]
    plain(type(v) is list)
    if shape.endswith("*"):
        return [(field, x, shape[:-1]) for x in v]
    if shape == "cases":
        return [child for a, b in v for child in ((field, a, "pattern"), (field, b, "value"))]
    plain(all(type(n) is str and n for n, _ in v))
    if shape == "updates":
        return [(f"{field}.{n}", x, "value") for n, x in v]
    return [child for n, x in v for child in _inside(x, f"{field}.{n}.")]


#: Of each kind: the field of its name, that of its qualified name, and those with nodes inside, from the last.
PLANS = {
    family: {
        kind: (
            next((f for f, _, shape, _ in fields if shape == "name"), None),
            next((f for f, _, shape, _ in fields if shape == "fqname"), None),
            [(f, "value" if shape == "literal" else shape, may_lack) for f, _, shape, may_lack in reversed(fields) if shape not in ("name", "fqname")],
        )
        for kind, fields in kinds.items() if kind not in ONLY_V4
    }
    for family, kinds in FIELDS.items()
}


def rows_of(root: Any, family: str, role: str) -> list[tuple]:
    """Of a plain tree of version 4, (node_id, parent_id, role, family, kind, name, fqn, lit_text, attrs, info) as ``tree.rows_of`` has them."""
    out: list[tuple] = []
    stack = [(role, root, family, None)]
    while stack:
        role, x, family, parent = stack.pop()
        ((kind, body),) = x.items()
        me = len(out)
        if kind in LITERALS:
            value = body["value"]
            out.append((me, parent, role, "literal", kind, None, None, value if type(value) is str else json.dumps(value), None, None))
            continue
        name, fqn, parts = PLANS[family][kind]
        attrs, found = body.get("attrs"), "attrs" in body
        if name is not None:
            name, found = body[name], found + 1
            if type(name) is not str or not name:
                raise NotPlain
        if fqn is not None:
            fqn, found = body[fqn], found + 1
            if type(fqn) is not str or not fqn:
                raise NotPlain
        out.append((me, parent, role, family, kind, name, fqn, None, json.dumps(attrs) if attrs else None, None))
        for field, shape, may_lack in parts:
            if may_lack and field not in body:
                continue
            found += 1
            if shape in FAMILY:
                stack.append((field, body[field], shape, me))
            else:
                stack += [(r, child, of, me) for r, child, of in reversed(_children(field, body[field], shape))]
        if len(body) != found:
            raise NotPlain
    return out


def listed(v: Any) -> list:
    if type(v) is not list:
        raise NotPlain
    return v


def _name_up(v: Any) -> str:
    if type(v) is not list or not v or not all(v):
        raise NotPlain
    return "-".join(v)


def _name_down(v: Any) -> list[str]:
    if type(v) is not str or not v:
        raise NotPlain
    return v.split("-")


def _fqname_up(v: Any) -> str:
    package, module, local = listed(v)
    return f"{'/'.join([_name_up(x) for x in package])}:{'/'.join([_name_up(x) for x in module])}#{_name_up(local)}"


def _fqname_down(v: Any) -> list:
    plain(FQNAME.fullmatch(v) is not None)
    return classic_fqname(v)


#: Of each family, what rewrites a kind of node: from the whole classic node, or from the body of one of version 4.
UP: dict[str, dict[str, Callable[[list], dict]]] = {family: {} for family in FAMILY}
DOWN: dict[str, dict[str, Callable[[dict], list]]] = {family: {} for family in FAMILY}


def _walk(family: str, to_v4: bool) -> Callable[[Any], Any]:
    table = UP[family] if to_v4 else DOWN[family]

    def down_walk(x: Any) -> list:
        ((kind, body),) = x.items()
        return table[kind](body)

    return (lambda x: table[x[0]](x)) if to_v4 else down_walk


WALKS = {(family, to_v4): _walk(family, to_v4) for family in FAMILY for to_v4 in (True, False)}


def rewrite(node: Any, family: str, to_v4: bool) -> Any:
    """A plain node in the other dialect, as ``tree.rewrite`` gives it."""
    return WALKS[family, to_v4](node)


def _inner_up(x: dict) -> dict:
    out: dict[str, Any] = {}
    given, result = x.get("inputTypes"), x.get("outputType")
    if given is not None:
        out["inputTypes"] = {_name_up(n): {"type": rewrite(t, "type", True)} for n, _, t in listed(given)}
    if result is not None:
        out["outputType"] = rewrite(result, "type", True)
    out["body"] = rewrite(x["body"], "value", True)
    return out


def _inner_down(x: dict) -> dict:
    x, body = inner_parts(x)
    out: dict[str, Any] = {}
    given, result = x.get("inputTypes"), x.get("outputType")
    if given is not None:
        out["inputTypes"] = [[n.split("-"), {}, rewrite(type_in(t), "type", False)] for n, t in given.items()]
    if result is not None:
        out["outputType"] = rewrite(result, "type", False)
    out["body"] = rewrite(body, "value", False)
    return out


def _part(shape: str, to_v4: bool) -> Callable[[Any], Any]:
    """What makes a field of ``shape`` in the other dialect."""
    name, inner = (_name_up, _inner_up) if to_v4 else (_name_down, _inner_down)
    pattern, value = WALKS["pattern", to_v4], WALKS["value", to_v4]
    if shape in ("name", "fqname"):
        return name if shape == "name" else _fqname_up if to_v4 else _fqname_down
    if shape == "definition":
        return inner
    if shape in FAMILY or shape == "literal":
        return WALKS["value" if shape == "literal" else shape, to_v4]
    if shape.endswith(" fields"):
        walk = WALKS[shape[:-7], to_v4]
        return (lambda v: {name(n): walk(x) for n, x in listed(v)}) if to_v4 else lambda v: [[name(n), walk(x)] for n, x in v.items()]
    if shape.endswith("*"):
        walk = WALKS[shape[:-1], to_v4]
        return lambda v: [walk(x) for x in listed(v)]
    if shape == "cases":
        return lambda v: [[pattern(a), value(b)] for a, b in listed(v)]
    if shape == "updates":
        return lambda v: [[name(n), value(x)] for n, x in listed(v)]
    return lambda v: [[name(n), inner(x)] for n, x in listed(v)]


def _literal(told: str, to_v4: bool) -> Callable[[Any], Any]:
    kind = {"WholeNumberLiteral": "IntegerLiteral"}.get(told, told) if to_v4 else {"IntegerLiteral": "WholeNumberLiteral"}.get(told, told)
    exact, one = EXACT[told], told == "CharLiteral"

    def made(x: Any) -> Any:
        value = x[1] if to_v4 else x["value"]
        if type(value) not in exact or one and len(value) != 1 or to_v4 and len(x) != 2:
            raise NotPlain
        return {kind: {"value": value}} if to_v4 else [kind, value]

    return made


def _node_up(kind: str, fields: list[tuple]) -> Callable[[list], dict]:
    parts, size = [(at, name, _part(shape, True)) for name, at, shape, _ in fields], len(fields) + 2

    def made(x: list) -> dict:
        if len(x) != size:
            raise NotPlain
        out = {}
        for at, name, part in parts:
            out[name] = part(x[at])
        attrs = x[1]
        out["attrs"] = {} if attrs == {} else up(attrs)
        return {kind: out}

    return made


def _node_down(kind: str, fields: list[tuple]) -> Callable[[dict], list]:
    parts = [(name, _part(shape, False), may_lack) for name, _, shape, may_lack in fields]

    def made(body: dict) -> list:
        out = [kind, down(body.get("attrs"))]
        for name, part, may_lack in parts:
            v = body.get(name)
            if v is None and not may_lack:
                raise NotPlain
            out.append([] if v is None else part(v))
        return out

    return made


def _variable_pattern(x: list) -> dict:
    plain(len(x) == 3)
    return {"AsPattern": {"pattern": {"WildcardPattern": {"attrs": {}}}, "name": _name_up(x[2]), "attrs": up(x[1])}}


for _family, _kinds in FIELDS.items():
    for _kind in LITERALS:
        UP[_family][_kind], DOWN[_family][_kind] = _literal(_kind, True), _literal(_kind, False)
    for _kind, _fields in _kinds.items():
        if _kind not in ONLY_V4:
            UP[_family][_kind], DOWN[_family][_kind] = _node_up(_kind, _fields), _node_down(_kind, _fields)
UP["pattern"] |= dict.fromkeys(ONLY_CLASSIC, _variable_pattern)
