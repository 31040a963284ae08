"""A parsed tree to typed values under a plan: names and namespaces, plain values, scalars."""

from __future__ import annotations

import base64
import datetime
import json
import re
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from .names import TEXT_KEY, is_attribute_key

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|NaN|[+-]?Infinity", re.ASCII)
_WHOLE = re.compile(r"[+-]?\d+", re.ASCII)
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


class DecodeError(ValueError):
    pass


def declarations(record: dict, scope: dict) -> dict:
    """The scope with a record's own namespace declarations."""
    own = {k[7:] if k[6:7] == ":" else "": v for k, v in record.items() if k == "@xmlns" or k.startswith("@xmlns:")}
    return {**scope, **own} if own else scope


def resolve_names(value: Any, node, scope: dict) -> Any:
    """Wire names to the plan's keys, by namespace and local name, else by local name alone."""
    if isinstance(value, list):
        inner = node.member if node is not None and node.kind == "array" else node
        return [resolve_names(v, inner, scope) for v in value]
    while node is not None and node.kind == "array":
        node = node.member
    if node is not None and node.kind == "union":
        node = node.merged
    if not isinstance(value, dict):
        field = node.value_field if node is not None and node.kind == "struct" else None
        return {field.key: value} if field is not None and field.key != TEXT_KEY and isinstance(value, str) else value
    scope = declarations(value, scope)
    fields = node.fields if node is not None and node.kind == "struct" else []
    out: dict = {}
    for key, child in value.items():
        if key == "@xmlns" or key.startswith("@xmlns:"):
            continue
        if key == TEXT_KEY:
            field = node.value_field if fields else None
            out[field.key if field is not None else key] = child
            continue
        place = "attribute" if is_attribute_key(key) else "element"
        name = key[1:] if place == "attribute" else key
        prefix, _, local = name.rpartition(":")
        inner = child[0] if isinstance(child, list) and child else child  # the first of a run stands for it
        own = declarations(inner, scope) if isinstance(inner, dict) and place == "element" else scope
        uri = own.get(prefix) or None if prefix or place == "element" else None
        field = next((f for f in fields if f.place == place and f.uri == uri and f.local == local), None) or next((f for f in fields if f.place == place and f.local == local), None)
        found = resolve_names(child, field.node if field is not None else node.member if node is not None and node.kind == "map" else None, scope) if place == "element" else child
        to = field.key if field is not None else ("@" if place == "attribute" else "") + local
        out[to] = found
    if set(out) == {TEXT_KEY}:
        return out[TEXT_KEY]
    return out


def typed(value: Any, node, path: str = "") -> Any:
    """The value that the plan wants, or a DecodeError."""
    if node.kind == "tree":
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if node.kind == "scalar":
        return scalar(plain(value, path), node, path)
    if node.kind == "array":
        return array(value, node, path)
    if node.kind == "union":
        return union(value, node, path)
    if node.kind == "map":
        if not isinstance(value, dict):
            raise DecodeError(f"Expected a record, but received {described(value)}{at(path)}")
        return [(k, typed(v, node.member, within(path, k))) for k, v in value.items()]
    if not isinstance(value, dict):
        raise DecodeError(f"Expected a record, but received {described(value)}{at(path)}")
    out = {}
    for f in node.fields:
        if f.key in value:
            out[f.key] = typed(value[f.key], f.node, within(path, f.key))
        elif f.optional:
            out[f.key] = None
        else:
            raise DecodeError(f"Missing key{at(within(path, f.key))}")
    return out


def union(value: Any, node, path: str) -> dict:
    """The first member that reads the value, under its name; where none does, the first one's error."""
    first = None
    for f in node.fields:
        try:
            return {**dict.fromkeys(g.key for g in node.fields), f.key: typed(value, f.node, path)}
        except DecodeError as e:
            first = first or e
    raise first or DecodeError(f"Expected a member of the union, but received {described(value)}{at(path)}")


def array(value: Any, node, path: str) -> list:
    inner = node.member
    structural = inner.structural
    if not isinstance(value, list):
        if node.single:
            value = [value]
        elif value in ("", {}):  # an element without content, or with nothing but namespace declarations
            value = [""] if structural else []
        else:
            raise DecodeError(f"Expected an array, but received {described(value)}{at(path)}")
    return [typed({} if m == "" and structural else m, inner, f"{path}[{i}]") for i, m in enumerate(value)]


def plain(value: Any, path: str) -> Any:
    """Character data of an element whose attributes nobody asked for; a record without any stays as it is."""
    if not isinstance(value, dict) or TEXT_KEY not in value:
        return value
    child = next((k for k in value if k != TEXT_KEY and not is_attribute_key(k)), None)
    if child is not None:
        raise DecodeError(f'the field "{path or "root"}" wants a plain value, but the element also carries the child element "{child}"; only attributes are discarded alongside #text')
    return value[TEXT_KEY]


def scalar(value: Any, node, path: str) -> Any:
    if not isinstance(value, str):
        raise DecodeError(f"Expected {node.type}, but received {described(value)}{at(path)}")
    try:
        out = parsed(value, node.type)
    except (ValueError, ArithmeticError):
        raise DecodeError(f"Expected {node.type}, but received {json.dumps(value, ensure_ascii=False)}{at(path)}") from None
    if node.enum is not None and not any(out == e and isinstance(e, bool) == isinstance(out, bool) for e in node.enum):
        raise DecodeError(f"Expected {' | '.join(json.dumps(e) for e in node.enum)}, but received {json.dumps(value, ensure_ascii=False)}{at(path)}")
    return out


def parsed(text: str, kind: str) -> Any:
    if kind == "string":
        return text
    if kind == "boolean":
        return {"true": True, "false": False}[text] if text in ("true", "false") else int("")
    if kind in ("double", "float"):
        if not _NUMBER.fullmatch(text):
            raise ValueError
        return float(text.replace("Infinity", "inf"))
    if kind in _BITS:
        n = int(text) if _WHOLE.fullmatch(text) else int("")
        if not -(1 << _BITS[kind] - 1) <= n < 1 << _BITS[kind] - 1:
            raise ValueError
        return n
    if kind.startswith("decimal"):
        if not _NUMBER.fullmatch(text):
            raise ValueError
        precision, scale = map(int, re.findall(r"\d+", kind))
        n = Decimal(text)
        if n != round(n, scale) or n.adjusted() >= precision - scale:
            raise ValueError
        return n
    if kind == "date":
        return datetime.date.fromisoformat(text)
    if kind.startswith("timestamp"):
        t = datetime.datetime.fromisoformat(text)
        return t if t.tzinfo or kind == "timestamp_ntz" else t.replace(tzinfo=datetime.timezone.utc)
    if kind == "binary":
        return base64.b64decode(text, validate=True)
    raise ValueError(kind)


class _Unread(Exception):
    """The short way does not read this value; ``typed`` does, or tells why not."""


def reader(node) -> Callable[[Any], Any]:
    """A function that reads what ``typed`` reads, made for one node: without paths, which only errors need."""
    if node.kind == "struct":
        return _struct_reader([(f.key, reader(f.node), f.optional) for f in node.fields])
    if node.kind == "array":
        return _array_reader(reader(node.member), node.member.structural, node.single)
    if node.kind == "scalar" and node.enum is None:
        return _scalar_reader(node.type)

    def slow(value: Any) -> Any:
        try:
            return typed(value, node)
        except DecodeError:
            raise _Unread from None

    return slow


def _struct_reader(fields: list[tuple[str, Callable, bool]]) -> Callable[[Any], dict]:
    def read(value: Any) -> dict:
        if type(value) is not dict:
            raise _Unread
        out = {}
        for key, inner, optional in fields:
            found = value.get(key, out)
            if found is not out:
                out[key] = inner(found)
            elif optional:
                out[key] = None
            else:
                raise _Unread
        return out

    return read


def _array_reader(inner: Callable, structural: bool, single: bool) -> Callable[[Any], list]:
    def read(value: Any) -> list:
        if type(value) is list:
            return [inner({} if structural and m == "" else m) for m in value]
        if not single:
            raise _Unread
        return [inner({} if structural and value == "" else value)]

    return read


def _scalar_reader(kind: str) -> Callable[[Any], Any]:
    number, whole = _NUMBER.fullmatch, _WHOLE.fullmatch
    bits = _BITS.get(kind, 0)
    least, most = -(1 << bits >> 1), (1 << bits >> 1) - 1

    def read(value: Any) -> Any:
        if type(value) is not str:
            value = value.get(TEXT_KEY) if type(value) is dict and all(map(is_attribute_key, value.keys() - {TEXT_KEY})) else None
            if value is None:
                raise _Unread
        if kind == "string":
            return value
        if kind == "double":
            if number(value) and value[-1] != "y":
                return float(value)
        elif bits:
            if whole(value) and least <= (n := int(value)) <= most:
                return n
        elif kind == "boolean":
            if value in ("true", "false"):
                return value == "true"
        else:
            try:
                return parsed(value, kind)
            except (ValueError, ArithmeticError):
                pass
        raise _Unread

    return read


def read_typed(value: Any, node, quick: Callable[[Any], Any]) -> Any:
    """``typed``, by the function that ``reader`` made where that will do."""
    try:
        return quick(value)
    except _Unread:
        return typed(value, node)


def described(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)[:200]


def within(path: str, key: str) -> str:
    return f"{path}.{key}" if path else key


def at(path: str) -> str:
    return f' at "{path}"' if path else ""
