"""Annotations of a schema, kept in the metadata of its fields, and their compilation to a plan.

A key ``@name`` is an attribute, ``#text`` character data, any other a child element.  Annotations change that:
``xmlAttribute``, ``xmlValue``, ``xmlName``, ``xmlNamespace`` with ``xmlPrefix``.  An element without a namespace of its
own is in that of the element around it; an attribute never is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field as member
from typing import Any

from pyspark.sql import types as T

from ..core.names import TEXT_KEY, is_attribute_key

NAMESPACE_KEY, PREFIX_KEY, NAME_KEY, ATTRIBUTE_KEY, VALUE_KEY = "xmlNamespace", "xmlPrefix", "xmlName", "xmlAttribute", "xmlValue"
#: Of our own: a field that may be absent, the values that it may have, a field that holds a tree as JSON text, and an
#: array that also reads a single element.
OPTIONAL_KEY, ENUM_KEY, JSON_KEY, SINGLE_KEY = "optional", "enum", "xmlJson", "xmlSingle"
#: A struct whose fields are the members of a union: an element is read by the first that can, and one is not null.
UNION_KEY = "xmlUnion"


_TOKEN = re.compile(r"\s*(`(?:[^`]|``)*`|[A-Za-z_@#][\w@#]*|\d+|[<>(),:])")
_SCALARS = {"string": T.StringType, "double": T.DoubleType, "float": T.FloatType, "int": T.IntegerType, "integer": T.IntegerType, "bigint": T.LongType, "long": T.LongType, "smallint": T.ShortType, "tinyint": T.ByteType, "boolean": T.BooleanType, "date": T.DateType, "timestamp": T.TimestampType, "timestamp_ntz": T.TimestampNTZType, "binary": T.BinaryType}


def types(text: str) -> T.DataType:
    """A type from its text (``a string, b array<int>`` or ``array<string>``), without a session."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"Cannot read the type {text!r} at {at}")
        tokens.append(m[1])
        at = m.end()
    tokens.append("")

    def take(want: str = "") -> str:
        token = tokens.pop(0)
        if want and token != want:
            raise ValueError(f"Expected {want!r} in the type {text!r}, but found {token!r}")
        return token

    def name() -> str:
        token = take()
        return token[1:-1].replace("``", "`") if token[:1] == "`" else token

    def parts(between: str, end: str) -> T.StructType:
        out = []
        while True:
            key = name()
            if between or tokens[0] == ":":
                take(":")
            out.append(T.StructField(key, one()))
            if tokens[0] != ",":
                take(end) if end else None
                return T.StructType(out)
            take(",")

    def one() -> T.DataType:
        kind = take().lower()
        if kind == "array":
            take("<")
            inner = one()
            take(">")
            return T.ArrayType(inner)
        if kind == "map":
            take("<")
            key = one()
            take(",")
            value = one()
            take(">")
            return T.MapType(key, value)
        if kind == "struct":
            take("<")
            return parts(":", ">")
        if kind == "decimal":
            if tokens[0] != "(":
                return T.DecimalType(10, 0)
            take("(")
            precision = int(take())
            take(",")
            scale = int(take())
            take(")")
            return T.DecimalType(precision, scale)
        if kind not in _SCALARS:
            raise ValueError(f"Unknown type {kind!r} in {text!r}")
        return _SCALARS[kind]()

    alone = len(tokens) == 2 or tokens[1] in ("<", "(")
    out = one() if alone else parts("", "")
    if tokens != [""]:
        raise ValueError(f"Cannot read the type {text!r}: {tokens[0]!r} is left")
    return out


def field(name: str, kind: T.DataType | str, *, namespace: str | None = None, prefix: str | None = None, xml_name: str | None = None, attribute: bool = False, value: bool = False, optional: bool = False, enum: list | None = None, tree: bool = False, single: bool = False, union: bool = False) -> T.StructField:
    """A field with annotations.  ``tree``: a string field that holds any tree as JSON text, for recursive or mixed shapes.

    ``union``: a struct field, or an array of structs, whose element is one of the struct's fields, the others being null.
    """
    given = {NAMESPACE_KEY: namespace, PREFIX_KEY: prefix, NAME_KEY: xml_name, ATTRIBUTE_KEY: attribute or None, VALUE_KEY: value or None, OPTIONAL_KEY: optional or None, ENUM_KEY: enum, JSON_KEY: tree or None, SINGLE_KEY: single or None, UNION_KEY: union or None}
    kind = types(kind) if isinstance(kind, str) else kind
    return T.StructField(name, kind, True, {k: v for k, v in given.items() if v is not None})


@dataclass
class Node:
    """A value: ``scalar`` (of a Spark type), ``tree``, ``struct``, ``union``, ``array`` or ``map``."""

    kind: str
    type: str = "string"
    fields: list[Field] = member(default_factory=list)
    member: Node | None = None
    enum: list | None = None
    #: Array that reads a single element too.
    single: bool = False

    @property
    def structural(self) -> bool:
        """Whether an empty element is a record without fields."""
        return self.kind in ("struct", "map") or self.kind == "union" and any(f.node.structural for f in self.fields)

    @property
    def merged(self) -> Node | None:
        """A struct with the fields of all members of a union that are structs."""
        inner = [f.node.merged if f.node.kind == "union" else f.node for f in self.fields]
        found = [g for n in inner if n is not None and n.kind == "struct" for g in n.fields]
        return Node("struct", fields=found) if found else None

    @property
    def value_field(self) -> Field | None:
        return next((f for f in self.fields if f.place == "text"), None)


@dataclass
class Field:
    key: str
    #: ``attribute``, ``text`` or ``element``.
    place: str
    local: str
    node: Node
    uri: str | None = None
    prefix: str = ""
    optional: bool = False

    @property
    def wire(self) -> str:
        return f"{self.prefix}:{self.local}" if self.prefix else self.local


@dataclass
class Plan:
    root: Node
    #: The root element.
    name: str
    uri: str | None = None
    prefix: str = ""
    #: Whether any annotation gives names or namespaces.
    active: bool = False
    #: Whether the root's own annotations name it or its namespace.
    root_declared: bool = False


class _Scan:
    def __init__(self):
        self.problems: list[str] = []
        self.active = False

    def node(self, kind: T.DataType, meta: dict, uri: str | None, prefix: str, name: str) -> Node:
        if isinstance(kind, T.StructType) and meta.get(UNION_KEY):
            return Node("union", fields=[Field(f.name, "element", name, self.node(f.dataType, f.metadata or {}, uri, prefix, name)) for f in kind.fields])
        if isinstance(kind, T.StructType):
            return Node("struct", fields=self.fields(kind, uri, prefix, name))
        if isinstance(kind, T.ArrayType):
            inner = self.node(kind.elementType, {k: v for k, v in meta.items() if k in (ENUM_KEY, JSON_KEY, UNION_KEY)}, uri, prefix, name)
            return Node("array", member=inner, single=NAME_KEY in meta or bool(meta.get(SINGLE_KEY)))
        if isinstance(kind, T.MapType):
            return Node("map", member=self.node(kind.valueType, {}, None, "", name))
        return Node("tree" if meta.get(JSON_KEY) else "scalar", type=kind.simpleString(), enum=meta.get(ENUM_KEY))

    def fields(self, kind: T.StructType, uri: str | None, prefix: str, element: str) -> list[Field]:
        out: list[Field] = []
        taken: dict[tuple, str] = {}
        value = None
        for f in kind.fields:
            meta = f.metadata or {}
            self.active |= any(k in meta for k in (NAMESPACE_KEY, PREFIX_KEY, NAME_KEY, ATTRIBUTE_KEY, VALUE_KEY))
            own, renamed = meta.get(NAMESPACE_KEY), meta.get(NAME_KEY)
            attribute = is_attribute_key(f.name) or bool(meta.get(ATTRIBUTE_KEY))
            local = f.name[1:] if is_attribute_key(f.name) else f.name
            if meta.get(VALUE_KEY) or f.name == TEXT_KEY:
                if meta.get(VALUE_KEY):
                    if attribute:
                        self.problems.append(f'the field "{f.name}" is marked as both an attribute and the element\'s value')
                    if renamed is not None:
                        self.problems.append(f'the value field "{f.name}" cannot have an xmlName, because character data has no name')
                    if own is not None:
                        self.problems.append(f'the value field "{f.name}" cannot have a namespace, because character data has none')
                    if value is not None:
                        self.problems.append(f'the element "{element}" has more than one value field, "{value}" and "{f.name}"')
                    value = value or f.name
                out.append(Field(f.name, "text", TEXT_KEY, self.node(f.dataType, meta, uri, prefix, f.name), optional=bool(meta.get(OPTIONAL_KEY))))
                continue
            if renamed is not None:
                if ":" in renamed:
                    self.problems.append(f'xmlName "{renamed}" on "{f.name}" must be a local name; use xmlPrefix for the prefix')
                local = renamed
            if own is not None and ":" in f.name:
                self.problems.append(f'"{f.name}" already carries a prefix, so it cannot also carry a namespace annotation')
            if attribute:
                own_prefix = meta.get(PREFIX_KEY, "") if own is not None else ""
                if own is not None and not own_prefix:
                    self.problems.append(f'the attribute "{f.name}" needs xmlPrefix, because a default namespace does not apply to attributes')
                made = Field(f.name, "attribute", local, self.node(f.dataType, meta, None, "", f.name), own, own_prefix, bool(meta.get(OPTIONAL_KEY)))
            else:
                at, mark = (own, meta.get(PREFIX_KEY, "")) if own is not None else (uri, prefix)
                if ":" in local:
                    at, mark = None, ""
                made = Field(f.name, "element", local, self.node(f.dataType, meta, at, mark, local), at, mark, bool(meta.get(OPTIONAL_KEY)))
            place = (made.place, made.uri, made.local)
            if place in taken:
                self.problems.append(f'"{taken[place]}" and "{f.name}" both resolve to "{made.local}" under the same element')
            taken.setdefault(place, f.name)
            out.append(made)
        return out


def plan(schema: T.DataType, root_name: str | None = None, annotations: dict[str, Any] | None = None) -> Plan:
    """The plan of a schema.  ``annotations`` of the root: those of a field, ``identifier`` and ``title``."""
    meta = dict(annotations or {})
    scan = _Scan()
    uri, prefix = meta.get(NAMESPACE_KEY), meta.get(PREFIX_KEY, "") if NAMESPACE_KEY in meta else ""
    name = root_name or meta.get(NAME_KEY) or meta.get("identifier") or meta.get("title") or "root"
    if ":" in (meta.get(NAME_KEY) or ""):
        scan.problems.append(f'xmlName "{meta[NAME_KEY]}" on "root" must be a local name; use xmlPrefix for the prefix')
    root = scan.node(schema, {k: v for k, v in meta.items() if k in (ENUM_KEY, JSON_KEY, UNION_KEY)}, uri, prefix, name)
    if scan.problems:
        raise ValueError("Invalid XML namespace annotation:" + "".join(f"\n\t- {p}" for p in scan.problems) + ".")
    active = scan.active or any(k in meta for k in (NAMESPACE_KEY, PREFIX_KEY, NAME_KEY))
    declared = any(k in meta for k in (NAMESPACE_KEY, NAME_KEY))
    return Plan(root, f"{prefix}:{name}" if prefix and ":" not in name else name, uri, prefix, active, declared)


def pruned(schema: T.StructType, names: list[str]) -> T.StructType:
    """Only the named fields (``a`` or ``a.b``), in the schema's order."""
    out = []
    for f in schema.fields:
        inner = [n[len(f.name) + 1 :] for n in names if n.startswith(f.name + ".")]
        if f.name in names:
            out.append(f)
        elif inner and isinstance(f.dataType, T.StructType):
            out.append(T.StructField(f.name, pruned(f.dataType, inner), f.nullable, f.metadata))
        elif inner and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out.append(T.StructField(f.name, T.ArrayType(pruned(f.dataType.elementType, inner)), f.nullable, f.metadata))
    return T.StructType(out)
