"""A schema to one expression that writes its documents, without leaving the JVM.

Names, namespace declarations, indentation and the order of keys are literals chosen on the driver; only values are left
to run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.names import resolve_name
from ..core.render import escape_attribute as escaped
from ..core.render import too_deep
from ..functions import names as fnames
from ..functions.escape import escape_attribute, escape_text
from ..functions.text import scalar_text
from .schema import Field, Node, Plan, types


@dataclass(frozen=True)
class RenderOptions:
    item_name: str = "item"
    format: bool = False
    indent: str = "  "
    suppress_empty_node: bool = True
    sort_keys: bool = False
    name: str = "repair"
    xml_version: str = "1.0"
    max_depth: int = 256


def joined(*parts: Column | str) -> Column:
    """Concatenation of columns and literals, neighbouring literals as one."""
    out: list[Column | str] = []
    for p in parts:
        if isinstance(p, str) and out and isinstance(out[-1], str):
            out[-1] += p
        elif not (isinstance(p, str) and not p):
            out.append(p)
    cols = [F.lit(p) if isinstance(p, str) else p for p in out]
    return cols[0] if len(cols) == 1 else F.concat(*cols) if cols else F.lit("")


class Encoder:
    def __init__(self, plan: Plan, options: RenderOptions):
        self.plan, self.o = plan, options

    def tag(self, name: str) -> str:
        return resolve_name(name, self.o.name, self.o.xml_version)

    def line(self, depth: int) -> str:
        return "\n" + self.o.indent * depth if self.o.format else ""

    def document(self, value: Column) -> Column:
        """Text of a document; null for null."""
        plan = self.plan
        if plan.root.kind == "array":
            if plan.active and plan.root_declared:
                raise ValueError("An array at the root of a namespaced schema cannot carry the root namespace or name.")
            tag = self.tag(plan.name)
            members = F.array_join(F.transform(self.flat(value, plan.root), lambda m: self.element(m, self.innermost(plan.root), self.o.item_name, None, "", {}, 1, True)), "")
            text = joined(f"<{tag}>", members, "\n" * self.o.format, f"</{tag}>")
        else:
            text = self.element(value, plan.root, plan.name, plan.uri, plan.prefix, {}, 0, True)
        return F.when(value.isNotNull(), joined(text, "\n" * self.o.format))

    def declare(self, uri: str | None, prefix: str, scope: dict) -> str:
        """Declaration that an element or attribute of this namespace needs, which is then in scope."""
        if not self.plan.active:
            return ""
        if uri is not None and prefix:
            if scope.get(prefix) == uri:
                return ""
            scope[prefix] = uri
            return f' xmlns:{prefix}="{escaped(uri)}"'
        if uri is None and scope.get("") is None or uri is not None and scope.get("") == uri:
            return ""
        scope[""] = uri
        return f' xmlns="{escaped(uri or "")}"'

    def innermost(self, node: Node) -> Node:
        while node.kind == "array":
            node = node.member
        return node

    def flat(self, value: Column, node: Node) -> Column:
        """The members of nested arrays as one array; an empty inner array counts for one empty member."""
        inner = node.member
        while inner.kind == "array":
            one = F.array(F.lit(None).cast(_type(self.innermost(node))))
            value = F.flatten(F.transform(value, lambda x: F.when(x.isNull() | (F.size(x) == 0), one).otherwise(x)))
            inner = inner.member
        return value

    def empty(self, tag: str, attributes: Column | str) -> list[Column | str]:
        return [f"<{tag}", attributes, "/>"] if self.o.suppress_empty_node else [f"<{tag}", attributes, f"></{tag}>"]

    def element(self, value: Column, node: Node, name: str, uri: str | None, prefix: str, scope: dict, depth: int, always: bool = False) -> Column:
        """Text of an element, never null: '' for an absent one, or with ``always`` the empty element."""
        if depth > self.o.max_depth:
            raise too_deep(self.o.max_depth)
        if node.kind == "array":
            inner = self.innermost(node)
            one = lambda m: self.element(m, inner, name, uri, prefix, scope, depth, True)
            none = one(F.lit(None).cast(_type(inner)))
            members = self.flat(value, node)
            return F.when(value.isNull(), "").when(F.size(value) == 0, none).otherwise(F.array_join(F.transform(members, one), ""))
        if node.kind == "union":  # the member that is there; an absent one writes nothing
            out = F.lit("") if not always else self.element(F.lit(None).cast("string"), Node("scalar"), name, uri, prefix, scope, depth, True)
            for f in reversed(node.fields):
                one = value.getField(f.key)
                out = F.when(one.isNotNull(), self.element(one, f.node, name, uri, prefix, scope, depth, True)).otherwise(out)
            return out
        scope = dict(scope)
        declared = self.declare(uri, prefix, scope)
        tag, before = self.tag(name), self.line(depth) if depth else ""
        if node.kind in ("scalar", "tree"):
            text = self.text(value, node, name)
            if node.kind == "tree":  # a whole element, written by the tree renderer
                return F.coalesce(text, F.lit("") if not always else joined(before, *self.empty(tag, declared)))
            full = joined(before, f"<{tag}{declared}>", escape_text(text), f"</{tag}>")
            nothing = joined(before, *self.empty(tag, declared))
            return F.when(value.isNull(), nothing if always else "").when(text == "", nothing).otherwise(full)
        if node.kind == "map":
            out = self.open_record(value, node, tag, declared, scope, depth, before)
        else:
            out = self.record(value, node, tag, declared, scope, depth, before)
        return F.when(value.isNull(), joined(before, *self.empty(tag, declared)) if always else F.lit("")).otherwise(out)

    def text(self, value: Column, node: Node, name: str) -> Column:
        if node.kind == "tree":
            from ..functions.xml import render_xml

            return render_xml(value, root_name=name, name=self.o.name, xml_version=self.o.xml_version, max_depth=self.o.max_depth, suppress_empty_node=self.o.suppress_empty_node)["value"]
        return scalar_text(value, types(node.type))

    def record(self, value: Column, node: Node, tag: str, declared: str, scope: dict, depth: int, before: str) -> Column:
        fields = node.fields
        if self.o.sort_keys:
            fields = sorted(fields, key=lambda f: f.key.encode("utf-16-be", "surrogatepass"))
        get = lambda f: value.getField(f.key)
        attributes: list[Column | str] = [declared]
        children: list[Column] = []
        present: list[Column] = []
        text: Column | None = None
        for f in fields:
            col = get(f)
            if f.place == "text":
                text = F.coalesce(self.text(col, f.node, f.key), F.lit(""))
            elif f.place == "attribute":
                attributes.append(self.declare(f.uri, f.prefix, scope) if f.uri is not None else "")
                attributes.append(F.coalesce(joined(f' {self.tag(f.wire)}="', escape_attribute(self.text(col, f.node, f.key)), '"'), F.lit("")))
            else:
                children.append(self.element(col, f.node, f.wire, f.uri, f.prefix, scope, depth + 1))
                present.append(col.isNotNull())
        opened = joined(*attributes)
        empty = joined(before, *self.empty(tag, opened))
        if not children:
            return empty if text is None else F.when(text == "", empty).otherwise(joined(before, f"<{tag}", opened, ">", escape_text(text), f"</{tag}>"))
        some = present[0]
        for p in present[1:]:
            some = some | p
        close = joined(self.line(depth), f"</{tag}>")
        if text is None:
            return F.when(some, joined(before, f"<{tag}", opened, ">", *children, close)).otherwise(empty)
        run = F.when(text == "", "").otherwise(joined(self.line(depth + 1), escape_text(text)))
        alone = joined(before, f"<{tag}", opened, ">", escape_text(text), f"</{tag}>")
        return F.when(some, joined(before, f"<{tag}", opened, ">", run, *children, close)).when(text == "", empty).otherwise(alone)

    def open_record(self, value: Column, node: Node, tag: str, declared: str, scope: dict, depth: int, before: str) -> Column:
        """A map: its keys are known at run time only, and so are their kinds and their repair."""
        entries = F.filter(F.map_entries(value), lambda e: e["value"].isNotNull())
        if self.o.sort_keys:
            entries = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        inner = node.member
        legal = lambda col: fnames.resolve_name(col, self.o.name, self.o.xml_version)
        of = lambda keep, write: F.array_join(F.transform(F.filter(entries, lambda e: keep(e["key"])), write), "")
        child = lambda k: ~fnames.is_attribute_key(k) & ~fnames.is_text_key(k)
        mark = "\ue000"  # stands for the name in an element written once for all keys

        def write(e: Column) -> Column:
            body = Encoder(self.plan, RenderOptions(**{**self.o.__dict__, "name": "ignore"})).element(e["value"], inner, mark, None, "", scope, depth + 1, True)
            return F.replace(body, F.lit(mark), legal(e["key"]))

        plain = inner.kind == "scalar"
        attributes = joined(declared, of(fnames.is_attribute_key, lambda e: joined(" ", legal(fnames.attribute_name(e["key"])), '="', escape_attribute(self.text(e["value"], inner, "")), '"'))) if plain else declared
        text = of(fnames.is_text_key, lambda e: self.text(e["value"], inner, "")) if plain else F.lit("")
        children = of(child, write)
        some = F.exists(entries, lambda e: child(e["key"]))
        run = F.when(text == "", "").otherwise(joined(self.line(depth + 1), escape_text(text)))
        return (
            F.when(some, joined(before, f"<{tag}", attributes, ">", run, children, self.line(depth), f"</{tag}>"))
            .when(text == "", joined(before, *self.empty(tag, attributes)))
            .otherwise(joined(before, f"<{tag}", attributes, ">", escape_text(text), f"</{tag}>"))
        )


def _type(node: Node) -> T.DataType:
    if node.kind in ("struct", "union"):
        return T.StructType([T.StructField(f.key, _type(f.node)) for f in node.fields])
    if node.kind == "array":
        return T.ArrayType(_type(node.member))
    if node.kind == "map":
        return T.MapType(T.StringType(), _type(node.member))
    return types(node.type)


__all__ = ["Encoder", "Field", "RenderOptions", "joined"]
