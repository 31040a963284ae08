"""A tree of str, list and dict to XML text; also JSON text to such a tree."""

from __future__ import annotations

import json

from .names import DEFAULT_ITEM_NAME, DEFAULT_ROOT_NAME, TEXT_KEY, XmlError, attribute_name, is_attribute_key, resolve_name

# What is escaped.
TEXT_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}
ATTRIBUTE_ESCAPES = TEXT_ESCAPES | {"\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}
_TEXT, _ATTRIBUTE = str.maketrans(TEXT_ESCAPES), str.maketrans(ATTRIBUTE_ESCAPES)
#: Nesting beyond which a value is not a tree.
DEEPEST_VALUE = 512


class XmlRenderError(ValueError):
    def __init__(self, message: str):
        super().__init__(message)
        self.message = message


def too_deep(max_depth: int) -> XmlRenderError:
    return XmlRenderError(f"XML nesting exceeded maxDepth ({max_depth}). Raise the limit if the document is legitimately this deep.")


def escape_text(text: str) -> str:
    return text.translate(_TEXT)


def escape_attribute(text: str) -> str:
    return text.translate(_ATTRIBUTE)


def as_text(value: object) -> str:
    """Character data of a value that is no string: its JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        value = int(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class Renderer:
    def __init__(self, root_name: str = DEFAULT_ROOT_NAME, item_name: str = DEFAULT_ITEM_NAME, format: bool = False, indent: str = "  ", suppress_empty_node: bool = True, sort_keys: bool = False, name: str = "repair", xml_version: str = "1.0", max_depth: int = 256):
        self.root, self.item, self.format, self.indent = root_name, item_name, format, indent
        self.short, self.sorted, self.mode, self.version, self.max_depth = suppress_empty_node, sort_keys, name, xml_version, max_depth

    def tag(self, name: str) -> str:
        try:
            return resolve_name(name, self.mode, self.version)
        except XmlError as e:
            raise XmlRenderError(e.message) from None

    def document(self, value: object) -> str:
        out: list[str] = []
        if isinstance(value, list):
            tag = self.tag(self.root)
            out.append(f"<{tag}>")
            for member in value:
                self.element(out, self.item, member, 1)
            out.append(f"{chr(10) if self.format else ''}</{tag}>")
        else:
            self.element(out, self.root, value, 0)
        return "".join(out) + "\n" * self.format

    def line(self, depth: int) -> str:
        return "\n" + self.indent * depth if self.format else ""

    def element(self, out: list[str], name: str, value: object, depth: int) -> None:
        if depth > self.max_depth:
            raise too_deep(self.max_depth)
        if isinstance(value, list):
            members = list(flat(value))
            for member in members or [""]:
                self.element(out, name, member, depth)
            return
        out.append(self.line(depth) if depth else "")
        tag = self.tag(name)
        if not isinstance(value, dict):
            text = "" if value is None else as_text(value)
            out.append(f"<{tag}>{escape_text(text)}</{tag}>" if text else self.empty(tag, ""))
            return
        keys = [k for k, v in value.items() if v is not None]
        if self.sorted:
            keys.sort(key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        attributes = "".join(f' {self.tag(attribute_name(k))}="{escape_attribute(as_text(value[k]))}"' for k in keys if is_attribute_key(k))
        children = [k for k in keys if not is_attribute_key(k) and k != TEXT_KEY]
        text = "" if value.get(TEXT_KEY) is None else as_text(value[TEXT_KEY])
        if not children and not text:
            out.append(self.empty(tag, attributes))
            return
        out.append(f"<{tag}{attributes}>")
        if text:
            out += (self.line(depth + 1) if children else "", escape_text(text))
        for k in children:
            self.element(out, k, value[k], depth + 1)
        out += (self.line(depth) if children else "", f"</{tag}>")

    def empty(self, tag: str, attributes: str) -> str:
        return f"<{tag}{attributes}/>" if self.short else f"<{tag}{attributes}></{tag}>"


def flat(members: list):
    for m in members:
        if isinstance(m, list):
            yield from flat(m)
        else:
            yield m


def render_xml(value: object, **options) -> str:
    return Renderer(**options).document(value)


def is_xml_value(value: object) -> bool:
    """Whether a value is a tree of strings, lists and records, not nested too deep.  Absent (None) fields are for JSON null
    refused, as only absence itself is allowed."""
    todo = [(value, 0)]
    while todo:
        v, depth = todo.pop()
        if depth > DEEPEST_VALUE or not isinstance(v, (str, list, dict)):
            return False
        todo += ((x, depth + 1) for x in (v if isinstance(v, list) else v.values() if isinstance(v, dict) else ()))
    return True
