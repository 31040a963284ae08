"""A tolerant, iterative parser: one document to a tree of str, list and dict.

An element is a str if it has neither attributes nor children, else a dict: ``@name`` attributes, ``#text`` trimmed text,
children under their names.  A repeated child becomes a list.  Offsets in errors are UTF-16 code units.
"""

from __future__ import annotations

import re

from .entities import _SPACE, decode_default
from .names import TEXT_KEY, XmlError, resolve_name, utf16_length

_NAME = re.compile(r"[^ \t\n\r/=>]*")
_WHITE = re.compile(r"[ \t\n\r]*")


class XmlParseError(ValueError):
    def __init__(self, message: str, position: int, text: str):
        super().__init__(message)
        self.message, self.position, self.input = message, position, text


class _Parser:
    def __init__(self, text: str, preserve_whitespace: bool, max_depth: int, name: str, xml_version: str):
        self.text, self.at = text, 0
        self.preserve, self.max_depth, self.mode, self.version = preserve_whitespace, max_depth, name, xml_version
        self.names: dict[tuple[str, str], str] = {}

    def fail(self, message: str, at: int | None = None):
        raise XmlParseError(message, utf16_length(self.text[: self.at if at is None else at]), self.text)

    def white(self) -> None:
        self.at = _WHITE.match(self.text, self.at).end()

    def until(self, end: str, what: str) -> str:
        """What stands before ``end``, which is passed over."""
        begin = self.at
        stop = self.text.find(end, begin)
        if stop < 0:
            self.fail(f"Unterminated {what}", begin)
        self.at = stop + len(end)
        return self.text[begin:stop]

    def misc(self) -> None:
        """White space, comments, processing instructions and a document type, in any number."""
        while True:
            self.white()
            if self.text.startswith("<!--", self.at):
                self.at += 4
                self.until("-->", "comment")
            elif self.text.startswith("<?", self.at):
                self.at += 2
                self.until("?>", "processing instruction")
            elif self.text.startswith("<!DOCTYPE", self.at):
                self.doctype()
            else:
                return

    def doctype(self) -> None:
        begin, depth = self.at, 0
        for m in re.compile(r"[\[\]>]").finditer(self.text, begin):
            depth += {"[": 1, "]": -1, ">": 0}[m[0]]
            if m[0] == ">" and depth <= 0:
                self.at = m.end()
                return
        self.fail("Unterminated DOCTYPE declaration", begin)

    def name(self, kind: str) -> str:
        begin = self.at
        raw = _NAME.match(self.text, begin)[0]
        if not raw:
            self.fail(f"Expected a {kind} name")
        self.at += len(raw)
        known = self.names.get((kind, raw))
        if known is None:
            try:
                known = resolve_name(raw, self.mode, self.version)
            except XmlError as e:
                self.fail(f'{kind.capitalize()} "{raw}" is not a legal XML name: {e.message.split(": ", 1)[1]}', begin)
            self.names[kind, raw] = known
        return known

    def start_tag(self) -> tuple[str, dict, bool]:
        """(name, attributes, whether the element is already closed), from after ``<``."""
        name, record = self.name("element"), {}
        while True:
            self.white()
            if self.at >= len(self.text):
                self.fail("Unterminated start tag")
            c = self.text[self.at]
            if c == ">":
                self.at += 1
                return name, record, False
            if c == "/":
                if self.text.startswith("/>", self.at):
                    self.at += 2
                    return name, record, True
            begin = self.at
            key = self.name("attribute")
            self.white()
            if not self.text.startswith("=", self.at):
                self.fail(f'Attribute "{key}" has no "="')
            self.at += 1
            self.white()
            quote = self.text[self.at : self.at + 1]
            if quote not in ("'", '"') or not quote:
                self.fail(f'Attribute "{key}" has no quoted value', begin)
            self.at += 1
            end = self.text.find(quote, self.at)
            if end < 0:
                self.fail(f'Unterminated value for attribute "{key}"')
            record["@" + key] = decode_default(self.text[self.at : end])
            self.at = end + 1

    def document(self) -> tuple[str, object]:
        self.misc()
        if not self.text.startswith("<", self.at):
            self.fail("Document has no root element")
        name, value = self.element()
        self.misc()
        if self.at < len(self.text):
            self.fail("Unexpected content after the root element")
        return name, value

    def element(self) -> tuple[str, object]:
        """The element that begins here, by a stack of open ones: [name, record, runs of text]."""
        text, stack = self.text, []
        while True:
            # At the "<" of a start tag.
            if len(stack) > self.max_depth:
                self.fail(f"Element nesting exceeded maxDepth ({self.max_depth})")
            self.at += 1
            name, record, closed = self.start_tag()
            stack.append((name, record, []))
            while True:
                if closed:
                    name, record, runs = stack.pop()
                    value = self.finish(record, runs)
                    if not stack:
                        return name, value
                    parent = stack[-1][1]
                    if name not in parent:
                        parent[name] = value
                    elif isinstance(parent[name], list):
                        parent[name].append(value)
                    else:
                        parent[name] = [parent[name], value]
                    closed = False
                if self.at >= len(text):
                    self.fail(f"Unclosed element <{stack[-1][0]}>", len(text))
                if text[self.at] != "<":
                    end = text.find("<", self.at)
                    end = len(text) if end < 0 else end
                    stack[-1][2].append(decode_default(text[self.at : end]))
                    self.at = end
                elif text.startswith("</", self.at):
                    self.closing(stack[-1][0])
                    closed = True
                elif text.startswith("<?", self.at):
                    self.at += 2
                    self.until("?>", "processing instruction")
                elif text.startswith("<!--", self.at):
                    self.at += 4
                    self.until("-->", "comment")
                elif text.startswith("<![CDATA[", self.at):
                    begin = self.at
                    end = text.find("]]>", begin + 9)
                    if end < 0:
                        self.fail("Unterminated CDATA section", begin)
                    stack[-1][2].append(text[begin + 9 : end])
                    self.at = end + 3
                elif text.startswith("<!", self.at):
                    self.fail("A declaration is not allowed inside an element")
                else:
                    break

    def closing(self, name: str) -> None:
        begin = self.at
        raw = _NAME.match(self.text, begin + 2)[0]
        if raw != name:
            self.fail(f"Closing tag </{raw}> does not match <{name}>", begin)
        self.at = begin + 2 + len(raw)
        self.white()
        if not self.text.startswith(">", self.at):
            self.fail(f"Malformed closing tag </{raw}>")
        self.at += 1

    def finish(self, record: dict, runs: list[str]) -> object:
        text = "".join(runs)
        if not self.preserve:
            text = text.strip(_SPACE)
        if not record:
            return text
        if text:
            record[TEXT_KEY] = text
        return record


#: One token of a document without comments and the like: text up to a tag, and a whole element of text alone, or a closing
#: tag, or a start tag with its attributes.
_NAMED = r"""[^ \t\n\r/=><!?&"']+"""
_SP = r"[ \t\n\r]"
_TOKEN = re.compile(rf"""([^<]*)<(?:({_NAMED})>([^<]*)</\2{_SP}*>|/({_NAMED}){_SP}*>|({_NAMED})((?:{_SP}+{_NAMED}{_SP}*={_SP}*(?:"[^"]*"|'[^']*'))*){_SP}*(/?)>)""")
_PAIR = re.compile(rf"""({_NAMED}){_SP}*={_SP}*(?:"([^"]*)"|'([^']*)')""")
_DECLARED = re.compile(r"[ \t\n\r]*(?:<\?(?:(?!\?>).)*\?>[ \t\n\r]*)?", re.S)


def _plain_document(text: str, names: dict[str, str], preserve: bool, max_depth: int) -> tuple[str, object] | None:
    """(root name, value) of a document of start tags, closing tags and text alone, whose names are all known.

    Anything else, errors too, gives None: the parser above then reads the document again and tells what is wrong.
    """
    match = _TOKEN.scanner(text, _DECLARED.match(text).end()).match  # each match begins where the last one ended
    stack: list = []
    name, record, runs = "", None, ""
    size = len(text)
    while True:
        m = match()
        if m is None:
            return None
        before, leaf, inner, closing, opening, attributes, alone = m.groups()
        if before:
            runs += decode_default(before) if "&" in before else before
        if leaf is not None and record is not None and len(stack) <= max_depth:
            own = names[leaf]
            if own != leaf:  # a closing tag must say the name as it is read
                return None
            value = decode_default(inner) if "&" in inner else inner
            if not preserve:
                value = value.strip(_SPACE)
            if own not in record:
                record[own] = value
            elif type(record[own]) is list:
                record[own].append(value)
            else:
                record[own] = [record[own], value]
            continue
        if leaf is not None:
            return (leaf, _trimmed(inner, preserve)) if record is None and names[leaf] == leaf and not before.strip(" \t\n\r") and _WHITE.match(text, m.end()).end() == size else None
        if closing is None:
            key = names[opening]
            if key is None:
                return None
            if record is None:
                if before.strip(" \t\n\r"):
                    return None
                runs = ""
            stack.append((name, record, runs))
            if len(stack) > max_depth + 1:
                return None
            name, record, runs = key, {}, ""
            if attributes:
                for label, double, single in _PAIR.findall(attributes):
                    key = names[label]
                    if key is None:
                        return None
                    value = double or single
                    record["@" + key] = decode_default(value) if "&" in value else value
            if not alone:
                continue
        elif closing != name:
            return None
        # The element ends here.
        if not preserve:
            runs = runs.strip(_SPACE)
        if not record:
            value = runs
        else:
            if runs:
                record[TEXT_KEY] = runs
            value = record
        own = name
        name, record, runs = stack.pop()
        if record is None:
            return (own, value) if _WHITE.match(text, m.end()).end() == size else None
        if own not in record:
            record[own] = value
        elif type(record[own]) is list:
            record[own].append(value)
        else:
            record[own] = [record[own], value]


def _trimmed(text: str, preserve: bool) -> str:
    text = decode_default(text)
    return text if preserve else text.strip(_SPACE)


class _Names(dict):
    """Names as they are resolved, None where they are illegal; forgets all when there are many."""

    def __init__(self, mode: str, version: str):
        super().__init__()
        self.mode, self.version = mode, version

    def __missing__(self, raw: str) -> str | None:
        try:
            known = resolve_name(raw, self.mode, self.version)
        except XmlError:
            return None
        if len(self) > 10_000:
            self.clear()
        self[raw] = known
        return known


_KNOWN: dict[tuple[str, str], _Names] = {}


def parse_document(text: str, preserve_whitespace: bool = False, max_depth: int = 256, name: str = "repair", xml_version: str = "1.0") -> tuple[str, object]:
    """(root name, value)."""
    names = _KNOWN.get((name, xml_version)) or _KNOWN.setdefault((name, xml_version), _Names(name, xml_version))
    found = _plain_document(text, names, preserve_whitespace, max_depth)
    return found if found is not None else _Parser(text, preserve_whitespace, max_depth, name, xml_version).document()


def parse_xml(text: str, **options) -> object:
    return parse_document(text, **options)[1]
