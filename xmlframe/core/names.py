"""XML names: productions, diagnosis, repair.  One table of code points makes the Python and the Java patterns."""

from __future__ import annotations

import functools
import re

# Code point ranges of the XML productions.
START_10 = ":A-Z_a-z", [(0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2FF), (0x370, 0x37D), (0x37F, 0x486), (0x488, 0x1FFF), (0x200C, 0x200D), (0x2070, 0x218F), (0x2C00, 0x2FEF), (0x3001, 0xD7FF), (0xF900, 0xFDCF), (0xFDF0, 0xFFFD)]
START_11 = ":A-Z_a-z", [(0xC0, 0x2FF), (0x370, 0x37D), (0x37F, 0x486), (0x488, 0x1FFF), (0x200C, 0x200D), (0x2070, 0x218F), (0x2C00, 0x2FEF), (0x3001, 0xD7FF), (0xF900, 0xFDCF), (0xFDF0, 0xFFFD), (0x10000, 0xEFFFF)]
MORE_10 = "\\-.0-9", [(0xB7, 0xB7), (0x300, 0x36F), (0x203F, 0x2040)]
MORE_11 = "\\-.0-9", [(0xB7, 0xB7), (0x300, 0x36F), (0x487, 0x487), (0x203F, 0x2040)]
#: What trimming removes and what separates tokens.
SPACE = [(0x9, 0xD), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
#: Characters that the sanitizer keeps, and those that the diagnosis takes for name characters.
KEPT = "A-Za-z0-9_\\-.:", [(0xB7, 0xB7), (0xC0, 0xFFFD), (0x10000, 0x10FFFF)]
KEPT_ASCII = "A-Za-z0-9_\\-.:", []

PRODUCTIONS = ("name", "ncName", "qName", "nmToken", "nmTokens")
ATTRIBUTE_PREFIX, TEXT_KEY, DEFAULT_ROOT_NAME, DEFAULT_ITEM_NAME = "@", "#text", "root", "item"


class XmlError(ValueError):
    """An error with a reason tag; further facts are attributes in ``facts``."""

    def __init__(self, tag: str, message: str, **facts):
        super().__init__(message)
        self.tag, self.message, self.facts = tag, message, facts


def ranges(table: list[tuple[int, int]], java: bool) -> str:
    one = (lambda c: f"\\x{{{c:X}}}") if java else (lambda c: f"\\U{c:08x}")
    return "".join(one(a) if a == b else f"{one(a)}-{one(b)}" for a, b in table)


def class_of(part: tuple[str, list], java: bool) -> str:
    return part[0] + ranges(part[1], java)


def character_classes(xml_version: str = "1.0", ascii_only: bool = False, java: bool = False) -> tuple[str, str]:
    """(start characters, name characters), as the inside of a class, with the colon first."""
    if ascii_only:
        return ":A-Z_a-z", ":A-Z_a-z\\-.0-9"
    start, more = (START_11, MORE_11) if xml_version == "1.1" else (START_10, MORE_10)
    return class_of(start, java), class_of(start, java) + class_of(more, java)


def pattern(production: str, xml_version: str = "1.0", ascii_only: bool = False, java: bool = False) -> str:
    """The production as a pattern for a whole string, without anchors."""
    check_production(production)
    s, c = character_classes(xml_version, ascii_only, java)
    ns, nc = s[1:], c[1:]
    space = ranges(SPACE, java)
    return {
        "name": f"[{s}][{c}]*",
        "ncName": f"[{ns}][{nc}]*",
        "qName": f"[{ns}][{nc}]*(?::[{ns}][{nc}]*)?",
        "nmToken": f"[{c}]+",
        "nmTokens": f"[{c}]+(?:[{space}]+[{c}]+)*",
    }[production]


def check_production(production: str) -> None:
    if production not in PRODUCTIONS:
        raise XmlError("InvalidProduction", f'Unknown production "{production}". Must be one of: {", ".join(PRODUCTIONS)}', production=production, expected=list(PRODUCTIONS))


@functools.lru_cache(maxsize=64)
def compiled(production: str, xml_version: str = "1.0", ascii_only: bool = False) -> re.Pattern:
    return re.compile(pattern(production, xml_version, ascii_only))


def is_valid(text: str, production: str, xml_version: str = "1.0", ascii_only: bool = False) -> bool:
    return compiled(production, xml_version, ascii_only).fullmatch(text) is not None


def utf16_length(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def diagnose(text: str, production: str, ascii_only: bool = False) -> tuple[str, int | None]:
    """(reason, position) of a text that is not valid."""
    if not text:
        return "Input is empty", None
    if production == "ncName" and ":" in text:
        return "Colon is not allowed in NCName", utf16_length(text[: text.index(":")])
    if production == "qName":
        if text[0] == ":":
            return "QName cannot start with a colon", 0
        if text[-1] == ":":
            return "QName cannot end with a colon", utf16_length(text) - 1
        if text.count(":") > 1:
            return "QName can have at most one colon", utf16_length(text[: text.rindex(":")])
    start, more = (r"[:A-Za-z_]", r"[A-Za-z0-9_\\\-.:]") if ascii_only else ("[:A-Za-z_\xc0-\ufffd\U00010000-\U0010ffff]", "[A-Za-z0-9_\\\\\\-.:\xb7\xc0-\ufffd\U00010000-\U0010ffff]")
    if production in ("name", "ncName", "qName") and not re.match(start, text):
        return f'First character "{text[0]}" is not a valid NameStartChar', 0
    for i, c in enumerate(text):
        if not re.match(more, c):
            at = utf16_length(text[:i])
            return f'Character "{c}" at position {at} is not a valid NameChar', at
    return "Does not match the production rules", None


def validate(text: str, production: str, xml_version: str = "1.0", ascii_only: bool = False) -> dict:
    if is_valid(text, production, xml_version, ascii_only):
        return {"valid": True, "production": production, "input": text, "reason": None, "position": None}
    reason, position = diagnose(text, production, ascii_only)
    return {"valid": False, "production": production, "input": text, "reason": reason, "position": position}


def sanitize(text: str, production: str = "name", replacement: str = "_", ascii_only: bool = False) -> str:
    """A legal name close to ``text``."""
    check_production(production)
    if not text:
        return replacement
    if production == "ncName":
        text = text.replace(":", "")
    text = re.sub(f"[^{class_of(KEPT_ASCII if ascii_only else KEPT, False)}]", lambda _: replacement, text)
    if production not in ("nmToken", "nmTokens") and re.match(r"[\-.0-9]", text):
        text = replacement + text
    return text or replacement


@functools.lru_cache(maxsize=4096)
def resolve_name(name: str, mode: str = "repair", xml_version: str = "1.0") -> str:
    """The name to write: as it is if legal or ignored, repaired, or an error."""
    if mode == "ignore" or is_valid(name, "qName", xml_version):
        return name
    if mode == "error":
        raise XmlError("InvalidName", f"Invalid XML name {quoted(name)}: {diagnose(name, 'qName')[0]}", name=name)
    return sanitize(name)


def quoted(text: str) -> str:
    import json

    return json.dumps(text, ensure_ascii=False)


def is_attribute_key(key: str) -> bool:
    return len(key) > 1 and key[0] == ATTRIBUTE_PREFIX


def attribute_name(key: str) -> str:
    return key[1:]


def is_text_key(key: str) -> bool:
    return key == TEXT_KEY


is_reserved_key = is_text_key
