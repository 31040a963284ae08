"""Entity references to text: five built-in entities, named tiers, numeric references under a policy, expansion limits."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from .names import SPACE, XmlError, utf16_length

# The predefined entities, and characters that names registered from outside cannot hold.
PREDEFINED = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "quot": '"'}
FORBIDDEN = "!?\\/[]$%{}^&*()<>|+"
LEVELS = {"allow": 0, "leave": 1, "remove": 2, "throw": 3}
LONGEST_TOKEN = 32
ENTITY_ACTION = {"ALLOW": "allow", "BLOCK": "block", "THROW": "throw"}

_SPACE = "".join(chr(c) for a, b in SPACE for c in range(a, b + 1))
_TOKEN = re.compile(r"&([^;]{1,%d});" % LONGEST_TOKEN, re.S)


def leading_number(text: str, base: int) -> int | None:
    """The number that a text begins with, what follows it ignored; None without a digit."""
    m = re.match(r"([+-]?)(?:0[xX](?=[0-9a-fA-F]))?([0-9a-fA-F]+)" if base == 16 else r"([+-]?)([0-9]+)", text.lstrip(_SPACE), re.ASCII)
    return None if m is None else int(m[2], base) * (-1 if m[1] == "-" else 1)


def plain_values(entities: Mapping) -> dict[str, str]:
    """Entities with a usable value: text, or a mapping with ``val``; others are left out."""
    out = {}
    for name, value in (entities or {}).items():
        if isinstance(value, Mapping) and ("regex" in value or "regx" in value):
            value = value.get("val")
        if isinstance(value, str):
            out[name] = value
    return out


def check_entity_name(name: str) -> None:
    bad = "#" if name[:1] == "#" else next((c for c in name if c in FORBIDDEN), None)
    if bad:
        raise XmlError("InvalidEntityName", f"[EntityReplacer] Invalid character '{bad}' in entity name: \"{name}\"", name=name, character=bad)


class EntityDecoder:
    """Decodes references in one pass; what they expand to is not read again.

    The counters of ``max_total_expansions`` and ``max_expanded_length`` run on over calls until ``reset``; zero is no limit.
    """

    def __init__(
        self,
        named_entities: Mapping | None = None,
        numeric_allowed: bool = True,
        on_ncr: str = "allow",
        null_ncr: str = "remove",
        xml_version: str | float = "1.0",
        remove: tuple[str, ...] = (),
        leave: tuple[str, ...] = (),
        max_total_expansions: int = 0,
        max_expanded_length: int = 0,
        apply_limits_to: str | tuple[str, ...] = "external",
        post_check: Callable[[str, str], str] | None = None,
        on_external_entity: Callable[[str, str], str] | None = None,
        on_input_entity: Callable[[str, str], str] | None = None,
    ):
        self.base = PREDEFINED | plain_values(named_entities or {})
        self.numeric_allowed, self.on_ncr = numeric_allowed, LEVELS.get(on_ncr, 0)
        self.null_ncr = max(LEVELS.get(null_ncr, 2), LEVELS["remove"])
        self.removed, self.left = frozenset(remove), frozenset(leave)
        self.most, self.longest = max_total_expansions or 0, max_expanded_length or 0
        if isinstance(apply_limits_to, str):
            apply_limits_to = (apply_limits_to if apply_limits_to in ("external", "base", "all") else "external",)
        self.tiers = frozenset(apply_limits_to)
        self.post_check, self.on_external, self.on_input = post_check, on_external_entity, on_input_entity
        self.external: dict[str, str] = {}
        self.input: dict[str, str] = {}
        self.count = self.grown = 0
        self.set_xml_version(xml_version)

    @classmethod
    def make(cls, options: Mapping | None) -> EntityDecoder:
        if options is None:
            raise XmlError("MissingOptions", "EntityDecoder.make: options is required. Use make({}) for a decoder with every default.", parameter="options")
        return cls(**options)

    def set_xml_version(self, version: str | float) -> None:
        self.version = "1.1" if version in (1.1, "1.1") else "1.0"

    def reset(self) -> None:
        self.input, self.count, self.grown = {}, 0, 0

    def _registered(self, entities: Mapping, hook: Callable | None, context: str) -> dict[str, str]:
        out = {}
        for name, value in plain_values(entities).items():
            action = hook(name, value) if hook else "allow"
            if action == "throw":
                raise XmlError("EntityRejected", f'[EntityDecoder] Registration of {context} entity "&{name};" was rejected by hook', name=name, context=context)
            if action != "block":
                out[name] = value
        return out

    def set_external_entities(self, entities: Mapping | None) -> None:
        for name in entities or {}:
            check_entity_name(name)
        self.external = self._registered(entities or {}, self.on_external, "external")

    def add_external_entity(self, name: str, value: str) -> None:
        check_entity_name(name)
        if isinstance(value, str) and "&" not in value:
            self.external |= self._registered({name: value}, self.on_external, "external")

    def add_input_entities(self, entities: Mapping | None) -> None:
        self.count = self.grown = 0
        self.input = self._registered(entities or {}, self.on_input, "input")

    def decode(self, text: str) -> str:
        if not isinstance(text, str) or "&" not in text:
            return text
        out, at = [], 0
        while (amp := text.find("&", at)) >= 0:
            m = _TOKEN.match(text, amp)
            found = self._resolve(m[1]) if m else None
            if found is None:
                out.append(text[at : amp + 1])
                at = amp + 1
                continue
            value, tier = found
            self._charge(m[1], value, tier)
            out += (text[at:amp], value)
            at = m.end()
        out.append(text[at:])
        whole = "".join(out)
        return self.post_check(whole, text) if self.post_check else whole

    def _resolve(self, token: str) -> tuple[str, str] | None:
        if token in self.removed:
            return "", "external"
        if token in self.left:
            return None
        if token[0] == "#":
            character = self._numeric(token)
            return None if character is None else (character, "base")
        for entities, tier in ((self.input, "external"), (self.external, "external"), (self.base, "base")):
            if token in entities:
                return entities[token], tier
        return None

    def _numeric(self, token: str) -> str | None:
        point = leading_number(token[2:], 16) if token[1:2] in ("x", "X") else leading_number(token[1:], 10)
        if point is None or point < 0 or point > 0x10FFFF:
            return None
        least = -1
        if point == 0:
            least = self.null_ncr
        elif 0xD800 <= point <= 0xDFFF or self.version == "1.0" and point < 32 and point not in (9, 10, 13):
            least = LEVELS["remove"]
        if not self.numeric_allowed and least < LEVELS["remove"]:
            return None
        level = max(self.on_ncr, least)
        if level == LEVELS["throw"]:
            raise XmlError("ProhibitedCharacterReference", f"[EntityDecoder] Prohibited numeric character reference &{token}; (U+{point:04X})", token=token, codepoint=point)
        return {0: chr(point) if level == 0 else "", 1: None, 2: ""}[level]

    def _charge(self, token: str, value: str, tier: str) -> None:
        if self.most <= 0 and self.longest <= 0 or "all" not in self.tiers and tier not in self.tiers:
            return
        if self.most > 0:
            self.count += 1
            if self.count > self.most:
                raise XmlError("ExpansionLimitExceeded", f"[EntityReplacer] Entity expansion count limit exceeded: {self.count} > {self.most}", actual=self.count, limit=self.most)
        if self.longest > 0 and (more := utf16_length(value) - utf16_length(token) - 2) > 0:
            self.grown += more
            if self.grown > self.longest:
                raise XmlError("ExpandedLengthLimitExceeded", f"[EntityReplacer] Expanded content length limit exceeded: {self.grown} > {self.longest}", actual=self.grown, limit=self.longest)


_DEFAULT = EntityDecoder()
#: What the default decoder may know: a built-in entity, or a numeric reference.
_USUAL = re.compile(r"&(amp|apos|gt|lt|quot|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});")


def decode_default(text: str) -> str:
    """The parser's decoding: built-in entities and numeric references, anything else left as it is."""
    if "&" not in text:
        return text
    if text.count("&#") == len(_PLAIN_NUMBER.findall(text)):
        return _USUAL.sub(_usual, text)
    return _DEFAULT.decode(text)


#: A numeric reference in its usual form; others are left to the decoder, which reads more forms.
_PLAIN_NUMBER = re.compile(r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});")


def _usual(m: re.Match) -> str:
    known = PREDEFINED.get(m[1])
    if known is None:
        known = _DEFAULT._numeric(m[1])
    return m[0] if known is None else known
