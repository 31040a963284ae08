from __future__ import annotations

import pytest

from xmlframe import EntityDecoder, XmlError

DECODED = [
    ({}, "&lt;&gt;&amp;&quot;&apos;", "<>&\"'"),
    ({}, "&eacute; & &;", "&eacute; & &;"),
    ({}, "&amp;lt;", "&lt;"),
    ({}, "&#65;&#x42;&#X43;", "ABC"),
    ({}, "&# 65;&#+65;&#65x;&#0065;", "AAAA"),
    ({}, "&#0x41;", ""),
    ({}, "&#x;&#-1;&#x110000;", "&#x;&#-1;&#x110000;"),
    ({}, "&#0;&#xD800;&#1;&#9;", "\t"),
    ({"xml_version": 1.1}, "&#1;", "\x01"),
    ({"numeric_allowed": False}, "&#65;&#0;", "&#65;"),
    ({"on_ncr": "leave"}, "&#65;", "&#65;"),
    ({"on_ncr": "remove"}, "a&#65;b", "ab"),
    ({"remove": ("lt", "#38")}, "a&lt;&#38;b", "ab"),
    ({"leave": ("lt",)}, "&lt;&gt;", "&lt;>"),
    ({"named_entities": {"x": "1", "y": {"regex": "z", "val": "2"}, "f": len, "amp": "AND"}}, "&x;&y;&f;&amp;", "12&f;AND"),
    ({"named_entities": {"n" * 32: "1", "n" * 33: "2"}}, f"&{'n' * 32};&{'n' * 33};", f"1&{'n' * 33};"),
    ({"named_entities": {"constructor": "c"}}, "&constructor;&toString;", "c&toString;"),
    ({"post_check": lambda out, _: out.upper()}, "a&lt;", "A<"),
    ({"post_check": lambda out, _: out.upper()}, "a", "a"),
]


@pytest.mark.parametrize(("options", "text", "want"), DECODED)
def test_decode(options, text, want):
    assert EntityDecoder.make(options).decode(text) == want


def test_missing_options():
    with pytest.raises(XmlError, match="options is required") as e:
        EntityDecoder.make(None)
    assert e.value.tag == "MissingOptions"


def test_limits_and_tiers():
    d = EntityDecoder(max_total_expansions=2)
    d.set_external_entities({"e": "x"})
    assert d.decode("&e;&e;&lt;&lt;&lt;") == "xx<<<"
    with pytest.raises(XmlError, match=r"\[EntityReplacer\] Entity expansion count limit exceeded: 3 > 2"):
        d.decode("&e;")
    d.reset()
    assert d.decode("&e;") == "x"
    grown = EntityDecoder(max_expanded_length=5, apply_limits_to="all", named_entities={"big": "x" * 20})
    with pytest.raises(XmlError, match=r"\[EntityReplacer\] Expanded content length limit exceeded: 15 > 5"):
        grown.decode("&big;")
    assert EntityDecoder(max_total_expansions=1, apply_limits_to=()).decode("&lt;&lt;") == "<<"
    with pytest.raises(XmlError):
        EntityDecoder(max_total_expansions=1, remove=("lt",)).decode("&lt;&lt;")


def test_registration():
    d = EntityDecoder(on_external_entity=lambda n, v: "block" if n == "b" else "throw" if n == "t" else "allow")
    d.set_external_entities({"a": "1", "b": "2"})
    assert d.decode("&a;&b;") == "1&b;"
    with pytest.raises(XmlError, match=r'\[EntityDecoder\] Registration of external entity "&t;" was rejected by hook'):
        d.set_external_entities({"t": "3"})
    assert d.decode("&a;") == "1"
    with pytest.raises(XmlError, match="Invalid character '#' in entity name: \"#a\""):
        d.set_external_entities({"#a": "x"})
    d.add_external_entity("c", "has & in it")
    d.add_external_entity("d", "4")
    assert d.decode("&c;&d;") == "&c;4"
    d.add_input_entities({"a": "mine"})
    assert d.decode("&a;") == "mine"
    with pytest.raises(XmlError, match=r"Prohibited numeric character reference &#0; \(U\+0000\)"):
        EntityDecoder(null_ncr="throw").decode("&#0;")


def test_usual_references_by_the_short_way():
    import random

    from xmlframe.core.entities import decode_default

    pieces = ["&amp;", "&lt;", "&#65;", "&#x41;", "&#0;", "&#xD800;", "&#65", "&#", ";", "&", "lt;", "x", "&#x;", "&#65abc;", "& #65;", "&copy;", "&#9999999;", "&#x110000;", "&#1;", "&#00000065;", "&x&lt;"]
    draw, plain = random.Random(2), EntityDecoder()
    for _ in range(20_000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 7)))
        assert decode_default(text) == plain.decode(text)
