from __future__ import annotations

import pytest

from xmlframe import XmlParseError, XmlRenderError
from xmlframe.core.parser import parse_document, parse_xml
from xmlframe.core.render import is_xml_value, render_xml

VALUES = [
    ("<r/>", ""),
    ("<r><a/></r>", {"a": ""}),
    ("<r a='1'/>", {"@a": "1"}),
    ('<r 1a="x"/>', {"@_1a": "x"}),
    ("<r>a &lt; b &amp; &#65;&#x42;</r>", "a < b & AB"),
    ("<a>Smith & Jones</a>", "Smith & Jones"),
    ("<r>a<!-- c -->b<?pi x?>c</r>", "abc"),
    ("<r><![CDATA[<&amp;>]]></r>", "<&amp;>"),
    ("<r>  x  </r>", "x"),
    ("<r>&#160;x</r>", "x"),
    ("<r>a<b/>c</r>", {"b": "", "#text": "ac"}),
    ("<r><a>1</a><b/><a>2</a></r>", {"a": ["1", "2"], "b": ""}),
    ('<?xml version="1.0"?><!DOCTYPE r [<!ENTITY x "y">]><!-- c --><r>&x;</r> ', "&x;"),
    ("<r><constructor/><__proto__/></r>", {"constructor": "", "__proto__": ""}),
    ('<r a="1" a="2"/>', {"@a": "2"}),
    ('<r a="x"b="y"/>', {"@a": "x", "@b": "y"}),
]
ERRORS = [
    ("", "Document has no root element", 0),
    ("x", "Document has no root element", 0),
    ("<r/><r/>", "Unexpected content after the root element", 4),
    ("<!-- x", "Unterminated comment", 4),
    ("<?x", "Unterminated processing instruction", 2),
    ("<!DOCTYPE r [", "Unterminated DOCTYPE declaration", 0),
    ("<>", "Expected a element name", 1),
    ("<r ", "Unterminated start tag", 3),
    ("<r a>", 'Attribute "a" has no "="', 4),
    ("<r a=1>", 'Attribute "a" has no quoted value', 3),
    ('<r a="1>', 'Unterminated value for attribute "a"', 6),
    ("<r><a>", "Unclosed element <a>", 6),
    ("<r><a>1</b></r>", "Closing tag </b> does not match <a>", 7),
    ("<r></r x>", "Malformed closing tag </r>", 7),
    ("<r><![CDATA[x</r>", "Unterminated CDATA section", 3),
    ("<r><!ELEMENT x></r>", "A declaration is not allowed inside an element", 3),
    ("<1a>x</1a>", "Closing tag </1a> does not match <_1a>", 5),
    ("<r>😀</a></r>", "Closing tag </a> does not match <r>", 5),
]


@pytest.mark.parametrize(("text", "value"), VALUES)
def test_values(text, value):
    assert parse_xml(text) == value


@pytest.mark.parametrize(("text", "message", "position"), ERRORS)
def test_errors(text, message, position):
    with pytest.raises(XmlParseError) as e:
        parse_xml(text)
    assert (e.value.message, e.value.position, e.value.input) == (message, position, text)


def test_depth():
    assert parse_document("<a>" * 4 + "</a>" * 4, max_depth=3)
    with pytest.raises(XmlParseError, match=r"Element nesting exceeded maxDepth \(3\)"):
        parse_document("<a>" * 5 + "</a>" * 5, max_depth=3)


def test_names_in_error_mode():
    with pytest.raises(XmlParseError, match='Element "1a" is not a legal XML name: '):
        parse_document("<1a/>", name="error")
    with pytest.raises(XmlParseError, match='Attribute "1a" is not a legal XML name: '):
        parse_document('<a 1a="x"/>', name="error")


RENDERED = [
    ("x", {}, "<root>x</root>"),
    ("", {}, "<root/>"),
    ("", {"suppress_empty_node": False}, "<root></root>"),
    (["a", "b"], {}, "<root><item>a</item><item>b</item></root>"),
    ([], {}, "<root></root>"),
    ({"a": []}, {}, "<root><a/></root>"),
    ({"a": ["1", ["2", "3"]]}, {}, "<root><a>1</a><a>2</a><a>3</a></root>"),
    ({"@id": "1"}, {}, '<root id="1"/>'),
    ({"b": "1", "@id": "x\n", "#text": "t"}, {}, '<root id="x&#10;">t<b>1</b></root>'),
    ({"b": "1", "a": "2"}, {"sort_keys": True}, "<root><a>2</a><b>1</b></root>"),
    ({"a": None, "b": "&<>\"'"}, {}, "<root><b>&amp;&lt;&gt;&quot;&apos;</b></root>"),
    ({"not a name": "x"}, {}, "<root><not_a_name>x</not_a_name></root>"),
    ({"a": {"b": "x"}, "#text": "t"}, {"format": True}, "<root>\n  t\n  <a>\n    <b>x</b>\n  </a>\n</root>\n"),
    (["a"], {"format": True}, "<root>\n  <item>a</item>\n</root>\n"),
    ({"n": 1.0, "t": True}, {}, "<root><n>1</n><t>true</t></root>"),
]


@pytest.mark.parametrize(("value", "options", "text"), RENDERED)
def test_rendering(value, options, text):
    assert render_xml(value, **options) == text


def test_render_errors():
    with pytest.raises(XmlRenderError, match="Invalid XML name"):
        render_xml({"a b": ""}, name="error")
    with pytest.raises(XmlRenderError, match=r"XML nesting exceeded maxDepth \(1\). Raise the limit if the document is legitimately this deep."):
        render_xml({"a": {"b": {"c": ""}}}, max_depth=1)


@pytest.mark.parametrize("text", [t for t, _ in VALUES])
@pytest.mark.parametrize("format", [False, True])
def test_fixed_point(text, format):
    name, value = parse_document(text)
    once = render_xml(value, root_name=name, format=format)
    assert parse_document(once) == (name, value)


def test_is_xml_value():
    deep = "x"
    for _ in range(600):
        deep = [deep]
    assert is_xml_value({"a": ["b", {}]}) and not is_xml_value({"a": 1}) and not is_xml_value(deep)


PIECES = ["<a>", "</a>", '<b x="1">', "</b>", "<c/>", "<c y='2' z = \"3\"/>", " text ", "&amp;", "&#65;", "&x;", "<!-- c -->", "<![CDATA[q]]>", "<?pi?>", "<1a/>", "<a b>", "<", ">", "\n", "<a:b>", "</a:b>", '<a x="1" x="2"/>', '<a x="<">', "</a >", "<constructor/>", "<@a/>", "<#text/>", '<a @b="1"/>']


def test_short_way_reads_what_the_parser_reads():
    import random

    from xmlframe.core.parser import _Parser

    def read(f):
        try:
            return f()
        except XmlParseError as e:
            return e.message, e.position

    draw = random.Random(1)
    for _ in range(20_000):
        text = draw.choice(["", '<?xml version="1.0"?>\n', "<!DOCTYPE r>", "  "]) + "<r>" + "".join(draw.choices(PIECES, k=draw.randint(0, 6))) + "</r>" + draw.choice(["", "\n", "x"])
        preserve, depth, name = draw.random() < 0.3, draw.choice([0, 1, 2, 256]), draw.choice(["repair", "error", "ignore"])
        assert read(lambda: parse_document(text, preserve, depth, name)) == read(lambda: _Parser(text, preserve, depth, name, "1.0").document()), text


def test_long_batches_are_taken_in_pieces(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from xmlframe import XmlCodec
    from xmlframe.functions.xml import PIECE, by_row, decode_entities_result, parse_xml, pieces

    texts = pa.array(["x" * (PIECE // 4)] * 10 + [None, "", "y" * (3 * PIECE)] + ["z"] * 1000)
    found = [some for (some,) in pieces(texts)]
    assert pa.concat_arrays(found).equals(texts)
    assert all(len(some) == 1 or some.nbytes <= PIECE for some in found)
    assert [len(a) == len(b) for a, b in pieces(texts, pa.array(range(len(texts))))].count(False) == 0
    assert list(pieces(texts.slice(0, 0))) == []

    # The first results are given back before the batch is read to its end.
    given = by_row(lambda text: {"value": text}, T._parse_datatype_string("value string")).func(iter([texts]))
    assert len(next(given)) < 10 and sum(map(len, given)) > 1000

    rows = spark.range(300, numPartitions=1).select("id", F.concat(F.lit("<a>"), F.repeat(F.lit("b"), 20_000), F.col("id"), F.lit("</a>")).alias("x"))
    codec = XmlCodec("string", "a")
    parsed = rows.select("id", parse_xml("x")["value"].alias("p"), codec.decode("x")["value"].alias("d"), decode_entities_result("x")["value"].alias("e"), "x")
    good = [F.sum(F.col(c).endswith(F.concat(F.lit("b"), F.col("id"), F.lit(end))).cast("int")) for c, end in (("p", '"'), ("d", ""), ("e", "</a>"))]
    assert list(parsed.agg(*good, F.sum((F.col("e") == F.col("x")).cast("int"))).first()) == [300] * 4
