"""Queries over written-out cases: what the driver's tables do not hold, with the expected rows as literal tables in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import functions as X
from .core.entities import EntityDecoder
from .core.names import XmlError
from .operators import XmlCodec
from .plans.schema import field
from .queries import fields, query, table


def literal(value: object, kind: str) -> str:
    """A value in SQL."""
    if value is None:
        return f"CAST(NULL AS {kind})"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL of a literal table; ``columns`` are ``name TYPE`` parts, the first one numbers the rows."""
    named = [c.split() for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join([str(i), *(literal(v, k) for v, (_, k) in zip(row, named))]) + ")" for i, row in enumerate(rows))
    cast = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in named)
    return f"SELECT CAST(i AS INTEGER) AS i, {cast} FROM (VALUES {values}) AS t(i, {', '.join(n for n, _ in named)})"


def numbered(spark: SparkSession, texts: list[str], first: int = 0) -> DataFrame:
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "i int, text string")


def each(spark: SparkSession, cases: list[tuple], options: Callable[[tuple], object], run: Callable[[DataFrame, tuple], DataFrame]) -> DataFrame:
    """``run`` over the texts of neighbouring cases with the same options, all in one frame."""
    out, at = None, 0
    while at < len(cases):
        end = at + 1
        while end < len(cases) and options(cases[end]) == options(cases[at]):
            end += 1
        some = run(numbered(spark, [c[1] for c in cases[at:end]], at), cases[at])
        out, at = some if out is None else out.unionByName(some), end
    return out


# The parser: (options, document, root, value, message, position; no position is -1 in the result).

PARSED = [
    ({}, "<r/>", "r", '""', None, None),
    ({}, "<?xml version=\"1.0\"?>\n<!-- c -->\n<!DOCTYPE r [ <!ELEMENT r ANY> ]>\n<r>x</r>", "r", '"x"', None, None),
    ({}, "<!-- a --><?pi x?><r/><!-- b --> <?q?>\n", "r", '""', None, None),
    ({}, "<r a='x\"y' b=\"&lt;&#65;\"/>", "r", '{"@a":"x\\"y","@b":"<A"}', None, None),
    ({}, "<r><a>1</a><b/><a>2</a></r>", "r", '{"a":["1","2"],"b":""}', None, None),
    ({}, "<r><![CDATA[<a> & b]]></r>", "r", '"<a> & b"', None, None),
    ({}, "<r>a<![CDATA[ &lt; ]]>b</r>", "r", '"a &lt; b"', None, None),
    ({}, "<r>a<!-- x -->b<?pi?>c</r>", "r", '"abc"', None, None),
    ({}, "<p>one<b>two</b>three</p>", "p", '{"b":"two","#text":"onethree"}', None, None),
    ({}, '<r a="1"> t </r>', "r", '{"@a":"1","#text":"t"}', None, None),
    ({}, "<r>&amp;&lt;&gt;&quot;&apos;&#65;&#x42; & &x;</r>", "r", '"&<>\\"\'AB & &x;"', None, None),
    ({}, "<r></r >", "r", '""', None, None),
    ({}, "<r><1a/></r>", "r", '{"_1a":""}', None, None),
    ({}, '<r 1a="x"/>', "r", '{"@_1a":"x"}', None, None),
    ({}, "<s:e xmlns:s=\"u\">x</s:e>", "s:e", '{"@xmlns:s":"u","#text":"x"}', None, None),
    ({}, "", None, None, "Document has no root element", 0),
    ({}, "x", None, None, "Document has no root element", 0),
    ({}, "<r/><r/>", None, None, "Unexpected content after the root element", 4),
    ({}, "<!-- x", None, None, "Unterminated comment", 4),
    ({}, "<?x", None, None, "Unterminated processing instruction", 2),
    ({}, "<!DOCTYPE r [", None, None, "Unterminated DOCTYPE declaration", 0),
    ({}, "<>", None, None, "Expected a element name", 1),
    ({}, "<r ", None, None, "Unterminated start tag", 3),
    ({}, "<r a>", None, None, 'Attribute "a" has no "="', 4),
    ({}, "<r a=1>", None, None, 'Attribute "a" has no quoted value', 3),
    ({}, '<r a="1>', None, None, 'Unterminated value for attribute "a"', 6),
    ({}, "<r><a>", None, None, "Unclosed element <a>", 6),
    ({}, "<r><a>1</b></r>", None, None, "Closing tag </b> does not match <a>", 7),
    ({}, "<r></r x>", None, None, "Malformed closing tag </r>", 7),
    ({}, "<r><![CDATA[x</r>", None, None, "Unterminated CDATA section", 3),
    ({}, "<r><!ELEMENT x></r>", None, None, "A declaration is not allowed inside an element", 3),
    ({}, "<1a>x</1a>", None, None, "Closing tag </1a> does not match <_1a>", 5),
    ({}, "<r>😀</a></r>", None, None, "Closing tag </a> does not match <r>", 5),
    ({"preserve_whitespace": True}, "<r> a\n</r>", "r", '" a\\n"', None, None),
    ({"name": "ignore"}, "<1a>x</1a>", "1a", '"x"', None, None),
    ({"name": "error"}, "<1a/>", None, None, 'Element "1a" is not a legal XML name: First character "1" is not a valid NameStartChar', 1),
    ({"name": "error"}, '<a 1a="x"/>', None, None, 'Attribute "1a" is not a legal XML name: First character "1" is not a valid NameStartChar', 3),
    ({"max_depth": 1}, "<a><b/></a>", "a", '{"b":""}', None, None),
    ({"max_depth": 1}, "<a><b><c/></b></a>", None, None, "Element nesting exceeded maxDepth (1)", 6),
]


@query(expected("root VARCHAR, value VARCHAR, message VARCHAR, position INTEGER", [(*c[2:5], -1 if c[5] is None else c[5]) for c in PARSED]))
def parse_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prolog, CDATA, comments, mixed content, repeats, repair, depth, and each way to fail with its place."""

    def run(df: DataFrame, case: tuple) -> DataFrame:
        p = X.parse_xml("text", **case[0])
        return df.select("i", p.alias("p")).select("i", F.col("p.name").alias("root"), "p.value", F.col("p.error.message").alias("message"), F.coalesce("p.error.position", F.lit(-1)).alias("position"))

    return each(spark, PARSED, lambda c: c[0], run)


# The tree renderer: (options, tree, document, message).

RENDERED = [
    ({}, '"x"', "<root>x</root>", None),
    ({}, '""', "<root/>", None),
    ({}, '["a","b"]', "<root><item>a</item><item>b</item></root>", None),
    ({}, "[]", "<root></root>", None),
    ({}, '{"a":["1",["2","3"]],"b":[]}', "<root><a>1</a><a>2</a><a>3</a><b/></root>", None),
    ({}, '{"b":"1","@id":"x\\n","#text":"t"}', '<root id="x&#10;">t<b>1</b></root>', None),
    ({}, '{"n":1.0,"t":true,"m":-2.5}', "<root><n>1</n><t>true</t><m>-2.5</m></root>", None),
    ({}, '{"not a name":"x"}', "<root><not_a_name>x</not_a_name></root>", None),
    ({"root_name": "r", "item_name": "i"}, '["a"]', "<r><i>a</i></r>", None),
    ({"suppress_empty_node": False}, '{"a":""}', "<root><a></a></root>", None),
    ({"sort_keys": True}, '{"b":"1","a":"2"}', "<root><a>2</a><b>1</b></root>", None),
    ({"format": True}, '{"a":{"b":"x"},"#text":"t"}', "<root>\n  t\n  <a>\n    <b>x</b>\n  </a>\n</root>\n", None),
    ({"name": "error"}, '{"a b":""}', None, 'Invalid XML name "a b": Character " " at position 1 is not a valid NameChar'),
    ({"max_depth": 1}, '{"a":{"b":{"c":""}}}', None, "XML nesting exceeded maxDepth (1). Raise the limit if the document is legitimately this deep."),
]


@query(expected("xml VARCHAR, message VARCHAR", [c[2:] for c in RENDERED]))
def render_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(df: DataFrame, case: tuple) -> DataFrame:
        return df.select("i", X.render_xml("text", **case[0]).alias("r")).select("i", F.col("r.value").alias("xml"), F.col("r.error.message").alias("message"))

    return each(spark, RENDERED, lambda c: c[0], run)


# Names beyond ASCII: (version, name; is it a name, a token, tokens, an ASCII name; reason and place; repaired, repaired in ASCII).

NAMED = [
    ("1.0", "élément", True, True, True, False, None, None, "élément", "_l_ment"),
    ("1.0", "×", False, False, False, False, "Does not match the production rules", None, "×", "_"),
    ("1.0", "·x", False, True, True, False, 'First character "·" is not a valid NameStartChar', 0, "·x", "_x"),
    ("1.0", "̀abc", False, True, True, False, "Does not match the production rules", None, "̀abc", "_abc"),
    ("1.0", "😀a", False, False, False, False, "Does not match the production rules", None, "😀a", "_a"),
    ("1.0", "a҇", False, False, False, False, "Does not match the production rules", None, "a҇", "a_"),
    ("1.0", "a😀 b", False, False, False, False, 'Character " " at position 3 is not a valid NameChar', 3, "a😀_b", "a__b"),
    ("1.0", "漢字", True, True, True, False, None, None, "漢字", "__"),
    ("1.0", "é è", False, False, True, False, 'Character " " at position 1 is not a valid NameChar', 1, "é_è", "___"),
    ("1.0", "-é", False, True, True, False, 'First character "-" is not a valid NameStartChar', 0, "_-é", "_-_"),
    ("1.0", "a\\b", False, False, False, False, "Does not match the production rules", None, "a_b", "a_b"),
    ("1.1", "×", True, True, True, False, None, None, "×", "_"),
    ("1.1", "😀a", True, True, True, False, None, None, "😀a", "_a"),
    ("1.1", "a҇", True, True, True, False, None, None, "a҇", "a_"),
    ("1.1", "҇a", False, True, True, False, "Does not match the production rules", None, "҇a", "_a"),
]


@query(expected("is_name BOOLEAN, is_nm_token BOOLEAN, is_nm_tokens BOOLEAN, ascii_name BOOLEAN, reason VARCHAR, position INTEGER, repaired VARCHAR, ascii_repaired VARCHAR", [(*c[2:7], -1 if c[7] is None else c[7], *c[8:]) for c in NAMED]))
def unicode_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of both versions of XML, the diagnosis and the repair, beyond ASCII and beyond the first plane."""

    def run(df: DataFrame, case: tuple) -> DataFrame:
        n, v = F.col("text"), X.validate(F.col("text"), "name", case[0])
        return df.select("i", X.is_name(n, case[0]).alias("is_name"), X.is_nm_token(n, case[0]).alias("is_nm_token"), X.is_nm_tokens(n, case[0]).alias("is_nm_tokens"), X.is_name(n, case[0], True).alias("ascii_name"), v["reason"].alias("reason"), F.coalesce(v["position"], F.lit(-1)).alias("position"), X.sanitize(n).alias("repaired"), X.sanitize(n, ascii_only=True).alias("ascii_repaired"))

    return each(spark, NAMED, lambda c: c[0], run)


# Entities: (policy, text or texts of one budget, external entities, entities of the input; value, tag, message).

_LONG = "n" * 32
ENTITIES = [
    ({}, "&lt;&gt;&amp;&quot;&apos;", {}, {}, "<>&\"'", None, None),
    ({}, "&eacute; & &; &amp;lt;", {}, {}, "&eacute; & &; &lt;", None, None),
    ({}, "&#65;&#x42;&#X43;", {}, {}, "ABC", None, None),
    ({}, "&# 65;&#+65;&#65x;&#0065;", {}, {}, "AAAA", None, None),
    ({}, "&#x;&#-1;&#x110000;", {}, {}, "&#x;&#-1;&#x110000;", None, None),
    ({}, "a&#0;&#xD800;&#1;&#9;b", {}, {}, "a\tb", None, None),
    ({"xml_version": 1.1}, "a&#1;b&#0;", {}, {}, "a\x01b", None, None),
    ({"numeric_allowed": False}, "&#65;&#0;", {}, {}, "&#65;", None, None),
    ({"on_ncr": "leave"}, "&#65;", {}, {}, "&#65;", None, None),
    ({"on_ncr": "remove"}, "a&#65;b", {}, {}, "ab", None, None),
    ({"on_ncr": "throw"}, "a&#65;b", {}, {}, None, "ProhibitedCharacterReference", "[EntityDecoder] Prohibited numeric character reference &#65; (U+0041)"),
    ({"null_ncr": "throw"}, "&#0;", {}, {}, None, "ProhibitedCharacterReference", "[EntityDecoder] Prohibited numeric character reference &#0; (U+0000)"),
    ({"remove": ("lt", "#38")}, "a&lt;&#38;b", {}, {}, "ab", None, None),
    ({"leave": ("lt", "#x26")}, "&lt;&gt;&#x26;", {}, {}, "&lt;>&#x26;", None, None),
    ({"named_entities": {"x": "1", "y": {"regex": "z", "val": "2"}, "amp": "AND", "big": _LONG}}, "&x;&y;&amp;&big;", {}, {}, f"12AND{_LONG}", None, None),
    ({"named_entities": {_LONG: "1", _LONG + "n": "2"}}, f"&{_LONG};&{_LONG}n;", {}, {}, f"1&{_LONG}n;", None, None),
    ({"named_entities": {"constructor": "c"}}, "&constructor;&toString;", {}, {}, "c&toString;", None, None),
    ({}, "&e;&f;", {"e": "out", "f": "F"}, {"e": "in"}, "inF", None, None),
    ({"on_external_entity": lambda n, v: "block" if n == "b" else "allow"}, "&a;&b;", {"a": "1", "b": "2"}, {}, "1&b;", None, None),
    ({"on_input_entity": lambda n, v: "throw"}, "&a;", {}, {"a": "1"}, None, "EntityRejected", '[EntityDecoder] Registration of input entity "&a;" was rejected by hook'),
    ({"post_check": lambda out, _: out.upper()}, "a&lt;", {}, {}, "A<", None, None),
    ({"max_total_expansions": 2}, "&e;&e;&lt;&lt;&lt;", {"e": "x"}, {}, "xx<<<", None, None),
    ({"max_total_expansions": 2, "apply_limits_to": "all"}, "&e;&lt;&lt;", {"e": "x"}, {}, None, "ExpansionLimitExceeded", "[EntityReplacer] Entity expansion count limit exceeded: 3 > 2"),
    ({"max_total_expansions": 1, "apply_limits_to": "base"}, "&e;&e;&lt;", {"e": "x"}, {}, "xx<", None, None),
    ({"max_expanded_length": 5}, "&big;", {"big": "x" * 20}, {}, None, "ExpandedLengthLimitExceeded", "[EntityReplacer] Expanded content length limit exceeded: 15 > 5"),
    ({"max_total_expansions": 2}, ["&e;", "&e;"], {"e": "x"}, {}, '["x","x"]', None, None),
    ({"max_total_expansions": 2}, ["&e;&e;", "&e;"], {"e": "x"}, {}, None, "ExpansionLimitExceeded", "[EntityReplacer] Entity expansion count limit exceeded: 3 > 2"),
]


@query(expected("value VARCHAR, tag VARCHAR, message VARCHAR", [c[4:] for c in ENTITIES]))
def entity_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies, tiers, hooks, limits, counters that run on over texts, and the forms of numeric references."""
    out = None
    for i, (policy, text, external, own, *_) in enumerate(ENTITIES):
        col = F.lit(text) if isinstance(text, str) else F.array(*map(F.lit, text))
        given = F.create_map(*[F.lit(x) for e in own.items() for x in e]) if own else None
        row = spark.range(1).select(F.lit(i).alias("i"), X.decode_entities_result(col, policy, external, given).alias("d"))
        some = row.select("i", "d.value", F.col("d.error.tag").alias("tag"), F.col("d.error.message").alias("message"))
        out = some if out is None else out.unionByName(some)
    return out


# What is refused on the driver, before a query runs: (message).


def _message(f: Callable[[], object]) -> str:
    try:
        f()
    except (ValueError, TypeError, XmlError) as e:
        return str(e)
    return "nothing"


def _invalid(*parts: T.StructField) -> Callable[[], object]:
    return lambda: XmlCodec(fields(*parts))


_ANNOTATION = "Invalid XML namespace annotation:\n\t- "
REFUSED: list[tuple[Callable[[SparkSession], object], str]] = [
    (lambda s: XmlCodec("array<string>", root={"xmlName": "regions"}).encode(F.array(F.lit("a"))), "An array at the root of a namespaced schema cannot carry the root namespace or name."),
    (lambda s: XmlCodec("array<string>", "r", root={"xmlNamespace": "urn:x"}).encode(F.array(F.lit("a"))), "An array at the root of a namespaced schema cannot carry the root namespace or name."),
    (lambda s: XmlCodec("a string").decode_frame(s.range(1), "id"), "Expected a string, but received bigint."),
    (lambda s: EntityDecoder.make(None), "EntityDecoder.make: options is required. Use make({}) for a decoder with every default."),
    (lambda s: EntityDecoder().set_external_entities({"#a": "x"}), "[EntityReplacer] Invalid character '#' in entity name: \"#a\""),
    (lambda s: EntityDecoder().add_external_entity("a b|", "x"), "[EntityReplacer] Invalid character '|' in entity name: \"a b|\""),
    (lambda s: EntityDecoder(on_external_entity=lambda n, v: "throw").set_external_entities({"t": "x"}), '[EntityDecoder] Registration of external entity "&t;" was rejected by hook'),
    (lambda s: X.validate(F.lit("a"), "x"), 'Unknown production "x". Must be one of: name, ncName, qName, nmToken, nmTokens'),
    (lambda s: XmlCodec("`not a name` string", "r", name="error").encode(F.struct(F.lit("x").alias("not a name"))), 'Invalid XML name "not a name": Character " " at position 3 is not a valid NameChar'),
    (lambda s: _invalid(field("a", "string", xml_name="x:y"))(), _ANNOTATION + 'xmlName "x:y" on "a" must be a local name; use xmlPrefix for the prefix.'),
    (lambda s: _invalid(field("p:a", "string", namespace="urn:x"))(), _ANNOTATION + '"p:a" already carries a prefix, so it cannot also carry a namespace annotation.'),
    (lambda s: _invalid(field("@a", "string", namespace="urn:x"))(), _ANNOTATION + 'the attribute "@a" needs xmlPrefix, because a default namespace does not apply to attributes.'),
    (lambda s: _invalid(field("a", "string", attribute=True, value=True))(), _ANNOTATION + "the field \"a\" is marked as both an attribute and the element's value."),
    (lambda s: _invalid(field("a", "string", value=True), field("b", "string", value=True))(), _ANNOTATION + 'the element "root" has more than one value field, "a" and "b".'),
    (lambda s: _invalid(field("a", "string"), field("b", "string", xml_name="a"))(), _ANNOTATION + '"a" and "b" both resolve to "a" under the same element.'),
]


@query(expected("message VARCHAR", [(m,) for _, m in REFUSED]))
def refused_on_the_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, _message(lambda f=f: f(spark))) for i, (f, _) in enumerate(REFUSED)], "i int, message string")


# Typed decoding: (codec, document; value as JSON without nulls, message).

_MEMBERS = fields(
    field("allowance", fields(field("kind", "string", enum=["allowance"]), field("id", "string", enum=["x", "y"]))),
    field("charge", fields(field("kind", "string", enum=["charge"]), field("id", "string", enum=["x", "y"]))),
    field("plain", "int"),
)
UNION = XmlCodec(fields(field("item", _MEMBERS, union=True)), "r")
UNIONS = XmlCodec(fields(field("item", T.ArrayType(_MEMBERS), union=True, single=True)), "r")
_ITEMS = XmlCodec(fields(field("item", T.ArrayType(fields(field("v", "string", optional=True))))), "r")
_SPACED = XmlCodec(fields(field("item", T.ArrayType(fields(field("v", "string", optional=True))), namespace="urn:items", prefix="i")), "r")
_TAGS = XmlCodec("tag array<string>", "r")
_PRICE = XmlCodec(fields(field("price", fields(field("amount", "double", value=True), field("currency", "string", attribute=True, optional=True)))), "r")
DECODED: list[tuple[XmlCodec, str, str | None, str | None]] = [
    (XmlCodec("a int", "r"), "<other><a>1</a></other>", '{"a":1}', None),
    (XmlCodec("a int", "r"), "<r><a>x</a></r>", None, 'Expected int, but received "x" at "a"'),
    (XmlCodec("a int", "r"), "<r><a>2147483648</a></r>", None, 'Expected int, but received "2147483648" at "a"'),
    (XmlCodec("a string, b string", "r"), "<r><a>x</a></r>", None, 'Missing key at "b"'),
    (XmlCodec("a string", "r"), "<r/>", None, 'Expected a record, but received ""'),
    (XmlCodec("title string", "r"), '<r><title lang="en">Dune</title></r>', '{"title":"Dune"}', None),
    (XmlCodec("title string", "r"), "<r><title>x<b/></title></r>", None, 'the field "title" wants a plain value, but the element also carries the child element "b"; only attributes are discarded alongside #text'),
    (XmlCodec("title string", "r"), "<r><title><b/></title></r>", None, 'Expected string, but received {"b": ""} at "title"'),
    (_ITEMS, "<r><item/></r>", '{"item":[{}]}', None),
    (_ITEMS, "<r><item/><item/></r>", '{"item":[{},{}]}', None),
    (_ITEMS, "<r><item><v>1</v></item><item><v>2</v></item></r>", '{"item":[{"v":"1"},{"v":"2"}]}', None),
    (_SPACED, '<r><i:item xmlns:i="urn:items"/></r>', '{"item":[{}]}', None),
    (_SPACED, '<r><q:item xmlns:q="urn:items"><q:v>1</q:v></q:item><q:item xmlns:q="urn:items"/></r>', '{"item":[{"v":"1"},{}]}', None),
    (_TAGS, "<r><tag/></r>", '{"tag":[]}', None),
    (_TAGS, "<r><tag/><tag/></r>", '{"tag":["",""]}', None),
    (_TAGS, '<r><tag k="1">x</tag><tag>y</tag></r>', '{"tag":["x","y"]}', None),
    (_TAGS, "<r><tag>only</tag></r>", None, 'Expected an array, but received "only" at "tag"'),
    (XmlCodec("tag array<string>", "r", array_from_single=True), "<r><tag>only</tag></r>", '{"tag":["only"]}', None),
    (XmlCodec(fields(field("tag", "array<int>", optional=True), field("n", "int")), "r"), "<r><n>1</n></r>", '{"n":1}', None),
    (XmlCodec(fields(field("tag", T.ArrayType(T.StringType()), enum=["x", "y"], optional=True)), "r"), '<r><tag s="c">x</tag><tag s="c">y</tag></r>', '{"tag":["x","y"]}', None),
    (XmlCodec("array<string>", "r"), "<r></r>", "[]", None),
    (_PRICE, '<r><price currency="USD">1.5</price></r>', '{"price":{"amount":1.5,"currency":"USD"}}', None),
    (_PRICE, "<r><price>1.5</price></r>", '{"price":{"amount":1.5}}', None),
    (XmlCodec("`soap:Body` string, `@xmlns:soap` string", "r"), '<r xmlns:soap="u"><soap:Body>x</soap:Body></r>', '{"soap:Body":"x","@xmlns:soap":"u"}', None),
    (XmlCodec(fields(field("i", T.ArrayType(T.StringType()), namespace="urn:a", prefix="a")), "r"), '<r xmlns:p="urn:a"><p:i>1</p:i><p:i>2</p:i></r>', '{"i":["1","2"]}', None),
    (UNION, '<r><item><kind>allowance</kind><id schemeID="c">x</id></item></r>', '{"item":{"allowance":{"kind":"allowance","id":"x"}}}', None),
    (UNION, "<r><item><kind>charge</kind><id>y</id></item></r>", '{"item":{"charge":{"kind":"charge","id":"y"}}}', None),
    (UNION, '<r><item unit="m">12</item></r>', '{"item":{"plain":12}}', None),
    (UNION, "<r><item><kind>other</kind><id>x</id></item></r>", None, 'Expected "allowance", but received "other" at "item.kind"'),
    (UNIONS, "<r><item>1</item><item><kind>charge</kind><id>x</id></item></r>", '{"item":[{"plain":1},{"charge":{"kind":"charge","id":"x"}}]}', None),
    (UNIONS, "<r><item>1</item></r>", '{"item":[{"plain":1}]}', None),
]


@query(expected("value VARCHAR, message VARCHAR, again VARCHAR", [(v, m, None if v is None else v) for _, _, v, m in DECODED]))
def decode_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain values, empty members, repeated and renamed elements, unions; ``again``: the value encoded and decoded once more."""
    out = None
    for i, (codec, text, *_) in enumerate(DECODED):
        once = numbered(spark, [text], i).select("i", codec.decode("text").alias("d")).select("i", "d.value", F.col("d.error.message").alias("message"))
        twice = once.select("i", "value", "message", codec.decode(codec.encode("value")).alias("e"))
        some = twice.select("i", F.to_json("value").alias("value"), "message", F.to_json("e.value").alias("again"))
        out = some if out is None else out.unionByName(some)
    return out


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '<r><item><kind>allowance</kind><id>x</id></item></r>' WHEN 1 THEN '<r><item><kind>charge</kind><id>y</id></item></r>' ELSE '<r><item>' || p_size || '</item></r>' END AS xml FROM part")
def encode_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member that is not null writes the element."""
    k = F.col("p_partkey") % 3
    of = lambda kind, id_: F.struct(F.lit(kind).alias("kind"), F.lit(id_).alias("id"))
    item = F.struct(F.when(k == 0, of("allowance", "x")).alias("allowance"), F.when(k == 1, of("charge", "y")).alias("charge"), F.when(k == 2, F.col("p_size")).alias("plain"))
    return table(spark, sf_dir, "part").select("p_partkey", UNION.encode(F.struct(item.alias("item"))).alias("xml"))


# Metrics.


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small documents, every tenth cut off before its end."""
    codec = XmlCodec("`@id` bigint, status string", "order")
    xml = codec.encode(F.struct(F.col("o_orderkey").alias("@id"), F.col("o_orderstatus").alias("status")))
    cut: Column = F.when(F.col("o_orderkey") % 10 == 0, F.expr("substring(xml, 1, length(xml) - 1)")).otherwise(F.col("xml"))
    return table(spark, sf_dir, "orders").withColumn("xml", xml).select("o_orderkey", cut.alias("xml"))


_ORDER_XML = "'<order id=\"' || o_orderkey || '\"><status>' || o_orderstatus || '</status></order>'"
_MEASURES = f"CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (o_orderkey % 10 = 0) AS BIGINT) AS failures, CAST(sum(length({_ORDER_XML}) - CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS length FROM orders"


@query(f"SELECT 'decode' AS what, {_MEASURES} UNION ALL SELECT 'parse', {_MEASURES}")
def parse_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, failures and length, as the decoder and the parser observe them, failures included."""
    codec = XmlCodec("`@id` bigint, status string", "order")
    rows = []
    for what in ("decode", "parse"):
        seen = Observation(what)
        df = _orders(spark, sf_dir)
        found = codec.decode_frame(df, "xml", observe=seen, log=False) if what == "decode" else X.parse_frame(df, "xml", observe=seen)
        found.write.format("noop").mode("overwrite").save()
        rows.append((what, *[int(seen.get[k]) for k in ("documents", "failures", "length")]))
    return spark.createDataFrame(rows, "what string, documents long, failures long, length long")


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey < 500")
def decode_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed documents dropped; the filter behind the decoder reaches the scan before it."""
    codec = XmlCodec("`@id` bigint, status string", "order")
    return codec.decode_frame(_orders(spark, sf_dir), "xml", mode="DROPMALFORMED").where("o_orderkey < 500").select("o_orderkey", "value.status")
