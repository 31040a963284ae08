from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmlframe import XmlCodec, field
from xmlframe import functions as X
from xmlframe.core.names import SPACE
from xmlframe.core.render import render_xml
from xmlframe.plans.schema import plan

EDGE = "".join(chr(c) for a, b in SPACE for c in range(a, b + 1))


def struct(*parts):
    return T.StructType(list(parts))


def encoded(spark, codec, value, kind=None):
    return spark.createDataFrame([(value,)], struct(T.StructField("v", kind or codec.schema))).select(codec.encode("v")).first()[0]


def decoded(spark, codec, text):
    return spark.createDataFrame([(text,)], "x string").select(codec.decode("x").alias("d")).first()["d"]


PRICE = XmlCodec(struct(field("@currency", "string"), field("amount", "string", value=True)), "price")
ROUND_TRIPS = [
    (XmlCodec("s string, n double, b boolean, i int", "r"), ("text", 1.5, False, -42), "<r><s>text</s><n>1.5</n><b>false</b><i>-42</i></r>"),
    (XmlCodec("`@href` string, `#text` string", "a"), ("/a", "link"), '<a href="/a">link</a>'),
    (XmlCodec("n double", "r"), (1e-7,), "<r><n>1e-7</n></r>"),
    (XmlCodec("a struct<b:string>", "r"), (("x",),), "<r><a><b>x</b></a></r>"),
    (XmlCodec("a array<int>", "r"), ([1, 2],), "<r><a>1</a><a>2</a></r>"),
    (XmlCodec("a array<struct<`@k`:string,v:string>>", "r"), ([("1", "x"), ("2", "")],), '<r><a k="1"><v>x</v></a><a k="2"><v/></a></r>'),
    (XmlCodec("m map<string,string>", "r"), ({"k": "v"},), "<r><m><k>v</k></m></r>"),
    (PRICE, ("USD", "19.99"), '<price currency="USD">19.99</price>'),
    (XmlCodec("`@q` string", "r"), ("\"'\n\t\r<&",), '<r q="&quot;&apos;&#10;&#9;&#13;&lt;&amp;"/>'),
    (XmlCodec(struct(field("a", "string", optional=True), field("b", "string"))), (None, "x"), "<root><b>x</b></root>"),
    (XmlCodec("d decimal(38,0)", "r"), (__import__("decimal").Decimal(9007199254740993),), "<r><d>9007199254740993</d></r>"),
    (XmlCodec(struct(*[field(f"f{i}", "string") for i in range(50)]), "r"), tuple(str(i) for i in range(50)), "<r>" + "".join(f"<f{i}>{i}</f{i}>" for i in range(50)) + "</r>"),
    (XmlCodec(struct(field("t", "string", tree=True), field("z", "string")), "r"), ('{"@k":"1","c":["a","b"]}', "x"), '<r><t k="1"><c>a</c><c>b</c></t><z>x</z></r>'),
    (XmlCodec(struct(field("@version", "string", namespace="urn:meta", prefix="meta"), field("title", "string")), "note", root={"xmlNamespace": "urn:notes"}), ("1", "t"), '<note xmlns="urn:notes" xmlns:meta="urn:meta" meta:version="1"><title>t</title></note>'),
    (XmlCodec(struct(field("items", T.ArrayType(struct(field("v", "string"))), xml_name="item")), "r"), ([("x",)],), "<r><item><v>x</v></item></r>"),
    (XmlCodec(struct(field("b", struct(field("c", "string")), namespace="urn:s", prefix="s"), field("d", struct(field("c", "string")), namespace="urn:s", prefix="s")), "a"), (("x",), ("y",)), '<a><s:b xmlns:s="urn:s"><s:c>x</s:c></s:b><s:d xmlns:s="urn:s"><s:c>y</s:c></s:d></a>'),
]


@pytest.mark.parametrize(("codec", "value", "text"), ROUND_TRIPS)
def test_round_trip(spark, codec, value, text):
    assert encoded(spark, codec, value) == text
    back = decoded(spark, codec, text)
    assert back["error"] is None
    assert encoded(spark, codec, back["value"]) == text


FAILURES = [
    ("a string", "<r><a>x</r>", "XmlParseError", "Closing tag </r> does not match <a>"),
    ("a double", "<r><a>not a number</a></r>", "SchemaError", 'Expected double, but received "not a number" at "a"'),
    ("a double", "<r><a> 1.5f</a></r>", "SchemaError", 'Expected double, but received "1.5f" at "a"'),
    ("a int", "<r><a>2147483648</a></r>", "SchemaError", 'Expected int, but received "2147483648" at "a"'),
    ("a boolean", "<r><a>True</a></r>", "SchemaError", 'Expected boolean, but received "True" at "a"'),
    ("a string, b string", "<r><a>x</a></r>", "SchemaError", 'Missing key at "b"'),
    ("a array<string>", "<r><a>only</a></r>", "SchemaError", 'Expected an array, but received "only" at "a"'),
    ("a string", "<r/>", "SchemaError", 'Expected a record, but received ""'),
    ("title string", "<r><title>x<b/></title></r>", "SchemaError", 'the field "title" wants a plain value, but the element also carries the child element "b"; only attributes are discarded alongside #text'),
    ("title string", '<r><title><b/></title></r>', "SchemaError", 'Expected string, but received {"b": ""} at "title"'),
]


@pytest.mark.parametrize(("schema", "text", "tag", "message"), FAILURES)
def test_failures(spark, schema, text, tag, message):
    got = decoded(spark, XmlCodec(schema, "r"), text)
    assert got["value"] is None and (got["error"]["tag"], got["error"]["message"]) == (tag, message)


def test_empty_elements_under_arrays(spark):
    one = XmlCodec(struct(field("item", T.ArrayType(struct(field("v", "string", optional=True))))), "r")
    assert decoded(spark, one, "<r><item/></r>")["value"]["item"][0]["v"] is None
    tags = XmlCodec("tag array<string>", "r")
    assert decoded(spark, tags, "<r><tag/></r>")["value"]["tag"] == []
    assert decoded(spark, tags, "<r><tag/><tag/></r>")["value"]["tag"] == ["", ""]
    assert decoded(spark, XmlCodec("tag array<string>", "r", array_from_single=True), "<r><tag>x</tag></r>")["value"]["tag"] == ["x"]


def test_enum(spark):
    codec = XmlCodec(struct(field("code", "int", enum=[200, 404])), "r")
    assert decoded(spark, codec, "<r><code>404</code></r>")["value"]["code"] == 404
    assert decoded(spark, codec, "<r><code>500</code></r>")["error"]["tag"] == "SchemaError"


PROBLEMS = [
    (struct(field("a", "string", xml_name="x:y")), 'xmlName "x:y" on "a" must be a local name; use xmlPrefix for the prefix'),
    (struct(field("p:a", "string", namespace="urn:x")), '"p:a" already carries a prefix, so it cannot also carry a namespace annotation'),
    (struct(field("@a", "string", namespace="urn:x")), 'the attribute "@a" needs xmlPrefix, because a default namespace does not apply to attributes'),
    (struct(field("a", "string", attribute=True, value=True)), 'the field "a" is marked as both an attribute and the element\'s value'),
    (struct(field("a", "string", value=True, xml_name="b")), 'the value field "a" cannot have an xmlName, because character data has no name'),
    (struct(field("a", "string", value=True, namespace="urn:x")), 'the value field "a" cannot have a namespace, because character data has none'),
    (struct(field("a", "string", value=True), field("b", "string", value=True)), 'the element "root" has more than one value field, "a" and "b"'),
    (struct(field("a", "string"), field("b", "string", xml_name="a")), '"a" and "b" both resolve to "a" under the same element'),
]


@pytest.mark.parametrize(("schema", "problem"), PROBLEMS)
def test_invalid_plans(schema, problem):
    with pytest.raises(ValueError) as e:
        XmlCodec(schema)
    assert str(e.value).startswith("Invalid XML namespace annotation:\n\t- ") and problem in str(e.value)


def test_root_names():
    assert plan(struct(field("a", "string")), None, {"identifier": "book", "title": "Book"}).name == "book"
    assert plan(struct(field("a", "string")), None, {"title": "Book"}).name == "Book"
    assert plan(struct(field("a", "string"))).name == "root"
    assert plan(struct(field("a", "string")), "x", {"xmlNamespace": "u", "xmlPrefix": "p"}).name == "p:x"


def test_guards(spark):
    codec = XmlCodec("array<string>", "r", root={"xmlNamespace": "urn:x"})
    with pytest.raises(ValueError, match="An array at the root of a namespaced schema cannot carry the root namespace or name."):
        codec.encode(F.array(F.lit("x")))
    with pytest.raises(TypeError, match="Expected a string, but received bigint."):
        XmlCodec("a string").decode_frame(spark.range(1), "id")
    with pytest.raises(ValueError, match="Invalid XML name"):
        XmlCodec("`not a name` string", "r", name="error").encode(F.struct(F.lit("x").alias("not a name")))


def test_modes_and_metrics(spark):
    df = spark.createDataFrame([("<r><a>1</a></r>",), ("<r>",), (None,)], "x string")
    codec = XmlCodec("a int", "r")
    seen = Observation("parse")
    rows = codec.decode_frame(df, "x", observe=seen).collect()
    assert [r["value"] and r["value"]["a"] for r in rows] == [1, None, None] and rows[1]["value_error"]["message"] == "Unclosed element <r>"
    assert seen.get == {"documents": 3, "failures": 1, "length": 18}
    assert codec.decode_frame(df, "x", mode="DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="XML parse error: Unclosed element <r>"):
        codec.decode_frame(df, "x", mode="FAILFAST").collect()


def test_plan_parses_once_and_pushes_filters(spark, tmp_path):
    spark.createDataFrame([("en", "<r><a>1</a></r>")], "lang string, x string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where("lang = 'en'")
    out = XmlCodec("a int", "r").decode_frame(df, "x").where("value.a = 1")
    shown = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert shown.count("ArrowEvalPython") == 1 and "EqualTo(lang,en)" in shown
    encode = df.select(XmlCodec("lang string", "r").encode_fields())._jdf.queryExecution().toString()
    assert "Python" not in encode.split("== Physical Plan ==")[1]


def test_filters_pass_the_decoder(spark, tmp_path):
    spark.createDataFrame([(1, "<r><a>1</a></r>"), (2, "<r>")], "id int, x string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for mode in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        out = XmlCodec("a int", "r").decode_frame(df, "x", mode=mode).where("id = 1 and value.a = 1").select("id", "value")
        shown = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert shown.count("ArrowEvalPython") == 1 and "PushedFilters: [IsNotNull(id), EqualTo(id,1)]" in shown
        assert [r["value"]["a"] for r in out.collect()] == [1]
    both = XmlCodec("a int", "r").decode_frame(df, "x").select("value", "value_error")._jdf.queryExecution().toString()
    assert both.split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1
    parsed = X.parse_frame(df, "x").where("id = 2").select("parsed.error.message")
    assert "EqualTo(id,2)" in parsed._jdf.queryExecution().toString() and parsed.first()[0] == "Unclosed element <r>"


def test_failures_are_logged(spark, caplog):
    read = XmlCodec("a int", "r")._function(None, True).func
    read(__import__("pyarrow").array(["<r>", "<r><a>1</a></r>"]))
    assert [m for m in caplog.messages if m.startswith("XML")] == ["XML parse error: Unclosed element <r>"]


def test_columns_that_are_no_text(spark):
    with pytest.raises(Exception, match="Expected a string, but received int64."):
        spark.range(1).select(XmlCodec("a int", "r").decode("id")).collect()


def test_entities_without_numbers_stay_in_the_jvm(spark):
    texts = ["a&amp;lt;b", "&lt;&gt;&quot;&apos;&x;&", "&#65;&amp;", None, "none"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.decode_entities("t").alias("d"))
    assert [r["d"] for r in rows.collect()] == ["a&lt;b", "<>\"'&x;&", "A&", None, "none"]


texts = st.text(st.characters(exclude_categories=("Cs",), exclude_characters="\x00"), max_size=20)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(texts, texts, st.floats(allow_nan=False), st.lists(texts, min_size=2, max_size=4)), min_size=1, max_size=30))
def test_random_round_trips(spark, rows):
    codec = XmlCodec("`@a` string, s string, n double, l array<string>", "r")
    df = spark.createDataFrame([(r,) for r in rows], struct(T.StructField("v", codec.schema)))
    found = df.select("v", codec.encode("v").alias("x")).withColumn("d", codec.decode("x")).collect()
    for r in found:
        back, v = r["d"]["value"], r["v"]
        assert (back["@a"], back["s"], back["l"]) == (v["@a"], v["s"].strip(EDGE), [t.strip(EDGE) for t in v["l"]])
        assert back["n"] == v["n"]
        tree = {"@a": v["@a"], "s": v["s"], "n": r["x"].split("<n>")[1].split("</n>")[0], "l": v["l"]}
        assert render_xml(tree, root_name="r") == r["x"]


def test_functions_take_nulls(spark):
    row = spark.createDataFrame([(None, "a&amp;b")], "n string, t string")
    got = row.select(X.parse_xml("n"), X.render_xml("n")["value"], X.decode_entities("n"), X.decode_entities("t"), X.escape_text("n"), X.is_xml_value("n")).first()
    assert list(got) == [None, None, None, "a&b", None, True]
    shared = row.select(X.decode_entities_result(F.array(F.lit("&e;"), F.lit("&e;")), {"max_total_expansions": 1}, {"e": "x"})["error"]["tag"]).first()[0]
    assert shared == "ExpansionLimitExceeded"
