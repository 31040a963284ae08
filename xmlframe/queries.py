"""Queries over the driver's tables, one or more for each group of operators, and the DuckDB SQL that says the same.

SQL knows no XML, so the oracles put the expected text or columns together from string functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import functions as X
from .core import names as N
from .operators import XmlCodec
from .plans.schema import field

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_escaped(col: str, attribute: bool = False) -> str:
    for raw, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        col = f"replace({col}, '{raw}', '{reference}')"
    if attribute:
        for raw, reference in ((9, "&#9;"), (10, "&#10;"), (13, "&#13;")):
            col = f"replace({col}, chr({raw}), '{reference}')"
    return col


def fields(*parts: T.StructField) -> T.StructType:
    return T.StructType(list(parts))


DOCUMENT = XmlCodec(fields(field("doc_id", "bigint", attribute=True, xml_name="id"), field("@lang", "string"), field("text", "string")), "document")
_DOCUMENT_SQL = f"'<document id=\"' || doc_id || '\" lang=\"' || {sql_escaped('lang', True)} || '\">' || CASE WHEN text = '' THEN '<text/>' ELSE '<text>' || {sql_escaped('text')} || '</text>' END || '</document>'"


def encoded_documents(df: DataFrame) -> Column:
    return DOCUMENT.encode(F.struct("doc_id", F.col("lang").alias("@lang"), "text"))


# Encoding.


@query(f"SELECT doc_id, {_DOCUMENT_SQL} AS xml FROM documents")
def encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", encoded_documents(df).alias("xml"))


ORDER = XmlCodec(
    fields(field("@id", "bigint"), field("status", "string"), field("line", T.ArrayType(fields(field("@n", "int"), field("part", "bigint"), field("qty", "int"), field("flag", "string"))))),
    "order",
)
_LINES = "string_agg('<line n=\"' || l_linenumber || '\"><part>' || l_partkey || '</part><qty>' || CAST(l_quantity AS INTEGER) || '</qty><flag>' || l_returnflag || '</flag></line>', '' ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag)"


def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("qty"), "l_returnflag"))).alias("lines"))
    line = F.transform("lines", lambda x: F.struct(x["l_linenumber"].alias("@n"), x["l_partkey"].alias("part"), x["qty"].alias("qty"), x["l_returnflag"].alias("flag")))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select("o_orderkey", F.struct(F.col("o_orderkey").alias("@id"), F.col("o_orderstatus").alias("status"), line.alias("line")).alias("v"))


@query(f"SELECT o_orderkey, '<order id=\"' || o_orderkey || '\"><status>' || o_orderstatus || '</status>' || coalesce(l, '') || '</order>' AS xml FROM orders LEFT JOIN (SELECT l_orderkey, {_LINES} AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def encode_orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_with_lines(spark, sf_dir).select("o_orderkey", ORDER.encode("v").alias("xml"))


@query("SELECT n_nationkey, '<nation key=\"' || n_nationkey || '\">' || chr(10) || '  <name>' || n_name || '</name>' || chr(10) || '  <region>' || chr(10) || '    <id>' || n_regionkey || '</id>' || chr(10) || '  </region>' || chr(10) || '</nation>' || chr(10) AS xml FROM nation")
def encode_pretty_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = XmlCodec("`@key` int, name string, region struct<id:int>", "nation", format=True)
    v = F.struct(F.col("n_nationkey").alias("@key"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("id")).alias("region"))
    return table(spark, sf_dir, "nation").select("n_nationkey", codec.encode(v).alias("xml"))


@query("SELECT s_suppkey, '<s a=\"' || s_suppkey || '\" z=\"' || s_nationkey || '\"><b>' || s_suppkey || '</b><name>' || s_name || '</name></s>' AS xml FROM supplier")
def encode_sorted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = XmlCodec("name string, `@z` int, b bigint, `@a` bigint", "s", sort_keys=True)
    v = F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("@z"), F.col("s_suppkey").alias("b"), F.col("s_suppkey").alias("@a"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", codec.encode(v).alias("xml"))


@query("SELECT '<regions>' || string_agg('<item>' || r_name || '</item>', '' ORDER BY r_name) || '</regions>' AS xml FROM region")
def encode_root_array_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list("r_name")).alias("v"))
    return names.select(XmlCodec("array<string>", "regions").encode("v").alias("xml"))


@query("SELECT r_regionkey, CASE r_regionkey % 5 WHEN 0 THEN '<r></r>' WHEN 1 THEN '<r><a></a></r>' WHEN 2 THEN '<r><b></b></r>' WHEN 3 THEN '<r><b>x</b><b></b></r>' ELSE '<r><c k=\"1\"></c></r>' END AS xml FROM region")
def encode_empty_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = XmlCodec("a string, b array<string>, c struct<`@k`:string>", "r", suppress_empty_node=False)
    k = F.col("r_regionkey") % 5
    b = F.when(k == 2, F.array().cast("array<string>")).when(k == 3, F.array(F.lit("x"), F.lit(None)))
    v = F.struct(F.when(k == 1, "").alias("a"), b.alias("b"), F.when(k == 4, F.struct(F.lit("1").alias("@k"))).alias("c"))
    return table(spark, sf_dir, "region").select("r_regionkey", codec.encode(v).alias("xml"))


@query("SELECT c_custkey, '<m id=\"' || c_custkey || '\"><name>' || c_name || '</name><market_segment>' || c_mktsegment || '</market_segment></m>' AS xml FROM customer")
def encode_open_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.create_map(F.lit("@id"), F.col("c_custkey").cast("string"), F.lit("name"), F.col("c_name"), F.lit("market segment"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", XmlCodec("map<string,string>", "m").encode(v).alias("xml"))


@query("SELECT c_custkey, CASE WHEN c_acctbal = CAST(c_acctbal AS BIGINT) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END AS text FROM customer")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.number_text(F.col("c_acctbal")).alias("text"))


# Names.


def _java_free(production: str, ascii_only: bool = True) -> str:
    return N.pattern(production, ascii_only=ascii_only)


_CASES = "(SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN replace(p_name, ' ', ':') WHEN 3 THEN p_size || p_type WHEN 4 THEN '-' || p_brand ELSE p_brand || ':x' END AS n FROM part)"


def name_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    n = F.when(k == 0, name).when(k == 1, F.replace(name, F.lit(" "), F.lit("_"))).when(k == 2, F.replace(name, F.lit(" "), F.lit(":"))).when(k == 3, F.concat(F.col("p_size").cast("string"), "p_type")).when(k == 4, F.concat(F.lit("-"), "p_brand")).otherwise(F.concat("p_brand", F.lit(":x")))
    return table(spark, sf_dir, "part").select("p_partkey", n.alias("n"))


@query("SELECT p_partkey, " + ", ".join(f"regexp_full_match(n, '{_java_free(p)}') AS {c}" for p, c in (("name", "is_name"), ("ncName", "is_nc_name"), ("qName", "is_q_name"), ("nmToken", "is_nm_token"))) + f", regexp_full_match(n, '[:A-Z_a-z\\-.0-9]+(?:\\s+[:A-Z_a-z\\-.0-9]+)*') AS is_nm_tokens FROM {_CASES}")
def name_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return name_cases(spark, sf_dir).select("p_partkey", X.is_name(n).alias("is_name"), X.is_nc_name(n).alias("is_nc_name"), X.is_q_name(n).alias("is_q_name"), X.is_nm_token(n).alias("is_nm_token"), X.is_nm_tokens(n).alias("is_nm_tokens"))


_CLEAN = "regexp_replace(n, '[^A-Za-z0-9_\\-.:]', '_', 'g')"


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(c, '^[-.0-9]') THEN '_' || c ELSE c END AS name, CASE WHEN regexp_matches(replace(c, ':', ''), '^[-.0-9]') THEN '_' || replace(c, ':', '') ELSE replace(c, ':', '') END AS nc_name, c AS nm_token FROM (SELECT p_partkey, {_CLEAN} AS c FROM {_CASES})")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return name_cases(spark, sf_dir).select("p_partkey", X.sanitize(n).alias("name"), X.sanitize(n, "ncName").alias("nc_name"), X.sanitize(n, "nmToken").alias("nm_token"))


@query(f"SELECT p_partkey, CASE WHEN regexp_full_match(n, '{_java_free('qName')}') THEN n WHEN regexp_matches({_CLEAN}, '^[-.0-9]') THEN '_' || {_CLEAN} ELSE {_CLEAN} END AS name FROM {_CASES}")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_cases(spark, sf_dir).select("p_partkey", X.resolve_name(F.col("n")).alias("name"))


@query(f"""
SELECT p_partkey, regexp_full_match(n, '{_java_free("qName")}') AS valid,
  CASE WHEN regexp_full_match(n, '{_java_free("qName")}') THEN NULL WHEN starts_with(n, ':') THEN 'QName cannot start with a colon' WHEN ends_with(n, ':') THEN 'QName cannot end with a colon'
    WHEN length(n) - length(replace(n, ':', '')) > 1 THEN 'QName can have at most one colon' WHEN NOT regexp_matches(n, '^[:A-Za-z_]') THEN 'First character "' || n[1] || '" is not a valid NameStartChar'
    WHEN good < length(n) THEN 'Character "' || n[good + 1] || '" at position ' || good || ' is not a valid NameChar' ELSE 'Does not match the production rules' END AS reason
FROM (SELECT p_partkey, n, length(regexp_extract(n, '^[A-Za-z0-9_\\-.:]*')) AS good FROM {_CASES})""")
def validate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.validate(F.col("n"), "qName")
    return name_cases(spark, sf_dir).select("p_partkey", v["valid"].alias("valid"), v["reason"].alias("reason"))


@query("SELECT k, starts_with(k, '@') AND length(k) > 1 AS attribute, substr(k, 2) AS name, k = '#text' AS text FROM (SELECT unnest(['@id', '@', '#text', 'a', '@@', '']) AS k)")
def key_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "region").limit(1).select(F.explode(F.array(*map(F.lit, ["@id", "@", "#text", "a", "@@", ""]))).alias("k"))
    return keys.select("k", X.is_attribute_key(F.col("k")).alias("attribute"), X.attribute_name(F.col("k")).alias("name"), X.is_text_key(F.col("k")).alias("text"))


# Text: escaping and entities.


@query(f"SELECT doc_id, {sql_escaped('text')} AS text, {sql_escaped('text', True)} AS attribute FROM documents")
def escape_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.escape_text("text").alias("text"), X.escape_attribute("text").alias("attribute"))


@query("SELECT doc_id, text FROM documents")
def decode_entities_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.decode_entities(X.escape_attribute("text")).alias("text"))


_N = "p_partkey % 7"


@query(f"SELECT p_partkey, CASE WHEN {_N} <= 3 THEN repeat('x', CAST({_N} AS INTEGER)) || '&' END AS value, CASE WHEN {_N} > 3 THEN '[EntityReplacer] Entity expansion count limit exceeded: 4 > 3' END AS message FROM part")
def decode_entities_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansions of registered entities are counted, those of built-in ones are not."""
    text = F.concat(F.repeat(F.lit("&e;"), (F.col("p_partkey") % 7).cast("int")), F.lit("&amp;"))
    found = table(spark, sf_dir, "part").select("p_partkey", X.decode_entities_result(text, {"max_total_expansions": 3}, {"e": "x"}).alias("d"))
    return found.select("p_partkey", "d.value", F.col("d.error.message").alias("message"))


@query("SELECT n_nationkey, n_name || ' ' || n_regionkey || ' &other;' AS value FROM nation")
def decode_entities_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that a row brings along."""
    own = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.decode_entities_result(F.lit("&name; &region; &other;"), input_entities=own)["value"].alias("value"))


# Parsing and trees.

_TRIM = N.ranges(N.SPACE, java=True)


@query(f"SELECT doc_id, lang, regexp_replace(text, '^[{_TRIM}]+|[{_TRIM}]+$', '', 'g') AS text FROM documents")
def parse_roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select(DOCUMENT.decode(encoded_documents(df)).alias("d")).select("d.value.doc_id", F.col("d.value.`@lang`").alias("lang"), "d.value.text")


@query("SELECT page_id, 'Attribute \"html\" has no \"=\"' AS message, CAST(14 AS INTEGER) AS position FROM pages")
def parse_errors_doctype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lower-case document type is no document type: it is read as an element, whose first attribute has no value."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<!doctype html>"), "html").alias("html"))
    return pages.select("page_id", X.parse_xml("html").alias("p")).select("page_id", F.col("p.error.message").alias("message"), F.col("p.error.position").alias("position"))


@query()
def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages through the parser: a tree or an error for each."""
    parsed = table(spark, sf_dir, "pages").select("page_id", X.parse_xml("html").alias("p"))
    return parsed.select("page_id", "p.name", "p.value", F.col("p.error.message").alias("message"), F.col("p.error.position").alias("position"))


@query(f"SELECT event_id, '<event id=\"' || event_id || '\"><type>' || {sql_escaped('event_type')} || '</type></event>' AS xml, true AS is_value FROM events")
def render_tree_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = F.to_json(F.struct(F.col("event_id").cast("string").alias("@id"), F.col("event_type").alias("type")))
    return table(spark, sf_dir, "events").select("event_id", X.render_xml(tree, root_name="event")["value"].alias("xml"), X.is_xml_value(tree).alias("is_value"))


@query("SELECT * FROM (VALUES ('\"a\"', true), ('[]', true), ('{\"a\":[\"b\",{}]}', true), ('1', false), ('null', false), ('{\"a\":null}', false), ('{\"a\":true}', false), ('x', false)) AS t(v, ok)")
def is_xml_value_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = ['"a"', "[]", '{"a":["b",{}]}', "1", "null", '{"a":null}', '{"a":true}', "x"]
    rows = table(spark, sf_dir, "region").limit(1).select(F.explode(F.array(*map(F.lit, cases))).alias("v"))
    return rows.select("v", X.is_xml_value("v").alias("ok"))


# Typed decoding.

TYPED = XmlCodec("`@id` bigint, status string, total double, urgent boolean, note string", "order")


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(CASE WHEN starts_with(o_orderpriority, '1') THEN 1 ELSE 0 END) AS BIGINT) AS urgent FROM orders GROUP BY 1")
def codec_orders_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.struct(F.col("o_orderkey").alias("@id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").startswith("1").alias("urgent"), F.lit("").alias("note"))
    back = table(spark, sf_dir, "orders").select(TYPED.decode(TYPED.encode(v)).alias("d")).select("d.value.*")
    cents = F.sum(F.round(F.col("total") * 100).cast("long"))
    return back.groupBy(F.col("status").alias("o_orderstatus")).agg(F.count("*").alias("n"), F.sum("@id").alias("keys"), cents.alias("cents"), F.sum(F.col("urgent").cast("long")).alias("urgent"))


@query("SELECT p_partkey, p_name AS title, NULL::VARCHAR AS message FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL, 'the field \"title\" wants a plain value, but the element also carries the child element \"b\"; only attributes are discarded alongside #text' FROM part WHERE p_partkey % 2 = 1")
def plain_value_with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = XmlCodec("title string", "book")
    text = F.concat(F.lit('<book><title lang="en">'), X.escape_text("p_name"), F.when(F.col("p_partkey") % 2 == 1, "<b/>").otherwise(""), F.lit("</title></book>"))
    return table(spark, sf_dir, "part").select("p_partkey", codec.decode(text).alias("d")).select("p_partkey", "d.value.title", F.col("d.error.message").alias("message"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN 'Missing key at \"seg\"' END AS message FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, NULL, 'Missing key at \"seg\"' FROM customer WHERE c_custkey % 5 = 0")
def optional_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = XmlCodec(fields(field("name", "string", optional=True), field("seg", "string"), field("@id", "bigint")), "c")
    v = F.struct(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("seg"), F.col("c_custkey").alias("@id"))
    return table(spark, sf_dir, "customer").select("c_custkey", codec.decode(codec.encode(v)).alias("d")).select("c_custkey", "d.value.name", F.col("d.error.message").alias("message"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS kind FROM events")
def literal_enum_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = XmlCodec(fields(field("kind", "string", enum=["click", "view"])), "e")
    return table(spark, sf_dir, "events").select("event_id", codec.decode(XmlCodec("kind string", "e").encode(F.struct(F.col("event_type").alias("kind")))).alias("d")).select("event_id", "d.value.kind")


# Namespaces.

SOAP, SHOP, AUTH = "http://schemas.xmlsoap.org/soap/envelope/", "urn:shop", "urn:auth"
ENVELOPE = XmlCodec(
    fields(
        field("Header", fields(field("Token", "string", namespace=AUTH, prefix="auth")), namespace=SOAP, prefix="soap", optional=True),
        field("Body", fields(field("Customer", fields(field("key", "bigint"), field("name", "string")), namespace=SHOP)), namespace=SOAP, prefix="soap"),
    ),
    "Envelope",
    root={"xmlNamespace": SOAP, "xmlPrefix": "soap"},
)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("c_custkey") % 2 == 0, F.struct(F.col("c_mktsegment").alias("Token")))
    body = F.struct(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).alias("Customer"))
    return table(spark, sf_dir, "customer").select("c_custkey", ENVELOPE.encode(F.struct(header.alias("Header"), body.alias("Body"))).alias("xml"))


@query(f"SELECT c_custkey, '<soap:Envelope xmlns:soap=\"{SOAP}\">' || CASE WHEN c_custkey % 2 = 0 THEN '<soap:Header><auth:Token xmlns:auth=\"{AUTH}\">' || c_mktsegment || '</auth:Token></soap:Header>' ELSE '' END || '<soap:Body><Customer xmlns=\"{SHOP}\"><key>' || c_custkey || '</key><name>' || c_name || '</name></Customer></soap:Body></soap:Envelope>' AS xml FROM customer")
def ns_soap_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes(spark, sf_dir)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS token, c_custkey AS key, c_name AS name FROM customer")
def ns_foreign_prefix_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that bind the namespace to another prefix."""
    foreign = F.replace(F.replace("xml", F.lit("soap:"), F.lit("s:")), F.lit("xmlns:soap="), F.lit("xmlns:s="))
    back = envelopes(spark, sf_dir).select("c_custkey", ENVELOPE.decode(foreign).alias("d"))
    return back.select("c_custkey", F.col("d.value.Header.Token").alias("token"), "d.value.Body.Customer.key", "d.value.Body.Customer.name")


@query("SELECT n_nationkey, 1 AS items, n_name AS first FROM nation")
def xml_name_array_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = XmlCodec(fields(field("items", T.ArrayType(fields(field("v", "string"))), xml_name="item")), "r")
    v = F.struct(F.array(F.struct(F.col("n_name").alias("v"))).alias("items"))
    return table(spark, sf_dir, "nation").select("n_nationkey", codec.decode(codec.encode(v)).alias("d")).select("n_nationkey", F.size("d.value.items").alias("items"), F.col("d.value.items")[0]["v"].alias("first"))


# Composition with what Spark brings.


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def aggregate_decoded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders written as documents, read again with only the fields that are wanted, and summed up."""
    single = XmlCodec(ORDER.schema, "order", array_from_single=True)
    xml = orders_with_lines(spark, sf_dir).where("v.line is not null").select(ORDER.encode("v").alias("xml"))
    line = xml.select(single.decode("xml", fields=["@id", "line.qty", "line.flag"]).alias("d")).select(F.col("d.value.`@id`").alias("id"), F.explode("d.value.line").alias("line"))
    return line.groupBy(F.col("line.flag").alias("l_returnflag")).agg(F.count("*").alias("n"), F.sum("line.qty").alias("quantity"), F.countDistinct("id").alias("orders"))


@query("SELECT conv_id, '<conversation id=\"' || conv_id || '\">' || string_agg('<turn role=\"' || " + sql_escaped("role", True) + " || '\">' || " + sql_escaped("text") + " || '</turn>', '' ORDER BY turn) || '</conversation>' AS xml FROM conversations WHERE text <> '' GROUP BY conv_id")
def encode_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = XmlCodec(fields(field("@id", "bigint"), field("turn", T.ArrayType(fields(field("role", "string", attribute=True), field("said", "string", value=True))))), "conversation")
    turns = table(spark, sf_dir, "conversations").where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("said")))).alias("turns"))
    v = F.struct(F.col("conv_id").alias("@id"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["said"].alias("said"))).alias("turn"))
    return turns.select("conv_id", codec.encode(v).alias("xml"))
