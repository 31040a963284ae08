"""Functions over whole documents, as Arrow-batched Python: they hold what built-in expressions cannot say.

Each call makes a function of its own, marked nondeterministic so that Spark evaluates it once for each row even where a
filter and a projection both use its result.  Filters on other columns belong before it.

An Arrow batch of long documents is large, and its Python objects and results are a multiple of that, so a function takes it
in pieces of PIECE bytes and gives back each piece's results before the next.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..core import entities as E
from ..core import parser as P
from ..core import render as R
from ..core.names import XmlError
from .text import utf16_length

PARSED = "name string, value string, error struct<message:string,position:int,input:string>"
DECODED = "value string, error struct<tag:string,message:string>"
RENDERED = "value string, error struct<message:string>"


#: Bytes of input, as Arrow has them, whose objects and results a function holds at a time; a longer row is a piece alone.
PIECE = 1 << 20


def pieces(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of a batch in slices of up to PIECE bytes together, or of one row."""
    left = [columns]
    while left:
        some = left.pop()
        n = len(some[0])
        if n > 1 and sum(c.nbytes for c in some) > PIECE:
            left += [tuple(c.slice(n // 2) for c in some), tuple(c.slice(0, n // 2) for c in some)]
        elif n:
            yield some


def by_row(one: Callable, returned: T.DataType):
    """An Arrow function of one column, or of two, from a function of one row's values."""
    arrow = to_arrow_type(returned)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (column,) in pieces(batch):
                yield pa.array(map(one, column.to_pylist()), arrow)

    def run_two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for a, b in pieces(*batch):
                yield pa.array(map(one, a.to_pylist(), b.to_pylist()), arrow)

    return F.arrow_udf(run if one.__code__.co_argcount == 1 else run_two, returned)


def _once(one: Callable, schema: str, *cols: Column) -> Column:
    return by_row(one, T._parse_datatype_string(schema)).asNondeterministic()(*cols)


def to_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def observed(df: DataFrame, observe: Observation, text: Column, error: Column) -> DataFrame:
    """``df`` with metrics of its documents: their number, the failures, and their length in UTF-16 units, failed or not."""
    return df.observe(observe, F.count(F.lit(1)).alias("documents"), F.count(error).alias("failures"), F.sum(utf16_length(text)).alias("length"))


def parse_frame(df: DataFrame, text: str, to: str = "parsed", observe: Observation | None = None, **options) -> DataFrame:
    """``df`` with ``parse_xml`` of a column, and the metrics of ``observed``; filters on other columns go before the parser."""
    out = df.select("*", F.explode(F.array(_parser(**options)(F.col(f"`{text}`")))).alias(to))
    return out if observe is None else observed(out, observe, F.col(f"`{text}`"), F.col(f"`{to}`.error"))


def parse_xml(col: Column | str, preserve_whitespace: bool = False, max_depth: int = 256, name: str = "repair", xml_version: str = "1.0") -> Column:
    """struct(name, value, error): the root's name, and its tree as JSON text in document order.  Null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.isNotNull(), _parser(preserve_whitespace, max_depth, name, xml_version).asNondeterministic()(col))


def _parser(preserve_whitespace: bool = False, max_depth: int = 256, name: str = "repair", xml_version: str = "1.0"):
    def one(text: str | None) -> dict:
        if text is None:
            return {}
        try:
            root, value = P.parse_document(text, preserve_whitespace, max_depth, name, xml_version)
            return {"name": root, "value": to_json(value)}
        except P.XmlParseError as e:
            return {"error": {"message": e.message, "position": e.position, "input": e.input}}

    return by_row(one, T._parse_datatype_string(PARSED))


def render_xml(col: Column | str, **options) -> Column:
    """struct(value, error): XML text of a tree given as JSON text."""
    R.Renderer(**options)

    def one(text: str | None) -> dict:
        if text is None:
            return {}
        try:
            return {"value": R.render_xml(json.loads(text), **options)}
        except (R.XmlRenderError, ValueError) as e:
            return {"error": {"message": str(e)}}

    return _once(one, RENDERED, F.col(col) if isinstance(col, str) else col)


def decode_entities_result(col: Column | str, policy: Mapping | None = None, external: Mapping | None = None, input_entities: Column | None = None) -> Column:
    """struct(value, error) of a text, or of an array of texts that share one budget (value: JSON array).

    ``policy`` holds the options of ``EntityDecoder``; each row is a document, so its counters begin at zero.
    """
    checked = E.EntityDecoder.make(policy or {})
    checked.set_external_entities(external)  # names and hooks are checked when the query is made
    policy, external = dict(policy or {}), dict(external or {})

    def one(text, entities) -> dict:
        if text is None:
            return {}
        decoder = E.EntityDecoder(**policy)
        try:
            decoder.set_external_entities(external)
            if entities is not None:
                decoder.add_input_entities(dict(entities))
            return {"value": decoder.decode(text) if isinstance(text, str) else to_json([decoder.decode(t) for t in text])}
        except XmlError as e:
            return {"error": {"tag": e.tag, "message": e.message}}

    given = input_entities if input_entities is not None else F.lit(None).cast("map<string,string>")
    return _once(one, DECODED, F.col(col) if isinstance(col, str) else col, given)


def decode_entities(col: Column | str) -> Column:
    """Built-in entities and numeric references to text, the rest as it is.

    Only texts with a numeric reference go to Python.  In others the five entities are replaced one after another, the
    ampersand last, so that what it makes is not read again.
    """

    def one(text: str | None) -> str | None:
        return text if text is None else E.decode_default(text)

    col = F.col(col) if isinstance(col, str) else col
    named = col
    for entity, character in sorted(E.PREDEFINED.items(), key=lambda e: e[0] == "amp"):
        named = F.replace(named, F.lit(f"&{entity};"), F.lit(character))
    numeric = col.contains("&#")
    return F.when(numeric, _once(one, "string", F.when(numeric, col))).when(col.contains("&"), named).otherwise(col)


def is_xml_value(col: Column | str) -> Column:
    """Whether JSON text is a tree of strings, arrays and objects only; null is absence, which is one."""

    def one(text: str | None) -> bool:
        try:
            return text is None or R.is_xml_value(json.loads(text))
        except (ValueError, RecursionError):
            return False

    return F.coalesce(_once(one, "boolean", F.col(col) if isinstance(col, str) else col), F.lit(True))


def xml_value_or_error(col: Column) -> Column:
    """The JSON text itself; a value that is not a tree stops the query."""
    return F.when(is_xml_value(col), col).otherwise(F.raise_error(F.lit("Expected an XML value")))
