"""``XmlCodec``: typed structs to XML text and back, under a declared schema."""

from __future__ import annotations

import logging
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..core import decode as D
from ..core.parser import XmlParseError, parse_document
from ..functions.xml import observed, pieces
from ..plans.encode import Encoder, RenderOptions
from ..plans.schema import SINGLE_KEY, plan, pruned, types

ERROR = "struct<tag:string,message:string,position:int>"
MODES = ("PERMISSIVE", "FAILFAST", "DROPMALFORMED")


class XmlCodec:
    """Compiled once on the driver; an invalid schema raises there.

    ``root``: annotations of the root element (``xmlNamespace``, ``xmlPrefix``, ``xmlName``, ``identifier``, ``title``).
    ``array_from_single``: every array also reads a single element.
    Rendering options: item_name, format, indent, suppress_empty_node, sort_keys, name, xml_version, max_depth.
    Parsing options: preserve_whitespace, and name, xml_version, max_depth as well.
    """

    def __init__(self, schema: T.DataType | str, root_name: str | None = None, *, root: dict[str, Any] | None = None, preserve_whitespace: bool = False, array_from_single: bool = False, **render: Any):
        self.schema = types(schema) if isinstance(schema, str) else schema
        if array_from_single:
            self.schema = _single(self.schema)
        self.root_name, self.root, self.preserve = root_name, root, preserve_whitespace
        self.options = RenderOptions(**render)
        self.plan = plan(self.schema, root_name, root)

    def encode(self, value: Column | str) -> Column:
        """XML text of a struct column: built-in expressions only.  Null for null."""
        return Encoder(self.plan, self.options).document(F.col(value) if isinstance(value, str) else value)

    def encode_fields(self) -> Column:
        """XML text of the columns that the schema names."""
        return self.encode(F.struct(*[F.col(f"`{f.name}`") for f in self.schema.fields]))

    def decode(self, text: Column | str, fields: list[str] | None = None, log: bool = False) -> Column:
        """struct(value, error); one of them is null, both for a null text.

        ``fields`` keeps only these of the schema.  ``log`` writes each failure to the worker's log.  A column that is not
        text is refused.  Documents are read once even where a filter and a projection both use the result; for that,
        filters on other columns are not moved before it (``decode_frame`` does move them).
        """
        return self._function(fields, log).asNondeterministic()(F.col(text) if isinstance(text, str) else text)

    def _function(self, fields: list[str] | None, log: bool):
        schema = self.schema if fields is None else pruned(self.schema, fields)
        compiled = plan(schema, self.root_name, self.root) if fields is not None else self.plan
        returned = T.StructType([T.StructField("value", _bare(schema)), T.StructField("error", types(ERROR))])
        arrow = to_arrow_type(returned)
        options = {"preserve_whitespace": self.preserve, "max_depth": self.options.max_depth, "name": self.options.name, "xml_version": self.options.xml_version}
        node, active = compiled.root, compiled.active

        def read(documents: pa.Array) -> pa.Array:
            if not (pa.types.is_string(documents.type) or pa.types.is_large_string(documents.type) or pa.types.is_null(documents.type)):
                raise TypeError(f"Expected a string, but received {documents.type}.")
            quick = D.reader(node)

            def one(document: str | None) -> dict | None:
                if document is None:
                    return {"value": None, "error": None}
                try:
                    _, tree = parse_document(document, **options)
                    return {"value": D.read_typed(D.resolve_names(tree, node, {}) if active else tree, node, quick), "error": None}
                except XmlParseError as e:
                    error = {"tag": "XmlParseError", "message": e.message, "position": e.position}
                except D.DecodeError as e:
                    error = {"tag": "SchemaError", "message": str(e), "position": None}
                if log:
                    logging.getLogger("xmlframe").error("XML parse error: %s", error["message"])
                return {"value": None, "error": error}

            # Trees and values are held for a piece at a time.
            return pa.concat_arrays([pa.array([], arrow), *(pa.array([one(d) for d in some.to_pylist()], arrow) for (some,) in pieces(documents))])

        return F.arrow_udf(read, returned)

    def decode_frame(self, df: DataFrame, text: str, to: str = "value", mode: str = "PERMISSIVE", fields: list[str] | None = None, observe: Observation | None = None, log: bool = False) -> DataFrame:
        """``df`` with the decoded ``to``.

        PERMISSIVE adds ``<to>_error``; DROPMALFORMED drops rows that fail; FAILFAST stops the query at the first.
        ``observe`` collects the number of documents and failures, and their length in UTF-16 units; filters stay behind it.

        The result comes out of a generator of one row, which Spark neither merges with what reads it, so that a document is
        read once, nor keeps filters on other columns behind, so that they reach the scan.
        """
        if mode not in MODES:
            raise ValueError(f"Unknown mode {mode!r}. Must be one of: {', '.join(MODES)}")
        if not isinstance(df.schema[text].dataType, T.StringType):
            raise TypeError(f"Expected a string, but received {df.schema[text].dataType.simpleString()}.")
        found = "_xml"
        while found in df.columns:
            found += "_"
        out = df.select("*", F.explode(F.array(self._function(fields, log)(F.col(f"`{text}`")))).alias(found))
        error = F.col(f"{found}.error")
        if observe is not None:
            out = observed(out, observe, F.col(f"`{text}`"), error)
        if mode == "DROPMALFORMED":
            out = out.where(error.isNull())
        if mode == "FAILFAST":
            value = F.when(error.isNull(), F.col(f"{found}.value")).otherwise(F.raise_error(F.concat(F.lit("XML parse error: "), F.col(f"{found}.error.message"))))
            return out.withColumn(to, value).drop(found)
        out = out.withColumn(to, F.col(f"{found}.value"))
        return (out.withColumn(f"{to}_error", error) if mode == "PERMISSIVE" else out).drop(found)


def _bare(kind: T.DataType) -> T.DataType:
    """The type without annotations."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _bare(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_bare(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), _bare(kind.valueType))
    return kind


def _single(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _single(f.dataType), f.nullable, {**f.metadata, **({SINGLE_KEY: True} if isinstance(f.dataType, T.ArrayType) else {})}) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_single(kind.elementType), kind.containsNull)
    return kind
