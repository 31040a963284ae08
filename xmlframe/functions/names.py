"""Names, in the JVM: patterns from the same table as the Python ones, anchored at the very ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import names as N
from .text import utf16_length


def _is(col: Column, production: str, xml_version: str, ascii_only: bool) -> Column:
    return col.rlike(rf"\A(?:{N.pattern(production, xml_version, ascii_only, java=True)})\z")


def is_name(col: Column, xml_version: str = "1.0", ascii_only: bool = False) -> Column:
    return _is(col, "name", xml_version, ascii_only)


def is_nc_name(col: Column, xml_version: str = "1.0", ascii_only: bool = False) -> Column:
    return _is(col, "ncName", xml_version, ascii_only)


def is_q_name(col: Column, xml_version: str = "1.0", ascii_only: bool = False) -> Column:
    return _is(col, "qName", xml_version, ascii_only)


def is_nm_token(col: Column, xml_version: str = "1.0", ascii_only: bool = False) -> Column:
    return _is(col, "nmToken", xml_version, ascii_only)


def is_nm_tokens(col: Column, xml_version: str = "1.0", ascii_only: bool = False) -> Column:
    return _is(col, "nmTokens", xml_version, ascii_only)


def is_attribute_key(col: Column) -> Column:
    return col.startswith(N.ATTRIBUTE_PREFIX) & (F.length(col) > 1)


def attribute_name(col: Column) -> Column:
    return F.substring(col, 2, 2147483647)


def is_text_key(col: Column) -> Column:
    return col == N.TEXT_KEY


is_reserved_key = is_text_key


def sanitize(col: Column, production: str = "name", replacement: str = "_", ascii_only: bool = False) -> Column:
    N.check_production(production)
    kept = N.class_of(N.KEPT_ASCII if ascii_only else N.KEPT, java=True)
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    text = F.replace(col, F.lit(":"), F.lit("")) if production == "ncName" else col
    text = F.regexp_replace(text, f"[^{kept}]", literal)
    if production not in ("nmToken", "nmTokens"):
        text = F.when(text.rlike(r"\A[\-.0-9]"), F.concat(F.lit(replacement), text)).otherwise(text)
    return F.when(text == "", F.lit(replacement)).otherwise(text)


def resolve_name(col: Column, mode: str = "repair", xml_version: str = "1.0") -> Column:
    """The name to write; in ``error`` mode a name that is not legal stops the query."""
    if mode == "ignore":
        return col
    legal = is_q_name(col, xml_version)
    if mode == "error":
        refused = F.concat(F.lit("Invalid XML name "), F.get_json_object(F.to_json(F.struct(F.array(col).alias("a"))), "$.a").substr(F.lit(2), F.length(F.get_json_object(F.to_json(F.struct(F.array(col).alias("a"))), "$.a")) - 2), F.lit(": "), validate(col, "qName", xml_version)["reason"])
        return F.when(legal, col).otherwise(F.raise_error(refused))
    return F.when(legal, col).otherwise(sanitize(col))


def validate(col: Column, production: str, xml_version: str = "1.0", ascii_only: bool = False) -> Column:
    """struct(valid, production, input, reason, position); positions count UTF-16 code units."""
    valid = _is(col, production, xml_version, ascii_only)
    start, more = (r"[:A-Za-z_]", r"[A-Za-z0-9_\\\-.:]") if ascii_only else (r"[:A-Za-z_\x{C0}-\x{FFFD}\x{10000}-\x{10FFFF}]", r"[A-Za-z0-9_\\\-.:\x{B7}\x{C0}-\x{FFFD}\x{10000}-\x{10FFFF}]")
    before = lambda n: utf16_length(F.substring(col, F.lit(1), n))
    colon = F.instr(col, ":")
    last_colon = F.length(col) - F.instr(F.reverse(col), ":")
    good = F.length(F.regexp_extract(col, rf"\A(?:{more})*", 0))
    bad = F.substring(col, good + 1, F.lit(1))
    cases: list[tuple[Column, Column, Column]] = [(col == "", F.lit("Input is empty"), F.lit(None).cast("int"))]
    if production == "ncName":
        cases.append((colon > 0, F.lit("Colon is not allowed in NCName"), before(colon - 1)))
    if production == "qName":
        cases.append((col.startswith(":"), F.lit("QName cannot start with a colon"), F.lit(0)))
        cases.append((col.endswith(":"), F.lit("QName cannot end with a colon"), utf16_length(col) - 1))
        cases.append((F.regexp_count(col, F.lit(":")) > 1, F.lit("QName can have at most one colon"), before(last_colon)))
    if production in ("name", "ncName", "qName"):
        cases.append((~col.rlike(rf"\A{start}"), F.concat(F.lit('First character "'), F.substring(col, 1, 1), F.lit('" is not a valid NameStartChar')), F.lit(0)))
    cases.append((good < F.length(col), F.concat(F.lit('Character "'), bad, F.lit('" at position '), before(good).cast("string"), F.lit(" is not a valid NameChar")), before(good)))
    reason, position = F.lit("Does not match the production rules"), F.lit(None).cast("int")
    for when, text, at in reversed(cases):
        reason, position = F.when(when, text).otherwise(reason), F.when(when, at.cast("int")).otherwise(position)
    return F.when(col.isNotNull(), F.struct(valid.alias("valid"), F.lit(production).alias("production"), col.alias("input"), F.when(~valid, reason).alias("reason"), F.when(~valid, position).alias("position")))
