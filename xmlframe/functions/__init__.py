"""Column functions."""

from .escape import escape_attribute, escape_text
from .names import attribute_name, is_attribute_key, is_name, is_nc_name, is_nm_token, is_nm_tokens, is_q_name, is_reserved_key, is_text_key, resolve_name, sanitize, validate
from .text import js_trim, number_text, scalar_text, utf16_length
from .xml import decode_entities, decode_entities_result, is_xml_value, parse_frame, parse_xml, render_xml, xml_value_or_error

__all__ = [
    "attribute_name", "decode_entities", "decode_entities_result", "escape_attribute", "escape_text", "is_attribute_key", "is_name", "is_nc_name", "is_nm_token", "is_nm_tokens",
    "is_q_name", "is_reserved_key", "is_text_key", "is_xml_value", "js_trim", "number_text", "parse_frame", "parse_xml", "render_xml", "resolve_name", "sanitize", "scalar_text", "utf16_length",
    "validate", "xml_value_or_error",
]
