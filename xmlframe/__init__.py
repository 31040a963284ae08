"""XML as columnar data for Spark: typed structs from documents and back, and the functions they are made of."""

from .core.entities import ENTITY_ACTION, EntityDecoder
from .core.names import DEFAULT_ITEM_NAME, DEFAULT_ROOT_NAME, TEXT_KEY, ATTRIBUTE_PREFIX, XmlError
from .core.parser import XmlParseError
from .core.render import XmlRenderError
from .operators import XmlCodec
from .plans.schema import ATTRIBUTE_KEY, NAME_KEY, NAMESPACE_KEY, PREFIX_KEY, VALUE_KEY, field, plan

__all__ = [
    "ATTRIBUTE_KEY", "ATTRIBUTE_PREFIX", "DEFAULT_ITEM_NAME", "DEFAULT_ROOT_NAME", "ENTITY_ACTION", "EntityDecoder", "NAMESPACE_KEY", "NAME_KEY", "PREFIX_KEY", "TEXT_KEY", "VALUE_KEY",
    "XmlCodec", "XmlError", "XmlParseError", "XmlRenderError", "field", "plan",
]
