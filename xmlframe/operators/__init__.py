"""Operators over frames: the codec between typed structs and documents."""

from .codec import XmlCodec

__all__ = ["XmlCodec"]
