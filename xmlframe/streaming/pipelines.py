"""Decoding documents as they arrive, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.codec import XmlCodec


def decoded_stream(documents: DataFrame, codec: XmlCodec, text: str = "document", mode: str = "PERMISSIVE") -> DataFrame:
    """A stream of decoded documents, failures beside them."""
    return codec.decode_frame(documents, text, mode=mode)


def windowed_counts(decoded: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of decoded rows in windows of event time; rows later than ``late`` are left out of a stream."""
    return decoded.withWatermark(time, late).groupBy(F.window(time, width), F.col(by)).count().select(F.col("window.start").alias("start"), by, "count")
