"""Streams: encoding and decoding keep no state between rows, so a codec works on a stream as it does on a table."""

from .pipelines import decoded_stream, windowed_counts

__all__ = ["decoded_stream", "windowed_counts"]
