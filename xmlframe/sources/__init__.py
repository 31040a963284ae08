"""Documents from and to files."""

from .files import read_documents, read_stream, write_documents

__all__ = ["read_documents", "read_stream", "write_documents"]
