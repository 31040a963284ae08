"""Files of XML: a document a file, a document a line, or a JSON line for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, per: str = "file") -> DataFrame:
    """(path, document): one row for each file, with ``per="line"`` for each line that is not blank, with ``per="json"`` for
    each document that ``write_documents`` wrote."""
    return _rows(_reader(spark.read, path, per), per)


def read_stream(spark: SparkSession, path: str, per: str = "file") -> DataFrame:
    """The same as a stream of files that arrive."""
    return _rows(_reader(spark.readStream, path, per), per)


def write_documents(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """One document a line, as a JSON object with the field ``document``: line breaks anywhere in a document come back."""
    df.select(F.col(column).alias("document")).where("document is not null").write.mode(mode).json(path)


def _reader(read, path: str, per: str):
    return read.schema("document string").json(path) if _per(per) == "json" else read.text(path, wholetext=per == "file")


def _rows(lines: DataFrame, per: str) -> DataFrame:
    if per == "json":
        return lines.where("document is not null").select(F.input_file_name().alias("path"), "document")
    kept = lines.where(F.trim("value") != "") if per == "line" else lines
    return kept.select(F.input_file_name().alias("path"), F.col("value").alias("document"))


def _per(per: str) -> str:
    if per not in ("file", "line", "json"):
        raise ValueError(f"per must be 'file', 'line' or 'json', not {per!r}")
    return per
