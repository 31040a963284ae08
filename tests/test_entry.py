from __future__ import annotations

import pytest

from conftest import DATA, same_rows
from xmlframe import cases, queries as Q  # noqa: F401  (cases adds its queries)
from xmlframe.sources import read_documents, read_stream, write_documents
from xmlframe.streaming import decoded_stream, windowed_counts


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_say_what_sql_says(spark, duck, name):
    same_rows(Q.QUERIES[name](spark, DATA), duck, Q.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pages_parse_or_tell_why(spark):
    rows = Q.parse_pages(spark, DATA).collect()
    assert rows and all((r["value"] is None) != (r["message"] is None) for r in rows)


def test_line_breaks_come_back(spark, tmp_path):
    texts = ['<a\n b="1"><![CDATA[x\ny]]>\r\n</a>', "<b>1</b>", "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    write_documents(df, "x", str(tmp_path / "docs"))
    back = read_documents(spark, str(tmp_path / "docs"), "json")
    assert sorted(r["document"] for r in back.collect()) == sorted(texts)


def test_files_and_streams(spark, tmp_path):
    out = str(tmp_path / "docs")
    codec = Q.XmlCodec("id bigint, kind string, at timestamp", "e")
    rows = spark.sql("SELECT id, concat('a', chr(10), id % 2) kind, timestamp'2024-01-01' + make_interval(0,0,0,0,id) at FROM range(6)")
    from pyspark.sql import functions as F

    write_documents(rows.select(codec.encode(F.struct("id", "kind", "at")).alias("x")), "x", out)
    back = codec.decode_frame(read_documents(spark, out, "json"), "document")
    assert sorted(r["value"]["kind"] for r in back.collect()) == ["a\n0"] * 3 + ["a\n1"] * 3
    stream = decoded_stream(read_stream(spark, out, "json"), codec).select("value.*")
    running = windowed_counts(stream, "at", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    try:
        running.processAllAvailable()
        assert spark.table("counts").agg({"count": "sum"}).first()[0] == 6
    finally:
        running.stop()
    with pytest.raises(ValueError, match="per must be"):
        read_documents(spark, out, "word")
