from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from xmlframe import XmlError
from xmlframe import functions as X
from xmlframe.core import names as N

CASES = ["foo123", "-bar", "élément", "a b", "x:y", "1a", "a:b:c", ":x", "x:", "", "a\\b", "x\n", "😀a", "a😀 b", "×", "҇a", "a b", "a\tb  c", "̀abc", "·x", "a" * 1000]


@pytest.mark.parametrize("production", N.PRODUCTIONS)
def test_jvm_and_python_agree(spark, production):
    rows = spark.createDataFrame([(c,) for c in CASES], "n string")
    for version in ("1.0", "1.1"):
        for ascii_only in (False, True):
            found = rows.select("n", X.validate(F.col("n"), production, version, ascii_only).alias("v"), X.sanitize(F.col("n"), production, "_", ascii_only).alias("s")).collect()
            for r in found:
                assert r["v"].asDict() == N.validate(r["n"], production, version, ascii_only)
                assert r["s"] == N.sanitize(r["n"], production, "_", ascii_only)


@pytest.mark.parametrize(
    ("text", "production", "reason", "position"),
    [
        ("", "name", "Input is empty", None),
        ("a:b", "ncName", "Colon is not allowed in NCName", 1),
        (":a", "qName", "QName cannot start with a colon", 0),
        ("a:", "qName", "QName cannot end with a colon", 1),
        ("a:b:c", "qName", "QName can have at most one colon", 3),
        ("1a", "name", 'First character "1" is not a valid NameStartChar', 0),
        ("not a name", "ncName", 'Character " " at position 3 is not a valid NameChar', 3),
        ("a\\b", "name", "Does not match the production rules", None),
    ],
)
def test_reasons(text, production, reason, position):
    found = N.validate(text, production)
    assert (found["valid"], found["reason"], found["position"]) == (False, reason, position)


def test_versions_differ():
    assert not N.is_valid("×", "name") and N.is_valid("×", "name", "1.1")
    assert not N.is_valid("\U00010000", "name") and N.is_valid("\U00010000", "name", "1.1")
    assert N.is_valid("a҇", "name", "1.1") and not N.is_valid("҇a", "name", "1.1")


def test_unknown_production():
    with pytest.raises(XmlError, match='Unknown production "x". Must be one of: name, ncName, qName, nmToken, nmTokens'):
        N.sanitize("a", "x")


def test_resolve_modes(spark):
    assert N.resolve_name("not a name") == "not_a_name"
    assert N.resolve_name("not a name", "ignore") == "not a name"
    with pytest.raises(XmlError, match='Invalid XML name "not a name": '):
        N.resolve_name("not a name", "error")
    row = spark.createDataFrame([("ok", "not ok")], "a string, b string")
    assert row.select(X.resolve_name(F.col("a"), "error")).first()[0] == "ok"
    with pytest.raises(Exception, match="Invalid XML name"):
        row.select(X.resolve_name(F.col("b"), "error")).collect()
