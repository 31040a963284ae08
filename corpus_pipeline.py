"""A training corpus from raw documents: five stages, each a table that the next one reads.

Language ID drops documents in no language; fuzzy line dedup cuts repeated lines from the texts; SimHash keeps one document
of each group of near duplicates; raking samples the documents to target shares of source, language and topic; byte-level
BPE encodes what is left.

Defined results: documents with a null doc_id go through all stages like any other and keep the null; a stage that needs a
key makes one of their text.  Null texts are in no language and go first.  More columns than those used here, whatever their
names, stay until the last stage.  Rows of one doc_id stay or go together.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xmlframe.llm import bpe, langid, linededup, mixing, simhash
from xmlframe.llm.common import Tables, dropping, prepare, read
from xmlframe.llm.queries import tokenizer

#: Share of the words that the mixture keeps.
KEEP = 0.5


def key() -> Column:
    """A row's key: the doc_id, and for a row without one a number above 2^62 made of its text, so that equal texts share it."""
    of_text = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)
    return F.coalesce(F.col("doc_id").cast("long"), of_text)


def boxed(docs: DataFrame) -> DataFrame:
    """(row, key, and the columns that operators read): all columns of ``docs`` in one, so that no name can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), key().alias("key"), "doc_id", "text", "lang", "source")


def unboxed(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The boxed rows whose key is among those of ``kept`` (key), as they were."""
    return rows.select("row", "key").join(kept.distinct(), "key", "left_semi").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language; null texts and texts without a letter go."""
    return langid.known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated lines cut from their texts; n_chars follows the text."""
    kept = linededup.deduplicated(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, one without an id only if none has any.

    Rows without an id whose texts are equal are one document: one row of them stays.
    """
    rows = boxed(docs)
    if (nameless := rows.where("doc_id is null")).take(1):
        one = nameless.groupBy("key").agg(F.min("row").alias("row")).select("row.*")
        rows = boxed(docs.where("doc_id is not null").unionByName(one))
    found = simhash.near_duplicates(rows, "key").where("doc_id = component_id")
    return unboxed(rows, found.select(F.col("doc_id").alias("key")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn at their calibrated rates, each once: KEEP of all words, whatever the rarest cell."""
    rows = boxed(docs)
    drawn = mixing.mix_documents(rows, id_col="key", budget=KEEP).where("sampled")
    return unboxed(rows, drawn.select(F.col("doc_id").alias("key")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode_documents(docs, *tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mixture),
    ("byte_bpe", encode),
]

#: Kernel methods, MinHash, SimHash and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again.

    What a stage's operator wrote goes when the stage is done, and a stage's result when the next one has read it.
    """
    prepare(spark)
    tables = Tables(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with dropping(spark, tables):
            docs = tables.put(stage(spark, docs, sf_dir))
        tables.keep(docs)
    return docs
