"""One query for each operator of this subpackage, over whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, linededup, mixing, secrets, simhash, substring, topk, toxicity
from .common import prepare, read

#: Vocabulary file of the encoder; its folder is the installed package's.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


#: Target shares of the mixture's budget by language; sources and topics get the square roots of their own shares.
LANGUAGES = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15, "": 0.05}}
#: The mixture's size as a share of all words, and how often a document may be taken.
BUDGET, REPEATS = 0.5, 4
#: Steps in which the secret scan takes the documents, each with the ledger of those before.
STEPS = 2


def tokenizer() -> tuple[str, str]:
    """(path of the vocabulary, pre-token pattern)."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), *tokenizer(), with_ids=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"), LANGUAGES, budget=BUDGET, repeats=REPEATS).withColumn("rate", F.round("rate", 6))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_in_steps(read(spark, sf_dir, "documents"), STEPS)
    return secrets.report(found)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_documents(read(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        return run

    own = (op1_byte_bpe, op2_toxicity, op3_source_mixing, op4_secret_scan, op5_substring_dedup, op6_simhash, op7_language, op8_line_dedup, op9_nearest, op10_top_documents)
    return {f.__name__: ready(f) for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing.oracle_sql(LANGUAGES, BUDGET, REPEATS), "op4_secret_scan": secrets.oracle_sql(), "op5_substring_dedup": substring.oracle_sql(), "op10_top_documents": topk.oracle_sql()}
