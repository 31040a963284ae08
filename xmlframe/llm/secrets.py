"""Secret scan over an incremental blob ledger, with DataFrame functions only.

Every version of a text is content-addressed by SHA-256.  The ledger holds what a rule version found in a blob; only pairs
of blob and rule version that it lacks are scanned, each once, however many paths share the blob, and findings are joined
back to all paths.

Spans are in code points, end exclusive.  They come from splitting a text at a rule's matches: the lengths of the pieces
and of the matches, summed up in order, give each match's place.

Defined results: null text counts as empty; an empty text and one without secrets have no spans and the digest of the
empty string; repeated rows share one scan and each get the findings; an id with several texts is a path with as many
versions, each a row; rows with a null id are scanned like any other and keep the null; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, text_of


def either_case(pattern: str) -> str:
    """The pattern with each letter in either case, ASCII letters only, whatever the engine's idea of case."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches whose ``group`` is shorter than ``least`` are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: In the order that breaks ties between spans.  A minimum length of a trailing run of one class is part of the pattern
#: where that changes no match: what is left of a run that was too short is shorter still.
RULES = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", "AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", "[0-9a-f]{32,}", base=True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36,}"),
)
RULE_VERSION = "1"

FINDING = "array<struct<start:long,rule:int,kind:string,end:long>>"
LEDGER = f"blob string, rule_version string, findings {FINDING}"


def matches(text: Column, rule: Rule, number: int) -> Column:
    """Array of (rule, skip: length before the match since the last, n: its length, ok), or null where nothing matches."""
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    ok = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.least else found
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("skip"), F.transform(found, F.length).alias("n"), F.transform(ok, lambda x: F.length(x) >= rule.least).alias("ok"))
    out = F.transform(zipped, lambda x, i: F.struct(F.lit(number).alias("rule"), i.alias("i"), x["skip"].cast("long").alias("skip"), x["n"].cast("long").alias("n"), x["ok"].alias("ok")))
    return F.when(text.rlike(rule.pattern), out)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of ``blobs`` (blob, text): one for each blob, also where nothing is found."""
    hits = blobs.select("blob", F.explode(F.flatten(F.array_compact(F.array(*[matches(F.col("text"), r, i) for i, r in enumerate(rules)])))).alias("hit")).select("blob", "hit.*")
    order = Window.partitionBy("blob", "rule").orderBy("i")
    end = F.sum(F.col("skip") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    spans = hits.withColumn("end", end).where("ok").select("blob", F.struct((F.col("end") - F.col("n")).alias("start"), F.col("rule").cast("int").alias("rule"), kind.alias("kind"), "end").alias("span"))
    found = spans.groupBy("blob").agg(F.array_sort(F.collect_list("span")).alias("findings"))  # as long as one text allows
    none = F.array().cast(FINDING)
    return blobs.select("blob").join(found, "blob", "left").select("blob", F.lit(version).alias("rule_version"), F.coalesce("findings", none).alias("findings"))


def scan(df: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, findings) of every row, and the ledger with what was new, as a written table.

    A row is one version of the text at a path, so a path may have many rows.  ``ledger`` is one that an earlier call
    returned; its rows of other rule versions stay as they are.
    """
    spark = df.sparkSession
    tables = Tables(spark, "secrets")
    docs = text_of(df, id_col, text_col).withColumn("blob", F.sha2("text", 256))
    known = ledger if ledger is not None else empty_ledger(spark)
    # One path stands for each blob.  Digests alone are grouped; texts move once, dealt by path.
    least = docs.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    unseen = tables.put(least.join(known.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti"))
    blobs = docs.join(unseen.where("doc_id is not null").withColumnRenamed("blob", "of"), "doc_id").where(F.col("blob") == F.col("of")).select("blob", "text")
    # A path given twice with the same text has a row for each.
    blobs = blobs.dropDuplicates(["blob"]) if _repeats(df, id_col) else blobs
    # A blob that only rows without an id have is fetched by its digest.
    pathless = unseen.where("doc_id is null").select("blob")
    if pathless.take(1):
        blobs = blobs.unionByName(docs.where("doc_id is null").select("blob", "text").join(pathless, "blob", "left_semi").dropDuplicates(["blob"]))
    after = tables.put(known.unionByName(scan_blobs(blobs, rules, version)))
    tables.keep(after)
    current = after.where(F.col("rule_version") == version).select("blob", "findings")
    return docs.select("doc_id", "blob").join(current, "blob", "left"), after


def scan_in_steps(df: DataFrame, steps: int, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``scan`` of all rows in ``steps`` parts (by id), as they would arrive one after another: each part reads the ledger
    that the parts before it wrote, and scans only what that lacks."""
    ledger = None
    for k in range(steps):
        _, ledger = scan(df.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(steps)) == k), ledger, rules, version, id_col, text_col)
    docs = text_of(df, id_col, text_col).select("doc_id", F.sha2("text", 256).alias("blob"))
    return docs.join(ledger.where(F.col("rule_version") == version).select("blob", "findings"), "blob", "left"), ledger


def _repeats(df: DataFrame, id_col: str) -> bool:
    """Whether an id stands in more than one row."""
    return bool(df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).take(1))


def report(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, and all spans as text."""
    base = [i for i, r in enumerate(rules) if r.base]
    only = lambda keep: F.filter("findings", lambda x: x["rule"].isin(*keep))
    written = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(only([i])).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    return findings.select("doc_id", *counts, F.sha2(written(only(base)), 256).alias("base_sha256"), written(F.col("findings")).alias("spans"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def oracle_sql() -> str:
    """``report(scan(documents))`` in DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(RULES):
        p = q(r.pattern)
        ok = f"length(regexp_extract_all(t, {p}, {r.group})[i]) >= {r.least}" if r.least else "true"
        parts.append(
            f"SELECT doc_id, {i} AS rule, {q(r.kind)} AS kind, list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s, length(h[i]) AS n "
            f"FROM (SELECT doc_id, t, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, {p}) AS h FROM d)) WHERE {ok}"
        )
    spans = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, rule)"
    base = [i for i, r in enumerate(RULES) if r.base]
    counts = ", ".join(f"count(*) FILTER (rule = {i}) AS n_{RULES[i].kind}" for i in base)
    back = ", ".join(f"CAST(coalesce(n_{RULES[i].kind}, 0) AS BIGINT) AS n_{RULES[i].kind}" for i in base)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}), "
        f"g AS (SELECT doc_id, {counts}, coalesce({spans} FILTER (rule <= {max(base)}), '') AS b, {spans} AS spans FROM f GROUP BY doc_id) "
        f"SELECT d.doc_id, {back}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"
    )
