"""Exact top-k search by BM25 over an inverted index, with block-max WAND pruning.

Every partition is a shard (cut further where it is large) with an inverted index of its documents, cut into blocks of
consecutive documents.  Each posting list keeps its largest impact, and the largest in each block.

A query's floor is a score that its k-th best document is known to reach: from a bounded sample of the documents (SEED of
them) that is searched first, then from what was found so far.  The query's terms are put in order of how little their lists
can add for their length.  The pivot is where the bounds of the terms before it add up to LIGHT of the floor: a document that
holds only those cannot reach it.  So the lists from the pivot on are scored for all documents, and of the lists before it
only the blocks in which some document can still reach the floor with what the terms before the pivot add at most in that
block.  All other postings are skipped.  What is found is exact; how much is skipped depends on the data (README).

Document frequencies, the number of documents and their mean length are global, so scores of shards compare and merge exactly.
Texts are cut into words once: a table has each document's terms that any query has, as numbers, and their counts.  Queries
are taken in parts with at most QUERY_TERMS terms; parts are broadcast and run over that table one by one.  Only where the
queries have more than VOCABULARY different terms, each part numbers its own and reads the texts again.

Terms are words between ASCII white space, A-Z in lower case.  Scores are rounded to PLACES places before they are ranked,
so that ties do not hang on the order of a sum.

Defined results: null and empty texts match nothing and, as queries, return nothing; a query is not its own match; equal
scores go to the smaller doc_id; repeated rows of one id are one candidate each, repeated queries are asked once; rows with
a null id count in the statistics but are neither queries nor results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, arrow_schema, as_batch, mapped, prepare, share

K1, B = 1.2, 0.75
PLACES = 6
#: Documents of a block, and of a shard at most.
BLOCK, SHARD = 16, 16_384
#: Postings of a shard, about; a shard ends beyond it.
SHARD_POSTINGS = 6_000_000
#: Terms of the queries that are broadcast at once.
QUERY_TERMS = 2_000_000
#: Different terms of queries that are numbered at once.
VOCABULARY = 4_000_000
#: Part of the floor that the terms before the pivot may reach.
LIGHT = 0.35
#: Documents of the sample that gives each query its first floor, about.
SEED = 4096


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(row, code, count) of each text's distinct terms, the terms, and the lengths of the texts."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, owner = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy().astype(np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(flat)
    terms = coded.dictionary.to_pylist()
    owner, code = owner[full], coded.indices.to_numpy()[full].astype(np.int64)
    both, n = np.unique(owner * max(1, len(terms)) + code, return_counts=True)
    return both // max(1, len(terms)), both % max(1, len(terms)), n, terms, np.bincount(owner, minlength=len(texts))


class Vocabulary:
    """Terms and their numbers, sent without the numbers."""

    def __init__(self, terms: pa.Array):
        self.terms, self._number = terms, None

    def __getstate__(self) -> pa.Array:
        return self.terms

    def __setstate__(self, terms: pa.Array) -> None:
        self.terms, self._number = terms, None

    def numbers(self, terms: list[str]) -> np.ndarray:
        """Of each term, -1 if it has none."""
        if self._number is None:
            self._number = {t: i for i, t in enumerate(self.terms.to_pylist())}
        get = self._number.get
        return np.array([get(t, -1) for t in terms], np.int64)


class Queries:
    """A part of the queries, their terms as numbers from 0 in order of the vocabulary's."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("doc_id").to_pylist()
        self.used = np.unique(rows.column("term").combine_chunks().flatten().to_numpy())
        self.terms = [np.searchsorted(self.used, x.values.to_numpy()) for x in rows.column("term")]
        self.weights = [x.values.to_numpy().astype(np.float64) for x in rows.column("n")]


def numbered(docs: DataFrame, held) -> DataFrame:
    """(doc_id, asked, words, term, n) of each of ``docs`` (doc_id, text, asked): numbers and counts of its terms that queries have."""

    def of(batch: pa.RecordBatch) -> dict:
        row, code, n, terms, lengths = counted(batch.column("text"))
        number = held.value.numbers(terms)[code] if terms else code
        keep = number >= 0
        row, number, n = row[keep], number[keep], n[keep]
        order = np.lexsort((number, row))
        cut = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(x[order], pa.int32())) for x in (number, n)]
        return {"doc_id": batch.column("doc_id"), "asked": batch.column("asked"), "words": pa.array(lengths, pa.int64()), "term": lists[0], "n": lists[1]}

    return mapped(docs, of, "doc_id long, asked boolean, words long, term array<int>, n array<int>")


def statistics(table: DataFrame, terms: int) -> tuple[np.ndarray, int, float]:
    """(document frequency of each of ``terms`` numbers, number of documents, mean length), over all documents."""
    to = arrow_schema("term long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents, words = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            total += np.bincount(batch.column("term").flatten().to_numpy(), minlength=terms)
            documents += batch.num_rows
            words += pc.sum(batch.column("words")).as_py() or 0
        at = np.flatnonzero(total)
        yield as_batch({"term": pa.array(np.r_[at, -1, -2]), "n": pa.array(np.r_[total[at], documents, words])}, to)

    rows = table.select("words", "term").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    term, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    frequency = np.zeros(terms, np.int64)
    frequency[term[term >= 0]] = n[term >= 0]
    documents, words = int(n[term == -1].sum()), int(n[term == -2].sum())
    return frequency, documents, words / max(1, documents)


def stretches(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and which range each is of."""
    size = end - begin
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + begin[of], of


class Shard:
    """Postings of some documents: by term, then document; entries are the stretches of one term in one block.

    ``doc``, ``term`` and ``impact`` come in order of documents.  ``scored`` of ``held`` postings of its queries were read.
    """

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        order = np.sort(term << 32 | np.arange(len(term))) & 0xFFFFFFFF  # by term, else as they came
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        term = term[order]
        block = self.doc // BLOCK
        new = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(block) != 0)]) if len(term) else np.empty(0, np.int64)
        self.begin, self.end = new, np.append(new[1:], len(term))
        self.block, self.most = block[new], np.maximum.reduceat(self.impact, new) if len(new) else np.empty(0)
        self.first = np.searchsorted(term[new], np.arange(terms + 1))
        self.run = np.append(new, len(term))[self.first]  # postings of term t: run[t] to run[t + 1]
        self.length = np.diff(self.run)
        self.top = np.zeros(terms)
        there = np.flatnonzero(self.length)
        if len(there):
            self.top[there] = np.maximum.reduceat(self.most, self.first[there])
        self.blocks = -(-len(ids) // BLOCK)
        self.scored = self.held = 0

    def search(self, own: int, terms: np.ndarray, weights: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of at least all documents that are among the k best here and reach ``floor``."""
        here = self.length[terms] > 0
        terms, weights = terms[here], weights[here]
        bound = self.top[terms] * weights
        if not len(terms) or bound.sum() < floor - 10.0**-PLACES:
            return np.empty(0), np.empty(0, np.int64)
        size = self.length[terms]
        order = np.argsort(bound / size, kind="stable")
        pivot = int(np.searchsorted(np.cumsum(bound[order]), LIGHT * floor))
        before, after = order[:pivot], order[pivot:]
        total = self._whole(terms[after], weights[after])
        self.held += int(size.sum())
        self.scored += int(size[after].sum())
        if pivot:
            entry, of = stretches(self.first[terms[before]], self.first[terms[before] + 1])
            weight, block = weights[before][of], self.block[entry]
            more = np.bincount(block, weights=self.most[entry] * weight, minlength=self.blocks)
            # Documents that stay below have less than the floor as they are, so that they need not be told apart later.
            alive = np.flatnonzero(total + np.repeat(more, BLOCK)[: len(total)] >= floor - 2 * 10.0**-PLACES)
            open_ = np.zeros(self.blocks, bool)
            open_[alive // BLOCK] = True
            mine = np.flatnonzero(open_[block])
            posting, part = stretches(self.begin[entry[mine]], self.end[entry[mine]])
            total += np.bincount(self.doc[posting], weights=self.impact[posting] * weight[mine][part], minlength=len(total))
            self.scored += len(posting)
        return self._best(own, total, k, floor)

    def _whole(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of all documents by these terms, whose lists are read run by run."""
        runs = list(zip(self.run[terms].tolist(), self.run[terms + 1].tolist()))
        if not runs:
            return np.zeros(len(self.ids))
        impact = np.concatenate([self.impact[a:b] for a, b in runs])
        impact *= np.repeat(weights, self.length[terms])
        return np.bincount(np.concatenate([self.doc[a:b] for a, b in runs]), weights=impact, minlength=len(self.ids))

    def _best(self, own: int, total: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rounded scores, ids) of documents that reach ``floor`` and the k-th best score, ties with it included."""
        hit = np.flatnonzero(total > max(0.0, floor - 10.0**-PLACES))
        hit = hit[self.ids[hit] != own]
        if len(hit) > k:
            least = np.partition(total[hit], -k)[-k] - 10.0**-PLACES  # rounding may bring others level
            hit = hit[total[hit] >= least]
        return np.round(total[hit], PLACES), self.ids[hit]


def search(table: DataFrame, held, stats, k: int) -> DataFrame:
    """(query_id, doc_id, score): the best k of each partition of ``numbered`` for each query, those below its floor left out."""
    from .ann import Best

    to = arrow_schema("query_id long, doc_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, (idf, mean, floors) = held.value, stats.value
        to_own = np.full(int(queries.used[-1]) + 2, -1)  # the last for all numbers beyond
        to_own[queries.used] = np.arange(len(queries.used))
        best = Best(len(queries.ids), k)
        kept: list[tuple] = []
        documents = postings = 0

        def flush() -> None:
            ids = np.concatenate([x[0] for x in kept])
            shard = Shard(ids, *(np.concatenate([x[i] for x in kept]) for i in (1, 2, 3)), len(queries.used))
            for q, (own, terms, weights) in enumerate(zip(queries.ids, queries.terms, queries.weights)):
                floor = max(best.score[q, -1], floors[q])
                score, found = shard.search(own, terms, weights, k, floor)
                if len(score):
                    best.add(q, score, found)

        for batch in batches:
            if not batch.num_rows:
                continue
            term, lengths = batch.column("term"), batch.column("words").to_numpy()
            row, number = pc.list_parent_indices(term).to_numpy().astype(np.int64), to_own[np.minimum(term.flatten().to_numpy(), len(to_own) - 1)]
            keep = number >= 0
            row, number, tf = row[keep], number[keep], batch.column("n").flatten().to_numpy()[keep].astype(np.float64)
            impact = idf[number] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / max(mean, 1e-9)))
            kept.append((batch.column("doc_id").to_numpy(), row + documents, number, impact))
            documents += batch.num_rows
            postings += len(row)
            if documents >= SHARD or postings >= SHARD_POSTINGS:
                flush()
                kept, documents, postings = [], 0, 0
        if kept:
            flush()
        q, r = np.nonzero(best.score > -np.inf)
        yield as_batch({"query_id": pa.array(np.array(queries.ids, np.int64)[q]), "doc_id": pa.array(best.id[q, r]), "score": pa.array(best.score[q, r])}, to)

    return table.select("doc_id", "words", "term", "n").mapInArrow(run, "query_id long, doc_id long, score double")


def first_floors(seeds: DataFrame, ids: list[int], k: int) -> np.ndarray:
    """For each query the k-th best score of what was found in the sample: a number for each query of the part."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    rows = seeds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", "score").toArrow()
    at = {q: i for i, q in enumerate(ids)}
    out = np.full(len(ids), -np.inf)
    for q, s in zip(rows.column("query_id").to_pylist(), rows.column("score").to_pylist()):
        out[at[q]] = s
    return out


def top_documents(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row with ``is_query``, its whole text as query: query_id, rank (from 1), doc_id, score."""
    spark = df.sparkSession
    prepare(spark)
    tables = Tables(spark, "topk")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(is_query, F.lit(False)).alias("asked"))

    def terms_of(batch: pa.RecordBatch) -> dict:
        row, code, _, terms, _ = counted(batch.column("text"))
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        return {"doc_id": batch.column("doc_id"), "terms": [[terms[c] for c in code[a:b]] for a, b in zip(cut, cut[1:])]}

    asked = tables.put(mapped(docs.where("asked and doc_id is not null").select("doc_id", "text"), terms_of, "doc_id long, terms array<string>").where(F.size("terms") > 0))
    parts = math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / QUERY_TERMS)
    part_of = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(parts))
    few = not parts or asked.select(F.explode("terms").alias("t")).agg(F.count_distinct("t")).first()[0] <= VOCABULARY
    found = table = None
    for p in range(parts):
        if table is None or not few:
            mine = asked if few else asked.where(part_of == p)
            terms = mine.select(F.explode("terms").alias("t")).distinct().sort("t").toArrow().column("t").combine_chunks()
            if not len(terms):
                continue
            table = tables.put(numbered(docs, spark.sparkContext.broadcast(Vocabulary(terms))))
            frequency, documents, mean = statistics(table, len(terms))
            named = table.where("doc_id is not null")
            sample = tables.put(named.where(share(F.col("doc_id"), 29) < min(1.0, SEED / max(1, documents))).coalesce(spark.sparkContext.defaultParallelism))
        rows = named.where("asked").where(F.size("term") > 0).where(part_of == p).dropDuplicates(["doc_id"]).orderBy("doc_id").select("doc_id", "term", "n").toArrow()
        if not rows.num_rows:
            continue
        queries = Queries(rows)
        held = spark.sparkContext.broadcast(queries)
        idf = np.log1p((documents - frequency + 0.5) / (frequency + 0.5))[queries.used]
        floors = np.full(len(queries.ids), -np.inf)
        seeds = search(sample, held, spark.sparkContext.broadcast((idf, mean, floors)), k)
        floors = first_floors(seeds, queries.ids, k)
        # Many small partitions are read as fewer shards: each shard costs some work for each query.
        shards = max(spark.sparkContext.defaultParallelism, -(-documents // (SHARD // 2)))
        over = named.coalesce(shards) if named.rdd.getNumPartitions() > shards else named
        some = search(over, held, spark.sparkContext.broadcast((idf, mean, floors)), k)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def oracle_sql(k: int = 10, step: int = 100) -> str:
    """``top_documents(documents, doc_id % step == 0)`` in DuckDB."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex({low}, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY ALL),
len AS (SELECT doc_id, sum(n) AS l FROM tf GROUP BY doc_id),
g AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(l) FROM len) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, g GROUP BY term, docs),
q AS (SELECT doc_id AS query_id, term, n AS m FROM tf WHERE doc_id % {step} = 0),
s AS (SELECT query_id, tf.doc_id, round(sum(m * idf * n * {K1 + 1} / (n + {K1} * ({1 - B} + {B} * l / mean))), {PLACES}) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.doc_id = tf.doc_id, g WHERE tf.doc_id <> query_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {k}"""
