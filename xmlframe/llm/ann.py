"""Approximate nearest neighbours by cosine, with score-aware anisotropic quantisation.

Unit vectors are quantised in subspaces of SUB dimensions with 16 centres each, so a code takes four bits.  Centres and
codes minimise |r|^2 + (ETA - 1) (r . x)^2 for the residual r of a vector x: residual error along the vector changes its
largest inner products and is penalised more.  A search looks up each code's tables, two codes a byte, over blocks of all
rows, and ranks the best RERANK of every block again by their exact cosine.

Centres are fitted on at most TRAIN vectors, drawn by id; every row is indexed.  Queries are broadcast in parts of at
most QUERY_BYTES.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
length than the most common (the shortest of equals); equal cosines go to the smaller id; repeated vectors are rows of
their own; a query with no candidate has no rows; rows with a null id take no part, as neither query nor candidate; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, arrow_schema, as_batch, mapped, prepare, share

SUB = 2
CENTRES = 16
ETA = 6.0
TRAIN = 8_000
SWEEPS = 8
RERANK = 192
#: Rows that are scanned together.
BLOCK = 8192
QUERY_BYTES = 32 << 20


class Codebook:
    """Centres of each subspace: array (subspaces, CENTRES, SUB)."""

    def __init__(self, unit: np.ndarray, seed: int = 5):
        self.dims = unit.shape[1]
        self.parts = -(-self.dims // SUB)
        self.parts += self.parts % 2  # two codes a byte
        x = self.padded(unit)
        n = len(x)
        draw = np.random.default_rng(seed)
        self.centres = x[draw.integers(0, n, CENTRES)].transpose(1, 0, 2).copy()
        self.centres += draw.normal(0, 1e-4, self.centres.shape)
        for _ in range(SWEEPS):
            code = self._encode(x)
            # Least squares for all centres at once: the penalty ties the subspaces together.
            width = self.parts * CENTRES * SUB
            rows = np.zeros((n, self.parts, CENTRES, SUB), np.float32)
            rows[np.arange(n)[:, None], np.arange(self.parts)[None, :], code] = x
            v = rows.reshape(n, width)
            used = np.zeros((self.parts, CENTRES))
            np.add.at(used, (np.arange(self.parts)[None, :], code), 1)
            a = (ETA - 1) * (v.T @ v).astype(np.float64)
            a[np.diag_indices(width)] += np.repeat(used.ravel(), SUB) + 1e-3
            whole = (x.reshape(n, -1) ** 2).sum(axis=1)
            b = (v * (1 + (ETA - 1) * whole)[:, None].astype(np.float32)).sum(axis=0, dtype=np.float64) + 1e-3 * self.centres.ravel()
            self.centres = np.linalg.solve(a, b).reshape(self.centres.shape)

    def padded(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros((len(unit), self.parts * SUB))
        out[:, : self.dims] = unit
        return out.reshape(len(unit), self.parts, SUB)

    def _encode(self, x: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest centres."""
        n = len(x)
        inner = np.einsum("nps,pcs->npc", x, self.centres)
        own = (x**2).sum(axis=2)
        square = own[:, :, None] - 2 * inner + (self.centres**2).sum(axis=2)[None]
        along = own[:, :, None] - inner  # (x - c) . x in each subspace
        code = square.argmin(axis=2)
        at = np.arange(n)
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(2):
            for p in range(self.parts):
                rest = total - along[at, p, code[:, p]]
                code[:, p] = (square[:, p] + (ETA - 1) * (rest[:, None] + along[:, p]) ** 2).argmin(axis=1)
                total = rest + along[at, p, code[:, p]]
        return code

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Bytes of two codes each."""
        code = self._encode(self.padded(unit)).astype(np.uint8)
        return code[:, 0::2] | code[:, 1::2] << 4

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """(queries, bytes of a code, 256): what each byte adds to a query's inner product."""
        inner = np.einsum("qps,pcs->qpc", self.padded(unit), self.centres)
        return (inner[:, 1::2, :, None] + inner[:, 0::2, None, :]).reshape(len(unit), self.parts // 2, 256).astype(np.float32)


def usable(vector: Column) -> Column:
    """Whether a vector can take part, its length apart."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = vector.cast("array<double>")
    return F.coalesce(vector.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows; each sum runs over one row's products in the same order wherever it stands."""
    return (queries * rows).sum(axis=1) / (np.sqrt((queries**2).sum(axis=1)) * np.sqrt((rows**2).sum(axis=1)))


def index(df: DataFrame, tables: Tables, id_col: str, vector_col: str) -> tuple[DataFrame, Codebook, int] | None:
    """(vec_id, embedding, code) of every row that takes part, the codebook, and the length of the vectors."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if lengths is None:
        return None
    dims, total = lengths
    rows = rows.where(F.size("embedding") == dims)
    sample = rows.where(share(F.col("vec_id"), 3) < min(1.0, 0.9 * TRAIN / total)).limit(TRAIN).orderBy("vec_id").select("embedding").toArrow().column(0).combine_chunks()
    learned = unit(matrix(sample, dims)) if len(sample) else unit(matrix(rows.limit(TRAIN).select("embedding").toArrow().column(0).combine_chunks(), dims))
    book = Codebook(learned)
    held = df.sparkSession.sparkContext.broadcast(book)

    def of(batch: pa.RecordBatch) -> dict:
        return {"vec_id": batch.column("vec_id"), "embedding": batch.column("embedding"), "code": [c.tobytes() for c in held.value.encode(unit(matrix(batch.column("embedding"), dims)))]}

    return tables.put(mapped(rows, of, "vec_id long, embedding array<double>, code binary")), book, dims


class Best:
    """The k best rows of each query so far: by score, then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score[query], score)), np.concatenate((self.id[query], ids))
        best = np.lexsort((i, -s))[: self.k]
        self.score[query], self.id[query] = s[best], i[best]


def search(indexed: DataFrame, book: Codebook, dims: int, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each partition for each query."""
    held = indexed.sparkSession.sparkContext.broadcast((book.tables(unit(queries)), query_ids, queries))
    to = arrow_schema("query_id long, vec_id long, score double")

    def scan(best: Best, ids: np.ndarray, vectors: np.ndarray, code: np.ndarray) -> None:
        tables, query_ids, queries = held.value
        order = np.argsort(ids, kind="stable")
        ids, vectors, code = ids[order], vectors[order], code[order]
        few = min(len(ids), RERANK + k + 1)
        for q0 in range(0, len(query_ids), 256):
            part = tables[q0 : q0 + 256]
            total = np.zeros((len(part), len(ids)), np.float32)
            for b in range(code.shape[1]):
                total += part[:, b, :][:, code[:, b]]
            # Equal estimates go to the smaller id: rows are in order of ids, and the sort is stable where it matters.
            floor = np.partition(total, len(ids) - few, axis=1)[:, len(ids) - few]
            for i in range(len(part)):
                above = np.flatnonzero(total[i] > floor[i])
                level = np.flatnonzero(total[i] == floor[i])[: few - len(above)]
                rows = np.concatenate((above, level))
                rows = rows[ids[rows] != query_ids[q0 + i]]
                if len(rows):
                    best.add(q0 + i, exact(np.broadcast_to(queries[q0 + i], (len(rows), dims)), vectors[rows]), ids[rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids = held.value[1]
        best, kept, n = Best(len(query_ids), k), [], 0

        def flush() -> None:
            whole = pa.Table.from_batches(kept).combine_chunks()
            code = np.frombuffer(b"".join(whole.column("code").to_pylist()), np.uint8).reshape(whole.num_rows, -1)
            scan(best, whole.column("vec_id").to_numpy(), matrix(whole.column("embedding").combine_chunks(), dims), code)

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                n += batch.num_rows
            if n >= BLOCK:
                flush()
                kept, n = [], 0
        if n:
            flush()
        q, r = np.nonzero(best.score > -np.inf)
        yield as_batch({"query_id": pa.array(query_ids[q]), "vec_id": pa.array(best.id[q, r]), "score": pa.array(best.score[q, r])}, to)

    return indexed.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row with ``is_query``: query_id, rank (from 1), vec_id, score (cosine) of the k nearest found."""
    spark = df.sparkSession
    prepare(spark)
    made = index(df, Tables(spark, "ann"), id_col, vector_col)
    if made is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexed, book, dims = made
    asked = indexed.where(is_query)
    # Tables of a query: 256 floats for each byte of its code, besides the vector.
    at_once = max(1, QUERY_BYTES // (book.parts // 2 * 1024 + dims * 8))
    parts = -(-asked.count() // at_once)
    found = None
    for p in range(parts):
        own = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(parts)) == p).orderBy("vec_id").select("vec_id", "embedding").toArrow()
        if own.num_rows:
            some = search(indexed, book, dims, own.column("vec_id").to_numpy(), matrix(own.column("embedding").combine_chunks(), dims), k)
            found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
