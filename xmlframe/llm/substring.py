"""Substring deduplication with a count-min prefilter.

A window is WINDOW consecutive words of a document.  A first pass counts windows in a count-min sketch: each partition
sketches its own documents, the sketches are merged block by block, and what remains of them is one bit for each cell,
whether it was counted twice or more.  A sketch only overestimates, so a window whose cells are not all set occurs in one
document only.  The second pass groups the windows that are left exactly, by 128 bits of hash, and finds the smallest
document of each.  No window is lost to the filter, whatever the sketch's size; a full one just lets more pass.

Exact copies of a text are first reduced to the smallest of them: the others lose every word that a window covers.

The sketch has cells in proportion to the input, up to MAX_CELLS in each row, so the bits broadcast are at most
ROWS * MAX_CELLS / 8 bytes.

Defined results: null and empty texts have no words, and texts shorter than a window lose none; a window repeated within
one document only is kept; repeated rows of one doc_id are the same document, so none of them is the other's repeat, though
each is judged by its own text; a null id counts as one document behind all others and stays null; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, arrow_schema, as_batch, mapped, own_id, prepare, told_apart

WINDOW = 13
ROWS = 2
MAX_CELLS = 1 << 28
#: Cells of one row for each window expected.
CELLS_PER_WINDOW = 2
#: Cells of a block, the unit in which sketches are merged.
BLOCK = 1 << 20
#: Sketches of a block that one task merges at a time.
FAN_IN = 64
#: Ids of exact copies that are broadcast, at most (16 bytes each).
MOST_COPIES = 4_000_000
#: Frequent windows that are broadcast with their smallest document, at most (24 bytes each); more are joined.
MOST_FREQUENT = 1_000_000
#: Parts that the rows of a frequent window are dealt to where they are joined.
SALTS = 16
#: Estimated count from which a window counts as frequent; its rows are then grouped by way of partial results.
FREQUENT = 200

_DRAW = np.random.default_rng(20240613)
#: For each of the two hashes: the base of its polynomial, and what it is mixed with.
BASE, MIX = (_DRAW.integers(0, 1 << 63, (2, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, the words' codes one after another, two 64-bit hashes of each code)."""
    split = pc.ascii_split_whitespace(texts)
    flat, owner = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(flat)
    hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()]), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    counts = np.bincount(owner[full], minlength=len(texts))
    return counts, coded.indices.to_numpy()[full], hashes


def rolled(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomials of each ``width`` neighbours, put together from stretches of 1, 2, 4, ... of them."""
    out, done, block, size, power = None, 0, h, 1, base
    while width:
        if width & 1:
            if out is None:
                out = block.copy()
            else:
                n = min(len(out), len(block) - done)
                out = out[:n] * np.uint64(power) + block[done : done + n]
            done += size
        width >>= 1
        if width:
            block = block[:-size] * np.uint64(power) + block[size:]
            power, size = power * power % (1 << 64), 2 * size
    return out


def windows(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash, second hash) of every window, row by row."""
    counts, codes, hashes = word_table(texts)
    n = len(codes)
    if n < width:
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    keys = []
    for k in range(2):
        total = rolled(hashes[:, k][codes], width, BASE[k])
        total ^= total >> np.uint64(29)
        total *= np.uint64(MIX[k])
        total ^= total >> np.uint64(32)
        keys.append(total)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    row = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    inside = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(np.maximum(counts - width + 1, 0))[:-1])), np.maximum(counts - width + 1, 0))
    at = first[row] + inside
    return row, inside, keys[0][at], keys[1][at]


def once_each(row: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Indices with one window of each kind in each row."""
    order = np.lexsort((first, row))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (np.diff(row[order]) != 0) | (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
    return order[new]


def cells(first: np.ndarray, second: np.ndarray, number: int) -> list[np.ndarray]:
    """The cell of each window in each row of the sketch."""
    return [((h >> np.uint64(8)) & np.uint64(number - 1)).astype(np.int64) for h in (first, second)][:ROWS]


def sketch_size(docs: DataFrame) -> int:
    """Cells in a row: a power of two, by a bound on the number of words."""
    n = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    want = max(BLOCK, n // 6 * CELLS_PER_WINDOW)
    return min(MAX_CELLS, 1 << (want - 1).bit_length())


def pack(counted: np.ndarray, at: np.ndarray) -> bytes:
    """Cells in order and their saturated counts: a byte for each step to the next cell, longer steps and counts apart."""
    step = np.diff(at, prepend=0).astype(np.uint32)
    long, more = step >= 255, np.flatnonzero(counted > 1).astype(np.uint32)
    sizes = np.array([len(step), long.sum(), len(more)], np.uint32)
    return b"".join(x.tobytes() for x in (sizes, np.minimum(step, 255).astype(np.uint8), step[long], more, counted[more].astype(np.uint8)))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, longs, more = np.frombuffer(data, np.uint32, 3).tolist()
    at = 12 + n
    step = np.frombuffer(data, np.uint8, n, 12).astype(np.int64)
    step[step == 255] = np.frombuffer(data[at : at + 4 * longs], np.uint32)
    at += 4 * longs
    counted = np.ones(n, np.uint8)
    counted[np.frombuffer(data[at : at + 4 * more], np.uint32)] = np.frombuffer(data, np.uint8, more, at + 4 * more)
    return np.cumsum(step), counted


def sketches(docs: DataFrame, number: int, width: int) -> DataFrame:
    """(block, part, data): the count-min sketch of each stretch of documents, by blocks of cells."""
    to = arrow_schema("block int, part int, data binary")

    def emit(held: list[list[np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
        for r in range(ROWS):
            at, counted = np.unique(np.concatenate([h[r] for h in held]), return_counts=True)
            blocks, begin = np.unique(at // BLOCK, return_index=True)
            end = np.append(begin[1:], len(at))
            data = [pack(np.minimum(counted[a:b], 255), at[a:b] % BLOCK) for a, b in zip(begin, end)]
            yield as_batch({"block": (r * (number // BLOCK) + blocks).astype(np.int32), "part": np.full(len(blocks), part, np.int32), "data": data}, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, n = [], 0
        for batch in batches:
            row, _, first, second = windows(batch.column("text"), width)
            own = once_each(row, first, second)
            held.append([c.astype(np.int32) for c in cells(first[own], second[own], number)])
            n += len(own)
            if n > 8_000_000:  # bounds memory; the counts are added up later in any case
                yield from emit(held, part)
                held, n = [], 0
        if n:
            yield from emit(held, part)

    return docs.select("text").mapInArrow(run, "block int, part int, data binary")


def add_up(parts: DataFrame, last: bool) -> DataFrame:
    """Add up the sketches of each key; at last keep bits: which cells reach 2, and which reach FREQUENT."""
    to = arrow_schema("block int, part int, data binary" if not last else "block int, twice binary, often binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done() -> pa.RecordBatch:
            if last:
                bits = [zlib.compress(np.packbits(total >= least).tobytes(), 1) for least in (2, FREQUENT)]
                return as_batch({"block": [key[0]], "twice": [bits[0]], "often": [bits[1]]}, to)
            at = np.flatnonzero(total)
            return as_batch({"block": [key[0]], "part": [key[1]], "data": [pack(total[at], at)]}, to)

        for batch in batches:
            for block, part, data in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "data"))):
                if (block, part) != key:
                    if key is not None:
                        yield done()
                    key, total = (block, part), np.zeros(BLOCK, np.int32)
                at, counted = unpack(data)
                total[at] = np.minimum(total[at] + counted, 255)
        if key is not None:
            yield done()

    keyed = parts.withColumn("part", F.lit(0) if last else (F.col("part") / FAN_IN).cast("int"))
    dealt = keyed.repartition("block", "part").sortWithinPartitions("block", "part")
    return dealt.mapInArrow(run, "block int, part int, data binary" if not last else "block int, twice binary, often binary")


class Filter:
    """Bits of the merged sketch."""

    def __init__(self, number: int, rows: list):
        self.number = number
        self.twice = np.zeros(ROWS * number // 8, np.uint8)
        self.often: dict[int, np.ndarray] = {}
        for r in rows:
            a = r["block"] * BLOCK // 8
            self.twice[a : a + BLOCK // 8] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
            often = np.frombuffer(zlib.decompress(r["often"]), np.uint8)
            if often.any():
                self.often[r["block"]] = np.flatnonzero(np.unpackbits(often)).astype(np.int32) + 0

    def frequent_cells(self) -> np.ndarray:
        return np.sort(np.concatenate([np.empty(0, np.int64), *(b * BLOCK + c.astype(np.int64) for b, c in self.often.items())]))

    def test(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window whether it may occur in two documents, and whether in very many."""
        may, many = np.ones(len(first), bool), np.ones(len(first), bool)
        frequent = self.frequent_cells()
        for r, c in enumerate(cells(first, second, self.number)):
            at = r * self.number + c
            may &= (self.twice[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            found = np.searchsorted(frequent, at)
            many &= (found < len(frequent)) & (frequent[np.minimum(found, max(0, len(frequent) - 1))] == at) if len(frequent) else False
        return may, many


def prefilter(docs: DataFrame, number: int, width: int) -> Filter:
    """The merged sketch's bits.  With many partitions, at most FAN_IN sketches of a block are added up at first."""
    parts = sketches(docs, number, width)
    if docs.rdd.getNumPartitions() > FAN_IN:
        parts = add_up(parts, last=False)
    return Filter(number, add_up(parts, last=True).collect())  # at most ROWS * number / 4 bytes


def copies(docs: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, v) of each document whose text is that of a smaller doc_id."""
    same = docs.select("doc_id", "v", F.unhex(F.sha2("text", 256)).alias("blob"))
    least = tables.put(same.groupBy("blob").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1"))
    return tables.put(same.join(least, "blob").where("leader < doc_id").select("doc_id", "v").distinct())


class Rows:
    """A set of rows (doc_id, v), held in order."""

    def __init__(self, table: pa.Table):
        order = np.lexsort((table.column("v").to_numpy(), table.column("doc_id").to_numpy()))
        self.ids, self.v = table.column("doc_id").to_numpy()[order], table.column("v").to_numpy()[order]
        self.most = int(np.unique(self.ids, return_counts=True)[1].max(initial=0))  # rows of one id

    def holds(self, batch: pa.RecordBatch) -> np.ndarray:
        """For each row of the batch whether it is in the set."""
        ids, v = batch.column("doc_id").to_numpy(), batch.column("v").to_numpy()
        found = np.zeros(len(ids), bool)
        at = np.searchsorted(self.ids, ids)
        for k in range(self.most):
            here = np.minimum(at + k, len(self.ids) - 1)
            found |= (self.ids[here] == ids) & (self.v[here] == v)
        return found


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces) and, on demand, kept (text)."""
    spark = df.sparkSession
    prepare(spark)
    tables = Tables(spark, "substring")
    docs = told_apart(df, id_col, text_col, tables)
    known = copies(docs, tables)
    # Copies are set aside where their ids are few enough to broadcast; else their windows go the way of all others.
    set_aside = Rows((known if known.count() <= MOST_COPIES else known.limit(0)).toArrow())
    aside = spark.sparkContext.broadcast(set_aside)

    def leaders(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(~aside.value.holds(batch)))

    first = mapped(docs, leaders, "doc_id long, v long, text string") if set_aside.most else docs
    number = sketch_size(docs)
    held = spark.sparkContext.broadcast(prefilter(first, number, width))
    frequent = bool(held.value.often)

    def survivors(often: bool):
        def of(batch: pa.RecordBatch) -> dict | None:
            row, at, a, b = windows(batch.column("text"), width)
            may, many = held.value.test(a, b)
            keep = np.flatnonzero(may & (many == often))
            if not len(keep):
                return None
            doc = batch.select(["doc_id", "v"]).take(pa.array(row[keep]))
            return {"a": pa.array(a[keep].view(np.int64)), "b": pa.array(b[keep].view(np.int64)), "doc_id": doc.column("doc_id"), "v": doc.column("v"), "at": pa.array(at[keep].astype(np.int32))}

        return mapped(first, of, "a long, b long, doc_id long, v long, at int")

    few = survivors(False).withColumn("least", F.min("doc_id").over(Window.partitionBy("a", "b")))
    late = few.where("least < doc_id").select("doc_id", "v", "at")
    hot = None
    if frequent:  # the smallest document of each frequent window, by partial results
        least = tables.put(survivors(True).groupBy("a", "b").agg(F.min("doc_id").alias("least")))
        rows = least.toArrow() if least.count() <= MOST_FREQUENT else None
        if rows is not None and len(pc.unique(rows.column("a"))) == rows.num_rows:
            order = np.argsort(rows.column("a").to_numpy())
            hot = spark.sparkContext.broadcast(tuple(rows.column(c).to_numpy()[order] for c in ("a", "b", "least")))
        else:
            salts = F.lit(SALTS)  # a frequent window's rows are dealt to several tasks
            many = survivors(True).withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), salts).cast("int"))
            of = least.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
            late = late.unionByName(many.join(of, ["a", "b", "salt"]).where("least < doc_id").select("doc_id", "v", "at"))

    def frequent_starts(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        """Starts of frequent windows that an earlier document has, for each row of the batch with any."""
        row, at, a, b = windows(batch.column("text"), width)
        a = a.view(np.int64)
        known, other, first_doc = hot.value
        found = np.minimum(np.searchsorted(known, a), len(known) - 1)
        late_here = np.flatnonzero((known[found] == a) & (other[found] == b.view(np.int64)) & (first_doc[found] < batch.column("doc_id").to_numpy()[row]))
        rows, begin = np.unique(row[late_here], return_index=True)
        return dict(zip(rows.tolist(), np.split(at[late_here], begin[1:])))

    late = late.groupBy("doc_id", "v").agg(F.collect_list("at").alias("at"))  # as long as one document
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        starts, copied = batch.column("at"), aside.value.holds(batch)
        more = frequent_starts(batch) if hot is not None else {}
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = text.encode().split()
            n = len(words)
            kept = words
            if copied[i] and n >= width:  # each of its words is covered
                kept = []
            elif starts[i].is_valid or i in more:
                covered = np.zeros(n + 1, np.int32)
                at = np.unique(np.concatenate(([] if not starts[i].is_valid else starts[i].values.to_numpy(), more.get(i, []))).astype(np.int64))
                covered[at] += 1
                covered[at + width] -= 1
                kept = [words[x] for x in np.flatnonzero(np.cumsum(covered[:n]) == 0)]
            joined = b" ".join(kept)
            out["n_words"].append(n)
            out["n_removed"].append(n - len(kept))
            out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
            if with_text:
                out["kept"].append(joined.decode())
        return out

    return mapped(docs.join(late, ["doc_id", "v"], "left").select("doc_id", "v", "text", "at"), cut, schema).withColumn("doc_id", own_id(F.col("doc_id")))


def oracle_sql() -> str:
    """``remove_repeats(documents)`` in DuckDB."""
    w = WINDOW
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {w - 1})) AS p FROM d WHERE len(ws) >= {w}),
k AS (SELECT doc_id, p, md5(array_to_string(ws[p + 1 : p + {w}], ' ')) AS key FROM s),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY key) AS least FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + {w})) AS p FROM m WHERE least < doc_id),
r AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""
