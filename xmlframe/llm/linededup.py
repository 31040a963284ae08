"""Fuzzy line deduplication: MinHash candidates, exact Jaccard verification, distributed union-find.

Lines are compared in a plain form: lower case, runs of white space as one space, none at the ends.  Equal lines are
grouped exactly by 128 bits of hash.  Different lines are compared by their sets of SHINGLE characters: signatures of
BANDS * PER_BAND least or greatest hashes make candidates of lines that agree in a whole band, and every candidate is verified by its exact
Jaccard similarity.  An edit inside a line changes SHINGLE shingles on each side, which a short line cannot bear: lines of up
to SHORT characters are compared by their sets of NARROW characters as well, and linked if either similarity is enough.  Each component of the verified links keeps one line, the first by (doc_id, line number).

The lines of one bucket are verified by growing groups from one of them, so that a bucket of similar lines takes work and
links in proportion to its size.  Small buckets with the same smallest line are read one after another, so that what one of them
showed need not be compared again.  Buckets of more than BUCKET lines are dealt out by pairs of parts, so that every pair
still meets in some task.

Texts move only for lines that are candidates: these are marked in a bit set of fixed size, which can mark too many lines
but never too few.

Defined results: null text counts as empty and has no lines to remove; blank lines are kept and compared with nothing; a
line shorter than a shingle is one shingle; repeated rows lose their lines to the first of them (same id: the first line
of equal number is kept in each copy); rows of one id with different texts are documents of their own; rows with a null id
come after all others and keep the null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, Tables, arrow_schema, as_batch, mapped, own_id, prepare, told_apart
from .graph import components

SHINGLE = 8
#: Shingles of lines of up to SHORT characters: one inner edit leaves enough from 29 characters on, two from 56, where
#: SHINGLE takes 79 and 151.
NARROW, SHORT = 3, 160
THRESHOLD = 0.8
#: Chance of missing a pair at the very threshold: (1 - 0.8 ** 4) ** 12, 0.2 %; at 0.85 it is 0.02 %.
BANDS, PER_BAND = 12, 4
#: For NARROW shingles, of which unlike lines share a tenth: chance of missing 0.7 % at the threshold, 0.03 % at 0.85.
NARROW_BANDS, PER_NARROW = 21, 7
#: Lines of a bucket that one task compares at once.
BUCKET = 4096
#: Lines of a bucket up to which it is read together with others.
KIN = 256
#: Shingles whose sets are kept for the next bucket (8 bytes each as numbers, about 100 as text).
HELD = 1_000_000
#: Shingles of a line that are looked up in another before all are.
PROBE = 64
#: Rows of a line from which it counts as common (or a thousandth of all lines, so that there are few).
COMMON = 100_000
#: Bits of the outlines of short lines and of others.
SHORT_BITS, LONG_BITS = 256, 1024
#: Rows of buckets that a task holds before it throws away what repeats (16 bytes each).
PRUNE = 4_000_000
#: Rows of buckets that are packed up at once, and shares of the buckets to a task, so many that tasks get about as much.
PACK, SHARES = 500_000, 16
#: Bits that mark candidate lines.
MARKS = 1 << 27

_DRAW = np.random.default_rng(977)
#: Each factor gives a least and a greatest hash, so half as many as there are of these will do.
TIMES = _DRAW.integers(0, 1 << 31, (BANDS * PER_BAND + 1) // 2, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
JOIN = _DRAW.integers(0, 1 << 31, SHINGLE.bit_length(), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
NARROW_TIMES = _DRAW.integers(0, 1 << 31, (NARROW_BANDS * PER_NARROW + 1) // 2, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def plain(line: str) -> str:
    return " ".join(line.lower().split())


#: White space that is not as it is in the plain form: what str.split divides at, but for spaces and ends of lines.
UNUSUAL = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["  "]
#: Lower case of the characters up to U+00FF, which is among them too; unusual white space becomes a tab.
LOWER = bytes(9 if chr(c) in UNUSUAL else ord(chr(c).lower()) for c in range(256))


def plain_lines(text: str) -> list[str]:
    """``plain`` of each line; texts without unusual white space need only be cut."""
    try:
        low = text.encode("latin-1").translate(LOWER)
        usual, low = b"\t" not in low and b"  " not in low, low.decode("latin-1")
    except UnicodeEncodeError:
        usual, low = not any(x in text for x in UNUSUAL), text.lower()
    return [x.strip(" ") for x in low.split("\n")] if usual else [plain(x) for x in text.split("\n")]


def lines_of(texts: list[str]) -> tuple[list[str], list[int], list[int]]:
    """(plain line, row, number) of each line that is not blank."""
    line, row, number = [], [], []
    for r, text in enumerate(texts):
        for i, p in enumerate(plain_lines(text)):
            if p:
                line.append(p)
                row.append(r)
                number.append(i)
    return line, row, number


def keys_of(lines: list[str]) -> np.ndarray:
    """128 bits of hash of each line, as two signed longs."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode()) for x in lines]), dtype=">i8").astype(np.int64).reshape(-1, 2)


def shingles(line: str, width: int | None = None) -> set[str]:
    """The line's set of ``width`` characters, by default NARROW for a short line and SHINGLE for others."""
    width = width or (NARROW if len(line) <= SHORT else SHINGLE)
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def stretches(lines: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of up to ``most`` characters, or of one longer line."""
    at, size = 0, 0
    for i, line in enumerate(lines):
        if size + len(line) > most and i > at:
            yield at, i
            at, size = i, 0
        size += len(line)
    if lines:
        yield at, len(lines)


def band_keys(lines: list[str], width: int = SHINGLE) -> np.ndarray:
    """One long for each line and band; lines of a bucket agree in all of the band's."""
    bands, per_band, before = (BANDS, PER_BAND, 0) if width == SHINGLE else (NARROW_BANDS, PER_NARROW, BANDS)
    least = np.empty((bands * per_band, len(lines)), np.uint32)
    for at, end in stretches(lines, 200_000):  # which stay in cache
        _minima(lines[at:end], least[:, at:end], width)
    out = np.empty((len(lines), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(lines), before + band + 1, np.uint64)
        for i in range(band * per_band, (band + 1) * per_band):
            key = (key ^ least[i]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out.view(np.int64)


def shingle_hashes(code: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """32 bits of hash of each run of ``width`` characters, from the hashes of its halves (which overlap if need be)."""
    h, half = code, 1
    while half < width:
        step = min(half, width - half)
        joined = h[:-step] * JOIN[half.bit_length() - 1]
        joined += h[step:]
        joined ^= joined >> np.uint32(15)
        h, half = joined, half + step
    h = h * JOIN[-1]
    h ^= h >> np.uint32(16)
    return h


def hashed(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the lines one after another, and each line's number of them (a shorter line has one)."""
    padded = [x if len(x) >= width else x.ljust(width, "\0") for x in lines]
    joined = "".join(padded)
    try:
        code = np.frombuffer(joined.encode("latin-1"), np.uint8).astype(np.uint32)
    except UnicodeEncodeError:
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(x) for x in padded], np.int64)
    within = np.ones(len(code), bool)  # no shingle runs from one line into the next
    within[(np.cumsum(length)[:, None] - np.arange(1, width)).ravel()] = False
    h = shingle_hashes(code, width)
    return h[within[: len(h)]], length - width + 1


def _minima(lines: list[str], out: np.ndarray, width: int = SHINGLE) -> None:
    """The least, and further down the greatest, of each line's shingle hashes under each of the width's factors.

    The greatest under a factor is the least under its negative.  Both come from one product, and are never in one band.
    """
    h, n = hashed(lines, width)
    first = np.cumsum(n) - n
    turned = np.empty_like(h)
    half = (len(out) + 1) // 2
    for i, times in enumerate(TIMES if width == SHINGLE else NARROW_TIMES):
        np.multiply(h, times, out=turned)
        np.minimum.reduceat(turned, first, out=out[i])
        if half + i < len(out):
            np.maximum.reduceat(turned, first, out=out[half + i])


def similar(a: set[str], b: set[str], probe: set[str]) -> bool:
    """Whether the Jaccard similarity reaches the threshold; ``probe`` is some of ``a``, whose misses alone may tell."""
    least = THRESHOLD * (len(a) + len(b)) / (1 + THRESHOLD)  # common shingles that it takes
    if min(len(a), len(b)) < least - 1e-9 or len(probe - b) > len(a) - least + 1e-9:
        return False
    both = len(a & b)
    return both >= THRESHOLD * (len(a) + len(b) - both)


def coded(line: str, width: int) -> np.ndarray | None:
    """The line's set of shingles as sorted numbers that say the shingles themselves; None where eight bytes cannot say them."""
    if len(line) < width:
        return None
    try:
        data = line.encode("latin-1") + bytes(8 - width)
    except UnicodeEncodeError:
        return None
    codes = np.ndarray(len(line) - width + 1, "<u8", data, strides=(1,))
    codes = np.sort((codes & np.uint64((1 << 8 * width) - 1)).astype(np.uint32) if width <= 4 else codes)
    first = np.empty(len(codes), bool)
    first[0] = True
    np.not_equal(codes[1:], codes[:-1], out=first[1:])
    return codes[first]


def similar_codes(a: np.ndarray, b: np.ndarray) -> bool:
    """``similar``, of two sets as ``coded`` has them."""
    if min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= THRESHOLD * (len(a) + len(b) - common)


def numbers(lines: list[str], width: int) -> list[int]:
    """The number of each line's different shingles; one of up to eight characters up to U+00FF is a number itself."""
    n, plain_bytes = [1] * len(lines), []
    for i, line in enumerate(lines):
        try:
            plain_bytes.append((i, line.encode("latin-1")))
        except UnicodeEncodeError:
            n[i] = len(shingles(line, width))
    data = b"".join(x for _, x in plain_bytes) + bytes(8)
    codes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)) & np.uint64((1 << 8 * width) - 1)
    at = 0
    for i, x in plain_bytes:
        if len(x) > width:
            found = np.sort(codes[at : at + len(x) - width + 1])
            n[i] = 1 + int(np.count_nonzero(found[1:] != found[:-1]))
        at += len(x)
    return n


def outlines(lines: list[str], width: int, size: int) -> list[bytes]:
    """For each line ``size`` bits, which of them its shingles fall on."""
    h, n = hashed(lines, width)
    bits = np.zeros(len(lines) * size, bool)
    bits[np.repeat(np.arange(len(lines)) * size, n) + (h >> np.uint32(33 - size.bit_length()))] = True
    return [x.tobytes() for x in np.packbits(bits.reshape(len(lines), size), axis=1)]


def outlined(lines: list[str]) -> tuple[list[bytes], list[int]]:
    """The outline of each line, of NARROW shingles for short lines, of SHINGLE for others, and the number of these."""
    bits, n = [b""] * len(lines), [0] * len(lines)
    for short in (True, False):
        width, size = (NARROW, SHORT_BITS) if short else (SHINGLE, LONG_BITS)
        of = [i for i, x in enumerate(lines) if (len(x) <= SHORT) == short]
        some = [lines[i] for i in of]
        for at, end in stretches(some, 100_000):
            for i, x, y in zip(of[at:end], outlines(some[at:end], width, size), numbers(some[at:end], width)):
                bits[i], n[i] = x, y
    return bits, n


class Outline:
    """What tells that two lines cannot be similar, without a look at their shingles.

    A bit that only one line has stands for a shingle that only it has, so the number of such bits is at most that of the
    shingles that the other lacks.  ``n`` is the number of different shingles.  A NARROW shingle begins a SHINGLE, if it is
    not one of the line's last, different ones different ones: so there are about as many of these at least, and at most as
    many as places for them, and what the other lacks of the ones it lacks of the others.  Of the line its length will do.
    """

    __slots__ = ("bits", "set", "short", "n", "wide_least", "wide_most")

    def __init__(self, line: str | int, bits: bytes, n: int):
        length = line if isinstance(line, int) else len(line)
        self.bits, self.short, self.n = int.from_bytes(bits), length <= SHORT, n
        self.set = self.bits.bit_count()
        self.wide_least = max(1, n - (SHINGLE - NARROW)) if self.short else n
        self.wide_most = max(1, length - SHINGLE + 1) if self.short else n

    def unlike(self, other: Outline) -> bool:
        if self.short != other.short:  # compared by SHINGLE, of which the larger set must not have many more
            return min(self.wide_most, other.wide_most) < THRESHOLD * max(self.wide_least, other.wide_least) - 1e-9
        both = (self.bits & other.bits).bit_count()
        here, there = self.set - both, other.set - both
        if _enough(here, self.n, other.n) and _enough(there, other.n, self.n):
            return False
        if not self.short:
            return True
        last = SHINGLE - NARROW
        return not (_enough(here - last, self.wide_most, other.wide_least) and _enough(there - last, other.wide_most, self.wide_least))


def _enough(lacking: int, most: int, least: int) -> bool:
    """Whether a set of at most ``most``, of which another of at least ``least`` lacks so many, can be similar to it."""
    return lacking <= (most - THRESHOLD * least) / (1 + THRESHOLD) + 1e-9


class Line:
    """A line in a bucket: its number, its outline, and its text, which few lines are asked for."""

    __slots__ = ("key", "outline", "texts", "at")

    def __init__(self, key: int, outline: Outline, texts: pa.Array, at: int):
        self.key, self.outline, self.texts, self.at = key, outline, texts, at

    @property
    def text(self) -> str:
        return self.texts[self.at].as_py()


class Compared:
    """What is known of the lines in buckets of one ``kin``: sets, links, and pairs that are unlike."""

    def __init__(self):
        self.sets: dict[tuple, set[str] | np.ndarray | None] = {}
        self.root: dict[int, int] = {}
        self.unlike: set[tuple] = set()
        self.held = 0

    def _kept(self, make: Callable, line: Line, width: int):
        at = make, line.key, width
        if at not in self.sets:
            if self.held > HELD:
                self.sets.clear()
                self.held = 0
            found = self.sets[at] = make(line.text, width)
            self.held += 0 if found is None else len(found)
            return found
        return self.sets[at]

    def similar(self, a: Line, b: Line) -> bool:
        """Whether either similarity of the two lines is enough."""
        for width in (NARROW, SHINGLE) if a.outline.short and b.outline.short else (SHINGLE,):
            mine, other = self._kept(coded, a, width), self._kept(coded, b, width)
            if mine is not None and other is not None:
                like = similar_codes(mine, other)
            else:
                own = self._kept(shingles, a, width)
                like = similar(own, self._kept(shingles, b, width), set(islice(own, PROBE)))
            if like:
                return True
        return False

    def top(self, key: int) -> int:
        while (up := self.root.get(key, key)) != key:
            self.root[key] = self.root.get(up, up)
            key = up
        return key

    def links(self, lines: list[Line]) -> list[tuple[int, int]]:
        """Links (as indices) that span, with those of earlier buckets, each group of similar ``lines``.

        A group grows from one line, over the lines that no group has yet; lines that are joined already need no look.
        """
        if len(self.unlike) > 200_000:
            self.unlike.clear()
        links, left = [], list(range(len(lines)))
        while left:
            todo = [left.pop(0)]
            while todo and left:
                i = todo.pop()
                line = lines[i]
                key, unlike = line.key, line.outline.unlike
                top, rest = self.top(key), []
                for j in left:
                    other = lines[j]
                    if (below := self.top(other.key)) == top:
                        todo.append(j)
                        continue
                    if unlike(other.outline):
                        rest.append(j)
                        continue
                    pair = (key, other.key) if key < other.key else (other.key, key)
                    if pair in self.unlike:
                        rest.append(j)
                        continue
                    if self.similar(line, other):
                        links.append((i, j))
                        self.root[below] = top
                        todo.append(j)
                    else:
                        self.unlike.add(pair)
                        rest.append(j)
                left = rest
        return links


def band_rows(docs: DataFrame, shares: int) -> DataFrame:
    """(share, rows): each band of each line, of short lines in both widths, lines that a batch repeats once.

    ``rows`` are pairs of longs, bucket and a, of the buckets of one share.  A task packs up to PACK of them at a time: Spark
    takes as long for a row of two numbers as for one of hundreds.
    """
    to = arrow_schema("share int, rows binary")

    def of(batch: pa.RecordBatch) -> np.ndarray | None:
        line = list(dict.fromkeys(lines_of(batch.column("text").to_pylist())[0]))
        if not line:
            return None
        a = keys_of(line)[:, 0]
        bucket, of = band_keys(line).ravel(), np.repeat(a, BANDS)
        if len(short := np.flatnonzero([len(x) <= SHORT for x in line])):
            narrow = band_keys([line[i] for i in short.tolist()], NARROW).ravel()
            bucket, of = np.concatenate((bucket, narrow)), np.concatenate((of, np.repeat(a[short], NARROW_BANDS)))
        return np.stack((bucket, of), axis=1)

    def packed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        share = (rows[:, 0] % shares).astype(np.int32)
        order = np.argsort(share)
        rows, share = rows[order], share[order]
        begins = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
        ends = [*begins[1:].tolist(), len(rows)]
        for i in range(0, len(begins), 1000):
            some = zip(begins[i : i + 1000].tolist(), ends[i : i + 1000])
            yield as_batch({"share": pa.array(share[begins[i : i + 1000]]), "rows": [rows[x:y].tobytes() for x, y in some]}, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if (rows := of(batch)) is not None:
                held.append(rows)
                n += len(rows)
            if n >= PACK:
                yield from packed(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from packed(np.concatenate(held))

    return docs.mapInArrow(run, "share int, rows binary")


def shared_buckets(docs: DataFrame) -> DataFrame:
    """(bucket, a), each once, of buckets with different lines.

    Rows are dealt by shares of the buckets; a task gathers them as numbers, and throws away what repeats whenever it has
    read PRUNE rows.
    """
    shares = SHARES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = arrow_schema("bucket long, a long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def shared(rows: np.ndarray) -> np.ndarray:
            """The rows whose bucket is there twice, in order of buckets."""
            rows = rows[:, np.argsort(rows[0])]
            same = rows[0, 1:] == rows[0, :-1]
            return rows[:, np.r_[same, False] | np.r_[False, same]]

        def distinct(rows: np.ndarray) -> np.ndarray:
            rows = rows[:, np.lexsort((rows[1], rows[0]))]
            return rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)]]

        for batch in batches:
            held.append(np.frombuffer(b"".join(batch.column("rows").to_pylist()), np.int64).reshape(-1, 2).T)
            n += held[-1].shape[1]
            if n > PRUNE:
                held = [distinct(np.concatenate(held, axis=1))]
                n = PRUNE // 2  # so that much is read before the next time, however much is left
        if not sum(x.shape[1] for x in held):
            return
        rows = shared(np.concatenate(held, axis=1))
        rows = shared(distinct(rows)) if rows.shape[1] else rows
        for at in range(0, rows.shape[1], 100_000):
            yield as_batch({"bucket": pa.array(rows[0, at : at + 100_000]), "a": pa.array(rows[1, at : at + 100_000])}, to)

    return band_rows(docs, shares).repartition("share").mapInArrow(run, "bucket long, a long")


def candidates(docs: DataFrame, tables: Tables) -> DataFrame:
    """(kin, bucket, a, x, y): lines of buckets with different lines; those of one (bucket, x, y) are to be compared.

    Buckets of up to KIN lines that share their smallest line, BANDS + NARROW_BANDS of them at most, have the same ``kin``.  Parts of a
    large bucket are paired up: a line stands in each pair that its part is in.
    """
    found = tables.put(shared_buckets(docs))
    # Buckets of the same lines, from other bands, are compared once: sums of two hashes tell them apart.
    sums = [F.sum(F.pmod(F.xxhash64("a", F.lit(i)), F.lit(1 << 44))).alias(f"s{i}") for i in (1, 2)]
    sizes = found.groupBy("bucket").agg(F.count("*").alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi"), *sums)
    chosen = tables.put(sizes.groupBy("n", "lo", "hi", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "n", F.when(F.col("n") > KIN, F.col("bucket")).otherwise(F.col("lo")).alias("kin")))
    shared = found.join(chosen, "bucket")
    parts = F.ceil(F.col("n") / (BUCKET // 2)).cast("int")
    mine = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    dealt = shared.withColumn("parts", F.when(F.col("n") > BUCKET, parts).otherwise(1)).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return tables.put(dealt.select("kin", "bucket", "a", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")))


def marks(lines: DataFrame) -> np.ndarray:
    """Bit set of the lines' hashes: MARKS / 8 bytes, whatever the input."""
    at = F.pmod("a", F.lit(MARKS))
    words = lines.select(F.shiftrightunsigned(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(a, {MARKS}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def placed_lines(docs: DataFrame, bits) -> DataFrame:
    """(a, b, doc_id, v, line, text) of each line; of the places of a marked line in a batch, the first has its text too."""

    def of(batch: pa.RecordBatch) -> dict | None:
        line, row, number = lines_of(batch.column("text").to_pylist())
        if not line:
            return None
        keys = keys_of(line)
        at = keys[:, 0] % MARKS
        ids, v = batch.column("doc_id").to_numpy()[row], batch.column("v").to_numpy()[row]
        first: dict[str, int] = {}
        for i in np.flatnonzero(bits.value[at >> 6] >> (at & 63) & 1).tolist():
            j = first.setdefault(line[i], i)
            if i != j and (ids[i], v[i], number[i]) < (ids[j], v[j], number[j]):
                first[line[i]] = i
        text: list[str | None] = [None] * len(line)
        for x, i in first.items():
            text[i] = x
        return {"a": pa.array(keys[:, 0]), "b": pa.array(keys[:, 1]), "doc_id": pa.array(ids), "v": pa.array(v), "line": number, "text": text}

    return mapped(docs, of, "a long, b long, doc_id long, v long, line int, text string")


def marked_lines(placed: DataFrame, tables: Tables) -> DataFrame:
    """(id, a, b, doc_id, v, line, text, bits, n): the lines with a text, each once, at its first place, numbered, with their outlines."""

    def with_outline(batch: pa.RecordBatch) -> dict:
        bits, n = outlined(batch.column("text").to_pylist())
        return {c: batch.column(c) for c in ("id", "a", "b", "doc_id", "v", "line", "text")} | {"bits": bits, "n": n}

    found = placed.where("text is not null")
    first = found.groupBy("a", "b").agg(F.min(F.struct("doc_id", "v", "line", "text")).alias("first")).select(F.monotonically_increasing_id().alias("id"), "a", "b", "first.*")
    return tables.put(mapped(first, with_outline, "id long, a long, b long, doc_id long, v long, line int, text string, bits binary, n int"))


def links(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Verified links (u, v) between the ids of different ``lines``."""
    to = arrow_schema("u long, v long")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, rows = Compared(), None, []
        made: dict[int, Line] = {}  # the lines of one kin
        out: list[tuple[int, int]] = []

        def compare() -> None:
            out.extend((rows[i].key, rows[j].key) for i, j in known.links(rows))

        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.stack([c.to_numpy() for c in batch.columns[:4]])
            ids, n, bits = (batch.column(c).to_pylist() for c in ("id", "n", "bits"))
            text = batch.column("text")
            lengths = pc.utf8_length(text).to_pylist()
            begins = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1
            for at, end in pairwise([0, *begins.tolist(), len(ids)]):
                if (bucket := tuple(of[:, at].tolist())) != last:
                    compare()
                    if last is None or bucket[:3] != last[:3]:
                        known = Compared()
                        made.clear()
                    last, rows = bucket, []
                for i in range(at, end):
                    if (line := made.get(ids[i])) is None:
                        line = made[ids[i]] = Line(ids[i], Outline(lengths[i], bits[i], n[i]), text, i)
                    rows.append(line)
            if out:
                yield as_batch({"u": [u for u, _ in out], "v": [v for _, v in out]}, to)
                out.clear()
        compare()
        if out:
            yield as_batch({"u": [u for u, _ in out], "v": [v for _, v in out]}, to)

    joined = pairs.join(lines, "a")
    dealt = joined.repartition("kin", "x", "y").sortWithinPartitions("kin", "x", "y", "bucket")
    return dealt.select("kin", "x", "y", "bucket", "id", "text", "bits", "n").mapInArrow(verify, "u long, v long")


def removals(docs: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, v, gone): numbers of the lines to remove, for documents (doc_id, v, text) that have any."""
    pairs = candidates(docs, tables)
    bits = docs.sparkSession.sparkContext.broadcast(marks(pairs.select("a").distinct()))
    placed = tables.put(placed_lines(docs, bits))
    lines = marked_lines(placed, tables)
    roots = components(links(pairs, lines), tables)
    place = F.struct("doc_id", "v", "line")
    # Each group of linked lines keeps the first place of any of them.
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = members.join(lines.select(F.col("id").alias("node"), "a", "b", place.alias("place")), "node")
    linked = tables.put(members.join(members.groupBy("root").agg(F.min("place").alias("keep")), "root").select("a", "b", "keep"))
    keys = placed.drop("text")
    first = keys.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(linked, ["a", "b"], "left")
    first = tables.put(first.where("n > 1 or keep is not null").select("a", "b", "n", F.coalesce("keep", "first").alias("keep")))
    # Lines that very many rows have (fewer than a thousand can) are broadcast; the others are joined.
    many = max(COMMON, keys.count() // 1000)
    common = F.broadcast(first.where(F.col("n") > many).drop("n"))
    found = keys.join(common, ["a", "b"], "left")
    rest = found.where("keep is null").drop("keep").join(first.where(F.col("n") <= many).drop("n"), ["a", "b"])
    gone = found.where("keep is not null").unionByName(rest).where(place != F.col("keep"))
    return gone.groupBy("doc_id", "v").agg(F.collect_set("line").alias("gone"))  # as long as one document


def without(text: str, gone: list[int] | None) -> str:
    if not gone:
        return text
    drop = set(gone)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_lines (not blank), n_removed, kept_sha256 (of the text that is left) and, on demand, kept."""
    prepare(df.sparkSession)
    tables = Tables(df.sparkSession, "lines")
    docs = told_apart(df, id_col, text_col, tables)

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_lines": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            kept = without(text, gone)
            out["n_lines"].append(sum(1 for x in text.split("\n") if x.strip()))
            out["n_removed"].append(len(gone or ()))
            out["kept_sha256"].append(hashlib.sha256(kept.encode()).hexdigest())
            if with_text:
                out["kept"].append(kept)
        return out

    schema = "doc_id long, n_lines long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return mapped(docs.join(removals(docs, tables), ["doc_id", "v"], "left").select("doc_id", "text", "gone"), cut, schema).withColumn("doc_id", own_id(F.col("doc_id")))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the removed lines cut from its text; all columns and rows stay, null texts too."""
    prepare(df.sparkSession)
    tables = Tables(df.sparkSession, "lines")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        return pa.array([t if t is None else without(t, g) for t, g in zip(texts.to_pylist(), gone.to_pylist())], pa.string())

    gone = removals(told_apart(df, id_col, text_col, tables), tables)
    # Columns of ``df`` travel in one struct, so that their names clash with nothing; v is the text's hash or 0.
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    found = rows.join(gone.withColumnRenamed("doc_id", "of"), (F.col("doc_id") == F.col("of")) & F.col("v").isin(F.lit(0), F.col("h")), "left")
    kept = cut(F.when(F.col("gone").isNotNull(), F.col("text")), "gone")
    return found.withColumn("kept", kept).select(*[F.when(F.col("gone").isNull(), F.col(f"row.`{c}`")).otherwise(F.col("kept")).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in df.columns])
