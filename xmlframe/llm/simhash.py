"""SimHash near-duplicates, found exactly by vantage-point trees over the fingerprints.

Links bear at most RADIUS differing bits, so of RADIUS + 1 blocks of a fingerprint's bits at least one is equal in both
ends.  Each block has a vantage-point tree of its own over the Hamming distance of the block's values.  The search radius
in that block is zero, so the triangle bound leaves no pair on two sides of a node, and a fingerprint goes to exactly one
leaf of each tree: RADIUS + 1 rows of it, whatever the number of fingerprints.  (One tree over whole fingerprints would have
to copy all that lie within RADIUS of a boundary, about 30 % at each level: rows would grow with the power 1.6.)

Values of the block that very many fingerprints share, such as those of a large group of near copies, are dealt again by
blocks of the bits that are left, LEVELS times at most: what then still lies together has too few free bits to be large.

Inside a leaf, fingerprints of equal block value are compared; where there are many of them, vantage points of their own
limit comparisons by the triangle bound to fingerprints at about the same distances, and those that a vantage point links
already are not compared with each other.  A leaf yields links that span its groups, not all pairs, and components are
joined up across leaves.

The trees are fitted on at most TREE_SAMPLE fingerprints; they only decide where a fingerprint is compared.

Defined results: null and empty texts, and any without a word, have fingerprint zero and are linked like any other;
repeated rows share a fingerprint; the id of a component is its smallest doc_id; rows with a null id are compared like any
other and keep the null, and a component whose rows all lack an id has a null component_id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, as_batch, arrow_schema, mapped, prepare, share, text_of
from .graph import components

#: Differing bits up to which fingerprints are linked.
RADIUS = 3
#: Fingerprints on which the trees are fitted, at most.
TREE_SAMPLE = 20_000
#: Rows that a leaf should hold, and beyond which the fingerprints of one block value are dealt again.
LEAF_SIZE, SHARD_SIZE = 2_000, 16_000
#: Times that fingerprints are dealt.  With four blocks of what is left each time, 64 bits leave 20 free after four.
LEVELS = 4
#: Bits of a block at each level, at most; with two bits for each block's number they make a value of 52 bits.
WIDTHS = (16, 12, 9, 7)
#: Counters for the sizes of what was dealt; a shared one can only make more rows be dealt again.
SLOTS = 1 << 18
#: Equal block values up to which all pairs are compared.
RUN = 64
#: Rows of one fingerprint from which it counts as hot (or a thousandth of all rows, so that there are few).
HOT = 10_000
SEED = 42


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z change case, only ASCII space divides
    if not words:
        return 0
    if len(words) <= 3:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        start = [0]
        at = 0
        for w in words:
            at += len(w) + 1
            start.append(at)
        hash64 = xxhash.xxh64_intdigest
        h = np.fromiter([hash64(joined[a : b - 1], SEED) for a, b in zip(start, start[3:])], dtype=np.uint64, count=len(words) - 2)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    prepare(df.sparkSession)

    def of(batch: pa.RecordBatch) -> dict:
        made = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(made.view(np.int64))}

    return mapped(text_of(df, id_col, text_col), of, "doc_id long, fp long")


def blocks_of(bits: list[int], parts: int) -> list[list[int]]:
    """The bits in ``parts`` runs of about the same length."""
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[x:y] for x, y in zip(cut, cut[1:])]


def free_blocks(path: tuple[int, ...]) -> list[list[int]]:
    """The blocks of the bits that are left when the blocks numbered by ``path`` are taken, one after another."""
    blocks = blocks_of(list(range(64)), RADIUS + 1)
    for k in path:
        blocks = blocks_of([b for i, block in enumerate(blocks) if i != k for b in block], RADIUS + 1)
    return blocks


def gather(points: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of the points' ``bits``."""
    if bits and bits == list(range(bits[0], bits[0] + len(bits))):
        return ((points >> np.uint64(bits[0])) & np.uint64((1 << len(bits)) - 1)).astype(np.int64)
    out = np.zeros(len(points), np.int64)
    for k, b in enumerate(bits):
        out |= ((points >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


class Tree:
    """A vantage-point tree over the values of a block of ``width`` bits; ``leaf`` is the leaf of each value.

    A node puts values nearer to its vantage point than its cut on one side, all others on the other.  Pairs are searched
    within distance zero, so that no value has to be on both.
    """

    def __init__(self, sample: np.ndarray, weight: float, most: int, width: int):
        self.leaf, self.leaves = np.zeros(1 << width, np.int32), 0
        values, counts = np.unique(sample, return_counts=True)
        todo = [(np.arange(1 << width), values, counts)]
        while todo:
            space, points, n = todo.pop()
            cut = self._cut(points, n) if n.sum() * weight > most and len(points) > 1 else None
            if cut is None:
                self.leaf[space] = self.leaves
                self.leaves += 1
                continue
            vantage, radius = cut
            for near in (True, False):
                side = lambda x: (np.bitwise_count(x ^ vantage) < radius) == near  # noqa: B023, E731
                todo.append((space[side(space)], points[side(points)], n[side(points)]))

    @staticmethod
    def _cut(points: np.ndarray, n: np.ndarray) -> tuple[int, int]:
        """The vantage point, among heavy values, and the cut that divide the weight most evenly."""
        best = None
        for vantage in points[np.argsort(-n, kind="stable")[:8]]:
            inside = np.cumsum(np.bincount(np.bitwise_count(points ^ vantage), weights=n))
            radius = int(np.abs(2 * inside[:-1] - inside[-1]).argmin())  # the last one would leave nothing outside
            even = abs(2 * inside[radius] - inside[-1])
            if best is None or even < best[0]:
                best = (even, int(vantage), radius + 1)
        return best[1], best[2]


class Forest:
    """A tree for each block of the fingerprints: leaves are numbered over all trees."""

    def __init__(self, sample: np.ndarray, total: int, leaf_size: int):
        weight = total / max(1, len(sample))
        self.trees = [Tree(gather(sample, bits), weight, leaf_size, len(bits)) for bits in blocks_of(list(range(64)), RADIUS + 1)]
        self.first = np.cumsum([0, *(t.leaves for t in self.trees)]).tolist()


def united(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indices of the links that span all groups: those that join two groups when taken in order."""
    parent = list(range(n))
    keep = []
    for k, (i, j) in enumerate(zip(left.tolist(), right.tolist())):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[max(i, j)] = min(i, j)
            keep.append(k)
    return np.array(keep, np.int64)


class Groups:
    """Union-find over the points of one search, kept as a label for each point; the smaller group is relabelled."""

    def __init__(self, n: int):
        self.label, self.members = np.arange(n), {}

    def unite(self, i: int, j: int) -> bool:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return False
        mine, other = self.members.pop(a, [np.array([a])]), self.members.pop(b, [np.array([b])])
        if sum(map(len, mine)) < sum(map(len, other)):
            a, mine, other = b, other, mine
        for rows in other:
            self.label[rows] = a
        merged = mine + other
        self.members[a] = merged if len(merged) < 64 else [np.concatenate(merged)]
        return True


def spanning_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as indices) that join up each group of distinct ``points`` reachable within the radius.

    First some points link all that lie within the radius of them, which settles most of a group of near copies in one
    pass each.  Then points are sorted by their distances to two vantage points, and each is compared with those that the
    triangle bound leaves and that are not of its group yet.
    """
    n = len(points)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    groups, left, right = Groups(n), [], []

    def link(i: int, found: np.ndarray) -> None:
        for j in found[np.unique(groups.label[found], return_index=True)[1]].tolist():
            if groups.unite(i, j):
                left.append(i)
                right.append(j)

    for i in (np.arange(16) * 2654435761 % n).tolist() if n > 4 * RUN else ():
        near = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= radius)
        link(i, near[groups.label[near] != groups.label[i]])
    first = np.bitwise_count(points ^ points[0]).astype(np.int64)
    second = np.bitwise_count(points ^ points[int(np.argmax(first))]).astype(np.int64)
    key = first * 128 + second
    order = np.argsort(key, kind="stable")
    cells, begin = np.unique(key[order], return_index=True)
    rows = dict(zip(cells.tolist(), np.split(order, begin[1:])))
    for c, mine in rows.items():
        others = [rows[x] for x in (c + 128 * a + b for a in range(radius + 1) for b in range(-radius, radius + 1)) if x >= c and x in rows]
        other = np.concatenate(others)
        for at in range(0, len(mine), 512):
            part = mine[at : at + 512]
            of = np.unique(groups.label[part])
            rest = other[groups.label[other] != of[0]] if len(of) == 1 else other
            for to in range(0, len(rest), 8192):
                some = rest[to : to + 8192]
                near = np.bitwise_count(points[part][:, None] ^ points[some][None, :]) <= radius
                for x in np.flatnonzero(near.any(axis=1)).tolist():
                    found = some[near[x]]
                    link(int(part[x]), found[groups.label[found] != groups.label[part[x]]])
    return np.array(left, np.int64), np.array(right, np.int64)


def leaf_links(points: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (as indices) among the points of equal ``value``."""
    order = np.argsort(value, kind="stable")
    value, points = value[order], points[order]
    begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    size = np.diff(np.r_[begin, len(value)])
    left, right = [], []
    small = np.flatnonzero(np.repeat(size <= RUN, size))  # all pairs of short runs, by the distance of their places
    for step in range(1, int(size[size <= RUN].max(initial=1))):
        a = small[small + step < len(value)]
        a = a[value[a] == value[a + step]]
        if not len(a):
            break
        a = a[np.bitwise_count(points[a] ^ points[a + step]) <= radius]
        left.append(a)
        right.append(a + step)
    for k in np.flatnonzero(size > RUN).tolist():
        i, j = spanning_links(points[begin[k] : begin[k] + size[k]], radius)
        left.append(i + begin[k])
        right.append(j + begin[k])
    i, j = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
    keep = united(len(value), i, j)
    return order[i[keep]], order[j[keep]]


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of one key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cut, cut[1:]):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)


def linked(distinct: DataFrame, tables: Tables, radius: int = RADIUS, shard_size: int = SHARD_SIZE, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """Spanning links (u, v) between the rows of ``distinct`` (fp), whose fingerprints differ; at most RADIUS bits."""
    spark = distinct.sparkSession
    total = distinct.count()
    if total < 2:
        return spark.createDataFrame([], "u long, v long")
    if radius > RADIUS:
        raise ValueError(f"radius must be at most {RADIUS}, the blocks are made for it")
    part = min(1.0, TREE_SAMPLE / 2 / total)
    sample = np.array([r[0] for r in distinct.where(share(F.col("fp"), 11) <= part).select("fp").limit(TREE_SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    held = spark.sparkContext.broadcast(Forest(sample, total, leaf_size))
    to, dealt_to = arrow_schema("u long, v long"), "leaf int, slot int, value long, fp long"

    def deal(batch: pa.RecordBatch) -> dict:
        """A row for each block: its leaf, and where its value is counted."""
        fp = batch.column("fp").to_numpy()
        value = np.stack([gather(fp.view(np.uint64), bits) for bits in free_blocks(())])
        leaf = np.stack([t.leaf[v] + first for t, v, first in zip(held.value.trees, value, held.value.first)])
        value = (value | np.arange(RADIUS + 1)[:, None] << WIDTHS[0]).ravel()  # as many as there are slots
        return {"leaf": pa.array(leaf.ravel()), "slot": pa.array(value.astype(np.int32)), "value": pa.array(value), "fp": pa.array(np.tile(fp, RADIUS + 1))}

    def deal_again(level: int):
        def of(batch: pa.RecordBatch) -> dict:
            """A row for each block of the bits that the row's blocks before leave free."""
            fp, value = batch.column("fp").to_numpy(), batch.column("value").to_numpy()
            shift = np.cumsum([w + 2 for w in WIDTHS[level:0:-1]], dtype=np.int64)  # the number of each block stands before its value
            path = np.stack([*(value >> (s - 2) & 3 for s in shift), value >> (int(shift[-1] if level else 0) + WIDTHS[0])])[::-1]
            made, of = [], []
            for p in np.unique(path, axis=1).T:
                mine = np.flatnonzero((path == p[:, None]).all(axis=0))
                for k, bits in enumerate(free_blocks(tuple(p.tolist()))):
                    made.append((value[mine] << 2 | k) << WIDTHS[level + 1] | gather(fp[mine].view(np.uint64), bits))
                    of.append(fp[mine])
            value = np.concatenate(made)
            slot = ((value.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int32)
            return {"leaf": pa.array(slot), "slot": pa.array(slot), "value": pa.array(value), "fp": pa.array(np.concatenate(of))}

        return of

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "leaf"):
            fp = group.column("fp").to_numpy()
            i, j = leaf_links(fp.view(np.uint64), group.column("value").to_numpy(), radius)
            if len(i):
                yield as_batch({"u": pa.array(fp[i]), "v": pa.array(fp[j])}, to)

    now, out = mapped(distinct.select("fp"), deal, dealt_to), None
    for level in range(LEVELS):
        # A slot's count is an upper bound of its values' counts; there are SLOTS of them at most.
        full = [r[0] for r in now.groupBy("slot").count().where(F.col("count") > shard_size).select("slot").collect()] if level < LEVELS - 1 else []
        marked = np.zeros(SLOTS, bool)
        marked[full] = True
        crowded = spark.sparkContext.broadcast(marked)
        here = lambda full_ones: lambda batch, held=crowded: batch.filter(pa.array(held.value[batch.column("slot").to_numpy()] == full_ones))
        rest = mapped(now, here(False), dealt_to) if full else now
        links = rest.select("leaf", "value", "fp").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(search, "u long, v long")
        out = links if out is None else out.unionByName(links)
        if not full:
            break
        now = tables.put(mapped(mapped(now, here(True), dealt_to), deal_again(level), dealt_to))
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 lowercase hex digits) and component_id (the smallest doc_id reachable)."""
    tables = Tables(df.sparkSession, "simhash")
    made = tables.put(fingerprints(df, id_col, text_col))
    distinct = tables.put(made.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    roots = components(linked(distinct, tables, radius), tables).select(F.col("node").alias("fp"), "root")
    joined = tables.put(distinct.join(roots, "fp", "left").select("fp", "doc_id", "n", F.coalesce("root", "fp").alias("root")))
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = tables.put(joined.join(least, "root").select("fp", "n", "component_id"))
    # A fingerprint that very many rows have (fewer than a thousand can) is broadcast; the others are joined.
    many = max(HOT, made.count() // 1000)
    hot = of.where(F.col("n") > many).select("fp", "component_id")
    known = made.join(F.broadcast(hot), "fp")
    rest = made.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(of.where(F.col("n") <= many).select("fp", "component_id"), "fp")
    return known.unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
