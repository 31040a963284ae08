"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token that is a vocabulary entry as a whole.
Tier two: for a miss, its bytes form a doubly linked list and a heap yields the adjacent pair of lowest rank, leftmost
first, until no pair is in the vocabulary.  Both tiers run once per distinct pre-token a worker meets; a memo of limited
size keeps what they returned.

Defined results: null and empty text encode to no ids; special tokens do not exist (their strings are ordinary text);
repeated rows are encoded alike, each for itself; text of any length is encoded whole; a row with a null id is encoded like
any other and keeps the null; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import mapped, prepare, text_of

#: Distinct pre-tokens that a worker keeps; beyond it the memo starts anew.
MEMO_SIZE = 400_000

MASK = (1 << 64) - 1


def mix(x: int) -> int:
    """A finaliser with full avalanche over 64 bits."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


class MinimalPerfectHash:
    """Hash and displace: n keys onto exactly n slots.  Buckets of one key store their slot as a negative number."""

    def __init__(self, keys: list[bytes], per_bucket: int = 1):
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        self.shift = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * self.n
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        free = bytearray(b"\1") * self.n
        singles = []
        for bucket, group in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(group) == 1:
                singles.append((bucket, group[0][1]))
                continue
            d = 0
            while True:
                d += 1
                at = [mix(h ^ d * 0x9E3779B97F4A7C15 & MASK) % self.n for h, _ in group]
                if len(set(at)) == len(at) and all(free[x] for x in at):
                    break
            self.shift[bucket] = d
            for x, (_, key) in zip(at, group, strict=True):
                free[x], self.slots[x] = 0, key
        left = (x for x in range(self.n) if free[x])
        for bucket, key in singles:
            x = next(left)
            self.shift[bucket], self.slots[x] = -1 - x, key

    def find(self, key: bytes) -> int:
        """The key's slot, or -1 if it is not one of the keys."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        x = -1 - d if d < 0 else mix(h ^ d * 0x9E3779B97F4A7C15 & MASK) % self.n
        return x if self.slots[x] == key else -1


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """For each way to split a vocabulary entry into two others: (left id, right id), packed, to the entry's id."""
    return {left << PACK | right: r for token, r in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}


#: Bits for one id in a packed pair, and for one position in a heap entry.
PACK = 32
LOW = (1 << PACK) - 1


def merge(piece: bytes, byte_ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of one pre-token: merge the adjacent pair of lowest rank, leftmost first, by a heap over linked bytes."""
    n = len(piece)
    ids: list = [byte_ids[b] for b in piece]
    rank = pairs.get
    wanted = [rank(a << PACK | b, -1) for a, b in zip(ids, ids[1:])]
    heap = [r << PACK | i for i, r in enumerate(wanted) if r >= 0]
    if not heap:
        return ids
    wanted.append(-1)
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = heappop(heap)
        i = top & LOW
        r = top >> PACK
        if wanted[i] != r:
            continue  # a pair that has since been merged or has grown
        j = after[i]
        end = after[j]
        after[i], ids[i], ids[j], wanted[j] = end, r, -1, -1
        if end < n:
            before[end] = i
            wanted[i] = q = rank(r << PACK | ids[end], -1)
            if q >= 0:
                heappush(heap, q << PACK | i)
        else:
            wanted[i] = -1
        if (h := before[i]) >= 0:
            wanted[h] = q = rank(ids[h] << PACK | r, -1)
            if q >= 0:
                heappush(heap, q << PACK | h)
    return [x for x in ids if x >= 0]


class Vocabulary:
    """Ranks of a tokenizer, its pre-token pattern, and the memo of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.plain = plain_pattern(pattern)
        self.pairs = pair_ranks(ranks)
        self.byte_ids = [ranks[bytes((b,))] for b in range(256)]
        self.bytes_of = dict(zip(ranks.values(), ranks, strict=True))
        self.hash = MinimalPerfectHash(list(ranks))
        self.rank_at = [ranks[k] for k in self.hash.slots]
        self.memo: dict[str, tuple[str, bytes]] = Memo(self)

    def encode_piece(self, piece: bytes) -> list[int]:
        slot = self.hash.find(piece)
        return [self.rank_at[slot]] if slot >= 0 else merge(piece, self.byte_ids, self.pairs)

    def pieces(self, text: str) -> list[str]:
        if self.plain and not NOT_PLAIN.search(text):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.encode_piece(p.encode("utf-8"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Memo(dict):
    """Pre-token to (its ids as decimal text, the bytes that those ids decode to)."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        v = self.vocabulary
        ids = v.encode_piece(piece.encode("utf-8"))
        out = (",".join(map(str, ids)), v.decode(ids))
        if len(self) >= MEMO_SIZE:
            self.clear()
        if len(piece) <= 64:
            self[piece] = out
        return out


#: Text of these characters only takes the standard library's engine, whose classes are spelled out below.
NOT_PLAIN = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ]")
#: What \p{L}, \p{N} and \s are among those characters.
PLAIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r\x20\xa0", r"\S": "^\t-\r\x20\xa0"}


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern with its classes spelled out for plain text, or None if it uses anything else."""
    inside, out, i = False, [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            name = next((k for k in PLAIN if pattern.startswith(k, i)), None)
            if name is None or inside and name == r"\S":
                return None
            out.append(PLAIN[name] if inside else f"[{PLAIN[name]}]")
            i += len(name)
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    return re.compile("".join(out))


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_HELD: dict[str, Vocabulary] = {}


def _vocabulary(lines: tuple[bytes, str]) -> Vocabulary:
    packed, pattern = lines
    key = hashlib.sha256(packed + pattern.encode()).hexdigest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, packed.splitlines())}, pattern)
    return _HELD[key]


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode each text and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes) and,
    with ``with_ids``, ids array<int>.  Null text counts as empty: no ids, and the digests of nothing.  The vocabulary file
    (about 1 MB, read once by the driver) is broadcast.
    """
    spark = df.sparkSession
    prepare(spark)
    with open(ranks_path, "rb") as f:
        held = spark.sparkContext.broadcast((f.read(), pattern))

    def encode(batch: pa.RecordBatch) -> dict:
        v = _vocabulary(held.value)
        memo = v.memo
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for text in batch.column("text").to_pylist():
            found = [memo[p] for p in v.pieces(text)]
            ids = ",".join([x[0] for x in found])
            out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join([x[1] for x in found])).hexdigest())
            if with_ids:
                out["ids"].append(np.array(ids.split(","), dtype=np.int32) if ids else np.empty(0, np.int32))
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return mapped(text_of(df, id_col, text_col), encode, schema)


def decode_documents(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The inverse: doc_id and the decoded bytes.  Null ids decode to nothing; an id outside the vocabulary is an error."""
    spark = df.sparkSession
    prepare(spark)
    with open(ranks_path, "rb") as f:
        held = spark.sparkContext.broadcast((f.read(), ""))

    def decode(batch: pa.RecordBatch) -> dict:
        v = _vocabulary(held.value)
        return {"doc_id": batch.column("doc_id"), "decoded": [v.decode(ids or []) for ids in batch.column("ids").to_pylist()]}

    return mapped(df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids"), decode, "doc_id long, decoded binary")
