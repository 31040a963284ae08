"""Toxicity of texts by noisy-channel deobfuscation.

A token that may be disguised (look-alike digits and symbols, letters repeated, spaced out or divided by symbols) becomes a
lattice: each character offers the letters it may stand for, or nothing, at a cost.  Viterbi decoding under a character
trigram model restores the likeliest letters, exactly.  The restored words are then scored.

The character model is counted over all documents.  Word weights are lower confidence bounds of log odds of word, prefix
and 4-gram features, learned from a bounded sample of labelled rows (SAMPLE); a logistic regression on a text's strongest
weights gives its score.  Halves of the sample weigh each other's words, so that it is fitted on words not seen before.

Defined results: null and empty texts get the score of a text without words; where no labelled row of both kinds exists,
every score is 0; labels given twice count as the larger; repeated rows are scored alike; rows with a null id are scored with a null doc_id,
are not held out and not learned from.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learnable, mapped, prepare, share, text_of

#: Labelled rows that are learned from, at most.
SAMPLE = 6000
#: Places to which word features are hashed.
PLACES = 1 << 22
#: Standard errors taken off each weight.
CAUTION = 2.0
#: Weight above which a word is strong.
STRONG = 2.0
#: Distinct tokens a worker remembers.
MEMO_SIZE = 400_000

#: Letters of the character model; the first place is any break between words, the last any other letter.
LETTERS = " abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7) + "œ"
SIZE = len(LETTERS) + 1
CODE = {c: i for i, c in enumerate(LETTERS)}
_TABLE = np.zeros(0x250, np.int64)
for _c in range(0x250):
    _TABLE[_c] = CODE.get(chr(_c), SIZE - 1 if chr(_c).isalpha() else 0)

#: What a character may stand for besides itself.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "€": "e", "£": "l", "¡": "i"}
SUBSTITUTED, REPEATED, DIVIDED, BROKEN, KEPT = 0.7, 0.8, 0.2, 6.0, 9.0
DIVIDERS = set(".-_*~'`,/\\:;=^|+ #%&\"")
EDGES = ".,;:!?\"'()[]{}<>|*%$&#~-_=+/\\"

LETTER = re.compile(r"[^\W\d_]")
SYMBOL = re.compile(r"[0-9@$!|+(<*#€£¡._~'`/\\:;=^-]")
#: What shows a disguise by itself, without a letter on each side.  No part of it repeats, so a search takes one pass.
ODD = re.compile(r"[0-9@$!|€£¡][^\W\d_]{2}|[^\W\d_]{2}[0-9@$!|€£¡]|(\w)\1\1|[a-z0-9@$!][@$!*][a-z0-9@$!]")
THRICE = re.compile(r"(\w)\1\1")
#: Four or more single characters with dividers between.  ``_`` and ``*`` are characters where they stand alone, else
#: dividers: each place of a text can be read in one way, and a run once read is not read again.
SPACED = re.compile(r"(?<!\S)(?:(?:[^\W_]|[@$!]|(?<!\S)[_*](?!\S))(?:[\s.-]|(?<=\S)[_*]|[_*](?=\S))++){3,}(?:[^\W_]|[@$!]|(?<!\S)[_*](?!\S))(?![^\W_])")
#: Runs of one symbol, which say no more than their first three.
RUN = re.compile(r"([^\w\s]|_)\1{3,}")


def disguised(token: str) -> bool:
    """Whether a symbol stands between letters, or what is ODD anywhere: three searches from where the last one ended."""
    if (letter := LETTER.search(token)) and (symbol := SYMBOL.search(token, letter.end())) and LETTER.search(token, symbol.end()):
        return True
    return ODD.search(token) is not None


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.where(points < len(_TABLE), points, ord("ª"))]


def count_characters(df: DataFrame) -> np.ndarray:
    """Trigram counts over all documents; at most SIZE ** 3 rows reach the driver."""

    def of(batch: pa.RecordBatch) -> dict:
        c = codes(" " + " ".join(batch.column("text").to_pylist()) + " ")
        c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
        counted = np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=1) if len(c) > 2 else np.empty(0, np.int64)
        at = np.flatnonzero(counted)
        return {"at": pa.array(at, pa.int32()), "n": pa.array(counted[at], pa.int64())}

    rows = mapped(df, of, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**3)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(SIZE, SIZE, SIZE)


def costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a b), interpolated with the bigram and the uniform distribution."""
    share3 = counts / np.maximum(counts.sum(axis=2, keepdims=True), 1)
    pairs = counts.sum(axis=0)
    share2 = pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    return -np.log(0.8 * share3 + 0.15 * share2[None] + 0.05 / SIZE).astype(np.float32)


def lattice(token: str) -> list[list[tuple[int, float]]]:
    """For each character the letters it may stand for (-1: none) and what each costs."""
    out = []
    for i, c in enumerate(token):
        places: dict[int, float] = {}
        if (own := CODE.get(c, SIZE - 1 if c.isalpha() else 0)) and c.isalpha():
            places[own] = 0.0
            if i and token[i - 1] == c:
                places[-1] = REPEATED
        for x in LOOKS_LIKE.get(c, ""):
            places[CODE[x]] = SUBSTITUTED
        if c in DIVIDERS or c.isspace():
            places[-1], places[0] = DIVIDED, BROKEN if not c.isspace() else BROKEN / 2
        elif not places or c.isdigit():
            places[0] = KEPT
        out.append(list(places.items()))
    return out


def restore(token: str, cost: list) -> str:
    """The likeliest letters behind a token: exact Viterbi over the lattice, states are the last two letters."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for places in lattice(RUN.sub(r"\1\1\1", token)):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (sum_, path) in best.items():
            row = cost[a][b]
            for c, price in places:
                if c < 0:
                    state, total, to = (a, b), sum_ + price, path
                elif c == 0 and b == 0:
                    state, total, to = (a, b), sum_ + price, path
                else:
                    state, total, to = (b, c), sum_ + price + row[c], (c, path)
                if state not in new or total < new[state][0]:
                    new[state] = (total, to)
        best = new
    _, path = min(((s + cost[a][b][0], p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])
    letters = []
    while path is not None:
        letters.append(LETTERS[path[0]] if path[0] < len(LETTERS) else "?")
        path = path[1]
    return "".join(reversed(letters)).strip()


_DRAW = np.random.default_rng(71).integers(0, 1 << 63, 66, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, sizes) of words' features: all their 4-grams (of bytes, with edges; ``sizes`` for each word), then each
    word's beginning, then each word as a whole."""
    edged = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    length = np.array([len(e) for e in edged], np.int64)
    start = np.cumsum(length) - length
    c = np.frombuffer(b"".join(edged) + b"\0\0\0\0", np.uint8).astype(np.uint64)
    n = len(c) - 4
    gram = c[:n] | c[1 : n + 1] << np.uint64(8) | c[2 : n + 2] << np.uint64(16) | c[3 : n + 3] << np.uint64(24)
    at = np.arange(n) - np.repeat(start, length)
    inside = at <= np.repeat(length, length) - 4
    beginning = gram[start] | c[start + 4] << np.uint64(32) | np.uint64(1 << 40)
    whole = np.add.reduceat((c[:n] + np.uint64(1)) * _DRAW[at % 64], start) if len(words) else gram
    places = (np.concatenate((gram[inside], beginning, whole)) * _DRAW[64]) >> np.uint64(64 - PLACES.bit_length() + 1)
    return places.astype(np.int32), np.maximum(length - 3, 0).astype(np.int32)


def strongest(places: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The largest weight among each word's features."""
    if not len(sizes):
        return np.empty(0, np.float32)
    w = weights[places]
    n = len(sizes)
    grams = np.maximum.reduceat(w[: -2 * n], np.cumsum(sizes) - sizes)
    return np.maximum(grams, np.maximum(w[-2 * n : -n], w[-n:]))


class Reader:
    """Words of texts, undisguised.  ``weigh_all`` remembers what each token is worth."""

    def __init__(self, cost: np.ndarray, weights: np.ndarray | None = None):
        self.cost, self.weights = cost.tolist(), weights
        self.memo: dict[str, float] = {}

    def words(self, token: str) -> list[str]:
        """The word that a token shows, and those it may hide."""
        shown = token.strip(EDGES)
        out = [shown] if len(shown) > 2 else []
        if shown.isalpha() and " " not in token:
            hides = THRICE.search(shown) or token[0] in "@$!"
        else:
            hides = len(token) > 2 and (" " in token or disguised(token))
        if hides:
            out += [w for x in dict.fromkeys((token.rstrip(".,;:?"), shown)) if x for w in restore(x, self.cost).split() if len(w) > 2]
        return out

    def tokens(self, text: str) -> list[str]:
        low = text.lower()
        return low.split() + [" ".join(m[0].split()) for m in SPACED.finditer(low)]

    def weigh_all(self, tokens: set[str]) -> None:
        """After this the memo has every one of the tokens."""
        if len(self.memo) + len(tokens) > MEMO_SIZE:
            self.memo.clear()
        new = [t for t in tokens if t not in self.memo]
        words, owner = [], []
        for i, t in enumerate(new):
            for w in self.words(t):
                words.append(w)
                owner.append(i)
        best = np.zeros(len(new), np.float32)
        np.maximum.at(best, np.array(owner, np.int64), strongest(*features(words), self.weights) if words else np.empty(0, np.float32))
        self.memo.update(zip(new, best.tolist()))

    def summaries(self, texts: list[str]) -> list[list[float]]:
        """For each text what the regression sees."""
        out = []
        for at in range(0, len(texts), 100):
            each = [self.tokens(t) for t in texts[at : at + 100]]
            self.weigh_all(set().union(*each))
            get = self.memo.__getitem__
            for tokens in each:
                distinct = np.array([get(t) for t in set(tokens)])
                strong = sum(1 for t in tokens if get(t) > STRONG) if len(distinct) and distinct.max() > STRONG else 0
                out.append(summarised(distinct, strong, len(tokens)))
        return out


def summarised(distinct: np.ndarray, strong: int, n: int) -> list[float]:
    """The strongest words, how many are strong, how often strong words occur, the length."""
    top = [*np.sort(distinct)[::-1][:3].tolist(), 0.0, 0.0, 0.0][:3]
    return [*top, min(float((distinct > STRONG).sum()), 8.0), min(100.0 * strong / max(1, n), 10.0), float(np.log1p(n))]


def weigh(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Cautious log odds of each feature."""
    counts = [np.bincount(np.concatenate([np.empty(0, np.int64), *(r for r, y in zip(rows, toxic) if y == k)]), minlength=PLACES) for k in (1, 0)]
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    pos, neg = counts[0] + 0.5, counts[1] + 0.5
    odds = np.log(pos / (n1 + 1)) - np.log(neg / (n0 + 1))
    return np.maximum(odds - CAUTION * np.sqrt(1 / pos + 1 / neg), 0).astype(np.float32)


def regress(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: (mean, scale, weights), the intercept last."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.1] * (len(w) - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


class Model:
    def __init__(self, cost: np.ndarray, weights: np.ndarray | None, regression: tuple | None):
        self.cost, self.weights, self.regression = cost, weights, regression

    def reader(self) -> Reader:
        if not hasattr(self, "_reader"):
            self._reader = Reader(self.cost, self.weights)
        return self._reader

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_reader"}

    def score(self, texts: list[str]) -> np.ndarray:
        if self.regression is None or not texts:
            return np.zeros(len(texts))
        mean, scale, w = self.regression
        z = (np.array(self.reader().summaries(texts)) - mean) / scale
        return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); learns labels of learnable rows only."""
    spark = docs.sparkSession
    cost = costs(count_characters(docs))
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    picked = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(share(F.col("doc_id")), "doc_id").limit(sample)
    read = spark.sparkContext.broadcast(cost)

    def of(batch: pa.RecordBatch) -> dict:
        reader = Reader(read.value)
        words = [sorted({w for t in set(reader.tokens(x)) for w in reader.words(t)}) for x in batch.column("text").to_pylist()]
        made = [features(ws) if ws else (np.empty(0, np.int32),) * 2 for ws in words]
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "places": [p for p, _ in made], "sizes": [n for _, n in made]}

    # At most ``sample`` rows of two numbers are broadcast.
    rows = mapped(docs.join(F.broadcast(picked), "doc_id"), of, "doc_id long, toxic int, places array<int>, sizes array<int>").toArrow()
    rows = rows.take(pa.array(np.argsort(rows.column("doc_id").to_numpy(), kind="stable")))
    y = rows.column("toxic").to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        return Model(cost, None, None)
    flat = [x.values.to_numpy() for x in rows.column("places")]
    sizes = [x.values.to_numpy() for x in rows.column("sizes")]
    each = [np.unique(f).astype(np.int64) for f in flat]
    fold = np.arange(len(y)) % 2
    x = np.zeros((len(y), 6))
    for k in (0, 1):
        weights = weigh([each[i] for i in np.flatnonzero(fold != k)], y[fold != k])
        for i in np.flatnonzero(fold == k):
            distinct = strongest(flat[i], sizes[i], weights)
            strong = int((distinct > STRONG).sum())
            x[i] = summarised(distinct, strong, len(distinct))
    return Model(cost, weigh(each, y), regress(x, y.astype(float)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def of(batch: pa.RecordBatch) -> dict:
        score = held.value.score(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    return mapped(docs.withColumn("held_out", held_out(F.col("doc_id"))), of, "doc_id long, held_out boolean, score double, predicted int")


def score_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the labelled rows and score every row."""
    prepare(df.sparkSession)
    docs = text_of(df, id_col, text_col)
    return predict(docs, fit(docs, labels))
