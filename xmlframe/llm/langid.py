"""Language identification by string kernels.

The kernel is a blended-spectrum presence kernel: a piece of text is the set of its character n-grams of 1 to MOST
characters, and k(x, y) = |x and y| / sqrt(|x| |y|).  A text is the mean of its pieces of PIECE characters (by their
length), so that its n-grams stay sparse however long it is, and the kernel of two texts is the mean over their pieces.
N-grams are hashed to DIMS places.  The Nystroem method represents a text by its kernel values with LANDMARKS training
texts, and kernel ridge regression learns one score for each language against the rest.  A batch of texts is scored by two
matrix products.

The model is fitted on a bounded sample: about PER_LANG texts of each language, fewer where that would be more than
LEARNED texts in all, drawn by their ids.  Executors send what they are in the kernel's space, DIMS numbers at most for a
text, however long it is.

Defined results: null text, and text without a letter, is ``und`` with score 0; where nothing could be learned, all texts
are; equal scores go to the language that sorts first; repeated rows are scored alike; rows with a null id are predicted
with a null doc_id, are not held out and not learned from; other columns are ignored, by ``known`` kept as they are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, held_out, learnable, mapped, prepare, share, text_of

MOST = 4
DIMS = 1 << 13
LANDMARKS = 256
#: Characters of a piece: some 2,000 different n-grams, which fill a quarter of the places.
PIECE = 1024
#: Training texts of each language, and of all, about (50 kB each at most).
PER_LANG, LEARNED = 400, 4000
RIDGE = 1e-3
#: How much larger scores are made before they become shares.
SHARPEN = 8.0

LETTER = regex.compile(r"\p{L}")
FACTOR = np.random.default_rng(31).integers(0, 1 << 32, MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def presence(code: np.ndarray, pieces: int) -> np.ndarray:
    """One row for each piece of a text's code points: 1 where an n-gram that begins in it falls."""
    out = np.zeros((pieces, DIMS), np.float32)
    row = np.arange(len(code)) // PIECE
    h = np.zeros(len(code), np.uint64)
    for n in range(min(MOST, len(code))):
        h = (h[: len(code) - n] + code[n:] * FACTOR[n]) * np.uint64(0x9E3779B97F4A7C15)
        inside = row[: len(h)] < pieces
        out[row[: len(h)][inside], (h >> np.uint64(65 - DIMS.bit_length()))[inside]] = 1
    return out


def embedded(texts: list[str]) -> np.ndarray:
    """One row for each text: the mean of its pieces' scaled presence, by their length."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in zip(out, texts):
        code = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for at in range(0, len(code), 64 * PIECE):  # some pieces at a time, with what their last n-grams reach into
            size = np.diff(np.append(np.arange(at, min(at + 64 * PIECE, len(code)), PIECE), min(at + 64 * PIECE, len(code))))
            rows = presence(code[at : at + 64 * PIECE + MOST - 1], len(size))
            row += (size / len(code) / np.sqrt(np.maximum(rows.sum(axis=1), 1))).astype(np.float32) @ rows
    return out


class Model:
    """Landmarks and the weights of their kernel values, one column for each language."""

    def __init__(self, rows: np.ndarray, langs: list[str]):
        """``rows`` are the training texts, embedded."""
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        y = np.array([self.langs.index(x) for x in langs])
        # Landmarks in turn from each language, so that small ones are represented.
        turn = np.lexsort((y, np.array([np.count_nonzero(y[:i] == y[i]) for i in range(len(y))])))
        chosen = np.sort(turn[: max(LANDMARKS, 8 * len(self.langs))])
        self.landmarks = rows[chosen].T.copy()
        inner = (rows[chosen] @ self.landmarks).astype(np.float64)
        value, vector = np.linalg.eigh(inner)
        good = value > 1e-6 * value.max()
        whiten = vector[:, good] / np.sqrt(value[good])
        phi = np.c_[(rows @ self.landmarks) @ whiten, np.ones(len(rows))]
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weigh = 1.0 / np.bincount(y)[y]  # languages count alike
        a = phi.T @ (phi * weigh[:, None]) + RIDGE * np.eye(phi.shape[1])
        beta = np.linalg.solve(a, phi.T @ (target * weigh[:, None]))
        self.weights, self.offset = (whiten @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.langs and t and LETTER.search(t)]
        for a in range(0, len(known), 128):
            part = known[a : a + 128]
            raw = (embedded([texts[i] for i in part]) @ self.landmarks) @ self.weights + self.offset
            odds = np.exp(SHARPEN * (raw - raw.max(axis=1, keepdims=True)).astype(np.float64))
            best = raw.argmax(axis=1)
            top = odds[np.arange(len(part)), best] / odds.sum(axis=1)
            for i, b, s in zip(part, best.tolist(), top.tolist()):
                lang[i], score[i] = self.langs[b], s
        return lang, score


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """A model of the rows from which labels may be learned."""
    rows = df.where(learnable(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}  # one row for each language
    if not counts:
        return Model(np.empty((0, DIMS), np.float32), [])
    each = min(per_lang, LEARNED / len(counts))
    part = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(each / n))])
    picked = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(share(F.col("doc_id")) < F.element_at(part, F.col("lang")))
    prepare(df.sparkSession)

    def of(batch: pa.RecordBatch) -> dict:
        made = [embedded([t])[0] for t in batch.column("text").to_pylist()]
        places = [np.flatnonzero(r).astype(np.int32) for r in made]
        return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "place": places, "value": [r[p] for r, p in zip(made, places)]}

    schema = "doc_id long, lang string, place array<int>, value array<float>"
    to, out = arrow_schema(schema), arrow_schema("model binary")

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = pa.Table.from_batches([b for b in batches if b.num_rows], to).sort_by([("doc_id", "ascending"), ("lang", "ascending")])
        held = np.zeros((sample.num_rows, DIMS), np.float32)
        for row, place, value in zip(held, sample.column("place"), sample.column("value")):
            row[place.values.to_numpy()] = value.values.to_numpy()
        yield as_batch({"model": [pickle.dumps(Model(held, sample.column("lang").to_pylist()))]}, out)

    # One task learns, so that the driver holds the model and not the sample.
    found = mapped(picked, of, schema).repartition(1).mapInArrow(learned, "model binary").first()
    return pickle.loads(found["model"]) if found else Model(np.empty((0, DIMS), np.float32), [])


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    prepare(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def of(batch: pa.RecordBatch) -> dict:
        lang, score = held.value.predict(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": lang, "score": score}

    return mapped(text_of(df, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id"))), of, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from ``df`` and predict every row of it."""
    return predict(df, fit(df, id_col, text_col, lang_col), id_col, text_col)


def known(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, with all columns, whose text is in some language: not ``und``.

    Where nothing could be learned, all texts with a letter may be.
    """
    model = fit(df, id_col, text_col, lang_col)
    prepare(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text_col).to_pylist()
        if not held.value.langs:
            return batch.filter(pa.array([bool(t and LETTER.search(t)) for t in texts], pa.bool_()))
        return batch.filter(pa.array([x != "und" for x in held.value.predict(texts)[0]], pa.bool_()))

    return df.mapInArrow(lambda batches: (keep(b) for b in batches), df.schema)
