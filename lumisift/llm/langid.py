"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its character n-grams (1 to 4 letters, word boundaries
included, hashed to BUCKETS), followed by a linear layer and a softmax; both are trained together
by stochastic gradient descent in numpy. As both layers are linear, a trained model is one table
of logits for each bucket. A part of the sample that training doesn't see sets the temperature
(least log loss) and the score under which predictions are rejected: the lowest at which the
accepted ones reach PRECISION. Rejected rows keep their prediction and have accepted false.

Only text and lang of rows that are not held out are learned from: a sample of about PER_LANGUAGE
rows of every language there is, drawn by a hash of doc_id and text. Rows are kept sparse. Prediction sees text alone.

Texts that are null or have no letter get `und`, score 0, and so does every text if there is
nothing to learn from. Whole texts are read. Ties of scores go to the language that sorts first.
Repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import slices

BUCKETS, DIMENSIONS, SIZES = 1 << 13, 16, (1, 2, 3, 4)
PER_LANGUAGE = 700
EPOCHS, BATCH, RATE, PRECISION = 12, 32, 8.0, 0.99
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Code points under 128 that are no letters become one boundary mark.
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def counts(text: str) -> np.ndarray:
    """How often each bucket is hit, as shares of all n-grams."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    low = code < 128
    code[low] = _ASCII[code[low]]
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
    out, h = np.zeros(BUCKETS, dtype=np.int64), np.zeros(len(code), dtype=np.uint32)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
        if n in SIZES:
            mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out += np.bincount(mixed >> np.uint32(19), minlength=BUCKETS)
    return (out / max(1, out.sum())).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    reject: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        p = _softmax(counts(text) @ self.logits + self.bias)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.reject)


@dataclass
class Counts:
    """Shares of buckets of many texts, row after row, without the zeros."""

    at: np.ndarray
    share: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def dense(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that some rows hit, and the rows' shares of those."""
        parts = [slice(self.starts[r], self.starts[r + 1]) for r in rows]
        hit, column = np.unique(np.concatenate([self.at[p] for p in parts]), return_inverse=True)
        out = np.zeros((len(rows), len(hit)), dtype=np.float32)
        out[np.repeat(np.arange(len(rows)), [p.stop - p.start for p in parts]), column] = np.concatenate([self.share[p] for p in parts])
        return hit, out

    def times(self, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
        """One product of a row's shares with a table at a time."""
        return np.stack([self.share[self.starts[r] : self.starts[r + 1]] @ table[self.at[self.starts[r] : self.starts[r + 1]]] for r in rows]) if len(rows) else np.zeros((0, table.shape[1]))


def sparse(rows: list[tuple[np.ndarray, np.ndarray]]) -> Counts:
    none = np.zeros(0)
    return Counts(np.concatenate([none.astype(np.int32), *(a for a, _ in rows)]), np.concatenate([none.astype(np.float32), *(s for _, s in rows)]), np.cumsum([0, *(len(a) for a, _ in rows)]))


def train(x: Counts, y: list[str], seed: int = 7) -> Model:
    """x: counts of the texts; y: their languages."""
    languages = sorted(set(y))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    number = {v: i for i, v in enumerate(languages)}
    own = np.array([number[v] for v in y])
    order = rng.permutation(len(own))
    rest, fit = (order[: len(own) // 5], order[len(own) // 5 :]) if len(own) >= 50 else (order, order)
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32), np.zeros(len(languages), dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(fit), BATCH):
            rows = fit[at : at + BATCH] if epoch == 0 else rng.choice(fit, min(BATCH, len(fit)))
            hit, shares = x.dense(rows)
            h = shares @ e[hit]
            off = _softmax(h @ w + b)
            off[np.arange(len(rows)), own[rows]] -= 1
            off /= len(rows)
            to_e = off @ w.T
            w -= 0.1 * rate * (h.T @ off)
            b -= 0.01 * rate * off.sum(axis=0)
            e[hit] -= 50 * rate * (shares.T @ to_e)
    z = x.times(rest, e @ w) + b
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(rest)), own[rest]] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
    t = min(loss, key=loss.get)
    p = _softmax(z / t)
    score, right = p.max(axis=1), p.argmax(axis=1) == own[rest]
    down = np.argsort(-score, kind="stable")
    precise = np.flatnonzero(np.cumsum(right[down]) >= PRECISION * np.arange(1, len(down) + 1))
    return Model(languages, (e @ w / t).astype(np.float32), b / t, float(score[down][precise[-1]]) if len(precise) else 1.0)


def model_of(docs: DataFrame, learn: Column) -> Model:
    """Learns from docs(doc_id, text, lang) where learn holds. The driver gets about PER_LANGUAGE sparse rows of each language."""
    known = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(learn).where("lang is not null and text is not null")
    have = known.groupBy("lang").agg(F.count("*").alias("n")).withColumn("part", F.least(F.lit(1.0), F.lit(PER_LANGUAGE) / F.col("n")))
    drawn = known.join(F.broadcast(have.select("lang", "part")), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("part") * (1 << 30))  # a row for each language is broadcast

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [counts(t) for t in batch.column("text").to_pylist()]
            hit = [np.flatnonzero(v).astype(np.int32) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([h.tobytes() for h in hit], pa.binary()), pa.array([v[h].tobytes() for v, h in zip(x, hit, strict=True)], pa.binary())], names=["doc_id", "lang", "at", "share"])

    rows: pd.DataFrame = drawn.select("doc_id", "text", "lang").mapInArrow(counted, "doc_id long, lang string, at binary, share binary").toPandas().sort_values(["lang", "doc_id", "at", "share"])
    return train(sparse([(np.frombuffer(a, dtype=np.int32), np.frombuffer(s, dtype=np.float32)) for a, s in zip(rows["at"], rows["share"], strict=True)]), rows["lang"].tolist())


def predicted(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [sent.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    own = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
