"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over the presence of words and
word beginnings; each later model also gets the probabilities of the categories before it,
in training those predicted out of fold. Weights are held non-negative, so a long
text isn't clean just for its length and an earlier category only adds suspicion, and an L1 penalty keeps only those that matter.

The chain is low_quality, common, rare, toxic. The first and the last are human labels. The two between are parts of the
toxic rows, found from the data: those that hold one of the words that many toxic rows share, and those that hold only others
which few share. Words, and these parts, are chosen from the rows that a model learns from and from no others, so what is predicted
out of fold has seen nothing of its fold. The threshold is the one with the best F1 out of fold.

Training takes a bounded sample of labelled rows (SAMPLE toxic, twice as many others, drawn
by a hash of doc_id). Of labels that disagree on a doc_id toxic counts, and low quality; a missing quality is left out of the first model.

Texts without a letter, null ones too, are never rejected and get the base rate; without any labelled toxic row
every probability is 0 and nothing is rejected. Repeated rows are scored alike; of texts that share a
labelled doc_id the first in order is learned from. Each row is scored by itself, on its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import by_text, id_text, slices

CATEGORIES = ("low_quality", "common", "rare", "toxic")
SAMPLE, FEATURES, FOLDS = 2000, 512, 5
PREFIXES = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def names_of(word: str) -> list[str]:
    """The word, and its beginnings marked as such."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Texts:
    """The names that each text shows, as numbers: row of[i] shows name at[i]. Every word is looked at once."""

    def __init__(self, words: list[list[str]]):
        numbers: dict[str, int] = {}
        of_word: dict[str, list[int]] = {}
        rows = []
        for own in words:
            found: set[int] = set()
            for w in own:
                if (of := of_word.get(w)) is None:
                    of = of_word[w] = [numbers.setdefault(n, len(numbers)) for n in names_of(w)]
                found.update(of)
            rows.append(np.fromiter(found, dtype=np.int32, count=len(found)))
        self.names, self.n = list(numbers), len(words)
        self.of = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])
        self.at = np.concatenate([np.zeros(0, dtype=np.int32), *rows])

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """In how many of the rows, a mask, each name is."""
        return np.bincount(self.at[rows[self.of]], minlength=len(self.names))

    def chosen(self, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Names that are much more common where y is 1, at most FEATURES, best first. Only names that some of those rows share are counted."""
        hit, other = rows & (y == 1), rows & (y == 0)
        p, q, bad, good = max(1, hit.sum()), max(1, other.sum()), self.counts(hit), self.counts(other)
        may = np.flatnonzero((bad >= 3) & (bad / p > 4 * (good / q)))
        lift = bad[may] * np.log((bad[may] + 0.5) / p / ((good[may] + 0.5) / q))
        return np.array(sorted(may.tolist(), key=dict(zip(may.tolist(), zip((-lift).tolist(), [self.names[i] for i in may], strict=True), strict=True)).get)[:FEATURES], dtype=np.int64)

    def showing(self, features: np.ndarray) -> Rows:
        """All texts by these names alone."""
        column = np.full(len(self.names), -1)
        column[features] = np.arange(len(features))
        there = column[self.at] >= 0
        return Rows(self.of[there], column[self.at[there]], self.n, len(features))


class Rows:
    """A sparse matrix of zeros and ones: row of[i] has column at[i]."""

    def __init__(self, of: np.ndarray, at: np.ndarray, n: int, width: int):
        self.of, self.at, self.n, self.width = of, at, n, width

    def only(self, rows: np.ndarray) -> Rows:
        number = np.full(self.n, -1)
        number[rows] = np.arange(len(rows))
        there = number[self.of] >= 0
        return Rows(number[self.of[there]], self.at[there], len(rows), self.width)

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=v[self.at], minlength=self.n)

    def back(self, off: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=off[self.of], minlength=self.width)


def fit(x: Rows, extra: np.ndarray, y: np.ndarray, penalty: float = 2e-4, rounds: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by accelerated proximal gradient: weights of x, with an L1 penalty, of extra, none negative, and the intercept."""
    n, k = len(y), x.width
    b = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    w = np.zeros(k + extra.shape[1])
    if not 0 < y.sum() < n:
        return w[:k], w[k:], b
    times = lambda v: x.times(v[:k]) + extra @ v[k:]
    back = lambda off: np.concatenate([x.back(off), extra.T @ off])
    u = np.ones(len(w))
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        u = back(times(u)) + 1e-12
        u /= np.linalg.norm(u)
    step = 4 * n / (float(u @ back(times(u))) + n)
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        off = _sigmoid(times(v) + c) - y
        w2 = v - step * back(off) / n
        w2[:k] -= step * penalty
        w2 = np.maximum(w2, 0)
        b2 = c - step * off.sum() / n
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w[:k], w[k:], b


@dataclass
class Chain:
    """For each category the weights of its features, of the earlier categories, and its intercept."""

    categories: tuple[str, ...]
    weights: list[dict[str, float]]
    earlier: list[np.ndarray]
    bases: list[float]
    threshold: float

    def __post_init__(self):
        self.known = {n for own in self.weights for n in own}
        self.seen: dict[str, tuple[str, ...]] = {}

    def names(self, words: Iterable[str]) -> set[str]:
        """Features that these words show."""
        if len(self.seen) > 100_000:
            self.seen.clear()
        on: set[str] = set()
        for word in words:
            if (of := self.seen.get(word)) is None:
                of = self.seen[word] = tuple(n for n in names_of(word) if n in self.known)
            if of:
                on.update(of)
        return on

    def judged(self, text: str | None) -> tuple[list[float], bool]:
        """The probability of each category, and whether the text is rejected."""
        words = words_of(text)
        on = sorted(self.names(words))
        out: list[float] = []
        for own, before, b in zip(self.weights, self.earlier, self.bases, strict=True):
            out.append(float(_sigmoid(np.asarray(b + sum(own.get(n, 0.0) for n in on) + np.dot(before, out)))))
        return out, bool(words) and out[-1] >= self.threshold

    def score(self, text: str | None) -> list[float]:
        return self.judged(text)[0]


class Learnt:
    """What the models of all categories see: features and labels come from the rows of `own` alone, all rows are shown by them."""

    def __init__(self, texts: Texts, toxic: np.ndarray, low: np.ndarray, own: np.ndarray):
        rated = own & np.isfinite(low)
        words, junk = texts.chosen(own, toxic), texts.chosen(rated, low)
        x, often = texts.showing(words), texts.counts(own & (toxic == 1))[words]
        most = texts.showing(words[often >= np.quantile(often, 0.75)] if len(words) else words)
        common, some = np.bincount(most.of, minlength=texts.n) > 0, np.bincount(x.of, minlength=texts.n) > 0
        self.labels = {"low_quality": low, "common": toxic * common, "rare": toxic * (some & ~common), "toxic": toxic}
        self.rows = {"low_quality": rated} | dict.fromkeys(CATEGORIES[1:], own)
        self.features = {"low_quality": junk} | dict.fromkeys(CATEGORIES[1:], words)
        self.shown = {"low_quality": texts.showing(junk)} | dict.fromkeys(CATEGORIES[1:], x)

    def fitted(self, category: str, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        rows = np.flatnonzero(self.rows[category])
        return fit(self.shown[category].only(rows), earlier[rows], self.labels[category][rows].astype(float))

    def predicted(self, category: str, earlier: np.ndarray, rows: np.ndarray, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
        w, u, b = model
        return _sigmoid(self.shown[category].only(rows).times(w) + earlier[rows] @ u + b)


def train(texts: list[list[str]], toxic: np.ndarray, low: np.ndarray, folds: np.ndarray) -> Chain:
    """texts: the distinct words of each; toxic: 0 or 1; low: 0, 1 or NaN, whether its quality is low."""
    n = len(texts)
    if not n or not toxic.any():
        return Chain(CATEGORIES, [{} for _ in CATEGORIES], [np.zeros(i) for i in range(len(CATEGORIES))], [-30.0] * len(CATEGORIES), 0.5)
    shown = Texts(texts)
    whole = Learnt(shown, toxic, low, np.ones(n, dtype=bool))
    parts = {k: Learnt(shown, toxic, low, folds != k) for k in np.unique(folds)} if len(np.unique(folds)) > 1 else {folds[0]: whole}
    weights, before, bases, earlier = [], [], [], np.zeros((n, 0))
    for category in CATEGORIES:
        out_of_fold = np.empty(n)
        for k, part in parts.items():
            held = np.flatnonzero(folds == k)
            out_of_fold[held] = part.predicted(category, earlier, held, part.fitted(category, earlier))
        w, u, b = whole.fitted(category, earlier)
        weights.append({shown.names[i]: float(v) for i, v in zip(whole.features[category], w, strict=True) if v > 0})
        before.append(u), bases.append(b)
        earlier = np.hstack([earlier, out_of_fold[:, None]])
    return Chain(CATEGORIES, weights, before, bases, cut_point(earlier[:, -1], toxic))


def cut_point(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1; the middle of the gap that gives it."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    i = int(f1.argmax())
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else 0)) / 2)


def sample_of(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> pd.DataFrame:
    """doc_id, toxic, low and the distinct words, a line each, of at most size toxic and twice as many other labelled rows, about."""
    quality = F.col("quality").try_cast("int") if "quality" in labels.columns else F.lit(None).cast("int")
    known = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("toxic").try_cast("int").alias("toxic"), quality.alias("quality")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), (1 - F.min(F.when(F.col("quality").isin(0, 1), F.col("quality")))).alias("low"))
    have = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    most = {0: 2 * size, 1: size}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.when(F.col("toxic") == 1, min(1.0, most[1] / max(1, have.get(1, 0)))).otherwise(min(1.0, most[0] / max(1, have.get(0, 0))))
    drawn = known.where(place < share * (1 << 30)).orderBy(place, "doc_id").limit(4 * size)

    def words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "toxic": part["toxic"], "low": part["low"].astype(float), "words": ["\n".join(sorted(words_of(t))) for t in part["text"]]})

    got = id_text(docs).where("text is not null").join(F.broadcast(drawn), "doc_id")  # at most 4 * size rows of three numbers are broadcast
    return got.mapInPandas(words, "doc_id long, toxic int, low double, words string").toPandas().sort_values(["doc_id", "words"]).drop_duplicates("doc_id")


def chain_of(docs: DataFrame, labels: DataFrame) -> Chain:
    rows = sample_of(docs, labels)
    once: dict[str, str] = {}  # one object for each word keeps the driver small
    texts = [[once.setdefault(w, w) for w in ws.split("\n") if w] for ws in rows.pop("words")]
    ids = rows["doc_id"].to_numpy(dtype=np.int64)
    return train(texts, rows["toxic"].to_numpy(dtype=float), rows["low"].to_numpy(dtype=float), ids * 2654435761 % 1000003 % FOLDS)


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, toxic (0 or 1: whether the row is rejected), a probability for each category."""
    model = docs.sparkSession.sparkContext.broadcast(chain)  # at most 2 * FEATURES words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches):
            out = [m.judged(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([int(bad) for _, bad in out], pa.int32()), *(pa.array([round(p[i], 6) for p, _ in out], pa.float64()) for i in range(len(m.categories)))], names=["doc_id", "toxic", *(f"p_{c}" for c in m.categories)])

    return id_text(docs).mapInArrow(run, "doc_id long, toxic int, " + ", ".join(f"p_{c} double" for c in chain.categories))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the chain rejects; scored in place, so no row moves. Rows with a null or word-free text stay."""
    model = docs.sparkSession.sparkContext.broadcast(chain_of(docs, labels))

    def clean(parts: Iterator[list[str | None]]) -> Iterator[list[bool]]:
        m = model.value
        for texts in parts:
            yield [not m.judged(t)[1] for t in texts]

    return by_text(docs, clean)
