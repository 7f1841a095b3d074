"""Benchmark decontamination: a lossless filter by rare words, then Smith-Waterman alignment.

The local score (match 2, mismatch -1, gap -1) is divided by that of a full copy. An alignment that reaches
the threshold t with an item of m words matches at least t * m of them, so it leaves at most (1 - t) * m
unmatched, and spans at most m + 2 * (1 - t) * m words of the text. So of any set of the item's words that is
greater by k, k are matched within that span, in whatever order and with whatever edits between them. The set
is the item's rarest words, so few texts have k of them so near; rarity is judged from the first texts of
a task and only decides how much is aligned, never what is found. What passes is bounded again by all of the
item's words (2 for a word that the item has, -1 for another), then aligned with the whole item.

The benchmark comes in blocks of at most BLOCK_WORDS words, so what is broadcast is bounded;
each block is a scan. Documents are never shuffled, and long ones are filtered in pieces.

Null and word-free texts and items match nothing, nor do items of fewer than least_words words, a parameter (half of so
short an item is no evidence). Documents and items without an id take part and are reported under null. Repeated rows of a
document give one row for each item. Ties: the best score counts, then the first place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import by_text, id_text, slices
from lumisift.llm.words import word_hashes

LEAST_WORDS, THRESHOLD = 4, 0.5
BLOCK_WORDS, PIECE_WORDS, SAMPLE_TEXTS = 2_000_000, 1 << 16, 64
MATCH, MISMATCH, GAP = 2, -1, 1
_BITS = 20


class Items:
    """Some test items, and for each the fewest words that an alignment matches and the most that it spans."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        self.own = [np.unique(w) for w in self.words]
        self.vocabulary, self.at = np.unique(np.concatenate(self.words), return_inverse=True)
        size = np.array([len(w) for w in self.words])
        matched = np.maximum(1, np.ceil(threshold * size - 1e-9)).astype(np.int64)
        self.least = [threshold * MATCH * len(w) for w in self.words]
        self.span = size + np.ceil(2 * (size - threshold * size)).astype(np.int64)
        self.count = np.minimum(matched, 1 + matched // 5)
        self.size, self.taken = size, size - matched + self.count

    def seeds(self, texts: list[str | None]) -> Seeds:
        """Each item's rarest words, by how often these texts have them."""
        often = np.zeros(len(self.vocabulary), dtype=np.int64)
        for text in texts:
            words = word_hashes(text)[0]
            there = np.minimum(np.searchsorted(self.vocabulary, words), len(often) - 1)
            often += np.bincount(there[self.vocabulary[there] == words], minlength=len(often))
        owner = np.repeat(np.arange(len(self.size)), self.size)
        order = np.lexsort((self.at, often[self.at], owner))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        kept = order[rank < self.taken[owner]]
        pairs = np.unique(np.stack([self.at[kept], owner[kept]]), axis=1)
        return Seeds(self, *pairs)


class Seeds:
    """Which items have a word among their rarest."""

    def __init__(self, items: Items, at: np.ndarray, owners: np.ndarray):
        used, first = np.unique(at, return_index=True)
        self.items, self.words, self.owners, self.first = items, items.vocabulary[used], owners, np.append(first, len(at))
        self.may = np.zeros(1 << _BITS, dtype=bool)
        self.may[self.words >> np.uint64(64 - _BITS)] = True

    def regions(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Item and first and end word of each stretch of a text that may hold an alignment at the threshold."""
        at = np.flatnonzero(self.may[words >> np.uint64(64 - _BITS)])
        number = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
        hit = self.words[number] == words[at]
        at, number = at[hit], number[hit]
        each = self.first[number + 1] - self.first[number]
        owner = self.owners[np.repeat(self.first[number] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        order = np.argsort(owner, kind="stable")
        owner, at = owner[order], np.repeat(at, each)[order]
        last = np.arange(len(owner)) + self.items.count[owner] - 1
        j = np.flatnonzero(last < len(owner))
        j = j[(owner[last[j]] == owner[j]) & (at[last[j]] - at[j] < self.items.span[owner[j]])]
        if not len(j):
            return
        low, high, owner = np.maximum(0, at[last[j]] + 1 - self.items.span[owner[j]]), at[j] + self.items.span[owner[j]], owner[j]
        for part in np.split(np.arange(len(j)), np.flatnonzero((owner[1:] != owner[:-1]) | (low[1:] > high[:-1])) + 1):
            yield int(owner[part[0]]), int(low[part[0]]), int(high[part[-1]])


def item_blocks(benchmark: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> Iterator[Items]:
    held, words = [], 0
    for row in benchmark.select(F.col("item_id").try_cast("long").alias("item_id"), "text").toLocalIterator():
        own = word_hashes(row.text)[0]
        if len(own) >= max(1, least_words):
            held.append((row.item_id, own))
            words += len(own)
        if words >= BLOCK_WORDS:
            yield Items(held, threshold)
            held, words = [], 0
    if held:
        yield Items(held, threshold)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local score, and the end (exclusive) in text of the first alignment that has it."""
    best, end = 0, 0
    step = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for word in item:
        new = np.maximum(row - GAP, 0)
        np.maximum(new[1:], row[:-1] + np.where(text == word, MATCH, MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new + GAP * step) - GAP * step
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def bound(own: np.ndarray, text: np.ndarray) -> int:
    """No local score is higher: the best stretch of text, each word of the item (own: distinct, sorted) counting MATCH."""
    there = own[np.minimum(np.searchsorted(own, text), len(own) - 1)] == text
    total = np.concatenate([[0], np.cumsum(np.where(there, MATCH, MISMATCH))])
    return int((total - np.minimum.accumulate(total)).max())


def found(seeds: Seeds, words: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
    """Item, share of a full copy's score, first and end word of the alignments at the threshold."""
    items = seeds.items
    over = int(items.span.max())
    for begin in range(0, len(words), PIECE_WORDS):
        for i, low, high in seeds.regions(words[begin : begin + PIECE_WORDS + over]):
            low, item = begin + low, items.words[i]
            near = words[low : begin + high]
            if bound(items.own[i], near) < items.least[i]:
                continue
            score, end = align(item, near)
            if score >= items.least[i]:
                length = align(item[::-1], near[:end][::-1])[1]
                yield items.ids[i], score / (MATCH * len(item)), low + end - length, low + end


def _leaks(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = None
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            seeds = seeds or items.value.seeds(texts[:SAMPLE_TEXTS])
            out = [(doc, *x) for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True) for x in found(seeds, word_hashes(text)[0])]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every (doc_id, item_id) whose best alignment has at least the threshold of a full copy's score, with the score and the words it spans."""
    spark = docs.sparkSession
    docs = id_text(docs)
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, threshold, least_words):
        out = out.union(docs.mapInArrow(_leaks(spark.sparkContext.broadcast(block)), schema))
    best = F.max(F.struct("score", -F.col("first_word"), "end_word"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("first_word"), F.col("b.end_word").alias("end_word"))


def _clean(items):
    def judge(parts: Iterator[list[str | None]]) -> Iterator[list[bool]]:
        seeds = None
        for texts in parts:
            seeds = seeds or items.value.seeds(texts[:SAMPLE_TEXTS])
            yield [next(found(seeds, word_hashes(t)[0]), None) is None for t in texts]

    return judge


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without the rows in which an item is found; each row is judged in place, by its text alone, and all columns stay."""
    out = docs
    for block in item_blocks(benchmark, threshold, least_words):
        out = by_text(out, _clean(docs.sparkSession.sparkContext.broadcast(block)))
    return out
