"""Exact top-k by Fagin's threshold algorithm.

Candidates are dealt to blocks by a hash of vec_id, queries to groups of bounded size; a block and
a group meet in one task. There each dimension is a list of the block's vectors sorted by value.
A query goes down all lists at once, from the top where its component is positive and from the
bottom where it is negative. At each depth the values there bound every vector: one that no list has
shown yet scores at most their weighted sum, one that some lists have shown at most that sum and what it
exceeds it by in those lists. Vectors are scored in full (random access) only if that bound reaches the
kth best score known so far, and the search stops as soon as no bound of an unscored vector does. Equal bounds go on
while a smaller vec_id could win the tie. Nothing is approximate.

The kth score to beat starts from a search among a bounded sample of the candidates, whose result
is a lower bound, so blocks without good candidates are left early; each further block needs less.

Components become floor(256 * x), x as double; scores are exact whatever their size, and one that doesn't fit a
long is an error. Vectors that are null, empty or hold a null or non-finite component take no part. Vectors of another length
than the query's are no candidates, nor are rows of the query's own vec_id. Rows that repeat a vec_id are candidates of their own;
a query that is repeated with the same vector is asked once, and with other vectors the results are ranked together.

Cost: a group of queries meets every block, so candidates are copied once for each GROUP_ROWS queries and queries
once for each BLOCK_ROWS candidates; sorting a block's lists is small beside searching them for a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisift.llm.common import by_group, cut

BLOCK_ROWS, GROUP_ROWS, SAMPLE_ROWS = 8192, 1024, 4096
#: Depths at which a query looks at its bounds, as shares of a list; what is left is scored when it is at most LEFT of the block.
DEPTHS, LEFT = (1 / 256, 1 / 64, 1 / 16, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1), 1 / 8
_EXACT = float(1 << 53)


def whole_numbers(x: list[float]) -> np.ndarray | None:
    """floor(256 * x) of a vector, None if it takes no part."""
    if not x or None in x:
        return None
    own = np.array(x, dtype=np.float64)
    if not np.isfinite(own).all():
        return None
    with np.errstate(over="ignore"):
        v = np.floor(256 * own)
    if not np.isfinite(v).all():
        raise OverflowError("a component times 256 is no double")
    return v


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, dims, vectors = [], [], []
        for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if i is not None and (v := whole_numbers(x)) is not None:
                ids.append(i), dims.append(len(v)), vectors.append(v.astype("<i4" if np.abs(v).max() < 1 << 31 else "<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())], names=["vec_id", "dim", "v"])


def unpacked(data: list[bytes], dim: int) -> np.ndarray:
    """Rows of whole numbers as doubles."""
    out = np.empty((len(data), dim))
    small = np.array([len(d) == 4 * dim for d in data], dtype=bool)
    out[small] = np.frombuffer(b"".join(d for d in data if len(d) == 4 * dim), dtype="<i4").reshape(-1, dim)
    out[~small] = np.frombuffer(b"".join(d for d in data if len(d) != 4 * dim), dtype="<f8").reshape(-1, dim)
    return out


class Lists:
    """The vectors of one block and their sorted lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # rows in order of id: ties of scores go to the smaller row
        self.ids, self.x = ids[order], np.asarray(x, dtype=np.float64)[order]
        by_list = np.ascontiguousarray(self.x.T)
        self.rows = np.argsort(-by_list, axis=1, kind="stable")
        self.values = np.take_along_axis(by_list, self.rows, axis=1)
        self.most = float(np.abs(self.x).max(initial=0))
        n = len(self.ids)
        self.depths = sorted({min(n, max(1, int(np.ceil(n * d)))) for d in DEPTHS}) if n else []

    def scores(self, rows: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
        if exact:  # all sums are whole numbers that doubles hold
            return (self.x[rows] @ q).astype(np.int64)
        own = [int(v) for v in q]
        found = [sum(int(a) * b for a, b in zip(r, own, strict=True)) for r in self.x[rows]]
        if any(abs(s) >= 1 << 63 for s in found):
            raise OverflowError("a score doesn't fit a long")
        return np.array(found, dtype=np.int64)

    def best(self, q: np.ndarray, k: int, own: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best k, of those that reach least, and how many vectors were scored."""
        n, q = len(self.ids), np.asarray(q, dtype=np.float64)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        total = float(np.abs(q).sum())
        exact = self.most * total < _EXACT
        slack = 0.0 if exact else self.most * total * 2.0**-40  # rounding of the bounds
        open_ = self.ids != own
        top, top_rows, scored = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0

        def take(rows: np.ndarray) -> None:
            nonlocal top, top_rows, scored
            open_[rows] = False
            scored += len(rows)
            rows_, found = np.concatenate([top_rows, rows]), np.concatenate([top, self.scores(rows, q, exact)])
            pick = np.lexsort((rows_, -found))[:k]
            top_rows, top = rows_[pick], found[pick]

        for to in self.depths:
            at_up, at_down = self.values[up, to - 1], self.values[down, n - to]
            unseen = float(at_up @ q[up]) + float(at_down @ q[down]) + slack
            bar = -np.inf if least is None else float(least)
            if len(top) == k and unseen > max(bar, float(top[-1])) and to < n:
                continue  # so high a bound of all vectors excludes none: further down
            # what each vector that was met exceeds the values at this depth by
            bound = np.full(n, unseen)
            for i, v in zip(up, at_up, strict=True):
                bound[self.rows[i, :to]] += (self.values[i, :to] - v) * q[i]
            for i, v in zip(down, at_down, strict=True):
                bound[self.rows[i, n - to :]] += (self.values[i, n - to :] - v) * q[i]
            if scored < k:
                rest = np.flatnonzero(open_)
                if len(rest):
                    take(rest[np.argpartition(-bound[rest], min(4 * k, len(rest)) - 1)[: 4 * k]])
            # a bound of the kth score is enough only for a smaller row; one of another block's score always is
            may = bound >= bar
            if len(top) == k and top[-1] >= bar:
                may = (bound > float(top[-1])) | ((bound >= float(top[-1])) & (np.arange(n) < top_rows[-1]))
            left = np.flatnonzero(open_ & may)
            if not len(left):
                break
            if len(left) <= max(4 * k, LEFT * n) or to == n:
                # the most promising first: they raise the kth score that the others have to reach
                for part in np.array_split(left[np.argsort(-bound[left], kind="stable")], 4):
                    if len(top) == k:
                        part = part[bound[part] >= float(top[-1])]
                    take(part)
                break
        keep = top >= least if least is not None else np.ones(len(top), dtype=bool)
        return self.ids[top_rows[keep]], top[keep], scored


def _search(k: int) -> Callable[[tuple, pa.Table], Iterable[pa.RecordBatch]]:
    def of(key: tuple, rows: pa.Table) -> Iterable[pa.RecordBatch]:
        asks = np.array(rows.column("asks").to_pylist(), dtype=bool)
        if asks.all() or not asks.any():
            return
        ids, least, x = np.array(rows.column("vec_id").to_pylist(), dtype=np.int64), rows.column("least").to_pylist(), unpacked(rows.column("v").to_pylist(), key[0])
        lists = Lists(ids[~asks], x[~asks])
        queries = {(int(ids[i]), x[i].tobytes()): i for i in np.flatnonzero(asks)}  # one that is repeated is asked once
        out = [(q, *lists.best(x[i], k, q, least[i])) for (q, _), i in queries.items()]
        sizes = [len(o[1]) for o in out]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([o[0] for o in out], sizes).astype(np.int64)), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out])), pa.array(np.repeat([o[3] for o in out], sizes).astype(np.int64))], names=["query_id", "vec_id", "score", "scored"])

    return of


def _near(candidates: DataFrame, queries: DataFrame, k: int, blocks: int, groups: int) -> DataFrame:
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.select("dim", own(blocks).alias("block"), each(groups).alias("grp"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("long").alias("least"))
    right = queries.select("dim", each(blocks).alias("block"), own(groups).alias("grp"), F.lit(True).alias("asks"), "vec_id", "v", "least")
    return by_group(left.union(right), ["dim", "block", "grp"], _search(k), "query_id long, vec_id long, score long, scored long")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """The k best candidates of every row of vectors(vec_id, embedding) for which asks holds: query_id, rank, vec_id, score."""
    whole = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_whole, "vec_id long, dim int, v binary"))
    count = whole.agg(F.count("*").alias("n"), F.count_if(asks).alias("q")).first()
    blocks, groups = -(-count.n // BLOCK_ROWS) or 1, -(-count.q // GROUP_ROWS) or 1
    queries = whole.where(asks).withColumn("least", F.lit(None).cast("long"))
    if blocks > 1:
        share = int((1 << 30) * min(1.0, SAMPLE_ROWS / count.n))
        first = _near(whole.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < share), queries, k, 1, groups)
        least = _ranked(first, k).where(F.col("rank") == k).select("vec_id", "query_id", "score")
        least = cut(least.select(F.col("query_id").alias("vec_id"), F.col("score").alias("least")))
        queries = queries.drop("least").join(least, "vec_id", "left")
    return _ranked(_near(whole, queries, k, blocks, groups), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
