"""Exact nearest neighbours by inner product.

Rows are dealt to blocks of bounded size, and each pair of a block of queries and a block of the database is a
cell: one task, which multiplies the two in numpy and keeps each query's own best k (functions.nearest). No
side is broadcast or collected, and no pairs are made: the shuffle that follows carries queries times blocks times k rows.
Neighbours can be searched inside the groups of a key: a key with many rows has cells of its own, the others share some.

Two plans give the same rows: `block` takes the products from the cells, `expr` takes only the pairs from
them and computes the products as a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.functions import nearest, vectors

#: A block's rows and bytes at most. Small tables are dealt to SPREAD blocks, of LEAST_ROWS rows at least, so that all cores have work.
BLOCK_ROWS, BLOCK_BYTES, SPREAD, LEAST_ROWS = 65_536, 1 << 26, 8, 2048
#: Keys that have cells of their own, at most.
OWN_KEYS = 1024
TOP_K = 15
#: Scores are rounded before they are ranked; a cell keeps what could still tie after rounding.
DIGITS = 6


def _block_rows(rows: int, size: int) -> int:
    """Rows of a block for a table of so many rows of so many bytes."""
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, size), max(LEAST_ROWS, -(-rows // SPREAD))))


def _packed(rows: DataFrame, name: str, keyed: bool) -> tuple[DataFrame, str]:
    """rows with their vectors as bytes, and the numpy type of these; vectors with a null, an infinity or a NaN take no part."""
    single = rows.schema["vector"].dataType.elementType == T.FloatType()
    kind = "<f4" if single else "<f8"
    columns = ["key", name] if keyed else [name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(len(columns))
            sizes = pc.list_value_length(given).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                part = batch if (sizes == dim).all() else batch.filter(pa.array(sizes == dim))
                x = part.column(len(columns)).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)
                real = np.isfinite(x).all(axis=1)
                x, part = np.ascontiguousarray(x[real]), part.filter(pa.array(real))
                ends = np.arange(len(x) + 1, dtype=np.int32) * (x.itemsize * dim)
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], packed], names=[*columns, "v"])

    vector = F.col("vector") if single else F.col("vector").cast("array<double>")
    own = rows.select(*columns, vector.alias("vector"))
    return own.mapInArrow(run, T.StructType([*(f for f in own.schema if f.name != "vector"), T.StructField("v", T.BinaryType())])), kind


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Equal values of all columns as equal numbers."""
    joined = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type)
    codes = pc.fill_null(joined.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _matrix(v: pa.ChunkedArray, kind: str) -> np.ndarray:
    sizes = pc.unique(pc.binary_length(v)).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes} bytes")
    out = np.frombuffer(b"".join(v.to_pylist()), dtype=kind)
    return out.reshape(len(v), -1)


def _ordered(ids: pa.ChunkedArray) -> np.ndarray:
    """Row numbers in the order of ids, as Spark orders them; a struct by its fields."""
    fields = ids.combine_chunks().flatten() if pa.types.is_struct(ids.type) else [ids]
    names = [f"f{i}" for i in range(len(fields))]
    return pc.sort_indices(pa.table(list(fields), names=names), [(n, "ascending") for n in names], null_placement="at_start").to_numpy()


def _cell(left: pa.Table, right: pa.Table, k: int, slack: float, sign: float, exclude_self: bool, kinds: tuple[str, str], keyed: bool) -> Iterator[pa.Table]:
    right = right.take(_ordered(right.column("item_id")))
    q, d = _matrix(left.column("v"), kinds[0]), _matrix(right.column("v"), kinds[1])
    if q.shape[1] != d.shape[1]:
        raise ValueError(f"vectors of {q.shape[1]} and {d.shape[1]} components")
    if sign < 0:
        q = -q
    q_keys, d_keys = _codes(left.column("key"), right.column("key")) if keyed else (np.zeros(len(q)), np.zeros(len(d)))
    ids = [left.column("query_id"), right.column("item_id")]
    if all(pa.types.is_integer(x.type) for x in ids):
        ids = [x.cast(pa.int64()) for x in ids]
    q_ids, d_ids = _codes(*ids) if exclude_self and ids[0].type == ids[1].type else (None, None)  # ids of different types are never equal
    q_order, d_order = np.argsort(q_keys, kind="stable"), np.argsort(d_keys, kind="stable")
    own_part = lambda order, keys, key: order[slice(*np.searchsorted(keys, (key, key + 1)))]
    for key in np.intersect1d(q_keys, d_keys):
        rows, columns = own_part(q_order, q_keys[q_order], key), own_part(d_order, d_keys[d_order], key)
        if q_ids is None or len(np.unique(d_ids[columns])) == len(columns):  # of equal vectors only the first can be among the best
            columns = columns[nearest.firsts_of_equal(d[columns], k + (q_ids is not None))]
        own = None
        if q_ids is not None:
            by_id = np.argsort(d_ids[columns], kind="stable")
            at = d_ids[columns][by_id]
            lo, hi = np.searchsorted(at, q_ids[rows], "left"), np.searchsorted(at, q_ids[rows], "right")
            r = np.repeat(np.arange(len(rows)), hi - lo)
            own = r, by_id[np.arange(len(r)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        r, c, raw = nearest.best(q[rows], d[columns], k, slack, own)
        asked = left.select([*(["key"] if keyed else []), "query_id"]).take(rows[r])
        yield asked.append_column("item_id", right.column("item_id").take(columns[c])).append_column("raw", pa.array(raw * sign))


def _dealt(rows: DataFrame, asks: bool, other_id: T.StructField, blocks: int, others: int, keys: DataFrame | None, shared: int) -> DataFrame:
    """Rows as (cell, asks, key, query_id, item_id, v), each in all cells of its block. keys: the first cell and the numbers of blocks of those keys that have cells of their own."""
    name, key = "query_id" if asks else "item_id", []
    first, mine, yours = F.lit(0), F.lit(blocks), F.lit(others)
    if keys is not None:
        sizes = ("q_blocks", "d_blocks") if asks else ("d_blocks", "q_blocks")
        rows, key = rows.join(F.broadcast(keys), F.col("key") == F.col("own key"), "left"), ["key"]  # at most OWN_KEYS rows
        first = F.coalesce("first", F.pmod(F.xxhash64("key"), F.lit(shared)).cast("int"))
        mine, yours = (F.coalesce(s, F.lit(1)) for s in sizes)
    block, other = F.pmod(F.xxhash64(name), mine).cast("int"), F.explode(F.sequence(F.lit(0), yours - 1))
    own = rows.withColumns({"at": first, "block": block, "width": yours if asks else mine}).withColumn("other", other)
    cell = F.col("at") + (F.col("block") * F.col("width") + F.col("other") if asks else F.col("other") * F.col("width") + F.col("block"))
    ids = {name: F.col(name), other_id.name: F.lit(None).cast(other_id.dataType)}
    return own.select(cell.cast("int").alias("cell"), F.lit(asks).alias("asks"), *key, *(ids[n].alias(n) for n in ("query_id", "item_id")), "v")


def near(queries: DataFrame, database: DataFrame, k: int, scale: float = 1.0, exclude_self: bool = False, keyed: bool = False) -> DataFrame:
    """(key,) query_id, item_id, raw: the pairs whose products can be among a query's best k once they are times scale and rounded.

    keyed: queries and database have a column key, and only rows with the same key meet.
    """
    names = ["query_id", "item_id"]
    sides = [df.where(F.col("vector").isNotNull()) for df in (queries, database)]
    if exclude_self:
        sides = [df.where(F.col(n).isNotNull()) for df, n in zip(sides, names, strict=True)]
    if keyed:
        sides = [df.where(F.col("key").isNotNull()) for df in sides]
    size = F.max(F.size("vector").cast("long")) * 8
    counts, keys, shared = [df.agg(F.count("*").alias("n"), size.alias("size")).first() for df in sides], None, 0
    limits = [_block_rows(c.n, c.size or 0) for c in counts]
    blocks = [max(1, -(-c.n // limit)) for c, limit in zip(counts, limits, strict=True)]
    cells = blocks[0] * blocks[1]
    if keyed:
        each = [df.groupBy("key").agg(F.count("*").alias(n)) for df, n in zip(sides, "qd", strict=True)]
        least = max(LEAST_ROWS, -(-(counts[0].n + counts[1].n) // OWN_KEYS))
        large = each[0].join(each[1], "key").where(F.col("q") + F.col("d") >= least).orderBy("key").collect()  # at most OWN_KEYS
        shared = cells = max(blocks)
        rows = []
        for r in large:
            own = [-(-n // limit) for n, limit in zip((r.q, r.d), limits, strict=True)]
            rows.append((r.key, cells, *own))
            cells += own[0] * own[1]
        kind = T.StructType([T.StructField("own key", sides[0].schema["key"].dataType), *(T.StructField(n, T.IntegerType()) for n in ("first", "q_blocks", "d_blocks"))])
        keys = queries.sparkSession.createDataFrame(rows, kind)
    packed, kinds = zip(*(_packed(df, n, keyed) for df, n in zip(sides, names, strict=True)), strict=True)
    id_fields = [df.schema[n] for df, n in zip(sides, names, strict=True)]
    left = _dealt(packed[0], True, id_fields[1], *blocks, keys, shared)
    right = _dealt(packed[1], False, id_fields[0], *reversed(blocks), keys, shared)
    sign, slack = math.copysign(1.0, scale), 2 * 10.0**-DIGITS / abs(scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        held.clear()
        for cell in pc.unique(rows.column("cell")).to_pylist():
            mine = rows.filter(pc.equal(rows.column("cell"), cell))
            asks = mine.column("asks")
            q, d = mine.filter(asks), mine.filter(pc.invert(asks))
            if len(q) and len(d):
                for part in _cell(q, d, k, slack, sign, exclude_self, kinds, keyed):
                    yield from part.to_batches(max_chunksize=1 << 16)

    out = T.StructType([*([sides[0].schema["key"]] if keyed else []), *id_fields, T.StructField("raw", T.DoubleType())])
    return left.union(right).repartitionById(cells, F.col("cell")).mapInArrow(run, out)


def scored_pairs(pairs: DataFrame, queries: DataFrame, database: DataFrame, score: Column) -> DataFrame:
    """query_id, item_id and score of pairs(query_id, item_id): queries(query_id, q), database(item_id, d)."""
    both = pairs.select(F.col("query_id").alias("asked"), F.col("item_id").alias("met")).distinct()
    met = both.join(queries, F.col("asked").eqNullSafe(F.col("query_id"))).join(database, F.col("met").eqNullSafe(F.col("item_id")))
    return met.select("query_id", "item_id", F.round(score, DIGITS).alias("score"))


def ranked(hits: DataFrame, k: int, *by: str) -> DataFrame:
    """The best k of each query by score, ties by id, with ranks from 1; the window's limit runs before its shuffle."""
    w = Window.partitionBy(*(by or ("query_id",))).orderBy(F.desc("score"), "item_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, database: DataFrame, k: int = TOP_K, scale: float = 1.0, exclude_self: bool = False, strategy: str = "block") -> DataFrame:
    """query_id, item_id, score, rank for queries(query_id, vector) against database(item_id, vector). Null vectors take no part."""
    found = near(queries, database, k, scale, exclude_self)
    best = ranked(found.select("query_id", "item_id", F.round(F.col("raw") * scale, DIGITS).alias("score")), k)
    if strategy == "expr":
        q, d = (df.where("vector is not null").withColumnRenamed("vector", n) for df, n in ((queries, "q"), (database, "d")))
        return ranked(scored_pairs(best, q, d, vectors.scaled_dot("q", "d", scale)), k)
    return best


def arg_max(hits: DataFrame, key: str, item: str, score: str, position: str) -> DataFrame:
    """The item with the highest score of each key, the first of equals."""
    best = F.max_by(F.struct(item, score), F.struct(F.col(score), -F.col(position)))
    return hits.groupBy(key).agg(best.alias("b")).select(key, F.col(f"b.{item}").alias(item), F.col(f"b.{score}").alias(score))
