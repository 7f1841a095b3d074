"""Helpers shared by the operators: input columns, shared folder, grouped streams, joins of hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.sources.shared import cut, cut_at, remove, shared_dir, shared_folder  # noqa: F401

#: Texts that are Python objects at one time; Spark bounds the bytes of an Arrow batch.
SLICE_ROWS = 512
#: A key with this share of the rows is joined by broadcast: no more than so many keys can have it.
HOT_SHARE = 1000
#: Bits of a filter of hashes, and of the words it comes in: what is broadcast has at most FILTER_BITS / WORD_BITS rows.
FILTER_BITS, WORD_BITS = 1 << 24, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text only: other columns, whatever their names, never reach an operator. A doc_id that is no whole number is null."""
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows, without copies: bounds the Python objects a worker makes of texts at one time. What Arrow no longer uses goes back before each batch."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
    pa.default_memory_pool().release_unused()


def by_text(docs: DataFrame, f: Callable[[Iterator[list[str | None]]], Iterator[list]], column: bool = False) -> DataFrame:
    """Rows judged in place by their text: f gets the texts of some rows at a time and gives for each whether it stays; with column, its new text."""
    own = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[str | None]]:
            for part in slices(batches):
                held.append(part)
                yield part.column(at).to_pylist()

        for out in f(texts()):
            part = held.pop()
            if column:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)
            else:
                yield part.filter(pa.array(out, pa.bool_()))

    return own.mapInArrow(run, own.schema)


def by_group(df: DataFrame, keys: list[str], f: Callable[[tuple, pa.Table], Iterable[pa.RecordBatch]], schema: str, parts: int | None = None) -> DataFrame:
    """f(key, rows) for every group of keys, from sorted partitions: one Python call a batch, not one a group."""
    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: tuple | None = None
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in keys]
            begin = 0
            ids = list(zip(*cols, strict=True))
            for i, k in enumerate(ids):
                if k != at:
                    if at is not None:
                        if i > begin:
                            held.append(batch.slice(begin, i - begin))
                        if held:
                            yield from f(at, pa.Table.from_batches(held))
                    held, begin, at = [], i, k
            if len(ids) > begin:
                held.append(batch.slice(begin))
        if held:
            yield from f(at, pa.Table.from_batches(held))

    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def hot_join(rows: DataFrame, facts: DataFrame, hot: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows with the columns of facts, which has each key once.

    hot: those of the facts whose key may be in a thousandth of the rows or more; there are at most HOT_SHARE of them,
    so they are sent to the rows. All other rows are shuffled by key, and no task holds a hot key; rows that are
    settled already are spread evenly. Rows with a null key match nothing: inner drops them, left keeps them.
    """
    values = F.struct(*(c for c in facts.columns if c != key))
    sent = F.broadcast(hot.select(F.col(key).alias("hot key"), values.alias("hot facts")))  # at most HOT_SHARE rows
    met = rows.join(sent, F.col(key) == F.col("hot key"), "left").drop("hot key")
    settled = F.col("hot facts").isNotNull() | F.col(key).isNull()
    met = met.withColumns({"cold key": F.when(~settled, F.col(key)), "spread": F.when(settled, F.xxhash64(*rows.columns)).otherwise(0)})
    out = met.join(facts.select(F.col(key).alias("cold key"), F.lit(0).cast("long").alias("spread"), values.alias("cold facts")), ["cold key", "spread"], "left")
    found = F.coalesce("hot facts", "cold facts")
    if how == "inner":
        out = out.where(found.isNotNull())
    return out.select(*rows.columns, *(found[c].alias(c) for c in facts.columns if c != key))


def hot_of(facts: DataFrame, weight: str, total: int) -> DataFrame:
    """The facts whose key is in at least a thousandth of the total rows; weight: in how many it is."""
    return facts.where(F.col(weight) * HOT_SHARE >= total)


def bit_filter(hashes: DataFrame, column: str) -> DataFrame:
    """(word, bits): a filter of FILTER_BITS bits over a column of 64-bit hashes, whatever their number; few enough rows to be sent to every task."""
    at = F.pmod(F.col(column), F.lit(FILTER_BITS))
    own = hashes.select(F.floor(at / WORD_BITS).cast("int").alias("word"), F.lit(1).cast("long").alias("one"), (at % WORD_BITS).cast("int").alias("bit"))
    return own.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))


def with_hit(rows: DataFrame, hash_: Column, bits: DataFrame, name: str) -> DataFrame:
    """rows with a boolean: false if the filter can't hold the row's hash. Rows don't move."""
    at = F.pmod(hash_, F.lit(FILTER_BITS))
    sent = F.broadcast(bits.withColumnsRenamed({"word": f"{name} word", "bits": f"{name} bits"}))  # at most FILTER_BITS / WORD_BITS rows of two numbers
    joined = rows.join(sent, F.floor(at / WORD_BITS).cast("int") == F.col(f"{name} word"), "left")
    held = F.getbit(F.coalesce(F.col(f"{name} bits"), F.lit(0).cast("long")), (at % WORD_BITS).cast("int")) == 1
    return joined.withColumn(name, held).drop(f"{name} word", f"{name} bits")
