"""Parts of a job, and what of it is done already."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with n, their place from 0 in the order of key, without one task that sorts all: range partitions are counted, then numbered each from its own start."""
    dealt = rows.repartitionByRange(key).withColumn("part", F.spark_partition_id())
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return dealt.withColumn("own", own).join(F.broadcast(starts), "part").withColumn("n", F.col("start") + F.col("own") - 1).drop("part", "own", "start")


def part(rows: DataFrame, key: str, number: int, parts: int) -> DataFrame:
    """Part `number` from 1: total // parts rows each, the rest goes to the last."""
    if not 1 <= number <= parts:
        raise ValueError(f"part {number} is not between 1 and {parts}")
    share = rows.count() // parts
    out = numbered(rows, key).where(F.col("n") >= (number - 1) * share)
    return (out if number == parts else out.where(F.col("n") < number * share)).drop("n")


def part_numbers(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """rows with the part that each belongs to."""
    share = rows.count() // parts
    own = F.lit(parts) if share == 0 else F.least(F.floor(F.col("n") / share) + 1, F.lit(parts))
    return numbered(rows, key).withColumn("part", own.cast("int")).drop("n")


def chunk(rows: DataFrame, key: str, size: int, index: int) -> DataFrame:
    """Chunk `index` from 0 of so many rows each."""
    if size <= 0:
        raise ValueError("size must be positive")
    chunks = -(-rows.count() // size)
    if chunks and not 0 <= index < chunks:
        raise ValueError(f"chunk {index} is not between 0 and {chunks - 1}")
    return numbered(rows, key).where((F.col("n") >= index * size) & (F.col("n") < (index + 1) * size)).drop("n")


def chunk_numbers(rows: DataFrame, key: str, size: int) -> DataFrame:
    return numbered(rows, key).withColumn("chunk", F.floor(F.col("n") / size).cast("int")).drop("n")


def to_do(rows: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Rows without a result; all of them if results are to be overwritten."""
    return rows if overwrite else rows.join(done.select(key), key, "left_anti")


def to_caption(rows: DataFrame, captions: DataFrame, complete_chars: int | None = None) -> DataFrame:
    """Rows without a caption. With complete_chars a caption counts only if it has exactly so many characters."""
    done = captions if complete_chars is None else captions.where(F.length("caption") == complete_chars)
    return rows.join(done.select("query_id"), "query_id", "left_anti")


def members(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def split_by_lookup(rows: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is known, and the others."""
    ids = known.select(key).distinct()
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")
