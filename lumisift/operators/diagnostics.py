"""How certain a query's hit list is, and which queries are doubtful."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumisift.sources.shared import cut

LIST_SIZE = 50


def probabilities(hits: DataFrame) -> DataFrame:
    """hits with p, the softmax of score over the query's hits."""
    own = Window.partitionBy("query_id")
    e = F.exp(F.col("score") - F.max("score").over(own))
    return hits.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(own)).drop("e")


def query_stats(hits: DataFrame) -> DataFrame:
    """query_id, entropy (natural), gap between the first and second score, low_top1_sim; the gap of a single hit is null."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return (
        probabilities(hits)
        .groupBy("query_id")
        .agg(F.round(-F.sum(F.col("p") * F.log(F.col("p") + 1e-10)), 6).alias("entropy"), F.round(at(1) - at(2), 6).alias("gap"), F.round(F.max("score"), 6).alias("low_top1_sim"))
    )


def extremes(stats: DataFrame, metric: str, highest: bool, n: int = LIST_SIZE) -> DataFrame:
    """The n queries with the highest or lowest metric, ties by id, with their place from 1."""
    order = F.desc(metric) if highest else F.asc_nulls_last(metric)
    best = stats.orderBy(order, "query_id").limit(n)  # at most n rows are numbered
    return best.withColumn("place", F.row_number().over(Window.orderBy(order, "query_id")))


def first_of_each(blocks: list[DataFrame], key: str = "query_id", place: str = "place") -> DataFrame:
    """Ordered union: of the rows with one key, the first by block and place; adds block."""
    tagged = reduce(DataFrame.unionByName, (b.withColumn("block", F.lit(i)) for i, b in enumerate(blocks, 1)))
    w = Window.partitionBy(key).orderBy("block", place)
    return tagged.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def doubtful(stats: DataFrame, n: int = LIST_SIZE) -> DataFrame:
    """Highest entropy, then smallest gap, then lowest top score; each query once. stats are worked out once and read three times."""
    stats = cut(stats)
    return first_of_each([extremes(stats, "entropy", True, n), extremes(stats, "gap", False, n), extremes(stats, "low_top1_sim", False, n)])
