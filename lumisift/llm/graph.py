"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import HOT_SHARE, cut_at, hot_join, hot_of, remove


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that an edge names; label is the smallest node of its component.

    Rounds join tables and keep minima; nothing is collected but counts. Nodes with many edges, and
    labels of many nodes, are sent to the rows that need them, so a hub is no task's work. What a round wrote goes when
    the next one is written. Rows with a null end are ignored; repeated edges and loops change nothing; an empty
    table gives an empty table.
    """
    spark = edges.sparkSession
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both, edges_at = cut_at(one.union(one.select("v", "u")).distinct())
    m = both.count()
    labels, at = cut_at(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label"), F.count("*").alias("degree")))
    n = labels.count()
    while True:
        told = labels.withColumnRenamed("node", "v")
        heard = hot_join(both, told, hot_of(told, "degree", m), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        best = labels.join(heard, "node").select("node", "label", "degree", F.least("label", "near").alias("best"))
        up = labels.select(F.col("node").alias("best"), F.col("label").alias("top"))
        common = F.broadcast(labels.groupBy(F.col("label").alias("best")).agg(F.count("*").alias("held")).where(F.col("held") * HOT_SHARE >= n).select("best"))  # at most HOT_SHARE rows
        jumped = hot_join(best, up, up.join(common, "best"), "best").select("node", F.least("best", "top").alias("next"), "label", "degree")
        new, new_at = cut_at(jumped)
        moved = new.where("next <> label").limit(1).count()
        remove(spark, at)
        labels, at = new.select("node", F.col("next").alias("label"), "degree"), new_at
        if not moved:
            remove(spark, edges_at)
            return labels.select("node", "label")
