"""Second scores for candidates, and what they change in the ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide(hits: DataFrame, k: int, item: str = "item_id", prefix: str = "image_id") -> DataFrame:
    """One row for each query with columns prefix_1 to prefix_k; empty slots are ''."""
    out = hits.where(F.col("rank").between(1, k)).groupBy("query_id").pivot("rank", list(range(1, k + 1))).agg(F.first(F.col(item).cast("string")))
    return out.select("query_id", *(F.coalesce(F.col(str(i)), F.lit("")).alias(f"{prefix}_{i}") for i in range(1, k + 1)))


def long(rows: DataFrame, k: int, item: str = "item_id", prefix: str = "image_id") -> DataFrame:
    """The other way: query_id, rank, item; empty slots stay, as ''."""
    slots = F.array(*(F.coalesce(F.col(f"{prefix}_{i}"), F.lit("")) for i in range(1, k + 1)))
    return rows.select("query_id", F.posexplode(slots).alias("at", item)).select("query_id", (F.col("at") + 1).alias("rank"), item)


def slots(rows: DataFrame, k: int, prefix: str = "image_id") -> Column:
    return F.array(*(F.col(f"{prefix}_{i}") for i in range(1, k + 1)))


def fused(candidates: DataFrame, image_scores: DataFrame) -> DataFrame:
    """candidates(query_id, rank, item_id, text_sim) with the sum of text and image scores; a score that is missing counts 0."""
    own = image_scores.select("query_id", "item_id", F.col("score").alias("image_sim"))
    total = F.round(F.coalesce("text_sim", F.lit(0.0)) + F.coalesce("image_sim", F.lit(0.0)), 6)
    return candidates.join(own, ["query_id", "item_id"], "left").withColumn("combined", total)


def reranked(scored: DataFrame, order: str = "input") -> DataFrame:
    """query_id, candidates: ids in the order they came in, or by combined score."""
    if order not in ("input", "score"):
        raise ValueError(f"order is {order}, not input or score")
    key = F.col("rank").cast("double") if order == "input" else -F.col("combined")
    found = F.sort_array(F.collect_list(F.struct(key.alias("k"), F.col("rank"), F.col("item_id"))))
    return scored.groupBy("query_id").agg(found.alias("f")).select("query_id", F.col("f.item_id").alias("candidates"))


def overridden(hits: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Slots 1 to k from lists(query_id, candidates) where a query has one, padded with ''; else those of hits(query_id, rank, item_id)."""
    seats = hits.where(F.col("rank") <= k).join(lists, "query_id", "left")
    new = F.coalesce(F.get("candidates", F.col("rank") - 1).cast("string"), F.lit(""))
    return seats.select("query_id", "rank", F.when(F.col("candidates").isNotNull(), new).otherwise(F.col("item_id").cast("string")).alias("item_id"))


def caption_lists(captions: DataFrame, query_captions: DataFrame) -> DataFrame:
    """query_id, query_caption, top_k_captions: captions(query_id, rank, image_id, caption) gathered in order."""
    own = F.sort_array(F.collect_list(F.struct("rank", F.struct("image_id", F.coalesce("caption", F.lit("")).alias("caption")).alias("c"))))
    return query_captions.join(captions.groupBy("query_id").agg(own.alias("o")), "query_id").select("query_id", "query_caption", F.col("o.c").alias("top_k_captions"))


def score_maps(hits: DataFrame) -> DataFrame:
    """query_id, scores: map of item to score, best first."""
    own = F.sort_array(F.collect_list(F.struct(F.col("rank"), F.struct(F.col("item_id").cast("string"), F.col("score")).alias("e"))))
    return hits.groupBy("query_id").agg(F.map_from_entries(F.transform(own, lambda x: x["e"])).alias("scores"))


def last_of_each(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of the rows with one key, the last in the order: a later one overwrites."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
