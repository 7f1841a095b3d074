"""From images to articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 10


def context(hits: DataFrame, image_article: DataFrame, articles: DataFrame) -> DataFrame:
    """query_id, image_id, article_id, article_url of each query's first image; queries whose image has no article drop out."""
    first = hits.where("rank = 1").select("query_id", F.col("item_id").alias("image_id"))
    found = first.join(image_article, "image_id")
    return found.join(articles.select("article_id", F.col("url").alias("article_url")), "article_id").select("query_id", "image_id", "article_id", "article_url")


def without_article(hits: DataFrame, image_article: DataFrame) -> DataFrame:
    """query_id and image_id of the queries that context() drops."""
    first = hits.where("rank = 1").select("query_id", F.col("item_id").alias("image_id"))
    return first.join(image_article, "image_id", "left_anti").select("query_id", "image_id")


def article_slots(hits: DataFrame, image_article: DataFrame, n: int = SLOTS, dedupe: bool = False) -> DataFrame:
    """query_id, rank, article_id of the first n images; '' where an image has none. With dedupe an article stays at its first rank only."""
    seats = hits.where(F.col("rank") <= n).select("query_id", "rank", F.col("item_id").alias("image_id"))
    found = seats.join(image_article, "image_id", "left").select("query_id", "rank", F.coalesce(F.col("article_id").cast("string"), F.lit("")).alias("article_id"))
    if not dedupe:
        return found
    return found.groupBy("query_id", "article_id").agg(F.min("rank").alias("rank")).select("query_id", "rank", "article_id")


def image_rows(articles: DataFrame) -> DataFrame:
    """article_id, image_id, position of each image that an article lists."""
    return articles.select("article_id", F.posexplode("images").alias("position", "image_id"))
