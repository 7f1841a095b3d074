"""Which crawled image is an article's original image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisift.functions import vectors
from lumisift.operators import similarity as near
from lumisift.sources.shared import cut


def pairs(origin: DataFrame, crawled: DataFrame, key: str = "article_id") -> DataFrame:
    """Pairs inside each article that has both: origin(key, origin_id, origin_pos, ...) and crawled(key, crawled_id, crawled_pos, ...)."""
    return origin.join(crawled, key)


def unit(rows: DataFrame, column: str) -> DataFrame:
    """rows with unit vectors, made once for each row and not for each pair; zero vectors become null."""
    return rows.withColumn(column, vectors.normalised(column))


def nearest(both: DataFrame, similarity: Column, variant: str = "strict_positive", key: str = "article_id") -> DataFrame:
    """key, origin_id, filename, score: the most similar crawled image, the first of equals.

    strict_positive: only a similarity over 0 matches; any_sign: the best one always does.
    """
    return _best(both.withColumn("score", F.round(similarity, 6)).where("score is not null"), variant, key)


def nearest_vectors(origin: DataFrame, crawled: DataFrame, variant: str = "strict_positive", key: str = "article_id") -> DataFrame:
    """nearest by cosine of origin's o_embedding and crawled's c_embedding inside each article, without making pairs: articles of any size are dealt to bounded blocks."""
    queries = unit(origin, "o_embedding").select(F.col(key).alias("key"), F.col("origin_id").alias("query_id"), F.col("o_embedding").alias("vector"))
    database = unit(crawled, "c_embedding").select(F.col(key).alias("key"), F.struct("crawled_pos", "crawled_id").alias("item_id"), F.col("c_embedding").alias("vector"))
    found = near.near(queries, database, 1, keyed=True)
    scored = found.select(F.col("key").alias(key), F.col("query_id").alias("origin_id"), "item_id.crawled_pos", "item_id.crawled_id", F.round("raw", near.DIGITS).alias("score"))
    return _best(scored, variant, key)


def _best(scored: DataFrame, variant: str, key: str) -> DataFrame:
    if variant not in ("strict_positive", "any_sign"):
        raise ValueError(f"variant is {variant}, not strict_positive or any_sign")
    if variant == "strict_positive":
        scored = scored.where("score > 0")
    best = F.max_by(F.struct("crawled_id", "score"), F.struct(F.col("score"), -F.col("crawled_pos")))
    return scored.groupBy(key, "origin_id").agg(best.alias("b")).select(key, "origin_id", F.col("b.crawled_id").alias("filename"), F.col("b.score").alias("score"))


def identical(both: DataFrame, difference: Column, most: float, key: str = "article_id") -> DataFrame:
    """key, origin_id, filename, score 1: the first crawled image whose pixels differ by no more than most; pairs of different shapes (null) don't match."""
    near = both.where(difference <= most)
    return near.groupBy(key, "origin_id").agg(F.min_by("crawled_id", "crawled_pos").alias("filename")).withColumn("score", F.lit(1.0))


def matched(origin: DataFrame, crawled: DataFrame, difference: Column, most: float, key: str = "article_id") -> DataFrame:
    """Pixels first, cosine for what is left. origin and crawled carry embedding and pixels columns (o_embedding, o_pixels, c_embedding, c_pixels).

    An original with an embedding but without pixels, or without any match, has a null match; one without an embedding has no row.
    """
    known = origin.where("o_embedding is not null")
    shown = known.where("o_pixels is not null")
    both = pairs(shown.drop("o_embedding"), crawled.where("c_pixels is not null").drop("c_embedding"), key)
    same = cut(identical(both, difference, most, key))
    close = nearest_vectors(shown.join(same.select(key, "origin_id"), [key, "origin_id"], "left_anti"), crawled, "strict_positive", key)
    found = same.unionByName(close)
    inside = known.join(crawled.select(key).distinct(), key, "left_semi")
    return inside.select(key, "origin_id").join(found, [key, "origin_id"], "left")


def match_maps(matches: DataFrame, key: str = "article_id") -> DataFrame:
    """key, matching: map of origin id to (filename, score), null where nothing matched."""
    entry = F.struct("origin_id", F.when(F.col("filename").isNotNull(), F.struct("filename", "score")).alias("match"))
    return matches.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("matching"))


def repaired(names: DataFrame, images: DataFrame, key: str = "article_id") -> DataFrame:
    """names(key, filename, ...) with image_id, the crawled image that the name means, null if none.

    Tried in order: the name, the name with .jpg, with .png, the name without its extension.
    """
    name = F.col("filename")
    tries = F.array(name, F.concat(name, F.lit(".jpg")), F.concat(name, F.lit(".png")), F.regexp_replace(name, r"\.[^.]*$", ""))
    each = names.select(key, "filename").distinct().select(key, "filename", F.posexplode(tries).alias("priority", "image_id"))
    found = each.join(images.select(key, "image_id"), [key, "image_id"]).groupBy(key, "filename").agg(F.min_by("image_id", "priority").alias("image_id"))
    return names.join(found, [key, "filename"], "left")


def first_match(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
