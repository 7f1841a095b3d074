"""Where in an article's text its images stand.

The text before and after an image's marker in the crawled copy is looked for in the original
text: first exactly, as a column expression; the fuzzy search, a Python step, sees only the rows
that no exact search placed before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumisift.functions import text as S
from lumisift.functions.fuzzy import fuzzy_find


def parts(contents: DataFrame, key: str = "article_id") -> DataFrame:
    """key, at, part, is_marker, prev_text, next_text: the lines of content with the nearest lines around each that are no markers, '' if none."""
    own = contents.select(key, F.posexplode(S.lines("content")).alias("at", "part")).withColumn("is_marker", S.is_marker("part"))
    plain = F.when(~F.col("is_marker"), F.col("part"))
    w = Window.partitionBy(key).orderBy("at")
    before = F.last(plain, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(plain, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return own.withColumns({"prev_text": F.coalesce(before, F.lit("")), "next_text": F.coalesce(after, F.lit(""))})


def neighbours(images: DataFrame, contents: DataFrame, mode: str = "marker", key: str = "article_id") -> DataFrame:
    """images(key, image_id, position, ...) with prev_text and next_text.

    marker: by the line <image_id>; index: by position among the lines, which a line end inside a paragraph shifts.
    """
    around = parts(contents, key)
    if mode == "marker":
        marks = around.where("is_marker").select(key, F.expr("regexp_extract(part, '<([^>]+)>', 1)").alias("image_id"), "prev_text", "next_text")
        marks = marks.dropDuplicates([key, "image_id"])
        out = images.join(marks, [key, "image_id"], "left")
    elif mode == "index":
        out = images.join(around.select(key, F.col("at").alias("position"), "prev_text", "next_text"), [key, "position"], "left")
    else:
        raise ValueError(f"mode is {mode}, not marker or index")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("prev_text", "next_text")})


def _tries():
    """needle and what is added to the place where it is found, in the order of the attempts."""
    prev, after = S.last_chars("prev_text"), S.first_chars("next_text")
    both = (F.col("prev_text") != "") & (F.col("next_text") != "")
    combined = F.when(both, F.concat("prev_text", F.lit(" "), "next_text"))
    return [(F.when(prev != "", prev), F.length(prev)), (F.when(after != "", after), F.lit(0)), (combined, F.length("prev_text") + 1)]


def located(rows: DataFrame, fuzzy: bool = True) -> DataFrame:
    """rows(origin_text, prev_text, next_text, ...) with origin_pos, null if nothing was found.

    For each attempt the exact place counts, else the fuzzy one; the added length is the needle's, also for a fuzzy hit.
    """
    out = rows.withColumn("origin_pos", F.lit(None).cast("int"))
    for needle, plus in _tries():
        open_ = F.col("origin_pos").isNull() & needle.isNotNull()
        at = S.find("origin_text", needle)
        out = out.withColumn("origin_pos", F.when(open_ & (at >= 0), at + plus).otherwise(F.col("origin_pos")).cast("int"))
        if fuzzy:
            open_ = F.col("origin_pos").isNull() & needle.isNotNull()
            found = fuzzy_find(F.when(open_, F.col("origin_text")), F.when(open_, needle))  # null for placed rows: no search
            out = out.withColumn("near", found).withColumn("origin_pos", F.when(F.col("near") >= 0, F.col("near") + plus).otherwise(F.col("origin_pos")).cast("int")).drop("near")
    return out


def placed(images: DataFrame) -> DataFrame:
    """The record of each original image: images(article_id, origin_id, n, filename, score, url, origin_pos, image_id) -> url, position, score.

    No match: '', null, 0; a match whose crawled image is unknown: '', null and the score.
    """
    missed, unknown = F.col("filename").isNull(), F.col("image_id").isNull()
    return images.select(
        "article_id", "origin_id", "n",
        F.when(missed | unknown, "").otherwise(F.col("url")).alias("url"),
        F.when(~(missed | unknown), F.col("origin_pos")).alias("position"),
        F.when(missed, 0.0).otherwise(F.col("score")).alias("score"),
    )


def rebuilt(articles: DataFrame, crawled: DataFrame, images: DataFrame) -> DataFrame:
    """Articles with the crawled metadata (defaults where there is no crawl) and the placed images in their original order."""
    own = F.sort_array(F.collect_list(F.struct("n", F.struct(F.col("origin_id").alias("id"), "url", "position", "score").alias("i"))))
    lists = images.groupBy("article_id").agg(own.alias("o")).select("article_id", F.col("o.i").alias("images"))
    kept = ("category", "author", "meta_description", "keywords", "word_count", "reading_time_minutes")
    meta = crawled.select(F.col("key").alias("article_id"), F.lit(True).alias("has_crawl"), *kept)
    out = articles.drop("images").join(meta, "article_id", "left").join(lists, "article_id", "left")
    default = {"category": F.lit(""), "author": F.lit(""), "meta_description": F.lit(""), "keywords": F.array().cast("array<string>"), "word_count": F.lit(0), "reading_time_minutes": F.lit(0.0)}
    out = out.withColumns({c: F.when(F.col("has_crawl"), F.col(c)).otherwise(v) for c, v in default.items()})
    return out.select("article_id", "url", "date", "title", *kept, F.coalesce("images", F.array().cast(lists.schema["images"].dataType)).alias("images"), "content")
