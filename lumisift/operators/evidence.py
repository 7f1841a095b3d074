"""Everything known about a query, joined; and the ranked table that is handed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.functions import text as S
from lumisift.operators.rerank import last_of_each


def image_lookup(articles: DataFrame) -> DataFrame:
    """image_id, url, position, score; of articles that list one image, the last by id counts."""
    rows = articles.select("article_id", F.posexplode("images").alias("n", "i"))
    rows = rows.select("article_id", "n", F.col("i.id").alias("image_id"), F.col("i.url").alias("url"), F.col("i.position").alias("position"), F.col("i.score").alias("score"))
    return last_of_each(rows, ["image_id"], "article_id", "n").drop("article_id", "n")


def caption_lookup(crawled: DataFrame) -> DataFrame:
    """image_url, alt, caption; of pages that hold one address, the last by key counts."""
    rows = crawled.select("key", F.posexplode("images").alias("n", "i")).select("key", "n", F.col("i.url").alias("image_url"), F.col("i.alt").alias("alt"), F.col("i.caption").alias("caption"))
    return rows.groupBy("image_url").agg(F.max_by(F.struct("alt", "caption"), F.struct("key", "n")).alias("r")).select("image_url", "r.alt", "r.caption")


def results(context: DataFrame, images: DataFrame, captions: DataFrame, articles: DataFrame, clean=S.without_urls) -> DataFrame:
    """The nine fields of a query's result. A query whose image or article is unknown is an error, found by counting: see unresolved()."""
    first = context.select("query_id", "image_id", "article_id").join(images.select("image_id", F.col("url").alias("image_url"), "position"), "image_id")
    found = first.join(articles.select("article_id", F.col("content").alias("article"), F.col("url").alias("article_url")), "article_id").join(captions, "image_url", "left")
    own = lambda c: clean(F.coalesce(c, F.lit("")))
    return found.select("query_id", own("alt").alias("crawl_alt"), own("caption").alias("crawl_caption"), "article", F.coalesce("position", F.lit(0)).alias("article_position"), "image_url", "article_url", "image_id", "article_id")


def unresolved(context: DataFrame, images: DataFrame, articles: DataFrame) -> DataFrame:
    """Queries that results() would drop."""
    ok = context.join(images, "image_id", "left_semi").join(articles, "article_id", "left_semi")
    return context.join(ok.select("query_id"), "query_id", "left_anti")


def caption_index(results_: DataFrame) -> DataFrame:
    """query_id, crawl_caption (the alternative text, not the caption), content; of rows with one id the last article_id counts."""
    own = last_of_each(results_, ["query_id"], "article_id")
    return own.select("query_id", F.coalesce("crawl_alt", F.lit("")).alias("crawl_caption"), F.coalesce("article", F.lit("")).alias("content"))


def merged(context: DataFrame, answers: DataFrame, entities: DataFrame, captions: DataFrame, summaries: DataFrame, index: DataFrame) -> DataFrame:
    """All evidence of each query of context; what is missing is ''. The first four come as (query_id, text)."""
    out = context.select("query_id")
    for name, df in (("question_answer", answers), ("name_entity_keyword", entities), ("generated_caption", captions), ("fact_summary", summaries)):
        out = out.join(df.select("query_id", F.col("text").alias(name)), "query_id", "left")
    out = out.join(index.select("query_id", "crawl_caption", F.col("content").alias("article")), "query_id", "left")
    or_empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select("query_id", or_empty("question_answer"), or_empty("name_entity_keyword"), or_empty("generated_caption"), F.struct(or_empty("fact_summary")).alias("article_summary"), or_empty("crawl_caption"), or_empty("article"))


def submission(ranking: DataFrame, captions: DataFrame) -> DataFrame:
    """ranking with generated_caption from captions(query_id, text), '' where there is none."""
    return ranking.drop("generated_caption").join(captions.select("query_id", F.col("text").alias("generated_caption")), "query_id", "left").withColumn("generated_caption", F.coalesce("generated_caption", F.lit("")))


def caption_counts(submitted: DataFrame) -> DataFrame:
    has = F.col("generated_caption") != ""
    return submitted.agg(F.count_if(has).alias("matched"), F.count_if(~has).alias("unmatched"))


def cleaned(submitted: DataFrame, column: str = "generated_caption") -> DataFrame:
    if column not in submitted.columns:
        raise ValueError(f"there is no column {column}")
    return submitted.withColumn(column, S.clean_caption(column))


def to_summarise(first: DataFrame, articles: DataFrame, done: DataFrame) -> DataFrame:
    """query_id, article_id, content of each query's first article that has no summary yet; a query without a known article drops out."""
    return first.join(done, "query_id", "left_anti").join(articles.select("article_id", "content"), "article_id").select("query_id", "article_id", "content")


def field(c: str, default: str = "") -> Column:
    return F.coalesce(F.col(c), F.lit(default))
