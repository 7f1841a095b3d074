"""The three jobs from end to end, each as lazily joined tables: only nearest neighbours, which all of retrieve reads, are written between stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.functions import html
from lumisift.operators import diagnostics, evidence, inference, matching, partitioning, positions, prompts, rerank, resolve, similarity
from lumisift.sources.shared import cut


def retrieve(queries: DataFrame, database: DataFrame, image_article: DataFrame, articles: DataFrame, text_scores: DataFrame | None = None, k: int = similarity.TOP_K, scale: float = 1.0, order: str = "input", slots: int = resolve.SLOTS) -> dict[str, DataFrame]:
    """hits, doubtful queries, hits after reranking of those (with text_scores(query_id, item_id, text_sim)), context, rejected queries, article slots."""
    hits = cut(similarity.top_k(queries, database, k, scale))
    doubtful = diagnostics.doubtful(diagnostics.query_stats(hits))
    final = hits
    if text_scores is not None:
        candidates = partitioning.members(hits, doubtful, "query_id").join(text_scores, ["query_id", "item_id"], "left").select("query_id", "rank", "item_id", "text_sim")
        final = rerank.overridden(hits, rerank.reranked(rerank.fused(candidates, hits), order), k)
    image_article = image_article.withColumn("image_id", F.col("image_id").cast("string"))
    final = final.withColumn("item_id", F.col("item_id").cast("string"))
    return {
        "hits": hits, "doubtful": doubtful, "final": final, "context": resolve.context(final, image_article, articles), "rejected": resolve.without_article(final, image_article),
        "slots": rerank.wide(resolve.article_slots(final, image_article, slots), slots, "article_id", "article_id"),
    }


def crawl(pages: DataFrame) -> DataFrame:
    """pages(key, url, html) -> the crawled records; pages that can't be parsed drop out."""
    parsed = pages.withColumn("f", html.parsed(F.col("key"), F.col("html"))).where("f.content is not null")
    return parsed.select("key", "url", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("crawl_date"), "f.*")


def align(articles: DataFrame, crawled: DataFrame, matches: DataFrame) -> DataFrame:
    """Rebuilt articles: matches(article_id, origin_id, filename, score) placed in the original texts."""
    images = crawled.select(F.col("key").alias("article_id"), F.explode("images").alias("i")).select("article_id", F.col("i.id").alias("image_id"), F.col("i.url").alias("url"), F.col("i.position").alias("position"))
    listed = resolve.image_rows(articles).select("article_id", F.col("position").alias("n"), F.col("image_id").alias("origin_id"))
    named = matching.repaired(listed.join(matches, ["article_id", "origin_id"], "left"), images)
    known = named.join(images, ["article_id", "image_id"], "left").join(articles.select("article_id", F.col("content").alias("origin_text")), "article_id")
    around = positions.neighbours(known, crawled.select(F.col("key").alias("article_id"), "content"))
    return positions.rebuilt(articles, crawled, positions.placed(positions.located(around)))


def caption(context: DataFrame, results: DataFrame, captions: DataFrame, articles: DataFrame, ranking: DataFrame, make: Callable[[], inference.Client] = inference.StubClient) -> dict[str, DataFrame]:
    """Summaries, answers, names, the final captions, and the cleaned table that is handed in."""
    index = evidence.caption_index(results)
    none = captions.limit(0)
    first = evidence.merged(context, none, none, captions, none, index)
    run = lambda df, s: inference.run_strategy(prompts.composed(df), s, make).select("query_id", "text")
    summaries, answers, names = run(first, "summarize"), run(first, "question_answer"), run(first, "name_entity")
    final = run(evidence.merged(context, answers, names, captions, summaries, index), "assemble")
    return {"summaries": summaries, "answers": answers, "names": names, "final": final, "submission": evidence.cleaned(evidence.submission(ranking, final))}
