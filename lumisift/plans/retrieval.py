"""Retrieval, diagnosis, reranking and resolution on the table of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions import vectors
from lumisift.operators import diagnostics, matching, partitioning, rerank, resolve, similarity
from lumisift.plans.registry import query, table
from lumisift.sources import files
from lumisift.sources.shared import cut

SCALE, K = 100.0, 15
_HITS = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS item_id, round(100 * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id
), hits AS (
  SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank
  FROM pairs QUALIFY rank <= 15
)"""
_STATS = (
    _HITS
    + """, soft AS (
  SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) AS e FROM hits
), prob AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS p FROM soft), stats AS (
  SELECT query_id, round(-sum(p * ln(p + 1e-10)), 6) AS entropy,
    round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 6) AS gap, round(max(score), 6) AS low_top1_sim
  FROM prob GROUP BY query_id
)"""
)
_EXTREMES = (
    _STATS
    + """, blocks AS (
  SELECT 1 AS block, *, row_number() OVER (ORDER BY entropy DESC, query_id) AS place FROM stats
  UNION ALL SELECT 2, *, row_number() OVER (ORDER BY gap, query_id) FROM stats
  UNION ALL SELECT 3, *, row_number() OVER (ORDER BY low_top1_sim, query_id) FROM stats
), lists AS (SELECT * FROM blocks WHERE place <= 50)"""
)
#: Stand-ins: which article an image belongs to, and the articles.
_LOOKUPS = """, image_article AS (SELECT vec_id AS image_id, vec_id * 3 AS article_id FROM embeddings WHERE vec_id % 4 <> 0),
articles AS (SELECT doc_id AS article_id, 'http://articles.example/' || doc_id AS url FROM documents)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.embeddings(spark, f"{sf_dir}/embeddings.parquet", "vec_id")


def hits(spark: SparkSession, sf_dir: str, strategy: str = "block") -> DataFrame:
    own = embeddings(spark, sf_dir)
    queries, database = own.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), own.select(F.col("id").alias("item_id"), F.col("embedding").alias("vector"))
    return similarity.top_k(queries, database, K, SCALE, exclude_self=True, strategy=strategy)


def lookups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    articles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.concat(F.lit("http://articles.example/"), F.col("doc_id").cast("string")).alias("url"))
    return e.where("vec_id % 4 <> 0").select(F.col("vec_id").alias("image_id"), (F.col("vec_id") * 3).alias("article_id")), articles


@query(_HITS + " SELECT * FROM hits")
def v1_k1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir)


@query(_HITS + " SELECT * FROM hits")
def j1_expr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "expr")


@query("""
WITH pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS item_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) / 0.7, 6) AS score
  FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id
) SELECT query_id, item_id, score FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) = 1
""")
def v2_k4_temperature_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), "vec_id", F.col("embedding").alias("vector"))
    found = similarity.near(e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "item_id"), 1, 1 / vectors.TEMPERATURE, exclude_self=True, keyed=True)
    return similarity.arg_max(found.select("query_id", "item_id", F.round(F.col("raw") / vectors.TEMPERATURE, 6).alias("score")), "query_id", "item_id", "score", "item_id")


def _inside(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Original images (even ids) and crawled ones (odd ids) of each article, for which the label stands in."""
    e = table(spark, sf_dir, "embeddings")
    origin = e.where("vec_id % 2 = 0").select(F.col("label").alias("article_id"), F.col("vec_id").alias("origin_id"), F.col("embedding").alias("o_embedding"))
    crawled = e.where("vec_id % 2 = 1").select(F.col("label").alias("article_id"), F.col("vec_id").alias("crawled_id"), F.col("vec_id").alias("crawled_pos"), F.col("embedding").alias("c_embedding"))
    return origin, crawled


def _nearest_sql(where: str) -> str:
    return f"""
WITH pairs AS (
  SELECT o.label AS article_id, o.vec_id AS origin_id, c.vec_id AS filename,
    round(list_cosine_similarity(CAST(o.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings o JOIN embeddings c ON o.label = c.label WHERE o.vec_id % 2 = 0 AND c.vec_id % 2 = 1
) SELECT article_id, origin_id, filename, score FROM pairs {where}
QUALIFY row_number() OVER (PARTITION BY article_id, origin_id ORDER BY score DESC, filename) = 1
"""


@query(_nearest_sql(""))
def v4_j10_nearest_any_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest_vectors(*_inside(spark, sf_dir), "any_sign")


@query(_nearest_sql("WHERE score > 0"))
def v3_j9_nearest_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest_vectors(*_inside(spark, sf_dir))


@query("""
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: 3 * CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM n)
SELECT vec_id, round(v[1] / size, 6) AS first, round(v[len(v)] / size, 6) AS last FROM s
""")
def v5_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalised(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return e.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


@query(_STATS + " SELECT query_id, item_id, rank, round(p, 6) AS p FROM prob")
def v8_w3_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.probabilities(hits(spark, sf_dir)).select("query_id", "item_id", "rank", F.round("p", 6).alias("p"))


@query(_STATS + " SELECT * FROM stats")
def w2_w6_query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.query_stats(hits(spark, sf_dir))


@query(_EXTREMES + " SELECT query_id, entropy, CAST(place AS INTEGER) AS place FROM lists WHERE block = 1")
def k3_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.extremes(diagnostics.query_stats(hits(spark, sf_dir)), "entropy", True).select("query_id", "entropy", "place")


@query(_EXTREMES + " SELECT query_id, entropy, gap, low_top1_sim, CAST(block AS INTEGER) AS block, CAST(place AS INTEGER) AS place FROM lists QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY block, place) = 1")
def s1_doubtful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.doubtful(diagnostics.query_stats(hits(spark, sf_dir))).select("query_id", "entropy", "gap", "low_top1_sim", "block", "place")


def _pivot(n: int, item: str, prefix: str) -> str:
    return ", ".join(f"coalesce(max(CASE WHEN rank = {i} THEN CAST({item} AS VARCHAR) END), '') AS {prefix}_{i}" for i in range(1, n + 1))


@query(_HITS + f" SELECT query_id, {_pivot(15, 'item_id', 'image_id')}, 'This is an image caption.' AS generated_caption FROM hits GROUP BY query_id")
def e8_prj7_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumisift.functions.text import PLACEHOLDER_CAPTION

    return rerank.wide(hits(spark, sf_dir), K).withColumn("generated_caption", F.lit(PLACEHOLDER_CAPTION))


@query(_HITS + " SELECT query_id, rank, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE rank <= 10")
def prj5_k2_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.long(rerank.wide(hits(spark, sf_dir), 10), 10)


@query(_HITS + " SELECT query_id, count(*) AS n, string_agg(item_id, ',' ORDER BY rank) AS items FROM hits GROUP BY query_id")
def a9_score_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.score_maps(hits(spark, sf_dir)).select("query_id", F.size("scores").cast("long").alias("n"), F.array_join(F.map_keys("scores"), ",").alias("items"))


#: Stand-in: a text score of 0 to 60 from the candidate's id; images with ids divisible by 3 have no image score.
_FUSED = (
    _HITS
    + """, fused AS (
  SELECT query_id, rank, item_id, round(CAST(item_id % 7 AS DOUBLE) * 10 + CASE WHEN item_id % 3 = 0 THEN 0.0 ELSE score END, 6) AS combined FROM hits WHERE rank <= 5
)"""
)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(hits(spark, sf_dir))  # read twice, searched once
    candidates = own.where("rank <= 5").select("query_id", "rank", "item_id", ((F.col("item_id") % 7).cast("double") * 10).alias("text_sim"))
    return rerank.fused(candidates, own.where("item_id % 3 <> 0"))


@query(_FUSED + " SELECT * FROM fused")
def j3_v7_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "rank", "item_id", "combined")


@query(_FUSED + " SELECT query_id, string_agg(item_id, ',' ORDER BY rank) AS candidates FROM fused GROUP BY query_id")
def k7_reranked_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.reranked(_fused(spark, sf_dir)).select("query_id", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


@query(_FUSED + " SELECT query_id, string_agg(item_id, ',' ORDER BY combined DESC, rank) AS candidates FROM fused GROUP BY query_id")
def k7_reranked_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.reranked(_fused(spark, sf_dir), "score").select("query_id", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


@query(
    _EXTREMES
    + """, doubt AS (SELECT DISTINCT query_id FROM lists), five AS (
  SELECT h.query_id, h.item_id, row_number() OVER (PARTITION BY h.query_id ORDER BY CAST(h.item_id % 7 AS DOUBLE) * 10 + h.score DESC, h.rank) AS at
  FROM hits h JOIN doubt USING (query_id) WHERE h.rank <= 5
)
SELECT h.query_id, h.rank, CASE WHEN d.query_id IS NULL THEN CAST(h.item_id AS VARCHAR) ELSE coalesce(CAST(f.item_id AS VARCHAR), '') END AS item_id
FROM hits h LEFT JOIN doubt d USING (query_id) LEFT JOIN five f ON f.query_id = h.query_id AND f.at = h.rank"""
)
def j2_j4_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(hits(spark, sf_dir))  # read four times, searched once
    doubt = diagnostics.doubtful(diagnostics.query_stats(own))
    five = partitioning.members(own.where("rank <= 5"), doubt, "query_id").select("query_id", "rank", "item_id", ((F.col("item_id") % 7).cast("double") * 10).alias("text_sim"))
    return rerank.overridden(own, rerank.reranked(rerank.fused(five, own), "score"), K)


@query(_HITS + _LOOKUPS + " SELECT h.query_id, h.item_id AS image_id, i.article_id, a.url AS article_url FROM hits h JOIN image_article i ON i.image_id = h.item_id JOIN articles a USING (article_id) WHERE rank = 1")
def j5_k5_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.context(hits(spark, sf_dir), *lookups(spark, sf_dir))


@query(_HITS + _LOOKUPS + " SELECT query_id, item_id AS image_id FROM hits WHERE rank = 1 AND item_id NOT IN (SELECT image_id FROM image_article)")
def flt4_j5_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.without_article(hits(spark, sf_dir), lookups(spark, sf_dir)[0])


_SLOTS = _HITS + _LOOKUPS + ", slots AS (SELECT h.query_id, h.rank, coalesce(CAST(i.article_id AS VARCHAR), '') AS article_id FROM hits h LEFT JOIN image_article i ON i.image_id = h.item_id WHERE rank <= 10)"


@query(_SLOTS + f" SELECT query_id, {_pivot(10, 'article_id', 'article_id')} FROM slots GROUP BY query_id")
def j6_k6_article_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.wide(resolve.article_slots(hits(spark, sf_dir), lookups(spark, sf_dir)[0]), 10, "article_id", "article_id")


@query(_SLOTS + " SELECT query_id, article_id, min(rank) AS rank FROM slots GROUP BY query_id, article_id")
def j6_deduped_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.article_slots(hits(spark, sf_dir), lookups(spark, sf_dir)[0], dedupe=True)


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def src5_src6_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return files.by_ids(e, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
