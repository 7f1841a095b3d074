"""Alignment, evidence, submission, audits and resumption on documents, labels and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.operators import audit, evidence, matching, partitioning, positions, rerank
from lumisift.plans.registry import query, table

#: Stand-in for a crawl: the text with a marker line after its first line.
_CRAWL_SQL = """
WITH art AS (SELECT doc_id AS article_id, text AS content FROM documents WHERE text IS NOT NULL), c AS (
  SELECT article_id, CASE WHEN instr(content, chr(10)) = 0 THEN content || chr(10) || '<' || article_id || '_0.jpg>'
    ELSE left(content, instr(content, chr(10))) || '<' || article_id || '_0.jpg>' || substr(content, instr(content, chr(10))) END AS content FROM art
), l AS (SELECT article_id, unnest(string_split(content, chr(10))) AS part, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM c),
m AS (SELECT *, regexp_matches(trim(part), '^<[^>]+>$') AS is_marker FROM l),
around AS (
  SELECT article_id, line_no, part, is_marker,
    coalesce(last_value(CASE WHEN NOT is_marker THEN part END IGNORE NULLS) OVER (PARTITION BY article_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev_text,
    coalesce(first_value(CASE WHEN NOT is_marker THEN part END IGNORE NULLS) OVER (PARTITION BY article_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS next_text FROM m
)"""


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("article_id"), F.col("text").alias("content"))


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.concat(F.lit("<"), F.col("article_id").cast("string"), F.lit("_0.jpg>"))
    end = F.instr("content", "\n")
    within = F.concat(F.substring("content", F.lit(1), end), mark, F.substring("content", end, F.length("content")))
    return _articles(spark, sf_dir).select("article_id", F.when(end == 0, F.concat("content", F.lit("\n"), mark)).otherwise(within).alias("content"))


@query(_CRAWL_SQL + " SELECT article_id, CAST(line_no AS INTEGER) AS line_no, is_marker, md5(prev_text) AS prev_text, md5(next_text) AS next_text FROM around")
def w8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.parts(_crawl(spark, sf_dir)).select("article_id", F.col("at").alias("line_no"), "is_marker", F.md5("prev_text").alias("prev_text"), F.md5("next_text").alias("next_text"))


_PLACE = """, img AS (SELECT a.article_id, a.content AS origin_text, right(r.prev_text, 6400) AS p, left(r.next_text, 6400) AS n, r.prev_text, r.next_text
  FROM art a JOIN around r ON r.article_id = a.article_id AND r.is_marker AND r.part = '<' || a.article_id || '_0.jpg>'),
spot AS (SELECT article_id, CAST(coalesce(CASE WHEN p <> '' AND instr(origin_text, p) > 0 THEN instr(origin_text, p) - 1 + length(p) END,
  CASE WHEN n <> '' AND instr(origin_text, n) > 0 THEN instr(origin_text, n) - 1 END,
  CASE WHEN prev_text <> '' AND next_text <> '' AND instr(origin_text, prev_text || ' ' || next_text) > 0 THEN instr(origin_text, prev_text || ' ' || next_text) + length(prev_text) END) AS INTEGER) AS position FROM img)"""


def _spots(spark: SparkSession, sf_dir: str, fuzzy: bool = False, mode: str = "marker") -> DataFrame:
    images = _articles(spark, sf_dir).select("article_id", F.concat(F.col("article_id").cast("string"), F.lit("_0.jpg")).alias("image_id"), F.col("content").alias("origin_text"))
    if mode == "index":
        images = images.withColumn("position", F.lit(1))
    return positions.located(positions.neighbours(images, _crawl(spark, sf_dir), mode), fuzzy)


@query(_CRAWL_SQL + _PLACE + " SELECT * FROM spot")
def p3_p6_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spots(spark, sf_dir).select("article_id", F.col("origin_pos").alias("position"))


@query()
def p4_p6_fuzzy_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original's second character is changed, so the first line is found by the fuzzy search only."""
    changed = F.concat(F.substring("origin_text", 1, 1), F.lit("#"), F.substring("origin_text", F.lit(3), F.length("origin_text")))
    images = _articles(spark, sf_dir).select("article_id", F.concat(F.col("article_id").cast("string"), F.lit("_0.jpg")).alias("image_id"), F.col("content").alias("origin_text"))
    around = positions.neighbours(images.withColumn("origin_text", changed), _crawl(spark, sf_dir))
    return positions.located(around).select("article_id", F.col("origin_pos").alias("position"))


_NAMES_SQL = """
WITH names AS (
  SELECT doc_id AS article_id, CASE doc_id % 5 WHEN 0 THEN doc_id || '_0.jpg' WHEN 1 THEN doc_id || '_0' WHEN 2 THEN doc_id || '_1' WHEN 3 THEN doc_id || '_2.gif' END AS filename, 0.5 + (doc_id % 5) / 10 AS score FROM documents
), images AS (SELECT doc_id AS article_id, doc_id || unnest(['_0.jpg', '_1.png', '_2']) AS image_id FROM documents),
tries AS (SELECT article_id, filename, score, unnest([filename, filename || '.jpg', filename || '.png', regexp_replace(filename, '\\.[^.]*$', '')]) AS image_id, unnest([0, 1, 2, 3]) AS priority FROM names),
best AS (SELECT t.article_id, t.filename, t.image_id FROM tries t JOIN images i USING (article_id, image_id) QUALIFY row_number() OVER (PARTITION BY t.article_id, t.filename ORDER BY priority) = 1),
repaired AS (SELECT n.article_id, n.filename, n.score, b.image_id FROM names n LEFT JOIN best b ON b.article_id = n.article_id AND b.filename = n.filename)"""


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"))
    own, n = F.col("article_id").cast("string"), F.col("article_id") % 5
    name = F.when(n == 0, F.concat(own, F.lit("_0.jpg"))).when(n == 1, F.concat(own, F.lit("_0"))).when(n == 2, F.concat(own, F.lit("_1"))).when(n == 3, F.concat(own, F.lit("_2.gif")))
    names = d.select("article_id", name.alias("filename"), (F.lit(0.5) + n / 10).alias("score"))
    images = d.select("article_id", F.explode(F.array(*(F.lit(e) for e in ("_0.jpg", "_1.png", "_2")))).alias("e")).select("article_id", F.concat(own, "e").alias("image_id"))
    return matching.repaired(names, images)


@query(_NAMES_SQL + " SELECT * FROM repaired")
def j12_repaired_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select("article_id", "filename", "score", "image_id")


@query(
    _NAMES_SQL.replace("WITH names", _CRAWL_SQL.strip() + _PLACE + ", names")
    + """ SELECT r.article_id, CASE WHEN r.filename IS NULL OR r.image_id IS NULL THEN '' ELSE 'http://i.example/' || r.image_id END AS url,
  CASE WHEN r.filename IS NOT NULL AND r.image_id IS NOT NULL THEN s.position END AS position, CASE WHEN r.filename IS NULL THEN 0.0 ELSE r.score END AS score,
  CASE WHEN l.doc_id IS NULL THEN '' ELSE 'q' || l.quality END AS category, CAST(coalesce(l.toxic, 0) AS INTEGER) AS word_count
FROM repaired r JOIN spot s USING (article_id) LEFT JOIN labels l ON l.doc_id = r.article_id"""
)
def p1_p7_j11_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand in for the crawled metadata: an article without a label has no crawl."""
    spots = _spots(spark, sf_dir).select("article_id", "origin_pos")
    images = _repaired(spark, sf_dir).join(spots, "article_id").withColumns({"origin_id": F.col("article_id").cast("string"), "n": F.lit(0), "url": F.concat(F.lit("http://i.example/"), F.col("image_id"))})
    articles = _articles(spark, sf_dir).withColumns({"url": F.lit(""), "date": F.lit(""), "title": F.lit("")})
    crawled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("category"), F.lit("").alias("author"), F.lit("").alias("meta_description"), F.array(F.lit("k")).alias("keywords"), F.col("toxic").alias("word_count"), F.lit(0.0).alias("reading_time_minutes"))
    whole = positions.rebuilt(articles, crawled, positions.placed(images))
    return whole.select("article_id", F.explode("images").alias("i"), "category", "word_count").select("article_id", "i.url", "i.position", "i.score", "category", "word_count")


_EVIDENCE_SQL = """
WITH context AS (SELECT doc_id AS query_id, doc_id % 50 AS image_id, doc_id AS article_id FROM documents),
images AS (SELECT doc_id % 50 AS image_id, 'http://i.example/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS INTEGER) END AS position, 0.5 AS score
  FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id DESC) = 1),
captions AS (SELECT 'http://i.example/' || item_id AS image_url, 'alt ' || text AS alt, 'see https://x.example/y ' || text AS caption FROM benchmark),
results AS (SELECT c.query_id, trim(coalesce(k.alt, ''), ' ' || chr(10)) AS crawl_alt, trim(regexp_replace(coalesce(k.caption, ''), 'https?://\\S+', '', 'g'), ' ' || chr(10)) AS crawl_caption,
  d.text AS article, coalesce(i.position, 0) AS article_position, i.url AS image_url, 'http://a.example/' || d.doc_id AS article_url, c.image_id, c.article_id
  FROM context c JOIN images i USING (image_id) JOIN documents d ON d.doc_id = c.article_id LEFT JOIN captions k ON k.image_url = i.url),
merged AS (SELECT c.query_id, coalesce('quality ' || l.quality, '') AS question_answer, coalesce(b.text, '') AS name_entity_keyword, CASE WHEN d.lang = 'en' THEN d.source ELSE '' END AS generated_caption,
  CASE WHEN c.query_id % 3 = 0 THEN left(d.text, 200) ELSE '' END AS fact_summary, r.crawl_alt AS crawl_caption, r.article
  FROM context c LEFT JOIN labels l ON l.doc_id = c.query_id LEFT JOIN benchmark b ON b.item_id = c.query_id JOIN documents d ON d.doc_id = c.query_id LEFT JOIN results r ON r.query_id = c.query_id)"""


def _lookup_tables(spark: SparkSession, sf_dir: str):
    d = table(spark, sf_dir, "documents")
    context = d.select(F.col("doc_id").alias("query_id"), (F.col("doc_id") % 50).alias("image_id"), F.col("doc_id").alias("article_id"))
    record = F.struct((F.col("doc_id") % 50).alias("id"), F.concat(F.lit("http://i.example/"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("int")).alias("position"), F.lit(0.5).alias("score"))
    articles = d.select(F.col("doc_id").alias("article_id"), F.concat(F.lit("http://a.example/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("content"), F.array(record).alias("images"))
    image = F.struct(F.concat(F.lit("http://i.example/"), F.col("item_id").cast("string")).alias("url"), F.concat(F.lit("alt "), F.col("text")).alias("alt"), F.concat(F.lit("see https://x.example/y "), F.col("text")).alias("caption"))
    crawled = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.array(image).alias("images"))
    return context, articles, crawled


@query(_EVIDENCE_SQL + " SELECT image_id, url, position, score FROM images")
def prj1_prj2_image_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.image_lookup(_lookup_tables(spark, sf_dir)[1])


@query(_EVIDENCE_SQL + " SELECT * FROM captions")
def prj3_caption_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.caption_lookup(_lookup_tables(spark, sf_dir)[2])


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    context, articles, crawled = _lookup_tables(spark, sf_dir)
    return evidence.results(context, evidence.image_lookup(articles), evidence.caption_lookup(crawled), articles)


@query(_EVIDENCE_SQL + " SELECT * FROM results")
def j13_p8_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


@query(_EVIDENCE_SQL + " SELECT query_id, crawl_alt AS crawl_caption, md5(coalesce(article, '')) AS content FROM results")
def prj4_w9_caption_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.caption_index(_results(spark, sf_dir)).withColumn("content", F.md5("content"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = lambda df, key, c: df.select(F.col(key).alias("query_id"), c.alias("text"))
    return evidence.merged(
        _lookup_tables(spark, sf_dir)[0],
        text(table(spark, sf_dir, "labels"), "doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string"))),
        text(table(spark, sf_dir, "benchmark"), "item_id", F.col("text")),
        text(d.where("lang = 'en'"), "doc_id", F.col("source")),
        text(d.where("doc_id % 3 = 0"), "doc_id", F.left("text", F.lit(200))),
        evidence.caption_index(_results(spark, sf_dir)),
    )


@query(_EVIDENCE_SQL + " SELECT query_id, question_answer, name_entity_keyword, generated_caption, fact_summary, coalesce(crawl_caption, '') AS crawl_caption, coalesce(article, '') AS article FROM merged")
def j14_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("query_id", "question_answer", "name_entity_keyword", "generated_caption", "article_summary.fact_summary", "crawl_caption", "article")


_SUBMIT_SQL = "WITH s AS (SELECT d.doc_id AS query_id, d.source AS article_id_1, coalesce('quality ' || l.quality, '') AS generated_caption FROM documents d LEFT JOIN labels l USING (doc_id))"


def _submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("article_id_1"), F.lit("old").alias("generated_caption"))
    captions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("text"))
    return evidence.submission(ranking, captions)


@query(_SUBMIT_SQL + " SELECT * FROM s")
def j15_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.cleaned(_submission(spark, sf_dir))


@query(_SUBMIT_SQL + " SELECT count_if(generated_caption <> '') AS matched, count_if(generated_caption = '') AS unmatched FROM s")
def a1_a2_caption_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.caption_counts(_submission(spark, sf_dir))


@query("SELECT d.doc_id AS query_id, d.doc_id AS article_id, d.text AS content FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j16_to_summarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    first = d.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("article_id"))
    return evidence.to_summarise(first, d.select(F.col("doc_id").alias("article_id"), F.col("text").alias("content")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id")))


def _ids(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("query_id"))


@query("SELECT doc_id AS query_id FROM labels INTERSECT SELECT item_id FROM benchmark")
def s2_j7_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.common(_ids(spark, sf_dir, "labels", "doc_id"), _ids(spark, sf_dir, "benchmark", "item_id"), "query_id")


@query("SELECT query_id, 'left_only' AS side FROM (SELECT doc_id AS query_id FROM labels EXCEPT SELECT item_id FROM benchmark) UNION ALL SELECT query_id, 'right_only' FROM (SELECT item_id AS query_id FROM benchmark EXCEPT SELECT doc_id FROM labels)")
def s3_s4_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.both_differences(_ids(spark, sf_dir, "labels", "doc_id"), _ids(spark, sf_dir, "benchmark", "item_id"), "query_id")


@query("""
WITH k AS (SELECT a.doc_id AS l, b.doc_id AS r FROM (SELECT DISTINCT doc_id FROM labels) a FULL JOIN (SELECT DISTINCT doc_id FROM documents) b ON a.doc_id = b.doc_id)
SELECT count_if(l IS NOT NULL AND r IS NOT NULL) AS n_common, count_if(r IS NULL) AS n_left_only, count_if(l IS NULL) AS n_right_only, round(count_if(l IS NOT NULL AND r IS NOT NULL) * 100.0 / count(r), 1) AS percent FROM k
""")
def a4_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overlap(_ids(spark, sf_dir, "labels", "doc_id"), _ids(spark, sf_dir, "documents", "doc_id"), "query_id")


@query("""
WITH f AS (SELECT DISTINCT 'labels' AS file, doc_id AS id FROM labels UNION SELECT 'benchmark', item_id FROM benchmark UNION SELECT 'embeddings', vec_id FROM embeddings)
SELECT file, count(*) AS n_ids, count_if(id IN (SELECT doc_id FROM documents)) AS n_common FROM f GROUP BY file
""")
def a11_related_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"labels": _ids(spark, sf_dir, "labels", "doc_id"), "benchmark": _ids(spark, sf_dir, "benchmark", "item_id"), "embeddings": _ids(spark, sf_dir, "embeddings", "vec_id")}
    return audit.related_overlap(named, _ids(spark, sf_dir, "documents", "doc_id"))


_FLAGS_SQL = """
WITH f AS (SELECT doc_id AS origin_id, source || '_' || doc_id || '.jpg' AS file, 0.25 AS score, doc_id IN (SELECT doc_id FROM labels) AS in_json, doc_id IN (SELECT vec_id FROM embeddings) AS has_file FROM documents WHERE doc_id % 10 <> 9)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand in for what was crawled, vectors for files; matches whose id ends in 9 are null."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("name"))
    matches = d.select(F.col("doc_id").alias("origin_id"), F.when(F.col("doc_id") % 10 != 9, F.col("name")).alias("filename"), F.lit(0.25).alias("score"))
    crawled = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.concat("name", F.lit(".jpg")).alias("image_id"))
    stored = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").select(F.concat("name", F.lit(".jpg")).alias("file"))
    return audit.match_flags(matches, crawled, stored)


@query(_FLAGS_SQL + " SELECT * FROM f")
def j19_match_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


@query(_FLAGS_SQL + " SELECT count(*) AS checked, count_if(in_json) AS found_in_json, count_if(NOT in_json) AS missing_in_json, count_if(has_file) AS file_exists, count_if(NOT has_file) AS file_missing FROM f")
def a5_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tallies(_flags(spark, sf_dir))


@query(_FLAGS_SQL + " SELECT origin_id, file, score, CASE WHEN NOT in_json AND NOT has_file THEN 'missing_both' WHEN NOT in_json THEN 'missing_in_json' ELSE 'missing_file' END AS issue FROM f WHERE NOT (in_json AND has_file)")
def a6_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).withColumn("issue", audit.issue()).where("issue is not null").select("origin_id", "file", "score", "issue")


@query("""
WITH n AS (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id)
SELECT doc_id AS article_id, CAST(3 AS INTEGER) AS n_origin, coalesce(n_turns, 0) AS n_matched FROM documents LEFT JOIN n ON conv_id = doc_id WHERE coalesce(n_turns, 0) <> 3
""")
def a12_count_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three images for each article; turns of the conversation with its id stand in for match entries."""
    articles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.array(*(F.lit(i) for i in range(3))).alias("images"))
    return audit.count_mismatches(articles, table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("article_id")))


@query("SELECT DISTINCT CAST(vec_id AS VARCHAR) AS id FROM embeddings e WHERE EXISTS (SELECT 1 FROM pages p WHERE contains(p.url, CAST(e.vec_id AS VARCHAR)))")
def j17_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.contained(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id")), table(spark, sf_dir, "pages").select(F.col("url").alias("name")))


@query("""
WITH k AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS key FROM benchmark ORDER BY key LIMIT 5)
SELECT CAST(doc_id AS VARCHAR) AS query_id, key FROM documents JOIN k ON contains(CAST(doc_id AS VARCHAR), key) OR contains(key, CAST(doc_id AS VARCHAR))
""")
def j18_similar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.similar_keys(_ids(spark, sf_dir, "documents", "doc_id").select(F.col("query_id").cast("string")), _ids(spark, sf_dir, "benchmark", "item_id").select(F.col("query_id").cast("string")))


@query("SELECT count(text) AS n, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest, round(avg(length(text)), 6) AS mean FROM documents")
def a10_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.length_stats(table(spark, sf_dir, "documents"), "text")


@query("SELECT count(DISTINCT label) AS n_articles, count(DISTINCT vec_id) AS n_images FROM embeddings")
def a3_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(F.countDistinct("label").alias("n_articles"), F.countDistinct("vec_id").alias("n_images"))


@query("SELECT doc_id, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':0'), doc_id LIMIT 10")
def k9_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 10)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 10")
def k10_k11_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(10)


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n, count(*) OVER () // 7 AS share FROM documents) SELECT doc_id, CAST(least(n // share + 1, 7) AS INTEGER) AS part FROM n")
def b1_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.part_numbers(_ids(spark, sf_dir, "documents", "doc_id"), "query_id", 7).select(F.col("query_id").alias("doc_id"), "part")


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 64 AS INTEGER) AS chunk FROM documents")
def b2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.chunk_numbers(_ids(spark, sf_dir, "documents", "doc_id"), "query_id", 64).select(F.col("query_id").alias("doc_id"), "chunk")


@query("SELECT doc_id AS query_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def flt1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.members(_ids(spark, sf_dir, "documents", "doc_id"), _ids(spark, sf_dir, "labels", "doc_id"), "query_id")


@query("SELECT doc_id AS query_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def flt2_b4_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.to_do(_ids(spark, sf_dir, "documents", "doc_id"), _ids(spark, sf_dir, "labels", "doc_id"), "query_id")


@query("SELECT doc_id AS query_id FROM documents WHERE length(source) <> 5")
def flt3_to_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("caption"))
    return partitioning.to_caption(_ids(spark, sf_dir, "documents", "doc_id"), captions, 5)


@query("SELECT source, doc_id, md5(coalesce(text, '')) AS text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) = 1")
def w7_w9_last_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text"))
    return rerank.last_of_each(d, ["source"], "n_chars", "doc_id").drop("n_chars")
