"""Prompts, conversations and model stages on documents and conversations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.operators import conversation, inference, prompts
from lumisift.plans.articles import _EVIDENCE_SQL, merged
from lumisift.plans.registry import ORACLES, query, table
from lumisift.plans.retrieval import _HITS, hits

TEMPLATE = "Summary:\n{{ summary.fact }}|{{ summary.raw }}\nPicture: {{ generated_caption }}\nCaption: {{ crawl_caption }}\nNames: {{ name_entity_keyword }}\nQuestions: {{ question_answer }}\n{% for e in examples %}Example {{ loop.index }}: {{ e.generated_caption }} -> {{ e.expected_output }}\n{% endfor %}Write."
#: Candidates of a query that get captions.
CANDIDATES = 3
EXAMPLES = [{"generated_caption": "a hall", "expected_output": "A hall in June."}, {"generated_caption": "a port"}]


@query(
    _EVIDENCE_SQL
    + """ SELECT query_id, 'Summary:' || chr(10) || fact_summary || '|' || chr(10) || 'Picture: ' || generated_caption || chr(10) || 'Caption: ' || coalesce(crawl_caption, '') || chr(10) || 'Names: ' || name_entity_keyword || chr(10)
  || 'Questions: ' || question_answer || chr(10) || 'Example 1: a hall -> A hall in June.' || chr(10) || 'Example 2: a port -> ' || chr(10) || 'Write.' AS prompt FROM merged"""
)
def m1_m2_prj6_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.rendered(prompts.composed(merged(spark, sf_dir), EXAMPLES), TEMPLATE)


@query("SELECT doc_id, len(string_split(text, ' ')) AS n, CAST(NULL AS VARCHAR) AS context FROM documents")
def m4_zipped_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("example"))
    z = d.select("doc_id", prompts.zipped(F.col("example"), F.array().cast("array<string>")).alias("z"))
    return z.select("doc_id", F.size("z").cast("long").alias("n"), F.get("z.context", F.lit(0)).alias("context"))


@query(ORACLES["m1_m2_prj6_prompts"] + " ORDER BY query_id LIMIT 1")
def m3_template_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of the first record."""
    first = merged(spark, sf_dir).orderBy("query_id").limit(1)
    return prompts.rendered(prompts.composed(first, EXAMPLES), TEMPLATE)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh text is null, as a turn that is to be filled."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 7 != 0, F.col("text")))
    own = F.sort_array(F.collect_list(F.struct("turn", F.struct("role", "text").alias("m"))))
    return c.groupBy("conv_id").agg(own.alias("o")).select("conv_id", F.col("o.m").alias("messages"))


_TURNS = "WITH c AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 7 <> 0 THEN text END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"
_SYSTEM = "CAST('A user talks with an assistant. The assistant answers helpfully and precisely.' AS VARCHAR)"


@query(
    _TURNS
    + f""" SELECT conv_id, {_SYSTEM} || string_agg(CASE WHEN i % 2 = 0 THEN '<image>' ELSE '' END || role || CASE WHEN coalesce(text, '') = '' THEN ':' || CASE WHEN i % 2 = 1 THEN '<answer>' ELSE '' END
  ELSE ': ' || CASE WHEN i % 2 = 1 THEN '<answer>' ELSE '' END || text || CASE WHEN i % 2 = 0 THEN ' ' ELSE '<|endofchunk|>' END END, '' ORDER BY i) AS prompt FROM c GROUP BY conv_id"""
)
def m5_prompt_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", conversation.prompt(conversation.get("open_flamingo_v1.1"), F.col("messages")).alias("prompt"))


@query(_TURNS + f" SELECT conv_id, {_SYSTEM} || chr(10) || '### ' || string_agg(role || CASE WHEN coalesce(text, '') = '' THEN ':' ELSE ': ' || text || chr(10) || '### ' END, '' ORDER BY i) AS prompt FROM c GROUP BY conv_id")
def m5_prompt_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", conversation.prompt(conversation.get("zero_shot"), F.col("messages")).alias("prompt"))


@query(
    _TURNS
    + f""" SELECT conv_id, {_SYSTEM} || string_agg(CASE WHEN coalesce(text, '') = '' THEN role || ': ' || CASE WHEN i % 2 = 0 THEN '<image>' ELSE '<answer>' END
  ELSE text || CASE WHEN i % 2 = 0 THEN ' ' ELSE '<|endofchunk|>' END END, '' ORDER BY i) AS prompt FROM c GROUP BY conv_id"""
)
def m6_interleaved_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", conversation.interleaved_prompt(conversation.get("open_flamingo_v1.1"), F.col("messages")).alias("prompt"))


@query(_TURNS + " SELECT conv_id, coalesce(string_agg(text, '' ORDER BY i), '') AS text FROM c GROUP BY conv_id")
def m7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", conversation.texts(F.col("messages")).alias("text"))


@query(
    _TURNS
    + """, a AS (SELECT conv_id, i, CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, text FROM c WHERE i >= 1)
SELECT c.conv_id, 'system=be brief' || coalesce((SELECT string_agg('|' || role || '=' || coalesce(text, ''), '' ORDER BY i) FROM a WHERE a.conv_id = c.conv_id AND (role = 'user' OR text IS NOT NULL)), '') AS messages FROM c WHERE i = 0"""
)
def m8_api_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation.api_messages(F.lit("be brief"), F.col("messages"), 1)
    line = F.transform(own, lambda m: F.concat(m["role"], F.lit("="), F.coalesce(m["content"], F.lit(""))))
    return messages(spark, sf_dir).select("conv_id", F.array_join(line, "|").alias("messages"))


@query(_TURNS + " SELECT conv_id, count(*) + 1 AS n, max_by(role, i) AS last_role, coalesce(string_agg(CASE WHEN text IS NOT NULL THEN text END, '' ORDER BY i), '') || 'done' AS text FROM c GROUP BY conv_id")
def m10_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn by the last role is appended, empty, then filled."""
    own = conversation.appended(F.col("messages"), F.element_at("messages", -1)["role"], F.lit(None).cast("string"))
    out = messages(spark, sf_dir).withColumn("messages", own).withColumn("messages", conversation.last_updated(F.col("messages"), F.lit("done")))
    return out.select("conv_id", F.size("messages").cast("long").alias("n"), F.element_at("messages", -1)["role"].alias("last_role"), conversation.texts(F.col("messages")).alias("text"))


@query(
    _TURNS
    + """, p AS (SELECT conv_id, i // 2 AS pair, coalesce(max(CASE WHEN i % 2 = 0 THEN replace(coalesce(text, ''), '<image>', '') END), '') AS said,
  max(CASE WHEN i % 2 = 1 THEN 'Assistant: ' || replace(regexp_replace(text, '(?s)^.*GPT:', ''), '<|endofchunk|>', '') END) AS answered FROM c GROUP BY conv_id, i // 2)
SELECT conv_id, count(*) AS n, string_agg(said || chr(10) || coalesce(answered, '-'), chr(10) ORDER BY pair) AS view FROM p GROUP BY conv_id"""
)
def m12_chat_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = conversation.chat_view(F.col("messages"))
    line = F.transform(pairs, lambda p: F.concat(p["said"], F.lit("\n"), F.coalesce(p["answered"], F.lit("-"))))
    return messages(spark, sf_dir).select("conv_id", F.size(pairs).cast("long").alias("n"), F.array_join(line, "\n").alias("view"))


@query("""
WITH t AS (SELECT doc_id, text, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), 1, 80), ' ') AS own FROM documents),
s AS (SELECT doc_id, text, ('0x' || left(md5(own), 7))::BIGINT AS seed FROM t),
v AS (SELECT doc_id, text, list_transform(range(1, 769), lambda j: CAST(seed * j % 9973 AS DOUBLE) / 9973 - 0.5) AS v FROM s)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE CAST(768 AS INTEGER) END AS size, CASE WHEN text IS NOT NULL THEN round(v[1] / sqrt(list_dot_product(v, v)), 6) END AS first FROM v
""")
def u2_encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", inference.encode_text(F.col("text")).alias("v"))
    return d.select("doc_id", F.size("v").alias("size"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


#: What the stub model makes of a prompt: a hash, then the prompt's words.
_STUB_SQL = _EVIDENCE_SQL + """, p AS (SELECT query_id, {prompt} AS prompt FROM merged)
SELECT query_id, '{name}' AS strategy, left(md5(prompt), 8) || coalesce(' ' || nullif(array_to_string(list_slice(list_filter(regexp_split_to_array(prompt, '\\s+'), lambda w: w <> ''), 1, {most} - 1), ' '), ''), '') AS text FROM p"""
_FIELDS = {"article": "coalesce(article, '')", "generated_caption": "generated_caption", "summary.fact": "fact_summary", "crawl_caption": "coalesce(crawl_caption, '')", "name_entity_keyword": "name_entity_keyword", "question_answer": "question_answer"}


def _stub_sql(name: str) -> str:
    """A strategy's template as a concatenation of SQL."""
    pieces = re.split(r"\{\{ ([\w.]+) \}\}", inference.STRATEGIES[name])
    parts = [_FIELDS[p] if i % 2 else " || chr(10) || ".join("'" + t.replace("'", "''") + "'" for t in p.split("\n")) for i, p in enumerate(pieces)]
    return _STUB_SQL.format(prompt=" || ".join(parts), name=name, most=inference.LIMITS[name][0])


def _strategy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return inference.run_strategy(prompts.composed(merged(spark, sf_dir), EXAMPLES), name)


@query(_stub_sql("summarize"))
def u8_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strategy(spark, sf_dir, "summarize")


@query(_stub_sql("assemble"))
def u9_u15_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strategy(spark, sf_dir, "assemble")


@query(_stub_sql("question_answer"))
def u10_question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strategy(spark, sf_dir, "question_answer")


@query(_stub_sql("name_entity"))
def u11_named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strategy(spark, sf_dir, "name_entity")


@query(_HITS + f" SELECT query_id, rank, item_id AS image_id, CASE WHEN item_id % 5 <> 0 THEN 'image ' || left(md5('vector ' || item_id), 8) ELSE '' END AS caption FROM hits WHERE rank <= {CANDIDATES}")
def u16_candidate_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short captions of every image's nearest ones; a text that names the vector stands in for an image's bytes."""
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.encode(F.concat(F.lit("vector "), F.col("vec_id").cast("string")), "UTF-8").alias("content"))
    slots = hits(spark, sf_dir).where(F.col("rank") <= CANDIDATES).select("query_id", "rank", F.col("item_id").alias("image_id"))
    return inference.caption_candidates(slots, images.where("image_id % 5 <> 0"))
