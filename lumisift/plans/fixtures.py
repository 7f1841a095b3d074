"""Queries on small inputs of their own, for what the tables don't hold: files, images, pages, templates. Their SQL is the rows that must come out."""

from __future__ import annotations

import io
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift import schemas
from lumisift.functions import html, pixels, vectors
from lumisift.operators import conversation, diagnostics, evidence, inference, matching, prompts
from lumisift.plans.registry import put, query, scratch
from lumisift.sources import files, http, sinks

_RED, _GREY = np.full((2, 3, 3), (200, 10, 30), dtype=np.uint8), np.arange(16, dtype=np.uint8).reshape(4, 4, 1).repeat(3, axis=2)


def _images(spark: SparkSession) -> str:
    folder = scratch(spark, "images")
    for name, data in {"red.png": pixels.png(_RED), "grey.PNG": pixels.png(_GREY), "broken.jpg": b"\xff\xd8no image" * 256, "note.txt": b"text"}.items():
        put(spark, f"{folder}/{name}", data)
    return folder


@query("SELECT * FROM (VALUES ('broken', 2.5), ('grey', NULL), ('red', NULL)) v(id, kb)")
def src1_prj8_image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = files.file_sizes(files.image_files(spark, _images(spark)))
    return sizes.select("id", F.when(F.col("id") == "broken", F.col("kb")).cast("decimal(2,1)").alias("kb"))


@query("SELECT * FROM (VALUES ('grey', 4, 4, 3), ('red', 2, 3, 3)) v(id, height, width, channels)")
def src2_decoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken file is left out."""
    return files.images(spark, _images(spark)).select("id", "height", "width", "channels")


@query("SELECT * FROM (VALUES ('red', 2, 3)) v(id, height, width)")
def src7_images_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("some/red.png",), ("unknown",), ("red",)], "name string")
    found = files.images_by_name(files.image_files(spark, _images(spark)), names)
    return files.decoded(found).select("id", "shape.height", "shape.width")


@query("SELECT * FROM (VALUES ('A', 't', 2), ('B', NULL, 0)) v(key, title, n)")
def src8_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'object')}/db.json"
    put(spark, path, json.dumps({"A": {"url": "u", "title": "t", "images": ["i", "j"]}, "B": {"url": "v", "images": []}}, indent=1).encode())
    return files.json_object(spark, path, schemas.ARTICLE).select("key", "title", F.size("images").alias("n"))


@query("SELECT * FROM (VALUES ('k1', 'x', 1)) v(file_key, content, position)")
def src9_json_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "folder")
    put(spark, f"{folder}/k1.a.json", json.dumps({"key": "k1", "content": "x", "images": [{"id": "k1_0.jpg", "position": 1}]}).encode())
    put(spark, f"{folder}/bad.json", b"{not json")
    return files.json_folder(spark, folder, schemas.CRAWLED, "key").select("file_key", "content", F.get("images", F.lit(0))["position"].alias("position"))


@query("SELECT * FROM (VALUES ('missing', 0), ('there', 1)) v(path, n)")
def src10_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, kind = scratch(spark, "tolerant"), "query_id string, entropy double, gap double, low_top1_sim double"
    put(spark, f"{folder}/list.json", json.dumps([{"query_id": "q", "entropy": 1.5}]).encode())
    n = {name: files.tolerant(lambda p=p: files.json_list(spark, p, schemas.STATS), spark, kind) for name, p in (("there", f"{folder}/list.json"), ("missing", f"{folder}/none.json"))}
    tagged = [df.agg(F.count("*").cast("int").alias("n")).select(F.lit(name).alias("path"), "n") for name, df in n.items()]
    return tagged[0].union(tagged[1])


_CSV = b'query_id,image_id_1,generated_caption\n007,"a ""quoted"", cell","two\nlines"\n8,,x\n'


@query("SELECT * FROM (VALUES ('007', 'a \"quoted\", cell', 'two' || chr(10) || 'lines'), ('8', '', 'x')) v(query_id, image_id_1, generated_caption)")
def src11_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'csv')}/in.csv"
    put(spark, path, _CSV)
    return files.csv(spark, path, schemas.retrieval(1))


@query("SELECT * FROM (VALUES (7, 'a \"quoted\", cell'), (8, NULL)) v(query_id, image_id_1)")
def src12_inferred_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'csv')}/in.csv"
    put(spark, path, _CSV)
    return files.inferred_csv(spark, path).select("query_id", "image_id_1")


def _answer(url: str) -> tuple[int, bytes]:
    return (404, b"") if "gone" in url else (200, f"body of {url}".encode())


@query("SELECT * FROM (VALUES ('a', 'body of http://h/a'), ('b', NULL), ('c', NULL)) v(key, body)")
def src13_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed table of answers stands in for the net."""
    urls = spark.createDataFrame([("a", "http://h/a"), ("b", "http://h/gone"), ("c", None)], "key string, url string")
    return http.pages(urls, _answer).select("key", "body")


@query("SELECT * FROM (VALUES ('a', 'https://h.cnn.com/a', 'body of https://h.cnn.com/a')) v(key, url, body)")
def src14_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = spark.createDataFrame([("a", "//h.cnn.com/a?w=1#x")], "key string, url string")
    return http.pages(urls, _answer, binary=True).select("key", "url", F.decode("body", "UTF-8").alias("body"))


@query("SELECT * FROM (VALUES ('one', 'Hi {{ a }}'), ('two', 'Ho')) v(name, text)")
def src15_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "templates")
    for name, text in {"one.j2": "Hi {{ a }}", "deep/two.j2": "Ho", "three.txt": "no"}.items():
        put(spark, f"{folder}/{name}", text.encode())
    return spark.createDataFrame(sorted(files.templates(spark, folder).items()), "name string, text string")


def _two(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("q2", "b"), ("q1", None)], "query_id string, caption string")


@query("SELECT * FROM (VALUES ('a', 2), ('b', 1)) v(id, n)")
def snk1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "embeddings")
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0]), ("c", None)], "id string, embedding array<float>")
    sinks.embeddings(rows.where("id = 'a'"), path)
    sinks.embeddings(rows.where("id <> 'a'"), path)
    return files.embeddings(spark, path).select("id", F.size("embedding").alias("n"))


@query("SELECT * FROM (VALUES ('q1', NULL), ('q2', 'b')) v(key, caption)")
def snk2_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "object")
    sinks.json_object(_two(spark), "query_id", path)
    return files.json_object(spark, path, "string").toDF("key", "caption")


@query("SELECT * FROM (VALUES ('q1', ''), ('q2', 'b')) v(query_id, caption)")
def snk3_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    sinks.csv(_two(spark), path)
    return files.csv(spark, path, "query_id string, caption string")


@query("SELECT * FROM (VALUES ('q1', NULL), ('q2', 'b')) v(query_id, caption)")
def snk4_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second write holds only what the first lacks."""
    path, rows = scratch(spark, "append"), _two(spark)
    sinks.append_new(rows.where("query_id = 'q1'"), rows.limit(0), path)
    sinks.append_new(rows, spark.read.parquet(path), path)
    return spark.read.parquet(path)


@query("SELECT 'query_id,caption' || chr(10) || 'q1,' || chr(10) || 'q2,b' || chr(10) AS text")
def snk5_csv_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.StringIO()
    sinks.csv_to(_two(spark).orderBy("query_id"), out)
    return spark.createDataFrame([(out.getvalue(),)], "text string")


@query("SELECT * FROM (VALUES ('k', 'k_0.png', 2, 3)) v(key, id, height, width)")
def snk6_crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records beside the bytes of their images, read back and decoded."""
    path = scratch(spark, "crawled")
    images = spark.createDataFrame([("k_0.png", pixels.png(_RED)), ("k_1.png", None)], "id string, content binary")
    sinks.crawled(spark.createDataFrame([("k", ["k_0.png", "k_1.png"])], "key string, images array<string>"), path, images)
    back = spark.read.schema("key string, images array<string>").json(f"{path}/records").select("key", F.explode("images").alias("id"))
    return back.join(files.decoded(spark.read.parquet(f"{path}/images")), "id").select("key", "id", "shape.height", "shape.width")


@query("SELECT * FROM (VALUES ('caption', true), ('other', false)) v(name, present)")
def flt7_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the cleaning of a column that is asked for is refused."""

    def has(name: str) -> bool:
        try:
            return name in evidence.cleaned(_two(spark), name).columns
        except ValueError:
            return False

    return spark.createDataFrame([(n, has(n)) for n in ("caption", "other")], "name string, present boolean")


@query("SELECT * FROM (VALUES ('a', 'o1', 'c2', 1.0), ('a', 'o2', 'c1', 0.8), ('a', 'o3', NULL, NULL)) v(article_id, origin_id, filename, score)")
def j8_pixels_then_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o1 has the pixels of c2; o2 is nearest to c1; o3 has none but negative similarities; o4 has no embedding."""
    side = lambda p, rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"article_id string, {p} string, e array<double>, p array<double>, pos int")
    origin = side("origin_id", [("a", "o1", [1.0, 0.0], [9.0, 9.0]), ("a", "o2", [0.8, 0.6], [50.0, 1.0]), ("a", "o3", [-1.0, -0.1], [70.0, 1.0]), ("a", "o4", None, [9.0, 9.0]), ("b", "o5", [1.0, 0.0], [9.0, 9.0])])
    crawled = side("crawled_id", [("a", "c1", [1.0, 0.0], [1.0, 1.0, 1.0]), ("a", "c2", [0.0, 1.0], [9.0, 9.5])])
    o = origin.select("article_id", "origin_id", F.col("e").alias("o_embedding"), F.col("p").alias("o_pixels"))
    c = crawled.select("article_id", "crawled_id", F.col("pos").alias("crawled_pos"), F.col("e").alias("c_embedding"), F.col("p").alias("c_pixels"))
    return matching.matched(o, c, pixels.array_difference(F.col("o_pixels"), F.col("c_pixels")), pixels.DIFFERENCE).select("article_id", "origin_id", "filename", "score")


@query("SELECT * FROM (VALUES ('a cat', 'a cat', 100.0), ('a cat', NULL, NULL)) v(a, b, text_sim)")
def v6_text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions through a text model, compared by scaled inner product."""
    rows = spark.createDataFrame([("a cat", "a cat"), ("a cat", None)], "a string, b string")
    encoded = rows.withColumns({"x": inference.encode_text(F.col("a")), "y": inference.encode_text(F.col("b"))})
    return encoded.select("a", "b", F.round(vectors.scaled_dot("x", "y", 100.0), 6).alias("text_sim"))


@query("SELECT * FROM (VALUES (1, 'a', 5), (1, 'b', 3), (1, 'c', 3)) v(batches, id, largest)")
def b3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen rows of one task in batches of five: each row is told the size of its batch."""
    rows = spark.createDataFrame([("a" if i < 10 else "b" if i == 10 else "c",) for i in range(13)], "id string").coalesce(1)
    out = inference.in_batches(rows, lambda x: [len(x)] * len(x), "id", "int", 5)
    return out.groupBy("id").agg(F.countDistinct("out").cast("int").alias("batches"), F.max("out").alias("largest")).select("batches", "id", "largest")


@query("SELECT * FROM (VALUES ('q1', 1), ('q2', 1), ('q3', 2)) v(query_id, block)")
def s5_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks put together, the first of each key kept."""
    stats = spark.createDataFrame([("q1", 0.3, 0.2, 5.0), ("q2", 0.2, 0.1, 9.0), ("q3", 0.1, 0.05, 7.0)], "query_id string, entropy double, gap double, low_top1_sim double")
    both = diagnostics.extremes(stats, "entropy", True).where("place <= 2").withColumn("block", F.lit(1)).unionByName(diagnostics.extremes(stats, "gap", False).where("place <= 2").withColumn("block", F.lit(2)))
    return matching.first_match(both, ["query_id"], "block").select("query_id", "block")


@query("SELECT * FROM (VALUES ('again', 'refused'), ('copy', 'unchanged'), ('override', 'taken')) v(step, result)")
def m9_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation.Template("fixture", "first")
    conversation.register(own, override=True)
    conversation.get("fixture").append("USER", "hi")
    out = [("copy", "unchanged" if not conversation.get("fixture").messages else "changed")]
    try:
        conversation.register(own)
        out.append(("again", "taken"))
    except ValueError:
        out.append(("again", "refused"))
    conversation.register(conversation.Template("fixture", "second"), override=True)
    out.append(("override", "taken" if conversation.get("fixture").system == "second" else "refused"))
    del conversation._registry["fixture"]
    return spark.createDataFrame(out, "step string, result string")


@query("SELECT * FROM (VALUES ('grey', 4, 4), ('none', NULL, NULL), ('wide', 1280, 1)) v(id, width, height)")
def m11_base64_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG in, PNG as base64 out, at most 1280 wide; read back."""
    rows = spark.createDataFrame([("grey", pixels.png(_GREY)), ("wide", pixels.png(np.zeros((2, 2000, 3), dtype=np.uint8))), ("none", b"text")], "id string, content binary")
    coded = rows.select("id", pixels.base64_png(F.col("content")).alias("coded"))
    shape = pixels.image_shape(F.unbase64("coded"))
    return coded.select("id", shape["width"].alias("width"), shape["height"].alias("height"))


@query("SELECT * FROM (VALUES (17, 'zero_shot', 'add_colon_single', '###')) v(n, name, style, stop_str)")
def m13_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = conversation.get(conversation.names()[-1])
    return spark.createDataFrame([(len(conversation.names()), last.name, last.style, last.stop_str)], "n int, name string, style string, stop_str string")


_PROMPT = "'Say it to me'"


@query("SELECT 'x' AS id, 768 AS size, 1.0 AS norm, 'image ' || left(md5('x'), 8) AS caption, 'image ' || left(md5('x'), 8) AS short, 'image ' || left(md5('x'), 8) AS beam")
def u1_u3_u4_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("x", b"x")], "id string, content binary")
    c = F.col("content")
    made = rows.select("id", inference.encode_image(c).alias("v"), *(inference.caption(c, k).alias(n) for n, k in (("caption", "caption"), ("short", "short_caption"), ("beam", "beam_caption"))))
    return made.select("id", F.size("v").alias("size"), F.round(F.sqrt(vectors.dot("v", "v")), 6).alias("norm"), "caption", "short", "beam")


@query(f"SELECT left(md5({_PROMPT}), 8) || ' Say it to me' AS text")
def u5_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("Say it to me",)], "p string").select(inference.generate(F.col("p")).alias("text"))


@query("SELECT left(md5('USER: hi' || chr(10) || 'ASSISTANT: '), 8) || ' USER: hi ASSISTANT:' AS answer, 768 AS size")
def u6_u14_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's next turn and its embedding, through the one object that holds all strategies."""
    turns = F.array(F.struct(F.lit("USER").alias("role"), F.lit("hi").alias("text")), F.struct(F.lit("ASSISTANT").alias("role"), F.lit(None).cast("string").alias("text")))
    whole = inference.Assembler()
    return spark.range(1).select(whole.chat(turns).alias("answer"), F.size(whole.embeddings(F.lit("hi"))).alias("size"))


def _enriched(context: str, names: str) -> str:
    made = {"enrich": "'Picture: a hall' || chr(10) || 'Context: in June' || chr(10) || 'Write a fuller caption.'", "enrich_2": "'Context: in June' || chr(10) || 'Names: Ann' || chr(10) || 'Picture: a hall' || chr(10) || 'Rewrite the caption with both.'", "provided_context": "'Use only this context: in June' || chr(10) || 'Caption: a hall'"}
    return " UNION ALL ".join(f"SELECT '{k}' AS strategy, left(md5({p}), 8) || ' ' || replace({p}, chr(10), ' ') AS text" for k, p in made.items())


@query(_enriched("in June", "Ann"))
def u12_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prompts.composed(spark.createDataFrame([("q", "a hall", "in June", "Ann")], "query_id string, generated_caption string, context string, name_entity_keyword string"))
    out = [inference.run_strategy(rows, s).select("strategy", "text") for s in ("enrich", "enrich_2", "provided_context")]
    return out[0].union(out[1]).union(out[2])


_PAGE = """<html><head><title> A &amp; B </title><meta itemprop="datePublished" content=""><meta name="pubdate" content="2024-05-01"><meta property="article:published_time" content="2024-05-02">
<meta name="author" content="Ann"><meta name="description" content="About"><meta name="keywords" content="x, y"></head><body><ul class="breadcrumbs"><li><a>News</a></li><li><a>World</a></li></ul>
<article><p>One <b>two</b></p><div class="image__container"><img src="//cdn.cnn.com/i.png?x=1" alt="al"></div><div class="image__metadata">Cap</div><p></p><p>three</p><div class="image__container"><p>no image</p></div></article></body></html>"""


@query("""
SELECT * FROM (VALUES ('A & B', '2024-05-01', '2024-05-02', 'World', 'Ann', 'About', 'x|y', 'Onetwo' || chr(10) || 'three' || chr(10) || 'no image' || chr(10) || '<k_0.png>', 5, '2024-05-01', 'k_0.png', 'https://cdn.cnn.com/i.png', 'al', 'Cap', 3))
v(title, publish_date, section, category, author, meta_description, keywords, content, word_count, event_date, id, url, alt, caption, position)
""")
def h2_h9_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page that has every field."""
    f = spark.createDataFrame([("k", _PAGE)], "key string, html string").select(html.parsed(F.col("key"), F.col("html")).alias("f")).select("f.*")
    i = F.get("images", F.lit(0))
    return f.select("title", "publish_date", "section", "category", "author", "meta_description", F.array_join("keywords", "|").alias("keywords"), "content", "word_count", "event_date", i["id"].alias("id"), i["url"].alias("url"), i["alt"].alias("alt"), i["caption"].alias("caption"), i["position"].alias("position"))


@query("SELECT * FROM (VALUES (1, 'a b c'), (2, ''), (3, '')) v(id, text)")
def t3_without_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "<p>a<b> b </b></p>c <script>x</script>"), (2, None), (3, "<br>")], "id int, html string")
    return rows.select("id", html.without_tags(F.col("html")).alias("text"))


