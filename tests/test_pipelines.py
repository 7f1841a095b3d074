from pyspark.sql import functions as F

from lumisift.functions import pixels
from lumisift.plans import pipelines
from tests.test_functions import PAGE, ppm


def test_retrieve(spark):
    vec = lambda *rows: spark.createDataFrame(list(rows), "id string, vector array<double>")
    q = vec(("q", [1.0, 0.0]), ("r", [0.0, 1.0])).withColumnRenamed("id", "query_id")
    d = vec(("i1", [1.0, 0.0]), ("i2", [0.9, 0.1]), ("i3", [0.0, 1.0])).withColumnRenamed("id", "item_id")
    m = spark.createDataFrame([("i1", "A"), ("i2", "B")], "image_id string, article_id string")
    a = spark.createDataFrame([("A", "ua"), ("B", "ub")], "article_id string, url string")
    text = spark.createDataFrame([("q", "i2", 5.0)], "query_id string, item_id string, text_sim double")
    out = pipelines.retrieve(q, d, m, a, k=2, slots=2)
    assert [tuple(r) for r in out["context"].collect()] == [("q", "i1", "A", "ua")] and [r.query_id for r in out["rejected"].collect()] == ["r"]
    again = pipelines.retrieve(q, d, m, a, text, k=2, order="score", slots=2)
    assert [r.image_id for r in again["context"].where("query_id = 'q'").collect()] == ["i2"]
    assert {r.query_id: (r.article_id_1, r.article_id_2) for r in again["slots"].collect()} == {"q": ("B", "A"), "r": ("", "B")}


def test_crawl_and_align(spark):
    pages = spark.createDataFrame([("k", "http://p", PAGE), ("n", "http://n", None)], "key string, url string, html string")
    crawled = pipelines.crawl(pages)
    assert [r.key for r in crawled.collect()] == ["k"]
    articles = spark.createDataFrame([("k", "http://o", "d", "t", "Start. Three is here.", ["o1", "o2"])], "article_id string, url string, date string, title string, content string, images array<string>")
    matches = spark.createDataFrame([("k", "o1", "k_0", 0.9)], "article_id string, origin_id string, filename string, score double")
    images = pipelines.align(articles, crawled, matches).first().images
    assert [tuple(i) for i in images] == [("o1", "https://cdn.cnn.com/i.png", 12, 0.9), ("o2", "", None, 0.0)]


def test_caption(spark):
    context = spark.createDataFrame([("q", "i", "A", "u")], "query_id string, image_id string, article_id string, article_url string")
    results = spark.createDataFrame([("q", "alt", "cap", "text", "A")], "query_id string, crawl_alt string, crawl_caption string, article string, article_id string")
    captions = spark.createDataFrame([("q", "a dog")], "query_id string, text string")
    ranking = spark.createDataFrame([("q", "A", ""), ("x", "B", "old")], "query_id string, article_id_1 string, generated_caption string")
    out = pipelines.caption(context, results, captions, context, ranking)
    said = {r.query_id: r.generated_caption for r in out["submission"].collect()}
    assert said["x"] == "" and "a dog" in said["q"] and "alt" in said["q"]


def test_png_and_tiles(spark):
    import base64

    df = spark.createDataFrame([(ppm(list(range(12)), 4),), (b"junk",)], "c binary")
    got = [r.p for r in df.select(pixels.base64_png(F.col("c"), widest=2).alias("p")).collect()]
    data = base64.b64decode(got[0])
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and data[16:24] == b"\0\0\0\x02\0\0\0\x01" and got[1] is None
    image = pixels.decode_ppm(ppm(list(range(12)), 4))
    cut = pixels.tiles(image, 2, 1, 4, thumbnail=True)
    assert len(cut) == 3 and all(t.shape == (4, 4, 3) for t in cut)
