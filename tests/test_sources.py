import json

import pytest
from pyspark.sql import functions as F

from lumisift import schemas
from lumisift.sources import files, http, sinks
from lumisift.streaming import ingest


def test_json_files(spark, tmp_path):
    (tmp_path / "db.json").write_text(json.dumps({"A": {"url": "u", "title": "t", "images": ["i", "j"]}, "B": {"url": "v", "images": []}}, indent=2))
    rows = {r.key: r for r in files.json_object(spark, str(tmp_path / "db.json"), schemas.ARTICLE).collect()}
    assert rows["A"].images == ["i", "j"] and rows["B"].title is None
    folder = tmp_path / "crawled"
    folder.mkdir()
    (folder / "k1.a.json").write_text(json.dumps({"key": "k1", "content": "x", "images": [{"id": "k1_0.jpg", "position": 1}]}))
    (folder / "bad.json").write_text("{not json")
    found = files.json_folder(spark, str(folder), schemas.CRAWLED, "key").collect()
    assert [(r.file_key, r.images[0].position) for r in found] == [("k1", 1)]
    (tmp_path / "list.json").write_text(json.dumps([{"query_id": "q", "entropy": 1.5}]))
    assert files.json_list(spark, str(tmp_path / "list.json"), schemas.STATS).first().entropy == 1.5
    assert files.tolerant(lambda: files.json_list(spark, str(tmp_path / "none.json"), schemas.STATS), spark, "query_id string").count() == 0


def test_csv_round_trip(spark, tmp_path):
    rows = [("007", 'a "quoted", cell', "two\nlines"), ("8", "", "x")]
    df = spark.createDataFrame(rows, "query_id string, image_id_1 string, generated_caption string")
    sinks.csv(df, str(tmp_path / "out"))
    back = files.csv(spark, str(tmp_path / "out"), schemas.retrieval(1))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_object_sink_and_append(spark, tmp_path):
    df = spark.createDataFrame([("q2", "b"), ("q1", None)], "query_id string, caption string")
    assert json.loads(sinks.as_object(df, "query_id").first().json) == {"q1": None, "q2": "b"}
    sinks.json_object(df, "query_id", str(tmp_path / "o"))
    assert files.json_object(spark, str(tmp_path / "o"), "string").count() == 2
    out = str(tmp_path / "t")
    sinks.append_new(df.where("query_id = 'q1'"), df.limit(0), out)
    sinks.append_new(df, spark.read.parquet(out), out)
    assert spark.read.parquet(out).count() == 2


def test_images_and_templates(spark, tmp_path):
    for name, data in (("a.JPG", b"P5\n1 1\n255\n\x05"), ("b.png", b"broken"), ("c.txt", b"")):
        (tmp_path / name).write_bytes(data)
    images = files.image_files(spark, str(tmp_path))
    assert sorted(r.id for r in images.select("id").collect()) == ["a", "b"]
    assert [r.id for r in files.decoded(images).collect()] == ["a"]
    names = spark.createDataFrame([("a",), ("/x/b.jpg",), ("zz",), ("a.jpg",)], "name string")
    assert sorted(r.id for r in files.images_by_name(images, names).select("id").collect()) == ["a", "b"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "t.j2").write_text("Hello {{ x }}\n")
    assert files.templates(spark, str(tmp_path / "sub")) == {"t": "Hello {{ x }}\n"}


def test_embeddings(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0]), ("b", None)], "id string, embedding array<float>")
    sinks.embeddings(df, str(tmp_path / "e"))
    assert files.embeddings(spark, str(tmp_path / "e")).count() == 1
    sinks.embeddings(df.where("id = 'b'"), str(tmp_path / "n"))
    with pytest.raises(ValueError):
        files.embeddings(spark, str(tmp_path / "n"))


def test_fetching(spark):
    waits, calls = [], []

    def get(url):
        calls.append(url)
        return {"ok": (200, b"x"), "gone": (404, b"")}.get(url, (429, b""))

    assert http.fetched("ok", get, waits.append) == b"x" and http.fetched("gone", get, waits.append) is None and not waits
    assert http.fetched("busy", get, waits.append) is None and waits == [1, 3] and calls.count("busy") == 3
    urls = spark.createDataFrame([("k", "//h.cnn.com/a?b"), ("n", None)], "key string, url string")
    out = {r.key: (r.url, r.body) for r in http.pages(urls, lambda u: (200, u.encode()), binary=True).collect()}
    assert out["k"] == ("https://h.cnn.com/a", b"https://h.cnn.com/a") and out["n"] == (None, None)


def test_ingest_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    up = lambda df: df.withColumn("x", F.col("x") + 1)
    for lot in ([1, 2], [3]):
        spark.createDataFrame([(i,) for i in lot], "x long").coalesce(1).write.mode("append").parquet(src)
        ingest.ingest(spark, src, "x long", out, mark, up).awaitTermination()
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [2, 3, 4]
