import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumisift.functions import fuzzy, html, pixels, vectors
from lumisift.functions import text as S


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        (None, ""), ("", ""), ("Here is the caption: A dog\nruns", "A dog runs"), ("HERE IS A REWRITTEN CAPTION:x", "x"), ("here is an image caption:    x　y\x1cz ", "x y z"),
        ("Here is the caption: e is the caption: x", "x"), ("e is the caption: Here is the caption: x", "Here is the caption: x"), ("five!", "five!"), ("Here is the rewritten caption: Here is the rewritten caption: x", "Here is the rewritten caption: x"),
    ],
)
def test_clean_caption(spark, raw, clean):
    assert one(spark, raw, S.clean_caption) == clean


def python_space(text):
    return " ".join(text.split())


@settings(max_examples=30, deadline=None)
@given(texts=st.lists(st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85    　ab​", max_size=12), min_size=1, max_size=30))
def test_white_space_is_pythons(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [(r.a, r.b, r.n) for r in df.select(S.clean_caption("c").alias("a"), S.strip("c").alias("b"), S.word_count("c").alias("n")).collect()]
    assert got == [(python_space(t), t.strip(), len(t.split())) for t in texts]


def test_reading_minutes_round_like_python(spark):
    rows = spark.range(3000).select("id", S.reading_minutes(F.col("id").cast("int")).alias("m")).collect()
    assert [r.m for r in rows] == [round(r.id / 200, 2) for r in rows]


def test_names_and_urls(spark):
    assert one(spark, "a.jpg.jpg", lambda c: S.drop_all(c, ".jpg")) == "a"
    assert one(spark, "a.b.png", S.stem) == "a.b" and one(spark, ".jpg", S.stem) == ".jpg"
    assert one(spark, "k_1_2.jpg", lambda c: S.before_last(c, "_")) == "k_1" and one(spark, "k", lambda c: S.before_last(c, "_")) == "k"
    assert one(spark, "//media.cnn.com/x.png?a#b", S.original_image_url) == "https://media.cnn.com/x.png"
    assert one(spark, "http://h/x.png?a#b", S.original_image_url) == "http://h/x.png?a#b"
    for url, suffix in (("http://h.com/a/b.PNG?x=1.y", ".PNG"), ("http://h.com", ".jpg"), ("//h.com", ".jpg"), ("http://h/a.b/c", ".jpg")):
        assert one(spark, url, S.url_suffix) == suffix
    assert one(spark, "a <img> b <img>", lambda c: S.replace_first(c, "<img>", F.lit("X"))) == "a X b <img>"
    assert one(spark, "none", lambda c: S.replace_first(c, "<img>", F.lit("X"))) == "none"
    assert one(spark, " a , b,", S.keywords) == ["a", "b", ""]
    assert one(spark, "PQ answer ", lambda c: S.after_prompt(c, F.lit("PQ"))) == "answer"
    assert one(spark, "héllo", lambda c: S.find(c, F.lit("l"))) == 2 and one(spark, "x", lambda c: S.find(c, F.lit("l"))) == -1
    assert one(spark, "x" * 81, S.preview) == "x" * 80 + "..." and one(spark, "x" * 80, S.preview) == "x" * 80
    assert one(spark, " <a b> ", S.is_marker) and not one(spark, "<a> b", S.is_marker) and not one(spark, "<>", S.is_marker)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.cosine("a", "b").alias("c"), vectors.normalised("a").alias("n"), vectors.temperature_dot("a", "b").alias("t"), vectors.exp_scaled_dot("a", "b", 0.0).alias("e")).collect()
    assert rows[0].c == pytest.approx(0.6) and rows[0].n == pytest.approx([0.6, 0.8]) and rows[0].t == pytest.approx(3 / 0.7) and rows[0].e == 3
    assert rows[1].c is None and rows[1].n is None


PAGE = """<html><head><title> A &amp; B </title><meta itemprop="datePublished" content=""><meta name="pubdate" content="2024-01-02">
<meta property="article:published_time" content="2024-01-03"><meta name="author" content="Ann"><meta name="keywords" content="x, y ,z"></head><body>
<ul class="breadcrumbs"><li><a>Home</a></li><li><a>World</a></li></ul><script>var t="</p><p>no</p>";</script>
<article><p>One <b>bold</b> end<p>Two<div class="image__container big"><img src="//cdn.cnn.com/i.png?q=1" alt="al"></div><div class="image__metadata"> Cap <i>x</i></div>
<div class="image__container"><img alt="no source"></div><div class="image__container"><img src="http://h/j"></div><p> </p><p>Three</p></article></body></html>"""


def test_page_fields():
    f = html.page_fields("k", PAGE)
    assert (f["title"], f["publish_date"], f["section"], f["category"], f["author"], f["meta_description"]) == ("A & B", "2024-01-02", "2024-01-03", "World", "Ann", None)
    assert f["keywords"] == ["x", "y", "z"] and f["event_date"] == "2024-01-02"
    assert f["content"].split("\n") == ["Oneboldend", "Two", "Three", "<k_0.png>", "<k_1.jpg>"]
    assert f["images"] == [{"id": "k_0.png", "url": "https://cdn.cnn.com/i.png", "alt": "al", "caption": "Capx", "position": 3}, {"id": "k_1.jpg", "url": "http://h/j", "alt": "", "caption": None, "position": 4}]
    only = html.page_fields("k", PAGE, downloaded=lambda u: "h/j" in u)
    assert [i["id"] for i in only["images"]] == ["k_0.jpg"]
    div = html.page_fields("k", '<div class="article-body"><p>x y</p></div><p>out</p>')
    assert div["content"] == "x y" and div["word_count"] == 2 and div["title"] is None and div["keywords"] is None
    assert html.page_fields("k", "no tags")["content"] == ""


def test_parsed_column(spark):
    df = spark.createDataFrame([("k", PAGE), ("n", None), ("e", "")], "key string, html string")
    rows = {r.key: r.f for r in df.select("key", html.parsed(F.col("key"), F.col("html")).alias("f")).collect()}
    assert rows["k"].images[0].caption == "Capx" and rows["n"].content is None and rows["e"].content == ""
    assert one(spark, "<p>a<b> b </b></p>c <script>x</script>", html.without_tags) == "a b c"


def brute_near(part, text, most):
    """Whether some stretch of text is within `most` edits of part."""
    row = list(range(len(part) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(part, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best <= most


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=8), st.text("abc", max_size=20), st.integers(0, 3))
def test_near_match(part, text, most):
    hit = fuzzy.near_match(part, text, most)
    assert (hit is not None) == brute_near(part, text, most)
    if hit:
        assert distance(part, text[hit[0] : hit[1]]) <= most


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=3, max_size=40), st.text("abc", max_size=90), st.integers(1, 4), st.sampled_from([1, 3, 256]), st.sampled_from([0, 1, 99]))
def test_near_match_is_the_first_run_s_best(part, text, most, strip, diagonals):
    """All starts and ends one by one: the first run of near ends, its first best one, the latest start of that."""
    if len(part) <= most:
        return
    ends = [min(distance(part, text[s:e]) for s in range(max(0, e - len(part) - most), e + 1)) for e in range(len(text) + 1)]
    run = []
    for e, d in enumerate(ends):
        if d <= most:
            run.append((d, e))
        elif run:
            break
    want = None
    if run:
        d, e = min(run)
        want = max(s for s in range(e + 1) if distance(part, text[s:e]) == d), e
    before = fuzzy.STRIP, fuzzy.DIAGONALS
    fuzzy.STRIP, fuzzy.DIAGONALS = strip, diagonals
    try:
        assert fuzzy.near_match(part, text, most) == want
    finally:
        fuzzy.STRIP, fuzzy.DIAGONALS = before


def test_near_match_stops_at_the_match():
    """A long part with a few edits is found in time that grows with its length, and what follows it isn't searched."""
    import random
    import time

    random.seed(2)
    some = lambda n: "".join(random.choices("abcdefgh ", k=n))
    part = some(6400)
    text = part[:50] + part[51:3000] + "#" + part[3000:] + some(400_000)
    began = time.process_time()
    hit = fuzzy.near_match(part, text, len(part) // 10)
    assert hit == (0, len(part)) and time.process_time() - began < 0.3


def test_fuzzy_find(spark):
    df = spark.createDataFrame([("xx hello brave world yy", "hello brxve world"), ("abc", "zzzzzzzzzzzz"), (None, "a"), ("a", None)], "t string, p string")
    assert [r.r for r in df.select(fuzzy.fuzzy_find(F.col("t"), F.col("p")).alias("r")).collect()] == [3, -1, None, None]


def ppm(values, width=2, kind="P5"):
    depth = 1 if kind == "P5" else 3
    return f"{kind}\n# c\n{width} {len(values) // width // depth}\n255\n".encode() + bytes(values)


def test_pixels(spark):
    rows = [(ppm([0, 0, 0, 0]), ppm([0, 0, 0, 255])), (ppm([1, 2, 3, 4]), ppm([1, 2, 3, 4, 5, 6])), (b"junk", ppm([1, 2, 3, 4])), (ppm([9, 9]), ppm([9] * 6, kind="P6"))]
    df = spark.createDataFrame(rows, "a binary, b binary")
    got = [r.d for r in df.select(pixels.pixel_difference(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[0] == pytest.approx(0.25) and got[3] == 0
    assert all(x is None or x != x for x in got[1:3])


def by_hand(width, height, tile=448):
    best, grid = float("inf"), (1, 1)
    for i, j in pixels.grids():
        off = abs(width / height - i / j)
        if off < best:
            best, grid = off, (i, j)
        elif off == best and width * height > 0.5 * tile * tile * i * j:
            grid = (i, j)
    return grid


def test_closest_grid(spark):
    sizes = [(100, 100), (2000, 2000), (1000, 500), (3000, 1500), (500, 1000), (1280, 720), (7, 900)]
    df = spark.createDataFrame(sizes, "w int, h int").withColumn("g", pixels.closest_grid(F.col("w"), F.col("h")))
    rows = df.select("w", "h", "g", pixels.tile_boxes(F.col("g")).alias("t")).collect()
    assert [(r.g.columns, r.g.rows) for r in rows] == [by_hand(w, h) for w, h in sizes]
    assert all(len(r.t) == r.g.columns * r.g.rows and r.t[-1].right == r.g.columns * 448 and r.t[-1].bottom == r.g.rows * 448 for r in rows)
