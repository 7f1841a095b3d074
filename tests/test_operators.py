import pytest
from pyspark.sql import functions as F

from lumisift.functions import pixels, vectors
from lumisift.operators import audit, conversation, diagnostics, evidence, inference, matching, partitioning, positions, prompts, rerank, resolve, similarity


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def hits_of(spark, items):
    return spark.createDataFrame(items, "query_id string, item_id string, score double, rank int")


def test_top_k_strategies_agree(spark, monkeypatch):
    import random

    random.seed(5)
    vecs = [(f"v{i:02d}", [random.gauss(0, 1) for _ in range(6)]) for i in range(40)]
    vecs[7] = ("v07", vecs[3][1])
    vecs[9] = ("v09", [0.0] * 6)
    q = spark.createDataFrame([*vecs[:9], ("null", None)], "query_id string, vector array<double>")
    d = spark.createDataFrame(vecs, "item_id string, vector array<double>")
    cols = ("query_id", "item_id", "score", "rank")
    for own in (False, True):
        expr = rows(similarity.top_k(q, d, 5, 2.0, own, "expr"), *cols)
        assert expr == rows(similarity.top_k(q, d, 5, 2.0, own), *cols) and len(expr) == 45
        monkeypatch.setattr(similarity, "BLOCK_ROWS", 7)
        assert expr == rows(similarity.top_k(q.repartition(3), d.repartition(5), 5, 2.0, own), *cols)
        monkeypatch.undo()
    assert similarity.top_k(q.limit(0), d).count() == 0
    assert similarity.top_k(q, d.limit(2), 5).groupBy("query_id").count().where("count <> 2").count() == 0


def test_stats_and_ordered_union(spark):
    h = hits_of(spark, [("a", "x", 2.0, 1), ("a", "y", 1.0, 2), ("b", "x", 5.0, 1), ("b", "y", 5.0, 2), ("c", "x", 1.0, 1)])
    s = {r.query_id: r for r in diagnostics.query_stats(h).collect()}
    assert s["a"].gap == 1 and s["b"].gap == 0 and s["c"].gap is None and s["b"].entropy == pytest.approx(0.693147) and s["c"].low_top1_sim == 1
    d = diagnostics.doubtful(diagnostics.query_stats(h), 1)
    assert rows(d, "query_id", "block") == [("b", 1), ("c", 3)]


def test_rerank(spark):
    h = hits_of(spark, [("q", "a", 0.5, 1), ("q", "b", 0.4, 2), ("r", "c", 0.9, 1), ("r", "d", 0.8, 2)])
    c = spark.createDataFrame([("q", 1, "a", 0.1), ("q", 2, "b", 0.9), ("q", 3, "zz", None)], "query_id string, rank int, item_id string, text_sim double")
    f = rerank.fused(c, h)
    assert rows(f, "item_id", "combined") == [("a", 0.6), ("b", 1.3), ("zz", 0.0)]
    assert rerank.reranked(f).first().candidates == ["a", "b", "zz"] and rerank.reranked(f, "score").first().candidates == ["b", "a", "zz"]
    with pytest.raises(ValueError):
        rerank.reranked(f, "other")
    short = spark.createDataFrame([("q", ["b"])], "query_id string, candidates array<string>")
    assert rows(rerank.overridden(h, short, 2), "query_id", "rank", "item_id") == [("q", 1, "b"), ("q", 2, ""), ("r", 1, "c"), ("r", 2, "d")]
    wide = rerank.wide(h, 3)
    assert wide.where("query_id = 'q'").first() == ("q", "a", "b", "") and rows(rerank.long(wide, 3), "query_id", "rank", "item_id")[2] == ("q", 3, "")


def test_resolve(spark):
    h = hits_of(spark, [("q", "i1", 0.5, 1), ("q", "i2", 0.4, 2), ("q", "i9", 0.3, 3), ("r", "i9", 0.9, 1)])
    m = spark.createDataFrame([("i1", "A"), ("i2", "A")], "image_id string, article_id string")
    a = spark.createDataFrame([("A", "http://a")], "article_id string, url string")
    assert rows(resolve.context(h, m, a), "query_id", "article_id", "article_url") == [("q", "A", "http://a")]
    assert rows(resolve.without_article(h, m), "query_id") == [("r",)]
    assert rows(resolve.article_slots(h, m), "query_id", "rank", "article_id") == [("q", 1, "A"), ("q", 2, "A"), ("q", 3, ""), ("r", 1, "")]
    assert rows(resolve.article_slots(h, m, dedupe=True), "query_id", "rank", "article_id") == [("q", 1, "A"), ("q", 3, ""), ("r", 1, "")]


def image(v):
    return f"P5\n2 1\n255\n".encode() + bytes(v)


def test_matching_variants(spark):
    origin = [("A", "o1", [1.0, 0.0], image([1, 2])), ("A", "o2", [-1.0, 0.0], image([250, 9])), ("A", "o3", None, image([1, 2])), ("A", "o4", [1.0, 0.0], None), ("B", "o5", [1.0, 0.0], image([1, 2]))]
    crawled = [("A", "c1", 0, [0.5, 0.5], image([77, 78])), ("A", "c2", 1, [1.0, 0.1], image([1, 2])), ("A", "c3", 2, [1.0, 0.1], image([1, 2]))]
    o = spark.createDataFrame(origin, "article_id string, origin_id string, o_embedding array<double>, o_pixels binary")
    c = spark.createDataFrame(crawled, "article_id string, crawled_id string, crawled_pos int, c_embedding array<double>, c_pixels binary")
    m = matching.matched(o, c, pixels.pixel_difference(F.col("o_pixels"), F.col("c_pixels")), 0.01)
    assert {r.origin_id: (r.filename, r.score) for r in m.collect()} == {"o1": ("c2", 1.0), "o2": (None, None), "o4": (None, None)}
    both = matching.pairs(o.where("o_embedding is not null"), c)
    cos = vectors.cosine("o_embedding", "c_embedding")
    assert [r.origin_id for r in matching.nearest(both, cos).orderBy("origin_id").collect()] == ["o1", "o4"]
    any_ = {r.origin_id: r.filename for r in matching.nearest(both, cos, "any_sign").collect()}
    assert any_ == {"o1": "c2", "o2": "c1", "o4": "c2"}
    maps = matching.match_maps(m).first().matching
    assert maps["o2"] is None and maps["o1"].filename == "c2"


def test_key_repair(spark):
    names = spark.createDataFrame([("A", n) for n in ("x.jpg", "y", "z", "w.gif", "none", None)], "article_id string, filename string")
    images = spark.createDataFrame([("A", n) for n in ("x.jpg", "x", "y.jpg", "y.png", "z.png", "w")] + [("B", "none")], "article_id string, image_id string")
    assert {r.filename: r.image_id for r in matching.repaired(names, images).collect()} == {"x.jpg": "x.jpg", "y": "y.jpg", "z": "z.png", "w.gif": "w", "none": None, None: None}


def test_positions(spark):
    contents = spark.createDataFrame([("A", "First line here.\n<A_0.jpg>\n<A_1.jpg>\nSecond line there, quite long.\nlast"), ("B", "x\n<B_0.jpg>")], "article_id string, content string")
    around = {(r.article_id, r.at): (r.prev_text, r.next_text) for r in positions.parts(contents).collect()}
    assert around["A", 1] == around["A", 2] == ("First line here.", "Second line there, quite long.") and around["B", 1] == ("x", "")
    images = spark.createDataFrame(
        [("A", "A_0.jpg", 1, "So. First line here. Go"), ("A", "A_1.jpg", 2, "Nope. Second lime there, quite long. Go"), ("B", "B_0.jpg", 1, "no"), ("A", "A_9.jpg", None, "First line here.")], "article_id string, image_id string, position int, origin_text string"
    )
    for mode in ("marker", "index"):
        placed = {r.image_id: r.origin_pos for r in positions.located(positions.neighbours(images, contents, mode)).collect()}
        assert placed == {"A_0.jpg": 4 + len("First line here."), "A_1.jpg": 6, "B_0.jpg": None, "A_9.jpg": None}
    exact = {r.image_id: r.origin_pos for r in positions.located(positions.neighbours(images, contents), fuzzy=False).collect()}
    assert exact["A_1.jpg"] is None and exact["A_0.jpg"] == 20


def test_rebuilt(spark):
    articles = spark.createDataFrame([("A", "u", "d", "t", "c", ["i"]), ("B", "u", "d", "t", "c", [])], "article_id string, url string, date string, title string, content string, images array<string>")
    crawled = spark.createDataFrame([("A", None, "w", "m", ["k"], 3, 0.02)], "key string, category string, author string, meta_description string, keywords array<string>, word_count int, reading_time_minutes double")
    found = spark.createDataFrame([("A", "i2", 1, None, None, None, None, None), ("A", "i1", 0, "f", 0.5, "http://x", 7, "f.jpg"), ("A", "i3", 2, "g", 0.4, None, None, None)], "article_id string, origin_id string, n int, filename string, score double, url string, origin_pos int, image_id string")
    out = {r.article_id: r for r in positions.rebuilt(articles, crawled, positions.placed(found)).collect()}
    assert [tuple(i) for i in out["A"].images] == [("i1", "http://x", 7, 0.5), ("i2", "", None, 0.0), ("i3", "", None, 0.4)]
    assert out["A"].category is None and out["A"].keywords == ["k"] and out["B"].category == "" and out["B"].images == [] and out["B"].word_count == 0


def test_evidence(spark):
    context = spark.createDataFrame([("q", "i", "A"), ("r", "i", "Z")], "query_id string, image_id string, article_id string")
    images = spark.createDataFrame([("i", "http://x", None, 0.5)], "image_id string, url string, position int, score double")
    captions = spark.createDataFrame([("http://x", "see http://y z", None)], "image_url string, alt string, caption string")
    articles = spark.createDataFrame([("A", "http://a", "text")], "article_id string, url string, content string")
    got = evidence.results(context, images, captions, articles).collect()
    assert [(r.query_id, r.crawl_alt, r.crawl_caption, r.article_position) for r in got] == [("q", "see  z", "", 0)]
    assert [r.query_id for r in evidence.unresolved(context, images, articles).collect()] == ["r"]
    text = lambda *x: spark.createDataFrame(list(x), "query_id string, text string")
    m = evidence.merged(context, text(("q", "Q")), text(), text(("r", "C")), text(), evidence.caption_index(evidence.results(context, images, captions, articles)))
    assert {r.query_id: (r.question_answer, r.generated_caption, r.article_summary.fact_summary, r.crawl_caption, r.article) for r in m.collect()} == {"q": ("Q", "", "", "see  z", "text"), "r": ("", "C", "", "", "")}
    s = evidence.submission(context, text(("q", "Here is the caption: hi")))
    assert evidence.caption_counts(s).first() == (1, 1) and rows(evidence.cleaned(s), "query_id", "generated_caption") == [("q", "hi"), ("r", "")]
    with pytest.raises(ValueError):
        evidence.cleaned(context)


def test_audit(spark):
    ids = spark.createDataFrame([("abc",), ("zz",), ("abcdef",), ("q",)], "id string")
    names = spark.createDataFrame([("xxabcdxx",), ("abcdefg",), ("q",)], "name string")
    assert rows(audit.contained(ids, names), "id") == [("abc",), ("abcdef",), ("q",)]
    a, b = spark.createDataFrame([("1",), ("2",), ("2",)], "query_id string"), spark.createDataFrame([("2",), ("3",), ("4",)], "query_id string")
    assert audit.overlap(a, b, "query_id").first() == (1, 1, 2, 33.3) and audit.overlap(a, b.limit(0), "query_id").first().percent is None
    assert rows(audit.both_differences(a, b, "query_id"), "query_id", "side") == [("1", "left_only"), ("3", "right_only"), ("4", "right_only")]
    m = spark.createDataFrame([("o1", "f", 1.0), ("o2", "g", 0.5), ("o3", None, None), ("o4", "h", 0.1)], "origin_id string, filename string, score double")
    flags = audit.match_flags(m, spark.createDataFrame([("f.jpg",)], "image_id string"), spark.createDataFrame([("f.jpg",), ("g.jpg",)], "file string"))
    assert rows(flags.withColumn("i", audit.issue()), "origin_id", "i") == [("o1", None), ("o2", "missing_in_json"), ("o4", "missing_both")]
    assert audit.tallies(flags).first() == (3, 1, 2, 2, 1)


def test_partitioning(spark):
    df = spark.createDataFrame([(i,) for i in range(11)], "k int").repartition(4)
    parts = [sorted(r.k for r in partitioning.part(df, "k", n, 3).collect()) for n in (1, 2, 3)]
    assert parts == [[0, 1, 2], [3, 4, 5], [6, 7, 8, 9, 10]]
    assert [sorted(r.k for r in partitioning.chunk(df, "k", 4, n).collect()) for n in (0, 2)] == [[0, 1, 2, 3], [8, 9, 10]]
    for bad in (lambda: partitioning.part(df, "k", 0, 3), lambda: partitioning.chunk(df, "k", 4, 3), lambda: partitioning.chunk(df, "k", 0, 0)):
        with pytest.raises(ValueError):
            bad()
    done = df.where("k < 5")
    assert partitioning.to_do(df, done, "k").count() == 6 and partitioning.to_do(df, done, "k", overwrite=True).count() == 11
    caps = spark.createDataFrame([("a", "12345"), ("b", "longer")], "query_id string, caption string")
    assert rows(partitioning.to_caption(caps.select("query_id"), caps, 5), "query_id") == [("b",)] and partitioning.to_caption(caps.select("query_id"), caps).count() == 0


def test_prompts(spark):
    df = spark.createDataFrame([("q", "fact", None)], "query_id string, f string, generated_caption string").select("query_id", "generated_caption", F.struct(F.col("f").alias("fact_summary")).alias("article_summary"))
    c = prompts.composed(df, [{"generated_caption": "g", "expected_output": "e"}])
    text = "{{ summary.fact }}-{{summary.raw}}-{{ generated_caption }}{% for x in examples %}[{{ loop.index }}{{ x.generated_caption }}{{ x.context }}{{ x.expected_output }}]{% endfor %}!"
    assert prompts.rendered(c, text).first().prompt == "fact--[1ge]!"
    assert prompts.rendered(prompts.composed(df), text).first().prompt == "fact--!"
    for bad in ("{% for x in examples %}", "{% endfor %}"):
        with pytest.raises(ValueError):
            prompts.compiled(bad)


def test_conversation(spark):
    t = conversation.get("one_shot")
    assert t.offset == 2 and len(t.messages) == 2 and len(conversation.names()) == 17
    t.append("Human", "Hi")
    t.append("Assistant", None)
    assert len(conversation.get("one_shot").messages) == 2
    m = spark.createDataFrame([([(r, x) for r, x in t.messages],)], "messages array<struct<role:string,text:string>>")
    prompt = m.select(conversation.prompt(t, F.col("messages")).alias("p")).first().p
    assert prompt.startswith(t.system + "\n### Human: ") and prompt.endswith("Human: Hi\n### Assistant:")
    api = m.select(conversation.api_messages(F.lit("S"), F.col("messages"), t.offset).alias("a")).first().a
    assert [(x.role, x.content) for x in api] == [("system", "S"), ("user", "Hi")]
    t.update_last("Yes")
    assert t.as_dict()["messages"][-1] == ["Assistant", "Yes"]
    with pytest.raises(ValueError):
        conversation.register(conversation.Template("otter"))
    with pytest.raises(ValueError):
        conversation.prompt(conversation.Template("odd", style="none"), F.col("messages"))


def test_inference_failures_cost_one_row(spark):
    class Odd(inference.StubClient):
        def generate(self, prompts, max_tokens, temperature):
            if any("bad" in p for p in prompts):
                raise ValueError
            return super().generate(prompts, max_tokens, temperature)

    df = spark.createDataFrame([("good",), ("bad",), (None,)], "p string").coalesce(1)
    got = [r.t for r in df.select(inference.generate(F.col("p"), make=Odd).alias("t")).collect()]
    assert got[0].endswith("good") and got[1:] == ["", ""]
    v = df.select(inference.encode_text(F.col("p")).alias("v")).collect()
    assert len(v[0].v) == inference.DIMENSIONS and v[2].v is None and sum(x * x for x in v[0].v) == pytest.approx(1)
    with pytest.raises(ValueError):
        inference.run_strategy(df, "unknown")


def test_near_is_exact_within_keys_of_any_size(spark, monkeypatch):
    """Large and small keys, repeated and zero vectors, ties after rounding: as all pairs ranked one by one, whatever the blocks."""
    import random

    random.seed(8)
    v = [(i % 7 if i % 3 else 0, i, [random.choice((-1.0, 0.0, 0.5, 1.0, 1.0000001)) for _ in range(3)]) for i in range(160)]
    v += [(9, 500, [1.0, 2.0, 3.0]), (None, 501, [1.0, 1.0, 1.0]), (0, 502, None), (0, 503, [1.0, None, 0.0])]
    e = spark.createDataFrame(v, "key int, id long, vector array<double>")
    q, d = e.withColumnRenamed("id", "query_id"), e.withColumnRenamed("id", "item_id")
    real = [r for r in v if r[0] is not None and r[2] and None not in r[2]]
    want = []
    for key, i, x in real:
        own = sorted((-round(2 * sum(a * b for a, b in zip(x, y, strict=True)), 6), j) for k, j, y in real if k == key and j != i)
        want += [(key, i, j, n) for n, (_, j) in enumerate(own[:4], 1)]
    for rows_, least in ((65_536, 2048), (65_536, 20), (9, 3)):
        monkeypatch.setattr(similarity, "BLOCK_ROWS", rows_)
        monkeypatch.setattr(similarity, "LEAST_ROWS", least)
        found = similarity.near(q, d, 4, 2.0, exclude_self=True, keyed=True)
        got = similarity.ranked(found.select("key", "query_id", "item_id", F.round(F.col("raw") * 2.0, 6).alias("score")), 4, "key", "query_id")
        assert rows(got, "key", "query_id", "item_id", "rank") == sorted(want, key=repr)


def test_best_products_hold_few_pairs_at_a_time(monkeypatch):
    """Single precision, many that are nearly equal, and blocks searched in halves keep what all products in doubles give."""
    import numpy as np

    from lumisift.functions import nearest

    rng = np.random.default_rng(3)
    d = rng.standard_normal((5000, 8))
    d[1000:3000] = d[0] + 1e-9 * rng.standard_normal((2000, 8))
    d[3000:3500] = d[1]
    d = d.astype(np.float32)
    q = np.concatenate([d[:600:3], d[1000:1010], np.zeros((1, 8), np.float32)])
    own = (np.arange(200), np.arange(0, 600, 3))
    all_ = q.astype(float) @ d.T.astype(float)
    all_[own] = -np.inf
    for held in (2_000_000, 3000):
        monkeypatch.setattr(nearest, "MOST_HELD", held)
        r, c, raw = nearest.best(q, d, 5, 2e-8, own)
        assert np.allclose(raw, all_[r, c]) and len(set(zip(r.tolist(), c.tolist(), strict=True))) == len(r)
        found = {}
        for i, j, x in sorted(zip(r.tolist(), c.tolist(), raw.tolist(), strict=True), key=lambda t: (t[0], -round(t[2], 6), t[1])):
            found.setdefault(i, []).append((round(x, 6), j))
        for i in range(len(q)):
            want = sorted(((-round(float(x), 6), j) for j, x in enumerate(all_[i]) if x > -np.inf))[:5]
            assert [(-s, j) for s, j in found[i][:5]] == want, i
    kept = nearest.firsts_of_equal(d, 4)
    assert len(kept) < 4600 and set(range(1000)) <= set(kept.tolist())


def test_expr_top_k_has_no_most_pairs(spark):
    """More pairs than the plan by expressions once was allowed."""
    n = 10_300
    e = spark.range(n).select("id", F.array(F.cos(F.col("id") * 0.37), F.sin(F.col("id") * 0.37)).alias("vector"))
    q, d = e.withColumnRenamed("id", "query_id"), e.withColumnRenamed("id", "item_id")
    found = similarity.top_k(q, d, 2, 100.0, True, "expr")
    assert found.count() == 2 * n
    few = q.where("query_id % 500 = 3")
    want = similarity.ranked(few.crossJoin(d.withColumnRenamed("vector", "w")).where("query_id <> item_id").select("query_id", "item_id", F.round(vectors.scaled_dot("vector", "w", 100.0), 6).alias("score")), 2)
    cols = ("query_id", "item_id", "score", "rank")
    assert rows(found.where("query_id % 500 = 3"), *cols) == rows(want, *cols)


def test_nearest_vectors_as_nearest_of_all_pairs(spark):
    import random

    random.seed(4)
    some = lambda: [random.choice((-1.0, 0.0, 0.0, 2.0)) for _ in range(3)]
    o = spark.createDataFrame([(i % 5, f"o{i}", some() if i % 9 else None) for i in range(60)], "article_id int, origin_id string, o_embedding array<double>")
    c = spark.createDataFrame([(i % 4, f"c{i:02d}", 100 - i, some() if i % 7 else None) for i in range(60)], "article_id int, crawled_id string, crawled_pos int, c_embedding array<double>")
    both = matching.pairs(matching.unit(o, "o_embedding"), matching.unit(c, "c_embedding"))
    cols = ("article_id", "origin_id", "filename", "score")
    for variant in ("strict_positive", "any_sign"):
        want = rows(matching.nearest(both, vectors.dot("o_embedding", "c_embedding"), variant), *cols)
        assert rows(matching.nearest_vectors(o, c, variant), *cols) == want and len(want) > 20
    with pytest.raises(ValueError):
        matching.nearest_vectors(o, c, "other")


def test_models_get_few_inputs_at_a_time(spark):
    """However many rows an Arrow batch has, a worker holds few texts and vectors as Python objects."""

    class Counting(inference.StubClient):
        def embed_texts(self, texts):
            return [[float(len(texts))] for _ in texts]

    df = spark.range(3000).coalesce(1).select("id", F.when(F.col("id") % 10 != 3, F.col("id").cast("string")).alias("p"))
    got = {r.id: r.v for r in df.select("id", inference.encode_text(F.col("p"), Counting).alias("v")).collect()}
    assert len(got) == 3000 and all((v is None) == (i % 10 == 3) for i, v in got.items())
    assert max(v[0] for v in got.values() if v) <= inference.SLICE_ROWS


def test_neighbours_are_searched_once(spark, monkeypatch, tmp_path):
    """Queries that read the hits more than once write them first: their plans hold no search, the search runs once."""
    from lumisift.plans import retrieval

    counted = spark.sparkContext.accumulator(0)
    real = retrieval.hits

    def hits(spark_, sf_dir, strategy="block"):
        def seen(batches):
            for b in batches:
                counted.add(b.num_rows)
                yield b

        found = real(spark_, sf_dir, strategy)
        return found.mapInArrow(seen, found.schema)

    monkeypatch.setattr(retrieval, "hits", hits)
    e = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"), F.lit(1).alias("label"))
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    for query in (retrieval.j3_v7_fused, retrieval.k7_reranked_input, retrieval.k7_reranked_score, retrieval.j2_j4_overridden, retrieval.s1_doubtful):
        counted.value = 0
        assert query(spark, str(tmp_path)).count() > 0 and counted.value == 60 * 15, query.__name__
