import os

import numpy as np
import pytest

from lumisift.llm import langid, toxicity


def docs_of(spark, n=600):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for d in range(n):
        toxic = d % 6 == 0
        words = [f"calm{''.join(rng.choice(list('abcdefgh'), 3))}" for _ in range(int(rng.integers(5, 300)))]
        if toxic:
            words[int(rng.integers(0, len(words)))] = ["idiot", "trash", "scumling", "scumlord", "scumish"][d // 6 % 5]
        rows.append((d, " ".join(words), "s"))
        if d % 2 == 0:
            labels.append((d, int(toxic), 1))
    return spark.createDataFrame([*rows, (9001, None, "s"), (9002, "", "s")], "doc_id long, text string, toxic string"), spark.createDataFrame([*labels, (9001, 0, 1), (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")


def test_toxic_held_out(spark):
    docs, labels = docs_of(spark)
    chain = toxicity.chain_of(docs, labels)
    assert chain.categories == toxicity.CATEGORIES and [len(u) for u in chain.earlier] == [0, 1, 2, 3] and chain.weights[3]
    out = {r.doc_id: r for r in toxicity.scored(docs, chain).collect()}
    assert len(out) == 602
    unseen = [d for d in range(600) if d % 2]
    assert all(not out[d].toxic for d in unseen) and sum(out[d].toxic for d in range(0, 600, 6)) >= 97
    assert not out[9001].toxic and not out[9002].toxic
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in out.items() if not r.toxic}


def test_toxicity_without_labels(spark):
    docs, labels = docs_of(spark, 12)
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.without_toxic(docs, few).count() == docs.count()
    assert toxicity.without_toxic(docs.limit(0), labels).count() == 0


def rows_of(x):
    at = np.argwhere(x)
    return toxicity.Rows(at[:, 0], at[:, 1], *x.shape)


def test_fit_is_plain_descent():
    """Against many slow projected gradient steps."""
    rng = np.random.default_rng(0)
    x, extra = (rng.random((120, 4)) < 0.3).astype(int), rng.random((120, 1))
    y = ((x[:, 0] > 0) | (rng.random(120) < 0.1)).astype(float)
    w, u, b = toxicity.fit(rows_of(x), extra, y, rounds=600)
    z = np.hstack([x, extra])
    v, c = [0.0] * 5, 0.0
    for _ in range(6000):
        off = 1 / (1 + np.exp(-(z @ np.array(v) + c))) - y
        v = [max(0.0, v[j] - 2.0 * (float(z[:, j] @ off) / 120 + (2e-4 if j < 4 else 0))) for j in range(5)]
        c -= 2.0 * off.mean()
    assert np.allclose([*w, *u], v, atol=0.2) and abs(b - c) < 0.1
    assert (w >= 0).all() and w[0] > 2 and (u >= 0).all()


def test_chain_is_plain_loops(spark):
    docs, labels = docs_of(spark, 240)
    chain = toxicity.chain_of(docs, labels)
    for text in ["calm idiot words", "trash trash scumling", "", None, "12 3", *[r.text for r in docs.limit(20).collect()]]:
        words = set()
        for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            words |= {w} | {w[:n] + "-" for n in (4, 5) if len(w) >= n}
        p = []
        for k in range(len(chain.categories)):
            z = chain.bases[k] + sum(v for name, v in chain.weights[k].items() if name in words) + sum(chain.earlier[k][j] * p[j] for j in range(k))
            p.append(1 / (1 + np.exp(-z)))
        assert np.allclose(chain.judged(text)[0], p) and chain.judged(text)[1] == (bool(words) and p[-1] >= chain.threshold)


def test_out_of_fold_sees_nothing_of_its_fold():
    texts = [["calm"]] * 40 + [["calm", f"bad{k % 4}"] for k in range(40)]
    toxic, folds = np.array([0.0] * 40 + [1.0] * 40), np.arange(80) % 4
    part = toxicity.Learnt(toxicity.Texts(texts), toxic, np.full(80, np.nan), folds != 1)
    shown = {toxicity.Texts(texts).names[i] for i in part.features["toxic"]}
    assert "bad1" not in shown and {"bad0", "bad2", "bad3"} <= shown and not len(part.features["low_quality"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_cross_validated():
    import pyarrow.parquet as pq

    frame = lambda t: pq.read_table(f"/root/testdata/sf0.01/{t}.parquet").to_pylist()
    texts = {r["doc_id"]: r["text"] for r in frame("documents")}
    rows = [r for r in frame("labels") if texts.get(r["doc_id"])]
    words, ids = [sorted(toxicity.words_of(texts[r["doc_id"]])) for r in rows], np.array([r["doc_id"] for r in rows])
    toxic, low = np.array([float(r["toxic"]) for r in rows]), np.array([1.0 - r["quality"] for r in rows])
    place, hits, caught = ids * 2654435761 % 1000003, 0, 0
    for k in range(5):
        own = place // 7 % 5 != k
        chain = toxicity.train([w for w, m in zip(words, own, strict=True) if m], toxic[own], low[own], place[own] % toxicity.FOLDS)
        bad = np.array([chain.judged(texts[i])[1] for i in ids[~own]])
        hits, caught = hits + (bad & (toxic[~own] == 1)).sum(), caught + bad.sum()
    assert hits / caught > 0.7 and hits / toxic.sum() > 0.6


def test_toxic_ties_repeats_and_long_texts(spark):
    docs, labels = docs_of(spark, 120)
    long = "calm " * 300_000 + "idiot"
    more = spark.createDataFrame([(0, "another text of the same id", "s"), (7001, long, "s"), (7001, long, "s")], docs.schema)
    model = toxicity.chain_of(docs.union(more), labels.union(labels))
    again = toxicity.chain_of(docs.union(more).repartition(5), labels.repartition(3))
    assert model.weights == again.weights and model.threshold == again.threshold
    out = [r for r in toxicity.scored(docs.union(more), model).collect() if r.doc_id == 7001]
    assert len(out) == 2 and out[0] == out[1] and out[0].toxic


LANGS = {"aa": "nhe zha mir tola kesh", "bb": "ordun fyx wele quor tass", "cc": "iluv emo sanari belu tomi"}


def spoken(spark, n=300):
    rng = np.random.default_rng(1)
    rows = []
    for d in range(n):
        lang = list(LANGS)[d % 3]
        rows.append((d, " ".join(rng.choice(LANGS[lang].split(), int(rng.integers(1, 60)))) + ".", lang))
    return spark.createDataFrame([*rows, (9001, None, "aa"), (9002, "12 3!", "aa"), (9003, "", None)], "doc_id long, text string, lang string")


def test_language_held_out(spark):
    from pyspark.sql import functions as F

    docs = spoken(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = {r.doc_id: r for r in langid.predicted(docs, langid.model_of(docs, ~held), held).collect()}
    right = [out[d].lang_pred == list(LANGS)[d % 3] for d in range(300) if out[d].held_out]
    assert len(right) > 40 and np.mean(right) > 0.97
    assert {out[d].lang_pred for d in (9001, 9002, 9003)} == {langid.UNKNOWN} and out[9001].score == 0
    assert all(0 <= r.score <= 1 for r in out.values()) and np.mean([r.accepted for r in out.values()]) > 0.9


def test_language_of_nothing(spark):
    from pyspark.sql import functions as F

    docs = spoken(spark, 6)
    model = langid.model_of(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predicted(docs, model, F.lit(False)).collect()} == {langid.UNKNOWN}


@pytest.mark.parametrize("text", ["a", "Ünder 5", "x" * 200_000, "\ud800 odd"])
def test_counts_sum_to_one(text):
    assert langid.counts(text).sum() == pytest.approx(1, abs=1e-3)


def test_many_languages_and_clashing_names(spark):
    """No language is left out, however many there are."""
    from pyspark.sql import functions as F

    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.default_rng(3)
    rows = []
    for n in range(60):
        own = [letters[n % 26] + letters[(n * 7 + k) % 26] + letters[(n // 26 * 5 + k) % 26] for k in range(6)]
        rows += [(n * 20 + d, " ".join(rng.choice(own, 40)), f"l{n:02}", 1.0, False) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, held_out boolean")
    model = langid.model_of(docs, F.col("doc_id") % 4 != 2)
    assert len(model.languages) == 60
    out = langid.predicted(docs, model, F.col("doc_id") % 4 == 2)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"] and out.count() == 1200
    again = langid.predicted(docs.union(docs), model, F.lit(True)).collect()
    assert len(again) == 2400 and len({(r.doc_id, r.lang_pred) for r in again}) == 1200


def test_prediction_is_plain_loops():
    """Averages of embeddings and the softmax, gram by gram."""
    x = [("aab bba", "x"), ("ccd ddc", "y")] * 30
    model = langid.train(langid.sparse([(np.flatnonzero(v).astype(np.int32), v[np.flatnonzero(v)]) for v in (langid.counts(t) for t, _ in x)]), [n for _, n in x])
    text = "aab Ccd 1"
    code = [ord(c) if c.isalpha() else 32 for c in " aab ccd   "]
    code = [c for i, c in enumerate(code) if i == 0 or c != 32 or code[i - 1] != 32]
    z, grams = np.zeros(2), 0
    for n in (1, 2, 3, 4):
        for at in range(len(code) - n + 1):
            h = 0
            for c in code[at : at + n]:
                h = (h * 0x01000193 + c) % 2**32
            h = (h ^ (n * 0x9E3779B1 % 2**32)) * 0x85EBCA6B % 2**32
            z, grams = z + model.logits[h >> 19], grams + 1
    z = z / grams + model.bias
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    lang, score, _ = model.predict(text)
    assert lang == model.languages[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-3)
