from itertools import combinations

import numpy as np
import pytest

from lumisift.llm import jaccard
from lumisift.llm.words import grams, word_hashes

DOCS = "doc_id long, text string, class_id string, copies int"


def brute(rows, threshold=0.8):
    """Classes and links by comparing every pair of whole shingle sets."""
    sets = {i: set(grams(word_hashes(t)[0], 5).tolist()) for i, t in rows}
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= threshold * len(x | y):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(i), links[i]) for i in sets}


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    rows, n = [], 0
    for _ in range(30):
        base = word(int(rng.integers(6, 200))).split()
        for copy in range(int(rng.integers(1, 6))):
            own = list(base)
            for _ in range(copy):
                own[int(rng.integers(0, len(own)))] = f"x{rng.integers(0, 99)}"
            rows.append((n, " ".join(own)))
            n += 1
    shared = word(60)
    for _ in range(10):
        rows.append((n, shared + " " + word(70)))
        n += 1
    return rows


def got(out):
    return {r.doc_id: (r.class_id, r.n_links) for r in out.collect()}


def test_same_as_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    assert got(jaccard.similar_groups(df)) == brute(rows)


def test_chunks_of_groups_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_CHUNK", 3)
    monkeypatch.setattr(jaccard, "COMPONENT_CHUNK", 2)
    rows = corpus(5)[:60]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    assert got(jaccard.similar_groups(df)) == brute(rows)


def test_nulls_short_texts_and_copies(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, TWO!"), (6, "one two three"), (7, None)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)
    assert got(jaccard.similar_groups(df)) == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 1), 5: (4, 1), 6: (6, 0), 7: (7, 0)}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1)] * 3 + [(9, "a b c d e f", "y", 2)], DOCS)
    out = jaccard.similar_groups(df).collect()
    assert len(out) == 4 and {(r.class_id, r.n_links) for r in out} == {(1, 3)}
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]
    assert jaccard.similar_groups(df.limit(0)).count() == 0


def test_rows_that_are_kept(spark):
    rows = [(None, "p q r s t u"), (None, "p q r s t u"), (None, "other words"), (1, "a b c d e f"), (1, "different text of the same id"), (2, "a b c d e f"), (3, None), (4, None)]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()), key=repr)
    assert kept == sorted({r for r in rows if r[0] != 2}, key=repr)


def test_one_doc_id_with_two_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "", 0), (1, "q r s t u v", "", 0), (2, "q r s t u v", "", 0)], DOCS)
    out = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar_groups(df).collect())
    assert out == [(1, 1, 0), (1, 1, 1), (2, 1, 1)]


@pytest.mark.parametrize("n", jaccard.STEPS)
def test_pruning_bound(n):
    from math import comb

    m = jaccard.least_matches(n, 0.8, 1e-6)
    tail = lambda k: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))
    assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


def test_components(spark):
    from lumisift.llm.graph import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    out = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_is_the_same_over_partitionings(spark):
    """Rows without doc_id take part, rows that repeat are one, and neither order nor partitions matter."""
    rows = corpus(7)[:50]
    rows = [(None if i % 17 == 5 else i // 2 * 2 if i % 13 == 3 else i, t) for i, t in rows] + rows[:2] + [(None, rows[8][1] + " tail"), (None, rows[8][1] + " tail"), (70, None), (70, None)]
    place = [(n, t) for n, (_, t) in enumerate(rows)]
    classes = brute(place)
    named = lambda n: (rows[n][0] is None, rows[n][0] or 0)
    firsts = {c: min((named(n) for n in classes if classes[n][0] == c)) for c in {c for c, _ in classes.values()}}
    want = sorted({(i, t) for n, (i, t) in enumerate(rows) if t and named(n) == firsts[classes[n][0]]} | set(), key=repr)
    for parts in (1, 7):
        df = spark.createDataFrame([(i, t, f"at {n}", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, at string, also int").repartition(parts)
        kept = [tuple(r) for r in jaccard.one_of_each(df).collect()]
        assert sorted(((i, t) for i, t, _, _ in kept if t), key=repr) == want
        assert sum(t is None for _, t, _, _ in kept) == 2 and all(a == f"at {n}" for _, _, a, n in kept)


def test_hot_keys_and_filters(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lumisift.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = spark.createDataFrame([(k, n) for n, k in enumerate([1] * 50 + [2] * 50 + [None] * 20 + list(range(3, 60)))], "k long, n long")
    facts = spark.createDataFrame([(k, f"v{k}", 50 if k < 3 else 1) for k in range(1, 40)], "k long, v string, w long")
    hot = common.hot_of(facts, "w", 177)
    assert hot.count() == 2
    inner, left = (common.hot_join(rows, facts, hot, "k", how).collect() for how in ("inner", "left"))
    assert len(inner) == 137 and all(r.v == f"v{r.k}" for r in inner) and len(left) == 177
    assert all((r.v == f"v{r.k}") if r.k and r.k < 40 else r.v is None for r in left)
    bits = common.bit_filter(facts.select(F.xxhash64("k").alias("h")), "h")
    out = common.with_hit(rows, F.xxhash64("k"), bits, "hit").collect()
    assert all(r.hit for r in out if r.k and r.k < 40) and not all(r.hit for r in out)
