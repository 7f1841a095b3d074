import hashlib
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumisift.llm import chat, licenses, topk

VECTORS = "vec_id long, embedding array<float>, score string"


def vectors(spark, n=400, dim=8):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=dim) / 3).astype(float).tolist(), "x") for i in range(n)]
    rows[20] = (20, rows[10][1], "x")
    rows[30] = (30, [0.0] * dim, "x")
    rows[39] = (39, [1e6, -1e6, *rows[39][1][2:]], "x")
    rows += [rows[3], rows[10], rows[34], (50, rows[31][1], "x")]  # repeated rows, and a query's id with another vector
    odd = [(1000, None, "x"), (1001, [0.1] * 7 + [None], "x"), (1002, [float("nan")] * dim, "x"), (1003, [0.5, 0.5], "x"), (1004, [], "x")]
    return rows, spark.createDataFrame([*rows, *odd], VECTORS)


def brute(rows, asks, k=5):
    whole = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(np.float64)).astype(int)) for i, v, _ in rows]
    out = []
    for q in sorted({i for i, _ in whole if asks(i)}):
        vectors = {tuple(v) for i, v in whole if i == q}
        best = sorted((-int(np.array(v) @ c), i) for v in vectors for i, c in whole if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize(("block", "group"), [(8192, 1024), (64, 3)])
def test_exact_top_k(spark, monkeypatch, block, group):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "GROUP_ROWS", group)
    monkeypatch.setattr(topk, "SAMPLE_ROWS", 100)
    rows, df = vectors(spark)
    out = topk.top_k(df, F.col("vec_id") % 10 == 0, 5)
    assert sorted(tuple(r) for r in out.collect()) == sorted(brute(rows, lambda q: q % 10 == 0))


def test_large_components_and_scores(spark):
    df = spark.createDataFrame([(0, [1e6, 1.0]), (50, [1.0, 1.0]), (3, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 50).orderBy("rank").collect()] == [(0, 256 * 256000256), (3, 262144)]
    big = [(0, [2.0**30, 1.0]), (50, [2.0**14, 1.0]), (1, [2.0**30, 1.5])]  # sums that no double holds
    got = topk.top_k(spark.createDataFrame(big, df.schema), F.col("vec_id") == 50).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**60 + 256 * 384), (0, 2**60 + 256 * 256)]


def test_score_beyond_a_long_is_an_error():
    lists = topk.Lists(np.array([1, 2]), np.array([[2.0**50, 1.0], [1.0, 1.0]]))
    with pytest.raises(OverflowError):
        lists.best(np.array([2.0**50, 1.0]), 5, -1)
    near = topk.Lists(np.arange(50), np.array([[2.0**40 + i, 3.0] for i in range(50)]))
    ids, scores, _ = near.best(np.array([2.0**20, 1.0]), 3, 49)  # beyond 2^53, within a long
    assert ids.tolist() == [48, 47, 46] and scores[0] == 2**20 * (2**40 + 48) + 3


def test_threshold_stops_early_and_ties():
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, (3000, 2))
    x[:, 1] //= 25
    lists = topk.Lists(np.arange(3000), x)
    ids, scores, seen = lists.best(np.array([100, 1]), 5, -1)
    order = np.lexsort((np.arange(3000), -(x @ [100, 1])))[:5]
    assert ids.tolist() == order.tolist() and seen < 300 and scores.tolist() == (x @ [100, 1])[order].tolist()
    same = topk.Lists(np.array([9, 4, 7, 1]), np.ones((4, 3), dtype=np.int64))
    assert same.best(np.array([1, 1, 1]), 2, 1)[0].tolist() == [4, 7]
    assert same.best(np.array([0, 0, 0]), 2, 1)[0].tolist() == [4, 7]
    assert same.best(np.array([1, 1, 1]), 2, 1, least=3)[0].tolist() == [4, 7] and not len(same.best(np.array([1, 1, 1]), 2, 1, least=4)[0])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_few_vectors_are_scored():
    """On 64 dense dimensions the bounds still leave most vectors unscored."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = np.array(t["vec_id"]), np.stack([topk.whole_numbers(v) for v in t["embedding"].to_pylist()])
    lists = topk.Lists(ids, x)
    scored = [lists.best(x[i], 5, ids[i])[2] for i in np.flatnonzero(ids % 50 == 0)]
    assert max(scored) < len(ids) / 2 and np.mean(scored) < len(ids) / 10


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(1, 4), st.integers(1, 6), st.integers(0, 10**6))
def test_best_is_brute_force(n, dim, k, seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-3, 4, (n, dim)), rng.integers(-2, 3, dim)
    ids = rng.permutation(2 * n)[:n]
    own = int(ids[0])
    want = sorted((-int(v @ q), int(i)) for i, v in zip(ids, x, strict=True) if i != own)[:k]
    got = topk.Lists(ids, x).best(q, k, own)
    assert list(zip((-got[1]).tolist(), got[0].tolist(), strict=True)) == want
    if want:
        least = -want[len(want) // 2][0]
        got = topk.Lists(ids, x).best(q, k, own, least)
        assert list(zip((-got[1]).tolist(), got[0].tolist(), strict=True)) == [w for w in want if -w[0] >= least]


def test_top_k_of_nothing(spark):
    _, df = vectors(spark, 40)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


CONTROL = ["<|turn|>", "<|says|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "|", "[", "\n", "a", "é", "😀"]


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(CONTROL), max_size=8).map("".join), min_size=1, max_size=6))
def test_escapes_are_reversible(spark, texts):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.formatted(df)).first()
    assert [(t.role, t.text) for t in back.turns] == [(r, t) for _, _, r, t in rows]
    assert back.loss_text == "".join(t for _, i, _, t in rows if i % 2)
    for mark in (chat.TURN, chat.SAYS, chat.END):
        assert back.formatted.count(mark) == len(rows)


def test_events_fold(spark):
    log = [
        (1, 1, 1, "delta", "user", "Hi"), (1, 2, 2, "delta", "assistant", "Hel"), (1, 3, 2, "delta", "assistant", "lo"), (1, 4, 3, "delta", "user", "old"),
        (1, 5, 2, "regenerate", "assistant", None), (1, 6, 2, "delta", "assistant", "Good "), (1, 7, 2, "delta", "assistant", "day"), (1, 8, 3, "delta", "user", "new"),
        (2, 1, 1, "delta", "user", "a"), (2, 2, 2, "delta", "assistant", "b"), (2, 3, 1, "edit", "user", "A"), (2, 4, 2, "delta", "assistant", "B"), (None, 1, 1, "delta", None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string")
    out = {(r.conv_id, r.msg): (r.role, r.text) for r in chat.folded(df).collect()}
    assert out == {(1, 1): ("user", "Hi"), (1, 2): ("assistant", "Good day"), (1, 3): ("user", "new"), (2, 1): ("user", "A"), (2, 2): ("assistant", "B"), (None, 1): ("", "")}


def test_digests_and_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, None, None, "q")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 2 and out[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nx\nassistant\nx\n").hexdigest()
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.formatted(df))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_licences(spark):
    mit = "\n".join(licenses.SENTENCES[k] for k in ("mit-title", "mit-grant", "mit-notice", "mit-warranty"))
    wrapped = licenses.SENTENCES["apache-notice"].replace(" ", "\n", 5)
    rows = [
        (1, mit, "MIT"), (2, f"intro text\n{wrapped} More.", "Apache-2.0"), (3, "word word\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT"),
        (4, "Nothing is Released under the stars.", ""), (5, None, ""), (6, "", ""), (7, "Text. THIS WORK is licensed under the gnu general public license; version 3. End", "GPL-3.0-only"),
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in licenses.licences(df).collect()}
    assert {i: out[i].licences for i, _, _ in rows} == {i: w for i, _, w in rows}
    assert out[1].spans == f"MIT:0:{len(mit) - 1}" and licenses.licences(df.limit(0)).count() == 0


def test_rules_follow_order():
    r = licenses.Rules({"a": "One thing.", "b": "Two things.", "c": "Three things."}, [("ABC", ("a", "b", "c")), ("AB", ("a", "b")), ("C", ("c",))], gap=1)
    name = lambda t: [x[0] for x in r.licences(r.sentences(t))]
    assert name("One thing. Two things. Three things.") == ["ABC"]
    assert name("One thing. Else. Two things. Three.") == ["AB"]
    assert name("One thing. Else. More. Two things. Three things.") == ["C"]
    assert name("Two things. One thing.") == []


def test_every_sentence_and_rule_is_found():
    r = licenses.Rules()
    for before in ("", "Some words:\n", " " * 100, "/" + "*" * 90 + " ", "__", "# "):
        for name, sentence in licenses.SENTENCES.items():
            for text in (sentence, sentence.replace(" ", "\n# ", 7), sentence.replace(", ", ",\n * ")):
                assert [f[2] for f in r.sentences(before + text)] == [r.known[tuple(licenses.normalised(sentence).split())]], (before, name)
        for licence, sequence in licenses.RULES:
            text = before + "\n".join(licenses.SENTENCES[k] for k in sequence)
            assert [x[0] for x in r.licences(r.sentences(text))] == [licence], sequence
    made, rules = licenses.about()
    for licence, (name,) in rules:
        assert [x[0] for x in r.licences(r.sentences(f"This file is released {made[name]}, as told."))] == [licence], name
    assert len(licenses.NAMES) >= 50


def test_near_sentences():
    r = licenses.Rules()
    name = lambda t: [x[0] for x in r.licences(r.sentences(t))]
    parts = [licenses.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty")]
    assert name("#" * 60 + " Released under the MIT License.") == ["MIT"]
    assert name(" ".join(parts).replace("substantial", "large").replace("free of charge", "free of any charge").replace("EXPRESS OR IMPLIED", "EXPRESSED OR IMPLIED")) == ["MIT"]
    words = parts[0].split()
    assert name(" ".join("other" if i % 4 == 0 else w for i, w in enumerate(words))) == []
    gpl = licenses.SENTENCES["gpl3-free"]
    assert name(gpl.replace("version 3", "version 4")) == [] and name(gpl.replace("program", "tool")) == ["GPL-3.0-or-later"]
    assert name("İ İ " + parts[0] + parts[1] + parts[2]) == ["MIT"]


def slow_matches(r, words):
    """Every known sentence slid over every word, whole and near."""
    found = set()
    for sentence, name in r.known.items():
        most = len(sentence) // licenses.NEAR_SHARE if len(sentence) >= licenses.NEAR_WORDS else 0
        for i in range(len(words)):
            if tuple(words[i : i + len(sentence)]) == sentence:
                found.add((i, i + len(sentence), name))
        if most:
            cost, begin, end = licenses.edits(list(sentence), words)
            if cost <= most:
                found.add((begin, end, name))
    return found


def test_matches_are_those_of_a_slow_search():
    r, rng = licenses.Rules(), np.random.default_rng(2)
    known = [list(w) for w in r.known]
    for _ in range(25):
        own = [f"x{n}" for n in rng.integers(0, 50, 30)]
        sentence = list(known[int(rng.integers(0, len(known)))])
        for _ in range(int(rng.integers(0, max(1, len(sentence) // 8)))):
            sentence[int(rng.integers(0, len(sentence)))] = "edit"
        at = int(rng.integers(0, 30))
        words = own[:at] + sentence + own[at:]
        kept, slow = r.matches(words), slow_matches(r, words)
        assert {n for _, _, n in kept} <= {n for _, _, n in slow} and bool(kept) == bool(slow)
        if slow:  # the longest stretch is among those kept
            assert max(e - b for b, e, _ in kept) == max(e - b for b, e, _ in slow)


def test_repeated_and_very_long_texts(spark):
    text = "word " * 300_000 + "\nReleased under the MIT License.\n" + "word " * 300_000
    df = spark.createDataFrame([(1, text), (1, text), (None, "SPDX-License-Identifier: GPL-2.0-or-later")], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.licences) for r in licenses.licences(df).collect())
    assert out == [(0, "GPL-2.0-or-later"), (1, "MIT"), (1, "MIT")]
