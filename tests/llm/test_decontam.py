import numpy as np

from lumisift.llm import decontam
from lumisift.llm.decontam import GAP, MATCH, MISMATCH, align


def table_align(item, text):
    """Smith-Waterman cell by cell."""
    h = np.zeros((len(item) + 1, len(text) + 1), dtype=int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            s = MATCH if item[i - 1] == text[j - 1] else MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] - GAP, h[i, j - 1] - GAP)
    return int(h.max())


def test_align_is_smith_waterman():
    rng = np.random.default_rng(1)
    for _ in range(60):
        item, text = rng.integers(1, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 25))
        assert align(item, text)[0] == table_align(item, text)


def corpus(spark):
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 900, n)]
    items = [(i, word(40)) for i in range(8)] + [(100, ["a", "b"]), (101, None), (102, [])]
    docs, want = [], set()
    for d in range(120):
        text = word(int(rng.integers(20, 400)))
        if d % 4 == 0:
            i = d // 4 % 8
            copy = list(items[i][1])
            for k in range(d % 3 * 3):
                copy[int(rng.integers(0, 40))] = f"edit{k}"
            if d % 8 == 0:
                copy.insert(20, "more")
            at = int(rng.integers(0, len(text)))
            text = text[:at] + copy + text[at:]
            want.add((d, i))
        docs.append((d, " ".join(text), d))
    docs += [(900, None, 0), (901, "", 0), (902, "w1", 0)] + docs[:1]
    b = spark.createDataFrame([(i, None if w is None else " ".join(w), "z") for i, w in items], "item_id long, text string, score string")
    return spark.createDataFrame(docs, "doc_id long, text string, score long"), b, want


def test_finds_copies_and_edits_only(spark, monkeypatch):
    docs, items, want = corpus(spark)
    out = decontam.leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want and out.count() == len(want)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == want
    kept = decontam.without_leaks(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_item_in_every_document(spark):
    item = " ".join(f"k{i}" for i in range(30))
    docs = spark.createDataFrame([(d, f"a{d} b{d} {item} c{d}") for d in range(50)], "doc_id long, text string")
    out = decontam.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert len(out) == 50 and all(r.score == 1.0 and (r.first_word, r.end_word) == (2, 32) for r in out)


def test_empty(spark):
    docs, items, _ = corpus(spark)
    assert decontam.leaks(docs.limit(0), items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0


def test_many_edited_copies_beside_few_full_ones(spark):
    item = [f"k{i}" for i in range(24)]
    edited = [f"e{i}" if i % 6 == 5 else w for i, w in enumerate(item)]
    docs = [(0, " ".join(["a", *item, "b"]))] + [(d, " ".join([f"a{d}", *edited, f"b{d}"])) for d in range(1, 41)]
    out = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in out} == set(range(41))


def test_filter_loses_no_alignment(monkeypatch):
    """Against alignment of every pair: edits of all kinds, shared words between items, seeds judged from other texts."""
    monkeypatch.setattr(decontam, "PIECE_WORDS", 50)
    rng = np.random.default_rng(3)
    hashed = rng.integers(1, 1 << 63, 60).astype(np.uint64) * np.uint64(2)
    items = decontam.Items([(i, hashed[np.minimum(rng.geometric(0.06, int(rng.integers(4, 25))), 60) - 1]) for i in range(12)], 0.5)
    seeds, hits = items.seeds(["w1 w2", None]), 0
    for d in range(150):
        words = hashed[rng.integers(0, 60, int(rng.integers(0, 160)))]
        copy = list(items.words[d % 12])
        for _ in range(int(rng.integers(0, len(copy)))):
            at, kind = int(rng.integers(0, len(copy))), rng.integers(0, 3)
            copy[at : at + (kind != 0)] = [hashed[rng.integers(0, 60)]] if kind < 2 else []
            copy = copy or [hashed[0]]
        words = np.insert(words, int(rng.integers(0, len(words) + 1)), np.array(copy, dtype=np.uint64))
        got = {}
        for i, score, _, _ in decontam.found(seeds, words):
            got[i] = max(score, got.get(i, 0))
        want = {i: s / (MATCH * len(w)) for i, w in enumerate(items.words) if (s := table_align(w, words)) >= MATCH * len(w) / 2}
        assert got == want
        hits += len(want)
    assert hits > 100
    spread = np.concatenate([[w, np.uint64(7)] for w in np.unique(hashed)[:20]])
    one = decontam.Items([(0, spread[::2])], 0.5)
    assert [x[0] for x in decontam.found(one.seeds([]), spread)] == [0]


def test_every_third_and_fourth_word_edited_and_rows_without_ids(spark):
    rng = np.random.default_rng(5)
    items = [(i if i else None, [f"w{x}" for x in rng.integers(0, 3000, 30)]) for i in range(6)]
    docs = []
    for d in range(60):
        step = 3 + d % 2
        copy = [f"e{d}" if k % step == step - 1 else w for k, w in enumerate(items[d % 6][1])]
        docs.append((d if d % 10 else None, " ".join([f"x{d}", "y", *copy, "z"])))
    docs += [(None, " ".join(f"v{d}" for d in range(50))), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    out = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert out == {(d if d % 10 else None, d % 6 or None) for d in range(60)}
    assert {r.text for r in decontam.without_leaks(df, bench).collect()} == {docs[-2][1], None}


def test_all_pairs_of_the_smallest_tables(spark):
    """Against alignment of every item with every whole document."""
    import pyarrow.parquet as pq

    docs, items = (pq.read_table(f"/root/testdata/sf0.001/{t}.parquet").to_pydict() for t in ("documents", "benchmark"))
    hashed = {i: decontam.word_hashes(t)[0] for i, t in zip(items["item_id"], items["text"], strict=True)}
    want = {}
    for d, text in zip(docs["doc_id"], docs["text"], strict=True):
        words = decontam.word_hashes(text)[0]
        for i, item in hashed.items():
            if np.isin(item, words).sum() * MATCH >= MATCH * len(item) / 2 and (s := align(item, words)[0]) >= MATCH * len(item) / 2:
                want[d, i] = s / (MATCH * len(item))
    frame = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    assert {(r.doc_id, r.item_id): r.score for r in decontam.leaks(frame("documents"), frame("benchmark")).collect()} == want and want


def test_very_long_text(spark):
    item = " ".join(f"k{i}" for i in range(30))
    text = "a b c d " * 100_000 + item + " e" * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = decontam.leaks(df, spark.createDataFrame([(1, item), (2, item + " tail")], "item_id long, text string")).collect()
    assert sorted((r.item_id, r.first_word) for r in out) == [(1, 400_000), (2, 400_000)]
