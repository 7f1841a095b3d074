import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumisift.llm import bpe, idstore

P = pytest.importorskip("public_tokenizers")
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "\t", "word", "Wörter", "'s", "don't", "123", ".", ",", "***", "　", "\xa0", "😀", "中文", "<|endoftext|>", "\r\n", "\x85", "\x1c", "a" * 40, "ǅ", "́"]
TEXTS = st.one_of(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), st.text(max_size=30))


def tiktoken_ids():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}).encode_ordinary


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_bytes_and_offsets(text):
    want = tiktoken_ids.of(text)
    for path in (RANKS, JSON):
        c = bpe.codec(path)
        ids = c.ids(next(iter(c.encode([text]))))
        assert ids.tolist() == want
        data = c.decode(ids)
        assert data == text.encode()
        at, chars = c.offsets(ids, data)
        assert [data[a:b] for a, b in zip(at, at[1:], strict=False)] == [c.decode(ids[i : i + 1]) for i in range(len(ids))]
        assert chars[-1] == len(text)


tiktoken_ids.of = tiktoken_ids()


def test_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "GENERATION", 5)
    monkeypatch.setattr(bpe, "TOGETHER", 2)
    c = bpe.Codec(RANKS)
    texts = [f"some word{i % 7}, and\nother ünd {i}" for i in range(60)] + [None, ""]
    assert [c.ids(x).tolist() for x in c.encode(texts)] == [tiktoken_ids.of(t or "") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=12), st.integers(0, 3))
def test_columns_are_encoded_like_texts(texts, skipped):
    column = pa.array([*["left out"] * skipped, *texts, "a b"], pa.string()).slice(skipped, len(texts))
    want = [tiktoken_ids.of(t or "") for t in texts]
    for c in test_columns_are_encoded_like_texts.codecs:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(bpe, "COLUMN_BYTES", 40)
            patch.setattr(bpe, "LEARNED", 3)
            assert [c.ids(x).tolist() for x in c.encode_column(column)] == want
        assert [c.ids(x).tolist() for x in c.encode_column(column)] == want
        assert [c.ids(x).tolist() for x in c.encode(texts)] == want


test_columns_are_encoded_like_texts.codecs = [bpe.Codec(JSON, 20), bpe.Codec(RANKS, 20), bpe.Codec(JSON), bpe.Codec(JSON, 20)]
test_columns_are_encoded_like_texts.codecs[-1].words = None  # as for models of other kinds


def test_store_looks_each_piece_up_once(monkeypatch):
    class Counted(dict):
        def __init__(self):
            self.looked_up = 0

        def get(self, *key):
            self.looked_up += 1
            return super().get(*key)

    c = bpe.Codec(JSON)
    c.known = known = Counted()
    monkeypatch.setattr(idstore, "codec", lambda *_: c)
    rows = pa.RecordBatch.from_pydict({"doc_id": [*range(900)], "text": [f"some words, and the {i % 9} others\nof line" for i in range(900)]})
    out = pa.Table.from_batches(idstore._encode(JSON)(iter([rows])))
    assert sorted(d for d in out["doc_id"].to_pylist() if d is not None) == [*range(900)]
    assert known.looked_up <= 2 * (7 + 9)  # not 900 times the eight pieces of a text


def test_tables(spark):
    df = spark.createDataFrame([(1, "héllo 😀", "x"), (2, None, "y"), (1, "héllo 😀", "x")], "doc_id long, text string, ids string")
    out = {r.doc_id: r for r in bpe.digests(df, RANKS).collect()}
    assert out[2].n_tokens == 0 and out[1].round_trip and out[2].decoded_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(df, RANKS), RANKS).collect()}
    assert back == {1: "héllo 😀", 2: ""}
    assert bpe.digests(df.limit(0), RANKS).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 60_000).astype("<u2")
    ends = idstore.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes[:-1].min() >= idstore.SHORTEST and sizes.max() <= idstore.LONGEST
    shifted = idstore.cuts(np.concatenate([ids[:77], ids]))
    assert len({e + 77 for e in ends} & set(shifted)) > len(ends) * 0.8
    assert idstore.cuts(ids[:0]) == [] and idstore.cuts(ids[:3]) == [3]


@given(st.lists(st.binary(max_size=50), max_size=8))
def test_checksums_add_up(parts):
    whole, after, total = b"".join(parts), sum(map(len, parts)), 0
    for p in parts:
        after -= len(p)
        total ^= int(idstore.moved(np.array([zlib.crc32(p)]), np.array([after]))[0])
    assert total == zlib.crc32(whole)


def stored(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, start int")
    return idstore.stored_summary(df, JSON, str(tmp_path / "store"))


def test_store_round_trip(spark, tmp_path):
    long = " ".join(f"tok{i % 971} x{i}" for i in range(9000))
    rows = [(5, "b"), (3, None), (9, long), (4, long), (8, "tail " + long), (10, ""), (11, "b")]
    out = {r.doc_id: r for r in stored(spark, rows, tmp_path).collect()}
    at = 0
    read = {r.doc_id: r.ids for r in idstore.documents(spark, str(tmp_path / "store")).collect()}
    for i, t in sorted(rows):
        ids = np.array([*tiktoken_ids.of(t or ""), 0], dtype="<u4")
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert read[i] == ids.tolist()
        at += len(ids)
    kept = idstore.chunks(spark, str(tmp_path / "store"))
    assert kept.count() == kept.distinct().count() and kept.count() < sum(len(r.hashes) for r in idstore.manifest(spark, str(tmp_path / "store")).collect())
    assert [r.doc_id for r in idstore.manifest(spark, str(tmp_path / "store")).orderBy("start").collect()] == sorted(i for i, _ in rows)


def test_store_of_nothing_and_of_repeats(spark, tmp_path):
    assert stored(spark, [], tmp_path / "a").count() == 0
    out = sorted((r.doc_id, r.start, r.n_tokens) for r in stored(spark, [(1, "b"), (1, "b"), (2, "b")], tmp_path / "b").collect())
    assert out == [(1, 0, 2), (1, 2, 2), (2, 4, 2)]


def test_hot_chunks_and_rows_without_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idstore, "HOT_SHARE", 3)
    rows = [(i, "" if i % 2 else f"text {i}") for i in range(40)] + [(None, "b"), (None, None)]
    out = sorted(((r.start, r.doc_id, r.n_tokens) for r in stored(spark, rows, tmp_path).collect()))
    assert [d for _, d, _ in out] == [None, None, *range(40)] and out[-1][0] + out[-1][2] == sum(len(tiktoken_ids.of(t or "")) + 1 for _, t in rows)
    assert idstore.documents(spark, str(tmp_path / "store")).count() == 42


def test_damage_is_found(spark, tmp_path):
    stored(spark, [(1, "a b c")], tmp_path)
    path = str(tmp_path / "store")
    bad = [(r.hash, bytes([r.ids[0] ^ 1]) + bytes(r.ids[1:])) for r in idstore.chunks(spark, path).collect()]
    spark.createDataFrame(bad, "key binary, ids binary").write.mode("overwrite").parquet(f"{path}/staged/kind=chunk")
    for read in (idstore.summary, idstore.documents):
        with pytest.raises(Exception, match="damaged"):
            read(spark, path).collect()


def test_merkle_root_depends_on_all_leaves():
    leaves = [bytes([i]) * 16 for i in range(7)]
    roots = {idstore.merkle_root(leaves[:n]) for n in range(8)} | {idstore.merkle_root(leaves[::-1])}
    assert len(roots) == 9
