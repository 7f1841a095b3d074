"""Byte-level BPE encoding and decoding over Arrow batches.

Encoding is done by the tokenizers library: its byte-level pre-tokenizer maps bytes to
characters, its BPE model merges them. A model is either a tokenizer file or a file of ranks;
ranks become merges (every split of a token into two tokens, in the order of the token's rank),
which gives the ids that merging by rank gives.

Texts are cut before single spaces and line ends between non-space characters. No match of the
pattern crosses such a place, so a piece has the same ids anywhere, and each worker encodes a
piece once while it keeps being met (two generations of a bounded cache). New pieces of some texts
go to the library together; the byte lengths of the ids part the result again. Of pieces that are a word and
some punctuation the words go, as single matches with their bytes already mapped to characters, to
the same model without a pre-tokenizer's pattern; the punctuation's ids are put behind.

Offsets come from the byte lengths of the ids: token i covers bytes starts[i] to starts[i+1];
character offsets count the bytes that begin a character, so a token that begins inside a
character has the offset after that character's start. Decoding reverses the byte table;
tokens may end inside a character, so whole documents of bytes are decoded, never single tokens.

Null texts are empty: no ids. Whole texts are encoded, whatever their length. Repeated rows
are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import id_text, slices

#: Pieces that a generation of a worker's cache holds, and texts that are encoded together.
GENERATION, TOGETHER = 100_000, 32
#: Bytes of texts whose pieces Arrow tells apart at one time (a longer text is taken whole), and new pieces that go to the library together.
COLUMN_BYTES, LEARNED = 1 << 23, 1024
#: Behind a word these are one match of the pattern; letters up to here have been letters in every version of Unicode in use.
_PUNCTUATION, _LAST_LETTER = ".,;:!?*#$%&()[]{}<>/|=+-@^~\"_", "\u024f"
#: All those letters, and what is nothing but such a word, for Arrow.
_LETTERS = "".join(c for c in map(chr, range(ord(_LAST_LETTER) + 1)) if c.isalpha())
_WORD = rf"\A[{_LETTERS}]+\z"
_OTHER_SPACE = re.compile(r"[^\S \n]")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _of_file(path: str):
    """Tokenizer, the same model over words that are parted by spaces (or None), and the bytes of each id."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    words = None
    own = json.loads(tokenizer.to_str())
    before, model = own["pre_tokenizer"] or {}, own["model"]
    if model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"] and own["normalizer"] is None:
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        words = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0, ignore_merges=model.get("ignore_merges", False)))
        words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    back = {c: b for b, c in enumerate(byte_characters())}
    return tokenizer, words, {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in tokenizer.get_vocab().items()}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def _of_ranks(path: str):
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, shown = read_ranks(path), byte_characters()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        halves = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(name[a], name[b]) for a, b in sorted(halves, key=lambda h: (ranks[h[0]], ranks[h[1]]))]
    tokenizer = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    words = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, cache_capacity=0, ignore_merges=True))
    words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    return tokenizer, words, {r: t for t, r in ranks.items()}


def _joined(values: pa.Array, starts: Iterable[int], between: str | bytes) -> pa.Array:
    """The values of each run, which begin at starts, in one."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), values), pa.scalar(between, values.type))


def _list(values: pa.Array) -> list[str]:
    """values.to_pylist() of texts without spaces, faster."""
    return _joined(values, [0, len(values)], " ")[0].as_py().split(" ")


class Codec:
    """Encodes texts to little-endian ids and decodes them."""

    def __init__(self, path: str, generation: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer, self.words, of = _of_ranks(path) if path.endswith(".tiktoken") else _of_file(path)
        size = max(of) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.sizes = np.array([len(of.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(of.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.shown = dict(enumerate(byte_characters()))
        self.tails: dict[str, bytes] = {}
        self.generation = generation or GENERATION
        self.known: dict = {}
        self.older: dict = {}

    @staticmethod
    def _plain(text: str) -> bool:
        """Whether every space and line end stands alone between other characters."""
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace())

    def _pieces(self, text: str) -> tuple[list, bool]:
        """Keys of the pieces; whether all may be encoded side by side."""
        if not self._plain(text):
            return self._any_pieces(text), False
        first, *lines = text.split("\n")
        out = first.split(" ")
        out[0] = (out[0],)
        for line in lines:
            own = line.split(" ")
            own[0] = "\n" + own[0]
            out += own
        return out, True

    @staticmethod
    def _any_pieces(text: str) -> list:
        """For texts with other white space; their pieces are encoded one by one."""
        first, *rest = _SAFE_SPACE.split(text)
        return [(first,), *rest]

    @staticmethod
    def _piece(key) -> str:
        return key[0] if isinstance(key, tuple) else key if key[0] == "\n" else " " + key

    def _tail(self, text: str) -> bytes:
        if (found := self.tails.get(text)) is None:
            found = self.tails[text] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        return found

    def _learn_words(self, keys: list) -> list:
        """Learns the pieces that are a word, perhaps with punctuation behind it; returns the others."""
        parts, words, others = [], {}, []
        for key in keys:
            line = key[0] == "\n"
            word = key.rstrip(_PUNCTUATION)[line:]
            if word.isalpha() and max(word) <= _LAST_LETTER:
                tail = key[line + len(word) :]
                if line:
                    words[key[: 1 + len(word)]] = word
                    parts.append((key, key[: 1 + len(word)], tail))
                else:
                    if word not in self.known:
                        words[word] = " " + word
                    if tail:
                        parts.append((key, word, tail))
            else:
                others.append(key)
        if words:
            self._learn_matches(list(words), list(words.values()))
            end = self._tail("\n")
            for key in words:
                if key[0] == "\n":
                    self.known[key] = end + self.known[key]
        for key, word, tail in parts:
            self.known[key] = self.known[word] + self._tail(tail) if tail else self.known[word]
        return others

    def _learn_matches(self, keys: list, words: list[str]) -> None:
        """Learns words that are single matches of the pattern."""
        text = "\n".join(words).encode().decode("latin-1").translate(self.shown).replace(self.shown[10], " ")
        self._part(keys, self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, [len(w.encode()) for w in words])

    def _part(self, keys: list, ids: list[int], sizes: list[int]) -> None:
        """Gives each key its share of the ids: those of so many bytes."""
        own = np.array(ids, dtype=self.dtype)
        ends = np.searchsorted(np.cumsum(self.sizes[own]), np.cumsum(sizes)) + 1
        data, begin = own.tobytes(), 0
        for key, end in zip(keys, (ends * self.dtype.itemsize).tolist(), strict=True):
            self.known[key] = data[begin:end]
            begin = end

    def _learn(self, joined: list, alone: list) -> None:
        if self.words is not None:
            joined = self._learn_words(joined)
        if joined:
            pieces = [self._piece(k) for k in joined]
            self._part(joined, self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, [len(p.encode()) for p in pieces])
        for key, e in zip(alone, self.tokenizer.encode_batch_fast([self._piece(k) for k in alone], add_special_tokens=False) if alone else (), strict=True):
            self.known[key] = np.array(e.ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as bytes of self.dtype."""
        for at in range(0, len(texts), TOGETHER):
            yield from self._encode(texts[at : at + TOGETHER])

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """As encode, of a column: Arrow parts the texts and tells their pieces apart, and Python meets each word or other piece of COLUMN_BYTES of texts once. Takes more memory than encode."""
        at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // COLUMN_BYTES
        ends = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
        for begin, end in zip(ends, ends[1:], strict=False):
            yield from self._encode_column(texts.slice(begin, end - begin))

    def _encode_column(self, texts: pa.Array) -> list[bytes]:
        own = texts.to_pylist()
        plain = [bool(t) and self._plain(t) for t in own]
        if (out := self._encode_plain(texts.filter(pa.array(plain, pa.bool_())))) is None:  # some hold other white space
            plain = [p and _OTHER_SPACE.search(t) is None for p, t in zip(plain, own, strict=True)]
            out = self._encode_plain(texts.filter(pa.array(plain, pa.bool_())))
        done, others = iter(out), self.encode([t for p, t in zip(plain, own, strict=True) if not p])
        return [next(done if p else others) for p in plain]

    def _encode_plain(self, texts: pa.Array) -> list[bytes] | None:
        """Of texts that are plain; None if a new piece holds other white space."""
        if not len(texts):
            return []
        self._age()
        parts = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n"), " ")
        coded, starts = parts.flatten().dictionary_encode(), parts.offsets.to_numpy()
        pieces = coded.dictionary
        values = self._values(pieces)
        if values is None:
            return None
        codes = coded.indices.to_numpy().copy()
        first, at = np.unique(codes[starts[:-1]], return_inverse=True)  # the first piece of a text has no space before it
        alone = [(k,) for k in _list(pieces.take(pa.array(first)))]
        codes[starts[:-1]] = len(pieces) + at
        self._learn([], [k for k in alone if k not in self.known])
        own = pa.array([self.known[k] for k in alone], pa.large_binary())
        return _joined(pa.concat_arrays([values, own]).take(pa.array(codes)), starts, b"").to_pylist()

    def _values(self, pieces: pa.Array) -> pa.Array | None:
        """The ids of different pieces; of one that is a word and punctuation each part is looked up by itself."""
        if self.words is None:
            return self._looked_up(pieces, [False] * len(pieces))
        word = pc.utf8_rtrim(pieces, _PUNCTUATION)
        simple = pc.match_substring_regex(word, _WORD)
        words = pc.if_else(simple, word, pieces).dictionary_encode()
        tails = pc.if_else(simple, pc.utf8_ltrim(pieces, _LETTERS), "").dictionary_encode()
        values = self._looked_up(words.dictionary, pc.match_substring_regex(words.dictionary, _WORD).to_pylist())
        if values is None:
            return None
        ends = pa.array(list(map(self._tail, _list(tails.dictionary))), pa.large_binary())
        return pc.binary_join_element_wise(values.take(words.indices), ends.take(tails.indices), pa.scalar(b"", pa.large_binary()))

    def _looked_up(self, pieces: pa.Array, simple: list[bool]) -> pa.Array | None:
        """The ids of different pieces, simple: those that are words; None if a new one holds other white space."""
        keys = _list(pieces)
        found = list(map(self.known.get, keys))
        gaps = [i for i, v in enumerate(found) if v is None]
        if _OTHER_SPACE.search("".join([keys[i] for i in gaps])):
            return None
        if self.older:
            for i in gaps:
                if (v := self.older.get(keys[i])) is not None:
                    self.known[keys[i]] = found[i] = v
            gaps = [i for i in gaps if found[i] is None]
        words, others = [keys[i] for i in gaps if simple[i]], [keys[i] for i in gaps if not simple[i]]
        for at in range(0, len(words), LEARNED):
            self._learn_matches(words[at : at + LEARNED], [" " + w for w in words[at : at + LEARNED]])
        for at in range(0, len(others), LEARNED):
            self._learn(others[at : at + LEARNED], [])
        for i in gaps:
            found[i] = self.known[keys[i]]
        return pa.array(found, pa.large_binary())

    def _age(self) -> None:
        if len(self.known) > self.generation:
            self.older, self.known = self.known, {}

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        self._age()
        rows, joined, alone = [], set(), set()
        for text in texts:
            keys, safe = self._pieces(text) if text else ([], True)
            found = list(map(self.known.get, keys))
            gaps = [i for i, v in enumerate(found) if v is None] if None in found else []
            new = {keys[i] for i in gaps}
            if safe and new and _OTHER_SPACE.search("".join(k for k in new if isinstance(k, str))):
                keys = self._any_pieces(text)
                found = list(map(self.known.get, keys))
                gaps = [i for i, v in enumerate(found) if v is None]
                new, safe = {keys[i] for i in gaps}, False
            for k in new:
                (joined if safe and isinstance(k, str) else alone).add(k)
            rows.append((keys, found, gaps))
        if self.older:
            for k in [k for k in (*joined, *alone) if k in self.older]:
                self.known[k] = self.older[k]
                joined.discard(k), alone.discard(k)
        self._learn(list(joined - alone), list(alone))
        for keys, found, gaps in rows:
            for i in gaps:
                found[i] = self.known[keys[i]]
        return [b"".join(found) for _, found, _ in rows]

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype=self.dtype)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self.flat[np.repeat(self.firsts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()

    def offsets(self, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Byte and character offset of the start of each token, and of the end of the last."""
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        begins = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
        return at, np.concatenate([[0], np.cumsum(begins)])[at]


@cache
def codec(path: str, generation: int | None = None) -> Codec:
    """One for each worker process."""
    return Codec(path, generation)


_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, split_tokens long, round_trip boolean"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """A row for each document: number of ids, digests of ids and of the decoded bytes, tokens that begin inside a character, whether decoding gave the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            n, a, b, split, same = [], [], [], [], []
            texts = batch.column("text").to_pylist()
            for text, data in zip(texts, c.encode(texts), strict=True):
                ids = c.ids(data)
                back = c.decode(ids)
                at, _ = c.offsets(ids, back)
                inner = (np.frombuffer(back, dtype=np.uint8)[at[:-1]] & 0xC0) == 0x80
                n.append(len(ids)), split.append(int(inner.sum()))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(back).hexdigest())
                same.append(back == (text or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(split, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "split_tokens", "round_trip"])

    return id_text(docs).mapInArrow(run, _DIGEST)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, and the byte and character offset of each token's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            out = []
            for data in c.encode(batch.column("text").to_pylist()):
                ids = c.ids(data)
                at, chars = c.offsets(ids, c.decode(ids))
                out.append((ids.astype(np.int32), at[:-1], chars[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([o[i] for o in out], pa.list_(k)) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64())))], names=["doc_id", "ids", "byte_starts", "char_starts"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>, byte_starts array<long>, char_starts array<long>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, text; bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            text = [c.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col("doc_id"), F.col("ids")).mapInArrow(run, "doc_id long, text string")
