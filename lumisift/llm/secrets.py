"""Secret scans through nested encodings.

The text is scanned, then whatever in it is encoded is decoded and scanned again, from a
worklist that ends when no layer yields a new one. Layers: percent escapes, Unicode escapes
(backslash u, U or x, and HTML character references, by number or name), base64 (standard and URL alphabets),
and gzip, zlib, bzip2, xz or zstd data anywhere inside base64. Text in base64 may be UTF-8 or UTF-16. Base64 may be wrapped over lines and touch
other text; it is decoded in all four steps. Bytes that are no text part it into pieces, of which those
under LEAST characters, too short for a finding, are left. A layer is the text of one encoded stretch or piece;
each of its characters knows which stretch of the document it came from, so findings in any
layer are spans of the document. A layer that was seen before at the same place isn't taken
up again (cycles end), and every decoding but decompression shortens its text.

Spans are (kind, start, end) in code points, end exclusive, of whole matches. A compressed
layer is read to its end, through all members and frames, in windows of WINDOW_BYTES; what may be unfinished at
a window's end goes to the next one whole. So memory is bounded by the longest stretch without a break;
`windowed` counts layers of more than one window. Null and empty texts have no findings. Repeated rows are scanned
alike. Each document is one row's work, whatever its length.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import by_text, id_text, slices

KINDS = ("assign", "access", "hex")
WINDOW_BYTES, FEED_BYTES = 16 << 20, 256
#: Shorter layers aren't counted as further windows.
OVERLAP = 4096
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINT = re.compile(r"(?:passw|secret|token|api)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_LONE = re.compile("[\udc80-\udcff]")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&(?:#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6})|[A-Za-z][A-Za-z0-9]{1,31});")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+|[A-Za-z0-9+/_-]++(?=\r?\n))(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+")
_CODE = re.compile(r"[A-Za-z0-9+/_=%\\&#;-]")
_BREAK = re.compile(r"\s+")
#: No finding and no stretch that could unfold to one is shorter; so no shorter piece of text is taken up.
LEAST = 16
_TEXT = re.compile(
    rb"(?:[\t\n\r -\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){%d,}+" % LEAST
)
#: The same in UTF-16, either byte first.
_WIDE = re.compile(rb"(?:[\t\n\r -\x7e]\x00){%d,}+|(?:\x00[\t\n\r -\x7e]){%d,}+" % (LEAST, LEAST))
_READABLE = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\ufffd]{%d}" % LEAST)
_ZLIB = b"|".join(re.escape(bytes([a, b])) for a in range(0x08, 0x80, 0x10) for b in range(256) if (a << 8 | b) % 31 == 0 and not b & 32)
_XZ = b"\xfd7zXZ\x00"
_MAGIC = re.compile(rb"\x1f\x8b\x08|\xfd7zXZ\x00|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\x28\xb5\x2f\xfd|" + _ZLIB, re.S)

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind's number, end) of the matches in one layer. Runs of the access and hex kinds hold no later match that a failing one could hide; an assignment is matched first and then dropped if short."""
    out = []
    if _ASSIGN_HINT.search(text):
        out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class _Unzlib:
    """zlib or gzip with the interface of the others."""

    def __init__(self):
        self.stream, self.rest, self.full = zlib.decompressobj(47), b"", False

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.stream.decompress(self.rest + data, most)
        self.rest, self.full = self.stream.unconsumed_tail, len(out) == most  # more may be held back although all input was taken
        return out

    eof = property(lambda self: self.stream.eof)
    needs_input = property(lambda self: not self.rest and not self.full)
    unused_data = property(lambda self: self.stream.unused_data)


class _Unzstd:
    """zstd likewise; FEED_BYTES of it hold few blocks, so what they unfold to is bounded."""

    def __init__(self):
        self.stream, self.needs_input = zstandard.ZstdDecompressor().decompressobj(), True

    def decompress(self, data: bytes, most: int) -> bytes:
        return self.stream.decompress(data)

    eof = property(lambda self: self.stream.eof)
    unused_data = property(lambda self: self.stream.unused_data)


def _inflated(data: bytes, at: int, ended: list[int]) -> Iterator[bytes]:
    """What compressed data holds from there on, through all members and frames that follow on one another; it ends where the
    data is broken. The place behind the last whole member is put into ended."""
    while _MAGIC.match(data, at):
        stream = _Unzstd() if data.startswith(b"\x28\xb5\x2f\xfd", at) else bz2.BZ2Decompressor() if data.startswith(b"BZh", at) else lzma.LZMADecompressor(lzma.FORMAT_XZ) if data.startswith(_XZ, at) else _Unzlib()
        fed = at
        try:
            while not stream.eof and (fed < len(data) or not stream.needs_input):
                more = data[fed : fed + FEED_BYTES] if stream.needs_input else b""
                fed += len(more)
                if out := stream.decompress(more, WINDOW_BYTES):
                    yield out
        except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            return
        at = fed - len(stream.unused_data)
        ended[0] = at
        while at < len(data) and not data[at]:  # zeros may pad members
            at += 1


def _texts(windows: Iterator[bytes]) -> Iterator[str]:
    """Decoded bytes in windows of text that end before whatever may be unfinished; bytes that are no text are replaced. A window
    is longer than WINDOW_BYTES where one stretch is."""
    decoder, held, size, least = codecs.getincrementaldecoder("utf-8")("replace"), [], 0, WINDOW_BYTES
    for data in (own[i : i + WINDOW_BYTES] for own in windows for i in range(0, len(own), WINDOW_BYTES)):
        held.append(decoder.decode(data))
        size += len(held[-1])
        if size < least:
            continue
        found = "".join(held)
        cut = _between(found)
        if _READABLE.search(found, 0, cut):
            yield found[:cut]
        held, size = [found[cut:]], len(found) - cut
        least = max(WINDOW_BYTES, 2 * size)
    found = "".join([*held, decoder.decode(b"", True)])
    if _READABLE.search(found):
        yield found


def _behind_space(text: str, at: int) -> int:
    """Behind the last space, tab or line feed before a place; steps back bit by bit, so that near ones are found at once."""
    step = 256
    while at:
        low = max(0, at - step)
        if (found := max(text.rfind(c, low, at) for c in " \t\n")) >= 0:
            return found + 1
        at, step = low, 2 * step
    return 0


def _unfinished(text: str) -> int:
    """Where the last four stretches without a space begin: an assignment has at most three, and may end in spaces. Lines whose
    ends could be base64 belong to one stretch."""
    at = len(text)
    for _ in range(4):
        while at and text[at - 1] in " \t\r\n":
            at -= 1
        while True:
            at = _behind_space(text, at)
            end = at
            while end and text[end - 1] in " \t":
                end -= 1
            if not (end and text[end - 1] == "\n"):
                break
            end -= 1 + text.startswith("\r\n", end - 2)
            if not (end > 0 and at < len(text) and _CODE.match(text, at) and _CODE.match(text, end - 1)):
                break
            at = end
    return at


def _between(text: str) -> int:
    """A place before all that may be unfinished that no assignment, which may hold spaces, lies over."""
    at = _unfinished(text)
    before = _unfinished(text[:at])
    return min([at, *(m.start() for m in _ASSIGN.finditer(text, before) if m.start() < at < m.end())])


def _percent(layer: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The whole layer with its percent escapes replaced: text, and first and end position in the layer of each character."""
    text, start, end, at = [], [], [], 0
    for m in _PERCENT.finditer(layer):
        found = binascii.unhexlify(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
        text += [layer[at : m.start()], _LONE.sub("\ufffd", found)]
        start.append(np.arange(at, m.start())), end.append(np.arange(at, m.start()) + 1)
        sizes = np.array([3 * (1 if _LONE.match(c) else len(c.encode())) for c in found])
        ends = m.start() + np.cumsum(sizes)
        start.append(ends - sizes), end.append(ends)
        at = m.end()
    if at:
        rest = np.arange(at, len(layer))
        yield "".join([*text, layer[at:]]), np.concatenate([*start, rest]), np.concatenate([*end, rest + 1])


def _escapes(layer: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The same with Unicode escapes and character references; pairs of surrogates are joined."""
    text, start, end, at = [], [], [], 0
    for m in _ESCAPE.finditer(layer):
        code = int(m[1] or m[2] or m[3] or "-1", 16)
        found = html.unescape(m[0]) if code < 0 else chr(code) if code < 0x110000 else ""
        if len(found) != 1:
            continue
        text += [layer[at : m.start()], found]
        start += [np.arange(at, m.start()), [m.start()]]
        end += [np.arange(at, m.start()) + 1, [m.end()]]
        at = m.end()
    if not at:
        return
    rest = np.arange(at, len(layer))
    out = "".join([*text, layer[at:]])
    first, last = np.concatenate([*start, rest]).astype(np.int64), np.concatenate([*end, rest + 1]).astype(np.int64)
    pairs = [m.start() for m in re.finditer("[\ud800-\udbff][\udc00-\udfff]", out)]
    if pairs:
        last[pairs] = last[np.array(pairs) + 1]
        keep = np.ones(len(out), dtype=bool)
        keep[np.array(pairs) + 1] = False
        out, first, last = out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace"), first[keep], last[keep]
    if len(out) == len(first):
        yield out, first, last


def _base64(layer: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """A layer for each piece of text in a base64 stretch, and for each window of compressed text in it. Whatever touches the
    stretch, lines too, is decoded with it: of the four ways to begin, one is in step with what was encoded."""
    for m in _BASE64.finditer(layer):
        body = _BREAK.sub("", m[0])
        if len(body) < LEAST:
            continue
        place = np.arange(m.start(), m.end())
        if len(body) < len(place):
            place = place[[not c.isspace() for c in m[0]]]
        body = body.replace("-", "+").replace("_", "/")
        for skip in range(4):
            own = body[skip : len(body) - ((len(body) - skip) % 4 == 1)]
            data = base64.b64decode(own + "=" * (-len(own) % 4))
            for piece in _TEXT.finditer(data):
                found = piece[0].decode()
                sizes = np.array([len(c.encode()) for c in found]) if len(found) < len(piece[0]) else np.ones(len(found), dtype=np.int64)
                ends = piece.start() + np.cumsum(sizes)
                yield found, place[skip + (ends - sizes) * 4 // 3], place[skip + -(-ends * 4 // 3) - 1] + 1
            for piece in _WIDE.finditer(data) if b"\x00" in data else ():
                ends = piece.start() + 2 * np.arange(1, len(piece[0]) // 2 + 1)
                yield piece[0].replace(b"\x00", b"").decode(), place[skip + (ends - 2) * 4 // 3], place[skip + -(-ends * 4 // 3) - 1] + 1
            at = 0
            while magic := _MAGIC.search(data, at):
                ended = [magic.start() + 1]
                for found in _texts(_inflated(data, magic.start(), ended)):
                    yield found, np.full(len(found), m.start()), np.full(len(found), m.end())
                at = ended[0]


def _decoded(layer: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Layers that are one step below this one, made one at a time."""
    if "%" in layer:
        yield from _percent(layer)
    if "\\" in layer or "&" in layer:
        yield from _escapes(layer)
    yield from _base64(layer)


def find(text: str | None) -> tuple[list[Span], set[Span], int, int]:
    """Spans of the text itself; spans of all layers; layers decoded; those that needed more than one window."""
    text = text or ""
    base = base_spans(text)
    spans, windowed, layers = set(base), 0, 0
    # layers in work, each with the places of its characters in the document and what is still to be decoded from it
    work = [(None, None, _decoded(text))]
    seen: set[tuple[int, int, bytes]] = set()
    last_place = None
    while work:
        first, last, below = work[-1]
        if (made := next(below, None)) is None:
            work.pop()
            continue
        inner, a, b = made
        if not len(inner):
            continue
        if first is not None:  # positions in the layer become positions in the document
            a, b = first[a], last[b - 1]
        if (key := (int(a[0]), int(b[-1]), hashlib.blake2b(inner.encode("utf-8", "surrogatepass"), digest_size=16).digest())) in seen:
            continue
        seen.add(key)
        layers += 1
        windowed += key[:2] == last_place and len(inner) > OVERLAP and a[0] == a[-1]
        last_place = key[:2]
        spans.update((int(a[s]), k, int(b[e - 1])) for s, k, e in base_spans(inner))
        work.append((a, b, _decoded(inner)))
    return base, spans, layers, int(windowed)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        cols: list[list] = [[] for _ in range(7)]
        for text in batch.column("text").to_pylist():
            base, spans, layers, windowed = find(text)
            counts = [sum(k == n for _, k, _ in base) for n in range(3)]
            for col, v in zip(cols, [*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(spans)), layers, windowed], strict=True):
                col.append(v)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=_NAMES)


_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers", "windowed"]


def secrets(docs: DataFrame) -> DataFrame:
    """A row for each document: counts and digest of the spans in the text itself, all spans, layers decoded."""
    return id_text(docs).mapInArrow(_found, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers long, windowed long")


def redact(text: str | None) -> str | None:
    """Each stretch that holds findings becomes one mark that names their kinds."""
    spans = sorted(find(text)[1]) if text else []
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kinds = spans[i][0], spans[i][2], {spans[i][1]}
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end, kinds, i = max(end, spans[i][2]), kinds | {spans[i][1]}, i + 1
        out += [text[at:start], f"[{'+'.join(KINDS[k] for k in sorted(kinds))}]"]
        at = end
    return "".join([*out, text[at:]]) if spans else text


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the findings in text replaced by marks, and n_chars, where there is one, counted anew; every row and column stays."""
    out = by_text(docs, lambda parts: ([redact(t) for t in texts] for texts in parts), column=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


__all__ = ["KINDS", "base_spans", "find", "listed", "redact", "redacted", "secrets"]
