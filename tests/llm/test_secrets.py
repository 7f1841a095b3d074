import base64
import bz2
import gzip
import re
import urllib.parse
import zlib

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from lumisift.llm import secrets as S


def plain(text):
    """The three patterns as they are stated, failing matches dropped afterwards."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


PIECES = ["password", "Token", "API_KEY", "=", ":", " ", '"', "AKIA", "AKIAKIA", "ABCDEF0123456789", "0123456789abcdef", "abc", "é", "secret=token:", "\n", "%", "x" * 13, "ſecret"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_base_is_as_stated(text):
    assert S.base_spans(text) == plain(text)


def cover(text, found):
    return {(S.KINDS[k], text[s:e]) for s, k, e in found}


def test_layers_and_spans():
    key = "AKIA" + "Q7" * 8
    percent = "".join(f"%{ord(c):02X}" for c in key)
    escapes = "".join(f"\\u{ord(c):04x}" for c in key)
    for layer in (percent, escapes):
        text = f"é see {layer} end"
        base, spans, layers, _ = S.find(text)
        assert not base and ("access", layer) in cover(text, spans) and layers == 1


def test_compressed_and_nested():
    inner = f'token="{"Zz9" * 8}" '
    for pack in (gzip.compress, zlib.compress, bz2.compress, zstandard.compress):
        for nested in (False, True):
            data = pack(inner.encode())
            coded = base64.b64encode(data).decode()
            text = urllib.parse.quote(coded, safe="") if nested else coded
            spans = S.find(f"x {text} y")[1]
            assert any(k == 0 and s == 2 and e <= 2 + len(text) for s, k, e in spans), (pack, nested)


def test_cycles_end_and_edge_cases():
    deep = "secret=abcdefABCDEF123"
    for _ in range(12):
        deep = base64.b64encode(deep.encode()).decode()
    assert any(k == 0 for _, k, _ in S.find(deep)[1])
    assert S.find(None) == S.find("") == ([], set(), 0, 0)
    assert S.find("%41" * 3 + "%zz %ff")[2] == 1
    assert S.redact("no secret here") == "no secret here" and S.redact(None) is None


def test_large_layers_are_read_to_their_end(monkeypatch):
    monkeypatch.setattr(S, "WINDOW_BYTES", 1000)
    monkeypatch.setattr(S, "OVERLAP", 100)
    hidden = "é " * 900 + 'x api_key: "Abcdefghij0123456789" ' + "b " * 3000 + "AKIA" + "Z9" * 10
    for pack in (gzip.compress, bz2.compress, zstandard.compress):
        text = base64.b64encode(pack(hidden.encode())).decode()
        _, spans, _, windowed = S.find(text)
        assert windowed and {k for _, k, _ in spans} >= {0, 1}, pack


def test_table(spark):
    df = spark.createDataFrame([(1, "password=abcdefabcdef12 x", "q", 3), (2, None, "q", None), (3, "", "q", 0), (1, "password=abcdefabcdef12 x", "q", 3)], "doc_id long, text string, spans string, n_chars int")
    out = {r.doc_id: r for r in S.secrets(df).collect()}
    assert out[1].n_assign == 1 and out[1].spans == "assign:0:23" and out[2].spans == "" and out[3].n_hex == 0
    red = S.redacted(df)
    assert red.columns == df.columns and sorted((r.doc_id, r.text, r.n_chars) for r in red.where("doc_id <> 2").collect()) == [(1, "[assign] x", 10), (1, "[assign] x", 10), (3, "", 0)]
    assert S.secrets(df.limit(0)).count() == 0


SECRET = "password = abcdefghijklmnop1234"


def test_base64_that_touches_other_text():
    coded = base64.b64encode(SECRET.encode()).decode()
    for before in ("data:", "/api/v1/", "host.example/files/", "session_", "a-b_c/", "x", "xy", "xyz"):
        text = before + coded
        assert ("assign", text[len(before) : len(before) + len(coded.rstrip("="))]) in cover(text, S.find(text)[1]), before
    packed = base64.b64encode(gzip.compress(SECRET.encode())).decode()
    for before in ("/api/v1/", "session_", "xy"):
        assert any(k == 0 for _, k, _ in S.find(before + packed)[1]), before


def test_base64_over_lines_and_bytes_that_are_no_text():
    noise = "".join(f"line {i * i * 7919} of much\n" for i in range(60))
    for data in (gzip.compress((noise + SECRET).encode()), (noise + SECRET).encode()):
        for end in ("\n", "\r\n", "\n  "):
            coded = base64.b64encode(data).decode()
            text = end.join(coded[i : i + 76] for i in range(0, len(coded), 76))
            assert any(k == 0 for _, k, _ in S.find(f"x:\n{text}\n")[1])
    for other in (b"\x00", b"\x1b", b"\xff", b"\xe0\x80"):
        data = other + SECRET.encode() + other
        assert any(k == 0 for _, k, _ in S.find(base64.b64encode(data).decode())[1])
        assert any(k == 0 for _, k, _ in S.find(base64.b64encode(zlib.compress(data)).decode())[1])
        text = "".join(f"%{c:02x}" for c in data)
        size = 3 * len(other)
        assert ("assign", text[size:-size]) in cover(text, S.find(text)[1])


def test_all_members_and_frames():
    for pack in (gzip.compress, zlib.compress, bz2.compress, zstandard.compress):
        parts = [pack(b"first, and more of it "), pack(b"passw"), pack(SECRET[5:].encode())]
        for data in (b"".join(parts), parts[0] + bytes(4) + pack(SECRET.encode()) + b"rest"):
            assert any(k == 0 for _, k, _ in S.find(base64.b64encode(data).decode())[1]), pack


def test_stretches_over_the_ends_of_windows(monkeypatch):
    monkeypatch.setattr(S, "WINDOW_BYTES", 1000)
    monkeypatch.setattr(S, "OVERLAP", 100)
    nested = base64.b64encode(("".join(f"{i * i * 7919} " for i in range(700)) + SECRET).encode()).decode()
    packed = base64.b64encode(gzip.compress(("".join(f"{i * i * 7919} " for i in range(900)) + SECRET).encode())).decode()
    wrapped = "\r\n ".join(nested[i : i + 76] for i in range(0, len(nested), 76))
    for inner in (nested, packed, wrapped, "token : " + "Zz" * 700, "token" + " " * 990 + "= " + "Zz" * 20):
        for shift in range(0, 1000, 90):
            hidden = "é " * shift + "; " + inner + " end" + " of it" * 400
            assert any(k == 0 for _, k, _ in S.find(base64.b64encode(gzip.compress(hidden.encode())).decode())[1]), (inner[:20], shift)


def test_wide_text_xz_and_named_references():
    import lzma

    for data in (SECRET.encode("utf-16-le"), SECRET.encode("utf-16"), b"x" + SECRET.encode("utf-16-be"), lzma.compress(SECRET.encode()), lzma.compress(b"first, and more ") + lzma.compress(SECRET.encode())):
        for shift in range(3):
            coded = base64.b64encode(b"." * shift + data).decode()
            assert any(k == 0 for _, k, _ in S.find(f"see {coded} end")[1]), data
    wide = base64.b64encode(SECRET.encode("utf-16-le")).decode()
    assert ("assign", wide.rstrip("=")) in cover(wide, S.find(wide)[1])
    text = "password&equals;&quot;abcdefghijklmnop&quot; &nosuch; &amp"
    assert ("assign", text[:38]) in cover(text, S.find(text)[1]) and not S.find(text)[0]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 80), st.integers(0, 3), st.booleans())
def test_windows_change_no_finding(before, kind, compressed):
    import lumisift.llm.secrets as own

    inner = [SECRET, base64.b64encode(SECRET.encode()).decode(), urllib.parse.quote(SECRET, safe=""), base64.b64encode(gzip.compress(SECRET.encode())).decode()][kind]
    hidden = ("lorem " * before + inner + " ipsum" * 40).encode()
    text = base64.b64encode(gzip.compress(hidden) if compressed else hidden).decode()
    whole, size = S.find(text)[1], own.WINDOW_BYTES
    try:
        own.WINDOW_BYTES = 64
        small = S.find(text)[1]
    finally:
        own.WINDOW_BYTES = size
    assert {(k, s, e) for s, k, e in small} == {(k, s, e) for s, k, e in whole} and any(k == 0 for _, k, _ in whole)


def test_base_columns_are_those_of_sql(spark):
    """The base spans of a table, by DuckDB's own regular expressions."""
    import duckdb

    kinds = {"n_access": "AKIA[A-Z0-9]{14,}", "n_hex": "[0-9a-f]{16,}"}
    counts = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) AS {n}" for n, p in kinds.items())
    assign = """len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 12)) AS n_assign"""
    want = {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, {assign}, {counts} FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()}
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in S.secrets(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == want and all(sum(v[k] for v in want.values()) for k in (0, 2))
