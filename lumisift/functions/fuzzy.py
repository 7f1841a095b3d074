"""Approximate substring search: the leftmost place where a text comes within so many edits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_SHARE = 0.1
#: Columns of the table of edit distances that have the same number of rows.
STRIP = 256
#: Diagonals are followed where the square of the distance is at most so many times the length.
DIAGONALS = 1


def near_match(part: str, text: str, most: int) -> tuple[int, int] | None:
    """Start and end of a stretch of text at edit distance at most `most` from part.

    Of the first run of end places that are near enough, the best one counts, the first of equals;
    its start is the latest one that gives its distance. Of most + 1 pieces of part any such stretch
    holds one unchanged, so only the text around exact hits of pieces is searched.
    """
    if len(part) <= most or not part:
        return (0, 0)
    if most == 0:
        return (at, at + len(part)) if (at := text.find(part)) >= 0 else None
    for low, high in _regions(part, text, most):
        if hit := _searched(part, text[low:high], most):
            return low + hit[0], low + hit[1]
    return None


def _regions(part: str, text: str, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of text that hold every near match whole, in order and apart from one another. Looked for in longer and longer beginnings of the text, as a match ends the search."""
    cuts = [len(part) * i // (most + 1) for i in range(most + 2)]
    reach, told = len(part) + 2 * most, 0
    end = 4 * reach
    while True:
        hits = set()
        for begin, stop in zip(cuts, cuts[1:], strict=False):
            piece = part[begin:stop]
            at = text.find(piece, 0, end)
            while at >= 0:
                hits.add(at - begin)
                at = text.find(piece, at + 1, end)
        out: list[tuple[int, int]] = []
        for start in sorted(hits):
            low, high = max(0, start - 2 * most), start + reach
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
            else:
                out.append((low, high))
        known = len(out) if end >= len(text) else sum(high + reach <= end for _, high in out)  # no piece further on can lengthen these
        yield from out[told:known]
        if end >= len(text):
            return
        told, end = known, 2 * end


def _masks(part: str) -> dict[str, int]:
    """At which places of part each character stands, as bits."""
    at: dict[str, list[int]] = {}
    for i, c in enumerate(part):
        at.setdefault(c, []).append(i)
    out = {}
    for c, places in at.items():
        bits = bytearray(len(part) // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        out[c] = int.from_bytes(bits, "little")
    return out


def _distances(part: str, text: str, most: int, whole: bool = False) -> Iterator[int]:
    """The least edit distance of part and a stretch that ends behind each character of text (whole: and begins where text does); exact where it is at most `most`, else over it.

    Myers' bit vectors: a column of the usual table as its differences, in whole numbers. Rows that lie further below a
    column's number than most can't be near enough, so a column has bits for the others only.
    """
    equal, length = _masks(part), len(part)
    rows = distance = min(length, STRIP + most)
    full = more = (1 << rows) - 1
    top, less = 1 << (rows - 1), 0
    for begin in range(0, len(text), STRIP):
        if rows < length and begin:
            longer = min(length, begin + STRIP + most)
            distance += longer - rows
            rows, full = longer, (1 << longer) - 1
            more |= full & ~(2 * top - 1)
            top = 1 << (rows - 1)
        rest = length - rows
        for c in text[begin : begin + STRIP]:
            eq = equal.get(c, 0) & full if rest else equal.get(c, 0)
            across = (((eq & more) + more) ^ more) | eq
            up = less | (full & ~(across | more))
            down = more & across
            if up & top:
                distance += 1
            elif down & top:
                distance -= 1
            eq |= less
            up = (up << 1) & full | whole
            more = (down << 1) & full | (full & ~(eq | up))
            less = up & eq
            yield distance + rest


def _same(a: str, b: str, i: int, j: int) -> int:
    """How many characters of a from i on are those of b from j on."""
    begin, step = i, 16
    while a[i : i + step] == b[j : j + step] and i + step <= len(a) and j + step <= len(b):
        i, j, step = i + step, j + step, 2 * step
    while step:
        if i + step <= len(a) and j + step <= len(b) and a[i : i + step] == b[j : j + step]:
            i, j = i + step, j + step
        step //= 2
    return i - begin


def _shortest(part: str, text: str, distance: int) -> int:
    """Length of the shortest beginning of text at the given edit distance from part, which is the least that any beginning has: by the furthest row of each diagonal for each number of edits."""
    length = len(part)
    row = {0: _same(part, text, 0, 0)}
    for _ in range(distance):
        new: dict[int, int] = {}
        for diagonal, i in row.items():  # diagonal: place in text less row
            for d, r in ((diagonal, i + 1), (diagonal - 1, i + 1), (diagonal + 1, i)):
                r = min(r, length)
                if 0 <= r + d <= len(text) and r > new.get(d, -1):
                    new[d] = r
        row = {d: r + _same(part, text, r, r + d) for d, r in new.items()}
    return min(length + d for d, r in row.items() if r == length)


def _searched(part: str, text: str, most: int) -> tuple[int, int] | None:
    best, top = 0, None
    for j, distance in enumerate(_distances(part, text, most), 1):
        if distance <= most:
            if top is None or distance < top:
                top, best = distance, j
        elif top is not None:
            break
    if top is None:
        return None
    back = part[::-1], text[:best][::-1]
    if top * top <= DIAGONALS * len(part):
        return best - _shortest(*back, top), best
    return best - next(i for i, distance in enumerate(_distances(*back, top, True), 1) if distance == top), best


def fuzzy_find(text: Column, part: Column, share: float = ERROR_SHARE) -> Column:
    """Start of the first near match with at most int(length * share) edits, -1 if there is none; null if either is null."""

    @F.pandas_udf("int")
    def run(texts: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(texts, parts, strict=True):
            if t is None or p is None:
                out.append(None)
                continue
            hit = near_match(p, t, int(len(p) * share))
            out.append(-1 if hit is None else hit[0])
        return pd.Series(out, dtype="Int32")

    return run(text, part)
