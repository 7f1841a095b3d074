"""The best products of the rows of two matrices, by blocks in single precision and then exactly.

A block of products is compared with what each row's kth best product so far still allows; what passes
is kept, and the few that are left are computed again in doubles, one component after the other as a
column expression does. The margin of the comparison covers the rounding errors of single precision,
so nothing that belongs to the best is lost.
"""

from __future__ import annotations

import numpy as np

ROWS, COLUMNS, FIRST = 512, 2048, 1024
#: Pairs that a block of rows may hold at one time; one that holds more is searched in halves.
MOST_HELD = 2_000_000
#: Components that are multiplied in doubles at one time.
_NUMBERS = 2_000_000
#: Norms within which single precision neither overflows nor loses its digits, and how far the largest may be from the usual one.
_SINGLE, _SPREAD = (1e-12, 1e12), 16.0


def products(q: np.ndarray, d: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Of pairs of rows, in doubles and in the order of the components."""
    out = np.empty(len(rows))
    step = 1 + _NUMBERS // max(1, q.shape[1])
    for at in range(0, len(rows), step):
        r, c = rows[at : at + step], columns[at : at + step]
        both = q[r].astype(np.float64) * d[c].astype(np.float64)
        out[at : at + step] = np.cumsum(both, axis=1)[:, -1] if both.shape[1] else 0.0
    return out


def firsts_of_equal(d: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the rows of d without those that `most` equal rows come before."""
    if len(d) <= most or not d.shape[1]:
        return np.arange(len(d))
    bits = np.ascontiguousarray(d).view(np.uint32 if d.dtype == np.float32 else np.uint64).astype(np.uint64)
    hashes = (bits * (np.random.default_rng(1).integers(1, 1 << 63, bits.shape[1], dtype=np.uint64) | np.uint64(1))).sum(axis=1, dtype=np.uint64)
    order = np.argsort(hashes, kind="stable")
    starts = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1], True])
    keep = np.ones(len(d), dtype=bool)
    for i in np.flatnonzero(np.diff(starts) > most):
        same = order[starts[i] : starts[i + 1]]
        keep[same[(bits[same] == bits[same[0]]).all(axis=1)][most:]] = False
    return np.flatnonzero(keep)


def _beaten(columns: np.ndarray, k: int) -> np.ndarray:
    """Of columns in the order of falling products: which have k smaller columns before them."""
    least: list[int] = []  # the k smallest so far, in order
    out = np.zeros(len(columns), dtype=bool)
    for i, c in enumerate(columns.tolist()):
        if len(least) == k:
            if c > least[-1]:
                out[i] = True
                continue
            least.pop()
        at = len(least)
        while at and least[at - 1] > c:
            at -= 1
        least.insert(at, c)
    return out


def best(q: np.ndarray, d: np.ndarray, k: int, slack: float, own: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of d and product of all pairs that are among a row's best k, also if products within slack of one another count as equal.

    Of equal ones the first rows of d count. own: pairs that don't take part, in the order of q. A row of q gets k pairs and those near the kth at least.
    """
    n, m, dim = len(q), len(d), q.shape[1]
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    if not n or not m:
        return none
    own_rows, own_columns = own or none[:2]
    q_norm, d_norm = (np.sqrt(np.square(x, dtype=np.float64).sum(axis=1)) for x in (q, d))
    if not q_norm.all():  # where all products are equal, the first rows of d are the best
        some, at = np.flatnonzero(q_norm), np.cumsum(q_norm > 0) - 1
        real = q_norm[own_rows] > 0
        out = [best(q[some], d, k, slack, (at[own_rows[real]], own_columns[real]))]
        out[0] = (some[out[0][0]], *out[0][1:])
        for r in np.flatnonzero(q_norm == 0):
            lo, hi = np.searchsorted(own_rows, (r, r + 1))
            c = np.setdiff1d(np.arange(min(m, k + hi - lo)), own_columns[lo:hi])[:k]
            out.append((np.full(len(c), r), c, np.zeros(len(c))))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
    usual = np.median(d_norm[d_norm > 0]) if d_norm.any() else 1.0
    largest = d_norm.max()
    single = _SINGLE[0] < usual and largest <= usual * _SPREAD and all(_SINGLE[0] < x < _SINGLE[1] for x in (q_norm.min(), q_norm.max(), largest))
    kind, unit = (np.float32, 2.0**-23) if single else (np.float64, 2.0**-52)
    left, right = q.astype(kind, copy=False), np.ascontiguousarray(d.astype(kind, copy=False).T)
    margins = 2 * (dim + 8) * unit * q_norm * largest + slack + 1e-30
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    room, marks = np.empty(ROWS * COLUMNS, dtype=kind), np.empty(ROWS * COLUMNS, dtype=bool)  # memory that is touched once

    def searched(begin: int, end: int) -> None:
        lo, hi = np.searchsorted(own_rows, (begin, end))
        mine_r, mine_c = own_rows[lo:hi] - begin, own_columns[lo:hi]
        by_column = np.argsort(mine_c, kind="stable")
        mine_r, mine_c = mine_r[by_column], mine_c[by_column]
        size, margin = end - begin, margins[begin:end]
        bar = np.full(size, -np.inf)
        held = (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=kind))
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        more = 0

        def gathered() -> None:
            nonlocal held, more
            r, c, s = (np.concatenate(x) for x in zip(held, *new, strict=True))
            order = np.lexsort((-s, r))
            r, c, s = r[order], c[order], s[order]
            starts = np.searchsorted(r, np.arange(size + 1))
            full = np.flatnonzero(np.diff(starts) >= k)
            bar[full] = np.fmax(bar[full], s[starts[full] + k - 1] - margin[full])
            stay = s >= bar[r]
            held, more = (r[stay], c[stay], s[stay]), 0
            new.clear()

        at = 0
        while at < m:
            to = min(m, at + (COLUMNS if at else FIRST))
            s = np.matmul(left[begin:end], right[:, at:to], out=room[: size * (to - at)].reshape(size, to - at))
            a, b = np.searchsorted(mine_c, (at, to))
            s[mine_r[a:b], mine_c[a:b] - at] = -np.inf
            if not at and to > k:
                bar = np.fmax(np.partition(s, to - k, axis=1)[:, to - k] - margin, -np.inf)
            # the bar in the products' own precision, rounded down
            low = np.nextafter(bar.astype(kind), kind(-np.inf))
            hit = marks[: size * (-(-(to - at) // 8) * 8)].reshape(size, -1)
            hit[:, to - at :] = False
            np.greater_equal(s, low[:, None], out=hit[:, : to - at])
            words = np.flatnonzero(hit.reshape(-1).view(np.uint64))
            bits = np.flatnonzero(hit.reshape(-1, 8)[words])
            flat = words[bits >> 3] * 8 + (bits & 7)
            r, c = np.divmod(flat, hit.shape[1])
            value = s[r, c]
            if not np.isfinite(value).all():
                real = value > -np.inf
                r, c, value = r[real], c[real], value[real]
            new.append((r.astype(np.int32), (c + at).astype(np.int32), value))
            more += len(r)
            if more > max(6 * k, 32) * size or len(held[0]) + more > MOST_HELD:
                gathered()
                if len(held[0]) > MOST_HELD // 2 and size > 1:
                    searched(begin, (begin + end) // 2), searched((begin + end) // 2, end)
                    return
            at = to
        gathered()
        r, c, _ = held
        r = r.astype(np.int64) + begin
        exact = products(q, d, r, c)
        real = np.isfinite(exact)
        r, c, exact = r[real], c[real], exact[real]
        order = np.lexsort((c, -exact, r))
        r, c, exact = r[order], c[order].astype(np.int64), exact[order]
        starts = np.searchsorted(r, np.arange(begin, end + 1))
        full = np.diff(starts) >= k
        least = np.full(size, -np.inf)
        least[full] = exact[starts[:-1][full] + k - 1] - slack
        stay = exact >= least[r - begin]
        for i in np.flatnonzero(np.diff(starts) > 4 * k):  # many that are nearly equal: of those the first rows of d are enough
            part = slice(starts[i], starts[i + 1])
            stay[part] &= ~_beaten(c[part], k)
        found.append((r[stay], c[stay], exact[stay]))

    for begin in range(0, n, ROWS):
        searched(begin, min(n, begin + ROWS))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
