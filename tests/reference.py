"""Plain numpy references of the statistics."""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np

REL_TOL = 1e-7


def _log_fact_table(n: int) -> np.ndarray:
    """ln k! for k = 0..n; the running sum is kept in extended precision so the
    rounding error does not grow with n."""
    out = np.zeros(n + 1)
    if n:
        out[1:] = np.cumsum(np.log(np.arange(1, n + 1, dtype=np.longdouble)), dtype=np.longdouble)
    return out


def fisher_rx2_p(col1: Sequence[int], col2: Sequence[int]) -> float:
    """Exact p-value of an r x 2 table (plain numpy; used per group)."""
    x = np.asarray(col1, dtype=np.int64)
    y = np.asarray(col2, dtype=np.int64)
    rows = x + y
    keep = rows > 0
    x, rows = x[keep], rows[keep]
    if len(rows) < 2:
        return 1.0
    n, k = int(rows.sum()), int(x.sum())
    lf = _log_fact_table(n)

    def lchoose(nn, kk):
        return lf[nn] - lf[kk] - lf[nn - kk]

    obs = float(sum(lchoose(int(r), int(v)) for r, v in zip(rows, x)))
    # partial tables over all rows but the last: running first-column totals and
    # summed log terms, pruned to totals that can still reach k; the last row's
    # count is then fixed by the column total
    tot = np.zeros(1, dtype=np.int64)
    lsum = np.zeros(1)
    remaining = int(rows.sum())
    for r in rows[:-1]:
        r = int(r)
        remaining -= r
        vals = np.arange(r + 1, dtype=np.int64)
        nt = (tot[:, None] + vals[None, :]).ravel()
        nl = (lsum[:, None] + lchoose(r, vals)[None, :]).ravel()
        ok = (nt <= k) & (nt + remaining >= k)
        tot, lsum = nt[ok], nl[ok]
    last = int(rows[-1])
    x_last = k - tot
    ok = (x_last >= 0) & (x_last <= last)
    lsum = lsum[ok] + lchoose(last, x_last[ok])
    base = lchoose(n, k)
    sel = lsum <= obs + math.log1p(REL_TOL)
    return float(min(1.0, np.exp(lsum[sel] - base).sum()))
