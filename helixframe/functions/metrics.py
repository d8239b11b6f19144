"""Column metrics: similarity of two profile columns.

Each metric exists as a Spark expression over four scalar columns per side and
as an array function for the pair kernels; ``METRICS`` names them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, functions as F

from helixframe.functions.special import chi2_tail_3df, chi2_tail_udf

Cells = Sequence[Column]
# Score of an empty column and the floor of the limited variant.
ALLR_EMPTY, ALLR_FLOOR = -15.0, -2.0


def _sum(terms) -> Column:
    return reduce(add, terms)


def pcc(f1: Cells, f2: Cells) -> Column:
    """Pearson correlation; 0 for a zero numerator, -1 when a side is empty."""
    m1, m2 = _sum(f1) / 4, _sum(f2) / 4
    num = _sum([(x - m1) * (y - m2) for x, y in zip(f1, f2)])
    d1, d2 = _sum([(x - m1) * (x - m1) for x in f1]), _sum([(y - m2) * (y - m2) for y in f2])
    return F.when((m1 == 0) | (m2 == 0), -1.0).when((num == 0) | (d1 * d2 == 0), 0.0).otherwise(num / F.sqrt(d1 * d2))


def allr(n1: Cells, w1: Cells, n2: Cells, w2: Cells) -> Column:
    """Average log-likelihood ratio from counts and log-odds of both sides."""
    whole = _sum([x + y for x, y in zip(n1, n2)])
    ratio = (_sum([y * w for y, w in zip(n2, w1)]) + _sum([x * w for x, w in zip(n1, w2)])) / F.nullif(whole, F.lit(0.0))
    return F.coalesce(ratio, F.lit(ALLR_EMPTY))


def allr_ll(n1: Cells, w1: Cells, n2: Cells, w2: Cells) -> Column:
    return F.greatest(allr(n1, w1, n2, w2), F.lit(ALLR_FLOOR))


def chi2_statistic(n1: Cells, n2: Cells) -> Column:
    t1, t2 = _sum(n1), _sum(n2)
    parts = []
    for x, y in zip(n1, n2):
        both = (x + 1 + y + 1) / (t1 + t2 + 8)
        e1, e2 = (t1 + 4) * both, (t2 + 4) * both
        parts.append((x + 1 - e1) * (x + 1 - e1) / e1 + (y + 1 - e2) * (y + 1 - e2) / e2)
    return _sum(parts)


def chi2(n1: Cells, n2: Cells) -> Column:
    return chi2_tail_udf(chi2_statistic(n1, n2))


def ssd(f1: Cells, f2: Cells) -> Column:
    return F.lit(2.0) - _sum([(x - y) * (x - y) for x, y in zip(f1, f2)])


def kl(f1: Cells, f2: Cells) -> Column:
    """10 minus the mean Kullback-Leibler divergence; cells with a zero are skipped."""

    def term(x: Column, y: Column) -> Column:
        return F.when((x == 0) | (y == 0), 0.0).otherwise(x * F.log(x / y) + y * F.log(y / x))

    return F.lit(10.0) - _sum([term(x, y) for x, y in zip(f1, f2)]) / 2


def _pcc_grid(p, q):
    f1, f2 = p["f"][:, :, None, :], q["f"][:, None, :, :]
    d1, d2 = f1 - f1.mean(-1, keepdims=True), f2 - f2.mean(-1, keepdims=True)
    num = (d1 * d2).sum(-1)
    den = np.sqrt((d1 * d1).sum(-1) * (d2 * d2).sum(-1))
    out = np.divide(num, den, out=np.zeros_like(num), where=den > 0)
    empty = (f1.sum(-1) == 0) | (f2.sum(-1) == 0)
    return np.where(empty, -1.0, out)


def _allr_grid(p, q):
    n1, n2 = p["n"][:, :, None, :], q["n"][:, None, :, :]
    w1, w2 = np.log2(p["f"] / 0.25)[:, :, None, :], np.log2(q["f"] / 0.25)[:, None, :, :]
    whole = (n1 + n2).sum(-1)
    num = (n2 * w1).sum(-1) + (n1 * w2).sum(-1)
    return np.where(whole == 0, ALLR_EMPTY, num / np.where(whole == 0, 1, whole))


def _chi2_grid(p, q):
    n1, n2 = p["n"][:, :, None, :] + 1, q["n"][:, None, :, :] + 1
    t1, t2 = n1.sum(-1, keepdims=True), n2.sum(-1, keepdims=True)
    both = (n1 + n2) / (t1 + t2)
    x = ((n1 - t1 * both) ** 2 / (t1 * both) + (n2 - t2 * both) ** 2 / (t2 * both)).sum(-1)
    return chi2_tail_3df(x)


def _ssd_grid(p, q):
    return 2 - ((p["f"][:, :, None, :] - q["f"][:, None, :, :]) ** 2).sum(-1)


def _kl_grid(p, q):
    f1, f2 = np.broadcast_arrays(p["f"][:, :, None, :], q["f"][:, None, :, :])
    ok = (f1 > 0) & (f2 > 0)
    a, b = np.where(ok, f1, 1.0), np.where(ok, f2, 1.0)
    return 10 - np.where(ok, a * np.log(a / b) + b * np.log(b / a), 0).sum(-1) / 2


# Grid functions take packed profiles {"f": [pairs, width, 4], "n": ...} and give
# scores [pairs, width1, width2].
METRICS: dict[str, Callable] = {
    "pcc": _pcc_grid,
    "allr": _allr_grid,
    "allr_ll": lambda p, q: np.maximum(_allr_grid(p, q), ALLR_FLOOR),
    "chi2": _chi2_grid,
    "ssd": _ssd_grid,
    "kl": _kl_grid,
}
