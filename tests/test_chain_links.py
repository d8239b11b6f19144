"""Links of blocks that are looked up together."""

import numpy as np
import pyarrow as pa
import pytest

from helixframe.operators import chains


@pytest.mark.parametrize("spread", [500, 50_000])
def test_links_of_many_blocks_are_looked_up_at_once(monkeypatch, spread):
    rnd, calls = np.random.default_rng(3), []
    n = 1_500
    t_start, q_start, size = np.sort(rnd.integers(0, 20_000, n)), rnd.integers(0, spread, n), rnd.integers(1, 50, n)
    own = rnd.integers(100, 2_000, n).astype(float)
    rows = pa.table({"j": np.arange(n), "t_start": t_start, "t_end": t_start + size, "q_start": q_start, "q_end": q_start + size, "own": own, "best": np.full(n, np.nan)})
    costs = chains.gap_costs
    monkeypatch.setattr(chains, "gap_costs", lambda *a: calls.append(1) or costs(*a))
    monkeypatch.setattr(chains, "CANDIDATES", 100_000)
    got = chains._settle(rows, 1_000, "medium").to_pydict()
    assert 1 <= len(calls) < 50
    best = own.copy()
    for j in range(n):
        t_gap, q_gap = t_start[j] - t_start - size, q_start[j] - q_start - size
        near = np.flatnonzero((t_gap >= 0) & (t_gap <= 1_000) & (q_gap >= 0) & (q_gap <= 1_000))
        gain = best[near] - costs("medium", t_gap[near], q_gap[near])
        link = (None, 0.0)
        if len(near) and gain.max() > 0:
            at = near[gain == gain.max()].min()
            link = (at, costs("medium", t_gap[[at]], q_gap[[at]])[0])
            best[j] += gain.max()
        at = got["j"].index(j)
        assert (got["best"][at], (got["i"][at], got["cost"][at])) == (best[j], link)


def test_blocks_far_apart_on_the_query_are_not_looked_at(monkeypatch):
    """All blocks are in reach on the target, one in a thousand on the query."""
    rnd, calls = np.random.default_rng(5), []
    n = 1_500
    t_start, q_start = np.sort(rnd.integers(0, 1_000, n)), rnd.integers(-1_000_000, 1_000_000, n)
    rows = pa.table({"j": np.arange(n), "t_start": t_start, "t_end": t_start + 1, "q_start": q_start, "q_end": q_start + 1, "own": np.full(n, 5_000.0), "best": np.full(n, np.nan)})
    costs = chains.gap_costs
    monkeypatch.setattr(chains, "gap_costs", lambda *a: calls.append(1) or costs(*a))
    monkeypatch.setattr(chains, "CANDIDATES", 10_000)
    got = chains._settle(rows, 1_000, "loose").to_pydict()
    assert len(calls) <= 2
    best = np.full(n, 5_000.0)
    for j in range(n):
        t_gap, q_gap = t_start[j] - t_start - 1, q_start[j] - q_start - 1
        near = np.flatnonzero((t_gap >= 0) & (q_gap >= 0) & (q_gap <= 1_000))
        best[j] += max([0.0, *(best[near] - costs("loose", t_gap[near], q_gap[near]))])
    assert [b for _, b in sorted(zip(got["j"], got["best"]))] == best.tolist() and max(best) > 5_000


@pytest.mark.parametrize("gap", [0, 1, 7, 20])
def test_links_over_the_edges_of_cells(gap):
    """Query ends at every distance from the edge of a cell, on both sides of zero."""
    at = np.arange(-3 * gap - 5, 3 * gap + 6)
    n = len(at)
    rows = pa.table({"j": np.arange(n), "t_start": np.arange(n) * 2, "t_end": np.arange(n) * 2 + 1, "q_start": at, "q_end": at, "own": np.full(n, 10.0), "best": np.full(n, np.nan)})
    got = chains._settle(rows, 2 * n, 0.0).to_pydict()
    assert got["best"] == [10.0 * (i + 1) for i in range(n)]
    got = chains._settle(rows, gap, 0.0).to_pydict()
    best = []
    for j in range(n):
        best.append(10.0 + max([0.0, *(best[i] for i in range(j) if 0 <= 2 * j - 2 * i - 1 <= gap and at[j] - at[i] <= gap)]))
    assert got["best"] == best
