"""Alignment recurrences over batches of profile pairs of one shape.

Scores are kept in whole millionths, so sums are exact and ties fall the same
way whatever the order of summation.  Each function takes the column scores
``s[pairs, w1, w2]`` and returns ``(score, end_i, end_j, steps)`` per pair, where
``steps[pairs, w1 + 1, w2 + 1]`` says where the best path into a cell came from
(0 diagonal, 1 from above, 2 from the left, 3 start).
"""

from __future__ import annotations

import numpy as np

UNIT = 1_000_000
MIN_OVERLAP = 3  # fixed value: shortest end-to-end overlap
DIAGONAL, UP, LEFT, START = 0, 1, 2, 3
FAR = -(1 << 60)


def units(x) -> np.ndarray:
    return np.rint(np.asarray(x, float) * UNIT).astype(np.int64)


def _better(found, i, j, value, allowed=True, ties=False):
    """Moves the running best to cell (i, j) where ``value`` beats it."""
    score, end_i, end_j = found
    won = ((value >= score) if ties else (value > score)) & allowed
    score[won], end_i[won], end_j[won] = value[won], i, j


def _start(n, low):
    return np.full(n, low, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32)


def ungapped(s):
    """Best contiguous run on any diagonal, restarted when the running score is not positive."""
    n, w1, w2 = s.shape
    m = np.zeros((n, w1 + 1, w2 + 1), np.int64)
    steps = np.full((n, w1 + 1, w2 + 1), START, np.int8)
    found = _start(n, -1)
    for i in range(1, w1 + 1):
        m[:, i, 1:] = np.maximum(0, m[:, i - 1, :-1] + s[:, i - 1, :])
        steps[:, i, 1:] = np.where(m[:, i, 1:] > 0, DIAGONAL, START)
        for j in range(1, w2 + 1):
            _better(found, i, j, m[:, i, j])
    return *found, steps


def contained(s):
    """Best mean column score over the diagonals that cover the whole shorter profile."""
    n, w1, w2 = s.shape
    short = min(w1, w2)
    steps = np.full((n, w1 + 1, w2 + 1), START, np.int8)
    found = _start(n, FAR)
    for shift in range(abs(w1 - w2) + 1):
        di, dj = (shift, 0) if w1 >= w2 else (0, shift)
        whole = sum(s[:, di + t, dj + t] for t in range(short))
        _better(found, di + short, dj + short, whole)
    steps[:, 1:, 1:] = DIAGONAL
    return found[0] // short, found[1], found[2], steps


def scan(s, gap_open=3.0, gap_extend=0.01):
    """One gap run at most: aligned, then an insertion or deletion, then aligned to the end."""
    n, w1, w2 = s.shape
    opened, extended = units(gap_open), units(gap_extend)
    shape = (n, w1 + 1, w2 + 1)
    f, ins, dele, tail = (np.zeros(shape, np.int64) for _ in range(4))
    found = _start(n, 0)
    states = np.zeros(n, np.int8)
    for i in range(1, w1 + 1):
        for j in range(1, w2 + 1):
            cell = s[:, i - 1, j - 1]
            f[:, i, j] = f[:, i - 1, j - 1] + cell
            ins[:, i, j] = np.maximum(f[:, i - 1, j] - opened, ins[:, i - 1, j] - extended)
            dele[:, i, j] = np.maximum(f[:, i, j - 1] - opened, dele[:, i, j - 1] - extended)
            tail[:, i, j] = cell + np.maximum(np.maximum(ins[:, i - 1, j - 1], dele[:, i - 1, j - 1]), tail[:, i - 1, j - 1])
            for state, table, ties in ((0, f, True), (1, ins, True), (2, dele, True), (3, tail, False)):
                value = table[:, i, j]
                won = (value >= found[0]) if ties else (value > found[0])
                states[won] = state
                _better(found, i, j, value, True, ties)
    steps = _scan_path(found, states, f, ins, dele, tail, opened)
    return *found, steps


def _scan_path(found, state, f, ins, dele, tail, opened):
    """Marks the cells of the best paths with the step that entered them."""
    steps = np.full(f.shape, START, np.int8)
    rows = np.arange(len(state))
    i, j = found[1].astype(int), found[2].astype(int)
    while True:
        live = (i > 0) & (j > 0)
        if not live.any():
            return steps
        r, y, x, now = rows[live], i[live], j[live], state[live]
        steps[r, y, x] = np.select([now == 1, now == 2], [UP, LEFT], DIAGONAL)
        up, left = np.where(now == 2, y, y - 1), np.where(now == 1, x, x - 1)
        a, b, c = ins[r, up, left], dele[r, up, left], tail[r, up, left]
        after_gap = np.where((a >= b) & (a >= c), 1, np.where((b >= a) & (b >= c), 2, 3))
        opens = np.where(now == 1, ins[r, y, x], dele[r, y, x]) == f[r, up, left] - opened
        state[live] = np.select([now == 0, now == 3], [0, after_gap], np.where(opens, 0, now))
        i[live], j[live] = up, left


def linear_gap(s, gap_open=1.0, overlap=True):
    """One cost per gapped column; ``overlap`` keeps only alignments that reach an end of a profile."""
    n, w1, w2 = s.shape
    cost = units(gap_open)
    m = np.zeros((n, w1 + 1, w2 + 1), np.int64)
    steps = np.full(m.shape, START, np.int8)
    found = _start(n, FAR)
    for i in range(1, w1 + 1):
        for j in range(1, w2 + 1):
            best = m[:, i - 1, j - 1] + s[:, i - 1, j - 1]
            step = np.zeros(n, np.int8)
            for value, name in ((m[:, i - 1, j] - cost, UP), (m[:, i, j - 1] - cost, LEFT)):
                step = np.where(value > best, name, step)
                best = np.maximum(value, best)
            if not overlap:
                step = np.where(best < 0, START, step)
                best = np.maximum(best, 0)
            m[:, i, j], steps[:, i, j] = best, step
            ends = (i == w1 and j >= MIN_OVERLAP) or (j == w2 and i >= MIN_OVERLAP)
            if not overlap or ends:
                _better(found, i, j, best)
    return *found, steps


def affine(s, gap_open=1.0, gap_extend=0.5, overlap=True, whole=False):
    """Affine gaps.  ``whole`` aligns end to end; else local, or ``overlap`` to an end of a profile."""
    n, w1, w2 = s.shape
    opened, extended = units(gap_open), units(gap_extend)
    shape = (n, w1 + 1, w2 + 1)
    m, x, y = (np.zeros(shape, np.int64) for _ in range(3))
    steps = np.full(shape, START, np.int8)
    if whole:
        for k in range(1, max(w1, w2) + 1):
            edge = -(opened + (k - 1) * extended)
            for t in (m, x, y):
                if k <= w1:
                    t[:, k, 0] = edge
                if k <= w2:
                    t[:, 0, k] = edge
        steps[:, 1:, 0], steps[:, 0, 1:] = UP, LEFT
    found = _start(n, FAR)
    best = np.zeros(n, np.int64)
    for i in range(1, w1 + 1):
        for j in range(1, w2 + 1):
            before = np.maximum(np.maximum(m[:, i - 1, j - 1], x[:, i - 1, j - 1]), y[:, i - 1, j - 1])
            m[:, i, j] = before + s[:, i - 1, j - 1]
            x[:, i, j] = m[:, i - 1, j] - opened
            if i > 1:
                x[:, i, j] = np.maximum(x[:, i, j], x[:, i - 1, j] - extended)
            y[:, i, j] = m[:, i, j - 1] - opened
            if j > 1:
                y[:, i, j] = np.maximum(y[:, i, j], y[:, i, j - 1] - extended)
            best = m[:, i, j].copy()
            step = np.zeros(n, np.int8)
            for value, name in ((x[:, i, j], UP), (y[:, i, j], LEFT)):
                step = np.where(value > best, name, step)
                best = np.maximum(value, best)
            if not overlap and not whole:
                step = np.where(best <= 0, START, step)
                m[:, i, j] = np.maximum(m[:, i, j], 0)
            steps[:, i, j] = step
            ends = (i == w1 and j >= MIN_OVERLAP) or (j == w2 and i >= MIN_OVERLAP)
            if not whole and (not overlap or ends):
                _better(found, i, j, best)
    if whole:
        found = best, np.full(n, w1, np.int32), np.full(n, w2, np.int32)
    return *found, steps


METHODS = {
    "contained": contained,
    "ungapped": ungapped,
    "scan": scan,
    "sw": linear_gap,
    "nw": lambda s, **options: affine(s, whole=True, **options),
    "swa": affine,
}


def walk(end_i: np.ndarray, end_j: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Aligned index pairs of all paths, last first: two arrays ``[pairs, steps]``.

    Indices are 1-based, 0 for a gap, -1 beyond the start of a path.
    """
    rows = np.arange(len(end_i))
    i, j = end_i.astype(int), end_j.astype(int)
    seen_i, seen_j = [], []
    while True:
        step = steps[rows, i, j]
        live = (step != START) & ((i > 0) | (j > 0))
        if not live.any():
            shape = (0, len(rows))
            return np.array(seen_i or np.empty(shape)).T, np.array(seen_j or np.empty(shape)).T
        seen_i.append(np.where(live, np.where(step == LEFT, 0, i), -1))
        seen_j.append(np.where(live, np.where(step == UP, 0, j), -1))
        i = np.where(live & (step != LEFT), i - 1, i)
        j = np.where(live & (step != UP), j - 1, j)
