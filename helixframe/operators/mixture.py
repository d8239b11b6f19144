"""Dirichlet-mixture prior over count columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from helixframe.functions.special import digamma_array, lgamma_array, lgamma_sql
from helixframe.operators.profiles import BASES
from helixframe.session import cut_lineage


@dataclass
class Component:
    """One mixture component: its share and its four Dirichlet parameters."""

    share: float
    alpha: tuple[float, float, float, float]


def log_weights(columns: DataFrame, components: DataFrame) -> DataFrame:
    """Joint log weight of every column row with every component ``(k, pmix, a_a, a_c, a_g, a_t)``.

    The components ride along as one array value, so no row is shuffled for them;
    the part that does not depend on the row is worked out once per component.
    """
    whole = "a_a + a_c + a_g + a_t"
    fixed = " - ".join([f"ln(pmix) + {lgamma_sql(f'({whole})')}", *[lgamma_sql(f"a_{b}") for b in BASES]])
    prepared = components.select("k", "pmix", *[f"a_{b}" for b in BASES], F.expr(f"({whole})").alias("whole"), F.expr(fixed).alias("fixed"))
    packed = prepared.agg(F.array_sort(F.collect_list(F.struct("*"))))
    cells = " + ".join(lgamma_sql(f"({b} + m.a_{b})") for b in BASES)
    weight = f"transform(_mix, m -> m.fixed + {cells} - {lgamma_sql('(a + c + g + t + m.whole)')})"
    return columns.withColumn("_mix", packed.scalar()).withColumn("_lw", F.expr(weight))


def responsibilities(columns: DataFrame, components: DataFrame) -> DataFrame:
    """``gamma`` per row and component, and the row's log-likelihood ``ll``."""
    weighed = log_weights(columns, components)
    top = F.array_max("_lw")
    spread = F.aggregate("_lw", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    lse = weighed.withColumn("ll", top + F.log(spread))
    return lse.select(
        *columns.columns, "ll", F.inline(F.arrays_zip(F.col("_mix").alias("m"), F.col("_lw").alias("lw")))
    ).select(*columns.columns, "ll", "m.k", F.exp(F.col("lw") - F.col("ll")).alias("gamma"))


def fit(counts: DataFrame, start: list[Component], max_rounds: int = 10_000, min_gain: float = 1e-6,
        floor: float = 1e-8) -> tuple[list[Component], list[float]]:
    """Expectation maximisation until a round gains at most ``min_gain`` of log-likelihood.

    Equal count columns are folded into one weighted row first.  Each round adds
    up per-partition sums, so only one short row per component and partition
    leaves a task.  After two rounds the parameters are carried on along their
    path, and the jump is kept if it raises the likelihood; that leads to the
    same place in far fewer rounds.
    """
    folded = cut_lineage(counts.groupBy(*BASES).agg(F.count(F.lit(1)).cast("double").alias("w")))
    rows = folded.agg(F.sum("w")).first()[0]
    history: list[float] = []

    def step(mix: list[Component]) -> tuple[float, list[Component]]:
        # A round is one stage: the short rows of the tasks are added up here.
        parts = folded.mapInPandas(partial(_partial_sums, mix), SUMS).collect()
        found = [{n: sum(r[n] for r in parts if r["k"] == k) for n in SUM_NAMES} for k in range(len(mix))]
        better = [
            Component(
                s["resp"] / rows,
                tuple(max(a * s[f"num_{b}"] / s["den"], floor) for a, b in zip(c.alpha, BASES)),
            )
            for c, s in zip(mix, found)
        ]
        return found[0]["ll"], better

    mix, done = list(start), 0
    while done < max_rounds:
        begin = mix
        for _ in range(2):
            ll, mix = step(previous := mix)
            history.append(ll)
        done += 3
        if history[-1] - history[-2] <= min_gain:
            break
        ll, after = step(_carried_on(begin, previous, mix, floor))
        if ll >= history[-1]:
            history.append(ll)
            mix = after
    return mix, history


def _carried_on(a: list[Component], b: list[Component], c: list[Component], floor: float) -> list[Component]:
    """Extrapolation of three successive estimates, on the logarithms of their parameters."""
    x, y, z = (np.log(np.maximum([[m.share, *m.alpha] for m in mix], floor)) for mix in (a, b, c))
    move, bend = y - x, (z - y) - (y - x)
    turn = np.linalg.norm(bend)
    reach = max(1.0, np.linalg.norm(move) / turn) if turn > 0 else 1.0
    far = np.exp(np.clip(x + 2 * reach * move + reach * reach * bend, np.log(floor), 25.0))
    shares = far[:, 0] / far[:, 0].sum()
    return [Component(float(s), tuple(map(float, row[1:]))) for s, row in zip(shares, far)]


SUM_NAMES = ["resp", *[f"num_{b}" for b in BASES], "den", "ll"]
SUMS = "k int, " + ", ".join(f"{name} double" for name in SUM_NAMES)


def _partial_sums(mix: list[Component], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    alpha = np.array([c.alpha for c in mix])
    whole = alpha.sum(1)
    constant = np.log([c.share for c in mix]) + lgamma_array(whole) - lgamma_array(alpha).sum(1)
    sums = np.zeros((len(mix), len(SUM_NAMES)))
    for batch in batches:
        n, w = batch[list(BASES)].to_numpy(float), batch["w"].to_numpy(float)
        cells = n[:, None, :] + alpha[None]
        depth = n.sum(1)[:, None] + whole[None]
        weight = constant + lgamma_array(cells).sum(2) - lgamma_array(depth)
        top = weight.max(1, keepdims=True)
        ll = top[:, 0] + np.log(np.exp(weight - top).sum(1))
        resp = np.exp(weight - ll[:, None]) * w[:, None]
        sums[:, 0] += resp.sum(0)
        sums[:, 1:5] += (resp[:, :, None] * (digamma_array(cells) - digamma_array(alpha)[None])).sum(0)
        sums[:, 5] += (resp * (digamma_array(depth) - digamma_array(whole)[None])).sum(0)
        sums[:, 6] += (ll * w).sum()
    out = pd.DataFrame(sums, columns=SUM_NAMES)
    out.insert(0, "k", np.arange(len(mix), dtype="int32"))
    yield out
