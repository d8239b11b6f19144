"""Special functions that Spark SQL lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SHIFT = 8


def lgamma_sql(x: str) -> str:
    """SQL text of log gamma for a positive argument: shifted Stirling series."""
    y = f"({x} + {SHIFT})"
    rising = " * ".join(f"({x} + {k})" for k in range(SHIFT))
    tail = f"(1 / 12D - (1 / 360D - (1 / 1260D - (1 / 1680D - 1 / 1188D / {y} / {y}) / {y} / {y}) / {y} / {y}) / {y} / {y}) / {y}"
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + {tail} - ln({rising}))"


def lgamma_array(x: np.ndarray) -> np.ndarray:
    y = x + SHIFT
    z = 1 / (y * y)
    tail = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - sum(np.log(x + k) for k in range(SHIFT))


def digamma_array(x: np.ndarray) -> np.ndarray:
    y = x + SHIFT
    z = 1 / (y * y)
    tail = z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    return np.log(y) - 0.5 / y - tail - sum(1 / (x + k) for k in range(SHIFT))


def erfc_array(x: np.ndarray) -> np.ndarray:
    """Complementary error function: a series near zero, a continued fraction further out."""
    a = np.abs(np.asarray(x, float))
    small, large = np.minimum(a, 2.5), np.maximum(a, 2.5)
    term, total = small, small
    for n in range(1, 60):
        term = term * (2 * small * small / (2 * n + 1))
        total = total + term
    near = 1 - 2 / math.sqrt(math.pi) * np.exp(-small * small) * total
    fraction = large
    for k in range(80, 0, -1):
        fraction = large + (k / 2) / fraction
    far = np.exp(-large * large) / (math.sqrt(math.pi) * fraction)
    tail = np.where(a < 2.5, near, far)
    return np.where(x < 0, 2 - tail, tail)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * erfc_array(-np.asarray(z, float) / math.sqrt(2)) if len(z) else np.zeros(0)


def chi2_tail_3df(x: np.ndarray) -> np.ndarray:
    """``1 - CDF`` of the chi-square distribution with 3 degrees of freedom."""
    x = np.asarray(x, float)
    if x.size == 0:
        return x
    return erfc_array(np.sqrt(x / 2)) + np.sqrt(2 * x / math.pi) * np.exp(-x / 2)


@F.pandas_udf(DoubleType())
def normal_cdf_udf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf(z.to_numpy()))


@F.pandas_udf(DoubleType())
def chi2_tail_udf(x: pd.Series) -> pd.Series:
    return pd.Series(chi2_tail_3df(x.to_numpy()))
