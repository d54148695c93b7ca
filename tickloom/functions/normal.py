"""Normal distribution in closed form and as vectorised functions."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_N = NormalDist()


@F.pandas_udf(T.DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: _N.cdf(v) if pd.notna(v) else None).astype("float64")


@F.pandas_udf(T.DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return p.map(lambda v: _N.inv_cdf(v) if pd.notna(v) and 0 < v < 1 else None).astype("float64")


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.sqrt(F.lit(2) * F.pi())


def ppf(p: float) -> float:
    """Quantile of a constant, on the driver."""
    return _N.inv_cdf(p)


def chi2_sf_even(x: Column, df: int) -> Column:
    """Upper tail of chi-squared with an even number of degrees: a Poisson sum."""
    term = out = F.lit(1.0)
    for k in range(1, df // 2):
        term = term * (x / 2) / k
        out = out + term
    return F.exp(-x / 2) * out
