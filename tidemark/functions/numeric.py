"""Rounding, ladders, ranks and distributions as column expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def js_to_fixed(digits: int):
    """A pandas UDF that rounds the exact binary value half up in magnitude; for output only, it leaves codegen."""
    step = Decimal(1).scaleb(-digits)

    @F.pandas_udf("double")
    def fixed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else float(Decimal(float(v)).quantize(step, ROUND_HALF_UP)))

    return fixed


def js_round(x: Column) -> Column:
    """Half toward plus infinity."""
    return F.floor(x + 0.5)


def ladder(x: Column, steps: list[tuple[str, float, str]], otherwise: str | None = None) -> Column:
    """The label of the first step (operator, threshold, label) that holds; operators: >, >=, <, <=."""
    out = F.lit(otherwise)
    for op, at, label in reversed(steps):
        holds = {">": x > at, ">=": x >= at, "<": x < at, "<=": x <= at}[op]
        out = F.when(holds, F.lit(label)).otherwise(out)
    return out


def over(a: Column, b: Column) -> Column:
    """a / b with a zero divisor taken as one."""
    return a / F.greatest(b, F.lit(1))


def mid_rank(value: str, *groups: str) -> Column:
    """Rank from 1 in ascending order, ties sharing their mean."""
    by = Window.partitionBy(*groups)
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(Window.partitionBy(*groups, value)) - 1) / 2


def pearson(x: str, y: str) -> Column:
    """From sums, with 0 where a side does not vary; an aggregate expression."""
    a, b, n = F.col(x).cast("double"), F.col(y).cast("double"), F.count(F.lit(1))
    cov = n * F.sum(a * b) - F.sum(a) * F.sum(b)
    va, vb = n * F.sum(a * a) - F.sum(a) * F.sum(a), n * F.sum(b * b) - F.sum(b) * F.sum(b)
    return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).otherwise(0.0)


def normal_cdf(z: Column, legacy: bool = False) -> Column:
    """Of the standard normal distribution, by a five-term polynomial; legacy leaves out the scaling by sqrt(2)."""
    x = F.abs(z) / (1.0 if legacy else 2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - series * F.exp(-x * x)
    return F.when(z >= 0, (1.0 + erf) / 2).otherwise((1.0 - erf) / 2)


def ranked(df: DataFrame, by: list, n: int) -> DataFrame:
    """The first n rows in an order; by must be total."""
    return df.orderBy(*by).limit(n)
