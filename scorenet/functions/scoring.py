"""Scores from p-values, and statistics of scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _unit(name: str, x: float) -> None:
    if not 0.0 <= x <= 1.0:
        raise ValueError(f"{name} must lie in [0, 1], not {x}")


def log_of(p: Column) -> Column:
    """Natural logarithm with minus infinity at zero and nan below it, where Spark's is null."""
    return F.when(p == 0, F.lit(float("-inf"))).when(p < 0, F.lit(float("nan"))).otherwise(F.ln(p))


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many digits as SQL engines round doubles: half away from zero once multiplied, the sign
    of zero kept. Spark's own rounds the shortest decimal text of ``x``, which differs near halves."""
    unit = 10.0**digits
    y = F.abs(x) * unit
    low = F.floor(y).cast("double")
    near = F.signum(x) * F.when(y - low >= 0.5, low + 1.0).otherwise(low) / unit
    return F.when(F.isnan(x) | (y >= 2.0**52), F.when(y < 2.0**1000, F.signum(x) * (y / unit)).otherwise(x)).otherwise(near)


def score_tau(p: Column, tau: float) -> Column:
    """-ln p + ln tau: positive just for p below tau; infinite for p = 0."""
    _unit("tau", tau)
    return -log_of(p) + F.lit(math.log(tau) if tau else -math.inf)


def bum_threshold(lam: float, a: float, fdr: float) -> float:
    """The p-value at which a beta-uniform mixture (lambda, a) reaches the false discovery rate; nan
    where the formula has no value."""
    for name, x in (("lambda", lam), ("a", a), ("FDR", fdr)):
        _unit(name, x)
    try:
        return ((lam + (1 - lam) * a - fdr * lam) / (fdr * (1 - lam))) ** (1 / (a - 1))
    except ZeroDivisionError:
        return math.nan


def score_bum(p: Column, lam: float, a: float, fdr: float) -> Column:
    """(a - 1) (ln p - ln tau) with tau of ``bum_threshold``."""
    tau = bum_threshold(lam, a, fdr)
    return F.lit(a - 1.0) * (log_of(p) - F.lit(math.log(tau) if tau > 0 else math.nan))


def sign_stats(nodes: DataFrame, score: str = "score") -> DataFrame:
    """(n_positive, n_negative, positive_fraction); a score of zero is not positive."""
    pos, n = F.count_if(F.col(score) > 0), F.count(score)
    return nodes.agg(pos.alias("n_positive"), (n - pos).alias("n_negative"), (pos / n).alias("positive_fraction"))


def all_negative(nodes: DataFrame) -> DataFrame:
    """(all_negative): whether no node has a positive score."""
    return nodes.agg((~F.coalesce(F.bool_or(F.col("score") > 0), F.lit(False))).alias("all_negative"))


def lower_bound(nodes: DataFrame) -> DataFrame:
    """(lower_bound): the best single node, or zero."""
    return nodes.agg(F.greatest(F.coalesce(F.max("score"), F.lit(0)), F.lit(0)).alias("lower_bound"))


def min_max_scaled(nodes: DataFrame) -> DataFrame:
    """nodes with ``norm``: the score between the least (0) and the greatest (1); 0 if all are equal."""
    ends = F.broadcast(nodes.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi")))  # one row
    span = F.col("_hi") - F.col("_lo")
    return nodes.join(ends).select(*nodes.columns, F.when(span == 0, F.lit(0.0)).otherwise((F.col("score") - F.col("_lo")) / span).alias("norm"))
