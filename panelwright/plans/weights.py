"""Weights of holdings by named methods, and caps on them.

Holdings are (date, code), returns (date, code, ret). Methods that weigh a covariance solve one rebalance in
one group, of the few names that are held on its date.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators import ts

#: Rows of past returns, half-life of their weights in rows, and how far the covariance is drawn to its diagonal.
PAST, HALF_LIFE, SHRINK = 30, 20, 0.3


def by_date():
    return Window.partitionBy("date")


def equal(held: DataFrame, returns: DataFrame) -> DataFrame:
    return held.select("date", "code", (1 / F.count("*").over(by_date())).alias("weight"))


def inverse_volatility(held: DataFrame, returns: DataFrame, past: int = PAST, least: int = 20) -> DataFrame:
    """In proportion to one over the deviation of the last returns; names without one are left out."""
    sd = returns.select("date", "code", ts.rolling("ret", past, "stddev_pop", least).alias("sd"))
    d = held.join(sd, ["date", "code"]).where("sd > 0")
    return d.select("date", "code", (1 / F.col("sd") / F.sum(1 / F.col("sd")).over(by_date())).alias("weight"))


def covariance(x: np.ndarray, half_life: int = HALF_LIFE) -> np.ndarray:
    """Of rows of returns by time, the newest last and heaviest."""
    t, n = x.shape
    if t < 2:
        return np.eye(n)
    w = 0.5 ** (np.arange(t - 1, -1, -1) / half_life)
    w /= w.sum()
    r = x - w @ x
    return (r * w[:, None]).T @ r


def least_variance(c: np.ndarray, shrink: float = SHRINK) -> np.ndarray:
    """Solution of least variance on the shrunk covariance, negative weights cut; equal weights where nothing is left."""
    c = (1 - shrink) * c + shrink * np.diag(np.diag(c))
    try:
        w = np.linalg.solve(c, np.ones(len(c)))
        w = np.clip(w / w.sum(), 0, None)
    except np.linalg.LinAlgError:
        w = np.zeros(len(c))
    return w / w.sum() if w.sum() > 1e-12 else np.full(len(c), 1 / len(c))


def equal_risk(c: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Multiplicative steps to weights of equal risk contributions."""
    w = np.full(len(c), 1 / len(c))
    for _ in range(rounds):
        risk = np.maximum(w * (c @ w), 1e-12)
        w = w * np.sqrt(max(risk.mean(), 1e-12) / risk)
        w /= w.sum()
    return w


def _solved(solve: Callable[[np.ndarray], np.ndarray]):
    def weigh(held: DataFrame, returns: DataFrame, past: int = PAST) -> DataFrame:
        last = returns.where("ret is not null").select("date", "code", F.collect_list("ret").over(ts.rows(1 - past)).alias("last"))

        def one(pdf):
            import pandas as pd

            pdf = pdf.sort_values("code")
            n = min(map(len, pdf["last"]))
            w = solve(covariance(np.array([v[len(v) - n :] for v in pdf["last"]], float).T))
            return pd.DataFrame({"date": pdf["date"], "code": pdf["code"], "weight": w})

        return held.join(last, ["date", "code"]).groupBy("date").applyInPandas(one, "date date, code string, weight double")

    return weigh


#: Weight methods by name.
METHODS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"equal": equal, "inverse_vol": inverse_volatility, "min_var": _solved(least_variance), "risk_parity": _solved(equal_risk)}


def weights(method: str, held: DataFrame, returns: DataFrame) -> DataFrame:
    """date, code, weight by the named method; a name without past returns has none where the method needs them."""
    if method not in METHODS:
        raise ValueError(f"no weight method {method}; there are {sorted(METHODS)}")
    return METHODS[method](held, returns)


def capped(weights: DataFrame, cap: float, rounds: int = 20) -> DataFrame:
    """Weights with none above cap: what is cut goes to the others in proportion, round after round."""
    w = by_date()
    for _ in range(rounds):
        over = F.col("weight") >= cap - 1e-12
        room = F.sum(F.when(~over, F.col("weight"))).over(w)
        excess = F.sum(F.when(over, F.col("weight") - cap)).over(w)
        weights = weights.withColumn("weight", F.when(over, F.lit(cap)).when(room > 0, F.col("weight") * (1 + F.coalesce(excess, F.lit(0.0)) / room)).otherwise(F.col("weight")))
    return weights


def group_capped(weights: DataFrame, group: str, cap: float, rounds: int = 10) -> DataFrame:
    """Weights whose groups are scaled down to the cap's share and then to a sum of 1, round after round."""
    g, w = Window.partitionBy("date", group), by_date()
    for _ in range(rounds):
        weights = weights.withColumn("weight", F.col("weight") * F.least(F.lit(1.0), cap * F.sum("weight").over(w) / F.sum("weight").over(g)))
        weights = weights.withColumn("weight", F.col("weight") / F.sum("weight").over(w))
    return weights
