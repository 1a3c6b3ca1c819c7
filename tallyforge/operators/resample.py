"""Bootstrap intervals from sums: one method at every size.

A resample gives each unit (a row, or a cluster of rows) a Poisson(1) count, drawn from a hash
of the seed, the draw and the unit, so an interval depends neither on partitions nor on the
order of rows.  Each batch of units sends one row of sums per draw.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def _counts(units: np.ndarray, draw: int, seed: int) -> np.ndarray:
    x = units ^ np.uint64((draw * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F + 1) % 2**64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(33))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.searchsorted(_STEPS, u, "right")


def resampled_sums(units: DataFrame, unit: str, sums: list[str], draws: int, seed: int) -> np.ndarray:
    """draws x sums: the sums over the units of each resample (``unit``: one row each)."""

    def partial(batches):
        total = np.zeros((draws, len(sums)))
        seen = False
        for pdf in batches:
            seen = seen or len(pdf) > 0
            at, x = pdf["_u"].to_numpy().view(np.uint64), pdf[sums].to_numpy(float)
            for i in range(draws):
                total[i] += _counts(at, i, seed) @ x
        if seen:
            yield pd.DataFrame({"draw": np.arange(draws), **{c: total[:, j] for j, c in enumerate(sums)}})

    keyed = units.select(F.xxhash64(F.col(unit)).alias("_u"), *[F.col(c).cast("double").alias(c) for c in sums])
    schema = ", ".join(["draw long", *[f"`{c}` double" for c in sums]])
    out = np.zeros((draws, len(sums)))
    for r in keyed.mapInPandas(partial, schema).groupBy("draw").agg(*[F.sum(c).alias(c) for c in sums]).collect():  # draws rows
        out[r[0]] = r[1:]
    return out


def percentiles(values: np.ndarray) -> tuple[float, float]:
    values = values[np.isfinite(values)]
    return (float(np.percentile(values, 2.5)), float(np.percentile(values, 97.5))) if len(values) else (None, None)


def bootstrap_mean(df: DataFrame, value: str, unit: str, cluster: str | None = None, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(n, clusters, mean, low, high): percentile interval of the mean of ``value``, rows (keyed by
    ``unit``) or whole clusters drawn with replacement.  Null values take no part; without any
    the mean is null."""
    rows = df.where(F.col(value).isNotNull())
    by = cluster or unit
    units = rows.groupBy(by).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    n, clusters, mean = units.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.sum("s") / F.sum("n")).first()
    low = high = None
    if n:
        s, k = resampled_sums(units, by, ["s", "n"], draws, seed).T
        with np.errstate(invalid="ignore", divide="ignore"):
            low, high = percentiles(s / k)
    return df.sparkSession.createDataFrame([(n, clusters, mean, low, high)], "n long, clusters long, mean double, low double, high double")
