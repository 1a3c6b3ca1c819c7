"""Patterns and spectra: zip archives, JSON patterns, text spectra, and fixed grids."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import running_sums
from . import ranges


def archive_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(archive, member) of zip archives: read from each central directory."""
    return ranges.zip_entries(spark, path, suffix).select("archive", "member")


def archive_texts(spark: SparkSession, path: str, members: DataFrame | None = None, suffix: str = ".json") -> DataFrame:
    """(archive, member, value) of the members' texts; ``members`` (member) restricts them before decoding."""
    return ranges.zip_texts(spark, path, members, suffix)


def spread_sample(names: DataFrame, most: int, strategy: str = "spread", column: str = "member") -> DataFrame:
    """All names if there are at most ``most``; else the first ones, or evenly spread ones."""
    if most <= 0 or strategy not in ("first", "spread"):
        raise ValueError("a positive number and strategy first or spread")
    if strategy == "first":
        return names.orderBy(column).limit(most)
    # places over all names come from sorted ranges; only the places picked, at most ``most``, are looked up
    placed = running_sums(names.withColumns({"_all": F.lit(0), "_one": F.lit(1)}), ["_all"], [column], {"_i": "_one"})
    total = names.agg(F.count(F.lit(1)).alias("_n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / max(most - 1, 1)))
    kept = placed.join(F.broadcast(total)).where((F.col("_n") <= most) | F.array_contains(picks, F.col("_i").cast("long")))
    return kept.select(*names.columns)


def parse_spectrum(text: Column) -> Column:
    """struct(header map, points): ``##KEY=value`` lines, then ``x, y`` rows; other rows are skipped."""
    lines = F.split(text, r"\r?\n")
    heads = F.filter(lines, lambda s: F.trim(s).startswith("##") & s.contains("="))
    entries = F.transform(heads, lambda s: F.struct(F.trim(F.substring_index(F.substring(F.trim(s), 3, 1 << 20), "=", 1)).alias("k"), F.trim(F.regexp_replace(F.trim(s), "^##[^=]*=", "")).alias("v")))
    # the last of equal keys counts
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["k"] == e["k"]))
    rows = F.transform(F.filter(lines, lambda s: ~F.trim(s).startswith("##") & s.contains(",")), lambda s: F.struct(F.expr("1").alias("_"), F.trim(F.split(s, ",")[0]).try_cast("double").alias("x"), F.trim(F.split(s, ",")[1]).try_cast("double").alias("y")))
    points = F.filter(rows, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.struct(F.map_from_entries(last).alias("header"), F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def grid(points: int = 4096, low: float = 0.0, high: float = 180.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * F.lit((high - low) / max(points - 1, 1)))


def standardize(df: DataFrame, x: str, y: str, points: int = 4096, low: float = 0.0, high: float = 180.0, out: str = "standard") -> DataFrame:
    """``df`` with y interpolated piecewise-linearly onto the grid: zero outside the data, first of
    equal x kept, scaled by the greatest value if that is positive.  Null without two points."""
    xs = np.linspace(low, high, points)

    @F.pandas_udf("array<float>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(u, v):
            if u is None or v is None or len(u) != len(v):
                return None
            u, v = np.asarray(u, float), np.asarray(v, float)
            good = np.isfinite(u) & np.isfinite(v)
            u, first = np.unique(u[good], return_index=True)
            if len(u) < 2:
                return None
            z = np.interp(xs, u, v[good][first], left=0.0, right=0.0)
            return (z / z.max() if z.max() > 0 else z).astype(np.float32)

        return pd.Series([one(u, v) for u, v in zip(a, b, strict=True)])

    return df.withColumn(out, run(F.col(x), F.col(y)))


def pattern_summary(df: DataFrame, text: str = "value") -> DataFrame:
    """Per JSON pattern: n_points, x and y ranges, labelled; null numbers if it isn't a pattern."""

    @F.pandas_udf("n_points long, x_min double, x_max double, y_min double, y_max double, labelled boolean")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            try:
                d = json.loads(t)
                u, v = np.asarray(d["two_theta_values"], float), np.asarray(d["intensities"], float)
                if u.ndim != 1 or u.shape != v.shape or not len(u):
                    raise ValueError("not a pattern")
                out.append((len(u), u.min(), u.max(), v.min(), v.max(), bool(d.get("label"))))
            except (ValueError, KeyError, TypeError):
                out.append((None,) * 6)
        return pd.DataFrame(out, columns=["n_points", "x_min", "x_max", "y_min", "y_max", "labelled"])

    return df.withColumn("summary", run(F.col(text)))
