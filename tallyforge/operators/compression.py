"""Does a compact representation lose support, task value or decisions against a richer one?

Arms are columns of one table: a loss and an availability of each arm, weights, a cluster and an
environment.  Every figure is a conditional sum, so all of them come from one aggregate; the
cluster bootstrap needs three sums per cluster and nothing else.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import component_verdict, risk_verdict
from . import resample


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def support(df: DataFrame, by: list[str] = (), tolerance: float = 0.05, weighted_tolerance: float = 0.05) -> DataFrame:
    """Support of the compact arm against the reference over rows (universe, compact, reference:
    boolean; importance): counts, coverages, absolute and weighted losses, verdict."""
    u, c, r, w = (F.col(x) for x in ("universe", "compact", "reference", "importance"))
    row = df.groupBy(*by).agg(
        F.count_if(u).alias("universe_count"), F.count_if(u & c).alias("compact_count"), F.count_if(u & r).alias("reference_count"), F.count_if(u & r & ~c).alias("excluded_count"),
        F.coalesce(F.sum(F.when(u, w)), F.lit(0.0)).alias("universe_weight"), F.coalesce(F.sum(F.when(u & ~c, w)), F.lit(0.0)).alias("lost_weight"),
        F.coalesce(F.sum(F.when(u & r & ~c, w)), F.lit(0.0)).alias("excluded_weight"), F.coalesce(F.sum(F.when(u & r, w)), F.lit(0.0)).alias("reference_weight"),
    )
    loss = _share(F.col("universe_count") - F.col("compact_count"), F.col("universe_count"))
    weighted = _share(F.col("lost_weight"), F.col("universe_weight"))
    verdict = F.when(loss.isNull(), "not_estimable").when(loss > tolerance, "support_loss").when(weighted.isNull(), "not_estimable").when(weighted > weighted_tolerance, "support_loss").otherwise("within_support_tolerances")
    return row.select(
        *by, "universe_count", "compact_count", "reference_count", "excluded_count", loss.alias("support_loss"), weighted.alias("weighted_support_loss"),
        _share(F.col("universe_count") - F.col("reference_count"), F.col("universe_count")).alias("reference_support_loss"),
        _share(F.col("excluded_count"), F.col("reference_count")).alias("excluded_of_reference"), _share(F.col("excluded_weight"), F.col("reference_weight")).alias("excluded_weight_of_reference"), verdict.alias("support_verdict"),
    )


def common_risk(df: DataFrame, by: list[str] = (), root: bool = False) -> DataFrame:
    """Weighted mean losses of both arms (their roots with ``root``) where both are available."""
    common = df.where("universe and compact and reference")
    mean = lambda c: F.sum(F.col("weight") * F.col(c)) / F.sum("weight")
    take = F.sqrt if root else (lambda x: x)
    row = common.groupBy(*by).agg(F.count(F.lit(1)).alias("common_count"), take(mean("compact_loss")).alias("compact_risk"), take(mean("reference_loss")).alias("reference_risk"))
    return row.withColumn("risk_gap", F.col("compact_risk") - F.col("reference_risk"))


def cluster_sums(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """What a resampling of clusters needs: weight and weighted losses of each, in order of first row."""
    common = df.where("universe and compact and reference")
    return common.groupBy(cluster).agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("compact_loss")).alias("wc"), F.sum(F.col("weight") * F.col("reference_loss")).alias("wr"))


def bootstrap_interval(df: DataFrame, cluster: str = "cluster", draws: int = 2000, seed: int = 0, root: bool = False) -> DataFrame:
    """(n_clusters, low, high): percentile interval of the risk gap, whole clusters drawn with
    replacement (``resample``).  Null under two clusters or rows."""
    sums = cluster_sums(df, cluster)
    n, rows = sums.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    low = high = None
    if n >= 2 and rows >= 2:
        w, c, r = resample.resampled_sums(sums, cluster, ["w", "wc", "wr"], draws, seed).T
        with np.errstate(invalid="ignore", divide="ignore"):
            low, high = resample.percentiles(np.sqrt(c / w) - np.sqrt(r / w) if root else (c - r) / w)
    return df.sparkSession.createDataFrame([(n, low, high)], "n_clusters long, low double, high double")


def audit_pair(df: DataFrame, risk_tolerance: float = 0.0, support_tolerance: float = 0.05, weighted_tolerance: float = 0.05, draws: int = 2000, seed: int = 0, root: bool = False) -> DataFrame:
    """One row: support, common risk with its interval, and the verdicts."""
    row = support(df, tolerance=support_tolerance, weighted_tolerance=weighted_tolerance).join(common_risk(df, root=root)).join(bootstrap_interval(df, draws=draws, seed=seed, root=root))
    risk = F.when(F.col("common_count") == 0, "not_estimable").otherwise(risk_verdict(F.col("low"), F.col("high"), risk_tolerance))
    row = row.withColumn("risk_verdict", risk)
    return row.withColumn("verdict", component_verdict(F.col("support_verdict"), F.col("risk_verdict")))


def information_cutoff(df: DataFrame, state: str, cutoff: float, assay: str | None = None, deadline: float | None = None, available: str | None = None) -> DataFrame:
    """One row of counts and a verdict: states after the cutoff, assays after the deadline or before
    their state, unknown times.  A violation outweighs an unknown time."""
    on = F.coalesce(F.col(available), F.lit(False)) if available else F.lit(True)
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    late = F.coalesce(on & known(state) & (F.col(state) > cutoff), F.lit(False))
    unknown = on & ~known(state)
    overdue = early = F.lit(False)
    if assay:
        early = F.coalesce(on & known(state) & known(assay) & (F.col(assay) < F.col(state)), F.lit(False))
        overdue = F.coalesce(on & known(assay) & (F.col(assay) > deadline), F.lit(False)) if deadline is not None else F.lit(False)
        unknown = unknown | (on & ~known(assay))
    row = df.agg(F.count_if(late).alias("state_violations"), F.count_if(overdue).alias("deadline_violations"), F.count_if(early).alias("order_violations"), F.count_if(late | overdue | early).alias("violations"), F.count_if(unknown).alias("unknown_times"))
    return row.withColumn("verdict", F.when(F.col("violations") > 0, "violated").when(F.col("unknown_times") > 0, "unverifiable").otherwise("passed"))


def pair_collisions(representation: DataFrame, pairs: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row: of decision pairs (left_id, right_id, weight) those whose representations (row_id,
    token; null: unavailable) are there and equal; ceilings are 1 - rate / 2."""
    l = representation.select(F.col("row_id").alias("left_id"), F.col("token").alias("lt"))
    r = representation.select(F.col("row_id").alias("right_id"), F.col("token").alias("rt"))
    met = pairs.join(l, "left_id", "left").join(r, "right_id", "left")
    there = F.col("lt").isNotNull() & F.col("rt").isNotNull()
    hit = there & (F.col("lt") == F.col("rt"))
    row = met.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(there).alias("covered"), F.count_if(hit).alias("collisions"), F.coalesce(F.sum(F.when(there, F.col("weight"))), F.lit(0.0)).alias("cw"), F.coalesce(F.sum(F.when(hit, F.col("weight"))), F.lit(0.0)).alias("hw"))
    rate, weighted = _share(F.col("collisions"), F.col("covered")), _share(F.col("hw"), F.col("cw"))
    verdict = F.when(rate.isNull(), "not_estimable").when(rate > tolerance, "collision_loss").otherwise("within_tolerance")
    return row.select("pairs", "covered", "collisions", rate.alias("collision_rate"), weighted.alias("weighted_rate"), (1 - rate / 2).alias("ceiling"), (1 - weighted / 2).alias("weighted_ceiling"), verdict.alias("verdict"))
