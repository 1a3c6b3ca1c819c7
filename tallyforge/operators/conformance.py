"""Cumulative conformance levels of an event dataset.

All functions take flat events: event_id, n_obs, payload, indexed, status, recorded, labelled,
frozen, signature and one string column per provenance axis.  Each level is one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grammar import AXES, NEGATIVE

FRACTION = 0.9  # of payload, orderable, provenance, outcome and frozen-label shares
REPLICATED = 4  # plan groups at least
LEVELS = {-1: "below_l0", 0: "l0_raw_trace", 1: "l1_provenance", 2: "l2_negatives_frozen_labels", 3: "l3_counterbalanced"}


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def level0(events: DataFrame) -> DataFrame:
    """Unique ids, events with payload, and order among events of several observations."""
    n = F.count(F.lit(1))
    several = F.count_if(F.col("n_obs") >= 2)
    row = events.agg(
        n.alias("event_count"),
        (F.count_if(F.coalesce(F.col("event_id"), F.lit("")) == "") == 0).alias("ids_given"),
        F.countDistinct("event_id").alias("ids"),
        F.count_if("payload").alias("with_payload"),
        several.alias("multi_obs"),
        F.count_if((F.col("n_obs") >= 2) & F.col("indexed")).alias("ordered"),
        F.coalesce(F.median("n_obs"), F.lit(0.0)).alias("median_obs"),
    )
    payload = _share(F.col("with_payload"), F.col("event_count"))
    order = F.when(F.col("multi_obs") > 0, F.col("ordered") / F.col("multi_obs")).otherwise(F.lit(1.0))
    unique = F.col("ids_given") & (F.col("ids") == F.col("event_count"))
    return row.select(
        "event_count", "multi_obs", "median_obs", unique.alias("unique_ids"), payload.alias("payload_fraction"), order.alias("orderable_fraction"),
        ((F.col("event_count") > 0) & unique & (payload >= FRACTION) & (order >= FRACTION)).alias("passed"),
    )


def axis_coverage(events: DataFrame, axes: tuple = AXES) -> DataFrame:
    """(axis, coverage, units): one aggregate over all axes; coverage is rounded to 3 places."""
    row = events.agg(F.count(F.lit(1)).alias("n"), *[F.count(a).alias(f"{a}__c") for a in axes], *[F.countDistinct(a).alias(f"{a}__d") for a in axes])
    cells = F.array(*[F.struct(F.lit(a).alias("axis"), F.round(_share(F.col(f"{a}__c"), F.col("n")), 3).alias("coverage"), F.col(f"{a}__d").alias("units")) for a in axes])
    return row.select(F.inline(cells))


def level1(events: DataFrame, axes: tuple = AXES) -> DataFrame:
    logged = F.col("coverage") >= FRACTION
    out = axis_coverage(events, axes).agg(F.count_if(logged).alias("logged_axes"), F.coalesce(F.min(F.when(logged, F.col("units"))), F.lit(0)).alias("min_units"))
    return out.withColumn("passed", F.col("logged_axes") >= 2)


def level2(events: DataFrame) -> DataFrame:
    row = events.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("recorded").alias("with_status"), F.count_if(F.col("status").isin(*NEGATIVE)).alias("negatives"),
        F.count_if("labelled").alias("labelled_events"), F.count_if(F.col("labelled") & F.coalesce("frozen", F.lit(False))).alias("frozen_events"),
    )
    status = _share(F.col("with_status"), F.col("n"))
    frozen = F.when(F.col("labelled_events") > 0, F.col("frozen_events") / F.col("labelled_events"))
    passed = (status >= FRACTION) & (F.col("negatives") >= 1) & F.coalesce(frozen >= FRACTION, F.lit(True))
    return row.select(status.alias("status_fraction"), "negatives", "labelled_events", frozen.alias("frozen_fraction"), passed.alias("passed"))


def plan_groups(events: DataFrame, axes: tuple = AXES) -> DataFrame:
    """(signature, n, varied): whether any axis takes two values among a plan's events."""
    varied = reduce(lambda a, b: a | b, [F.min(a) < F.max(a) for a in axes])
    return events.where("signature is not null").groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.coalesce(varied, F.lit(False)).alias("varied_any"), *[F.coalesce(F.min(a) < F.max(a), F.lit(False)).alias(f"v_{a}") for a in axes]).select("signature", "n", reduce(lambda a, b: a | b, [F.col(f"v_{a}") for a in axes]).alias("varied"))


def level3(events: DataFrame, axes: tuple = AXES) -> DataFrame:
    row = plan_groups(events, axes).agg(F.count(F.lit(1)).alias("plan_groups"), F.count_if(F.col("n") >= 2).alias("replicated"), F.count_if((F.col("n") >= 2) & F.col("varied")).alias("varied_groups"))
    need = F.greatest(F.lit(1), F.floor(F.col("replicated") / 2))
    return row.withColumn("passed", (F.col("replicated") >= REPLICATED) & (F.col("varied_groups") >= need))


def grade(events: DataFrame, axes: tuple = AXES) -> DataFrame:
    """One row: the level reached (it stops at the first one failed), its evidence, selection risk."""
    named = lambda df, k: df.select(*[F.col(c).alias(f"l{k}_{c}") for c in df.columns])
    # four one-row results: a join of single rows
    row = named(level0(events), 0).join(named(level1(events, axes), 1)).join(named(level2(events), 2)).join(named(level3(events, axes), 3))
    level = F.when(~F.col("l0_passed"), -1).when(~F.col("l1_passed"), 0).when(~F.col("l2_passed"), 1).when(~F.col("l3_passed"), 2).otherwise(3)
    bias = (
        F.when(F.round("l2_status_fraction", 3) < FRACTION, "unknown_outcomes_not_recorded")
        .when(F.col("l2_negatives") == 0, "high_no_negatives_recorded")
        .when(F.col("l2_negatives") < 0.05 * F.greatest("l0_event_count", F.lit(1)), "elevated_few_negatives")
        .otherwise("low_negatives_present")
    )
    units = F.when(F.col("l1_logged_axes") == 0, "none_logged").when(F.col("l1_min_units").between(1, 4), "high").otherwise("lower")
    name = F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))])
    return row.withColumns({"level": level, "success_bias_risk": bias, "few_units_risk": units}).withColumn("level_name", name[F.col("level")])
