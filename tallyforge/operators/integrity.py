"""Referential, state and clock rules over ledger tables; every violation is a row.

An issue has code, row_type, row_id and detail.  Rules are declared as data and compiled to
anti joins and filters, so a rule over a large table is one shuffle on its key at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

ISSUE = ("code", "row_type", "row_id", "detail")


def issues(rows: DataFrame, code: str | Column, row_type: str, row_id: Column, detail: Column) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return rows.select(code.alias("code"), F.lit(row_type).alias("row_type"), row_id.cast("string").alias("row_id"), detail.cast("string").alias("detail"))


def report(*found: DataFrame) -> DataFrame:
    """All issues in a stable order."""
    return reduce(DataFrame.unionByName, found).orderBy("code", "row_type", "row_id", "detail")


@dataclass(frozen=True)
class Reference:
    """``column`` (a value or a list of them) of ``source`` names ``key`` of ``target``; null is allowed."""

    source: str
    column: str
    target: str
    key: str


def references(value: Column, kind: str) -> Column:
    """A list of references: a single value stands for a list of one."""
    return value if kind.startswith("array") else F.array(value)


def missing_references(tables: dict[str, DataFrame], rule: Reference, row_id: str) -> DataFrame:
    """Rows that name a target which isn't there, once per missing name."""
    source, target = tables[rule.source], tables[rule.target].select(F.col(rule.key).alias("_k"))
    kind = dict(source.dtypes)[rule.column]
    named = source.select(F.col(row_id).alias("_id"), F.explode(references(F.col(rule.column), kind)).alias("_k")).where("_k is not null")
    lost = named.join(target, "_k", "left_anti").distinct()
    return issues(lost, "unknown_reference", rule.source, F.col("_id"), F.concat(F.lit(f"{rule.column}="), F.col("_k").cast("string")))


def first_rows(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """(key..., n) of keys that repeat."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconcile(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str) -> DataFrame:
    """(key, state): full outer match of two tables: left_only, right_only, differs, same."""
    l = left.select(F.col(key).alias("_l"), F.col(left_value).alias("_a"))
    r = right.select(F.col(key).alias("_r"), F.col(right_value).alias("_b"))
    met = l.join(r, F.col("_l") == F.col("_r"), "full_outer")
    state = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("differs")
    return met.select(F.coalesce("_l", "_r").alias(key), state.alias("state"))


def missing_combinations(rows: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Combinations of the distinct values of two small lists that no row has."""
    every = a.distinct().join(F.broadcast(b.distinct()))  # lists of specifications, checked small by the caller
    return every.join(rows.select(*every.columns).distinct(), every.columns, "left_anti")


def ordered_clocks(df: DataFrame, row_type: str, row_id: str, clocks: list[str], strict: bool = False) -> DataFrame:
    """Rows whose clocks run backwards between neighbours; a missing clock orders nothing."""
    out = []
    for a, b in zip(clocks, clocks[1:], strict=False):
        bad = F.col(b) <= F.col(a) if strict else F.col(b) < F.col(a)
        out.append(issues(df.where(bad), f"{b}_before_{a}", row_type, F.col(row_id), F.concat_ws(" < ", F.col(b).cast("string"), F.col(a).cast("string"))))
    return reduce(DataFrame.unionByName, out)


def outcome_rules(df: DataFrame, row_id: str, status: str, value: str, lower: str, upper: str) -> DataFrame:
    """Exact outcomes have a value and no bounds, censored ones a bound and no value, others neither."""
    s, v, lo, hi = (F.col(c) for c in (status, value, lower, upper))
    code = (
        F.when((s == "exact") & v.isNull(), "exact_without_value")
        .when((s == "exact") & (lo.isNotNull() | hi.isNotNull()), "exact_with_bounds")
        .when((s == "right_censored") & lo.isNull(), "censored_without_bound")
        .when(s.isin("right_censored", "left_censored", "interval_censored") & v.isNotNull(), "censored_with_value")
        .when((s == "left_censored") & hi.isNull(), "censored_without_bound")
        .when((s == "interval_censored") & (lo.isNull() | hi.isNull() | (lo > hi)), "interval_not_ordered")
        .when(~s.isin("exact", "right_censored", "left_censored", "interval_censored") & (v.isNotNull() | lo.isNotNull() | hi.isNotNull()), "missing_with_value")
    )
    found = df.withColumn("_code", code).where("_code is not null")
    return issues(found, F.col("_code"), "outcome", F.col(row_id), s)


def partition_leaks(nodes: DataFrame, unit: str, partition: str) -> DataFrame:
    """(unit, n_partitions) of units that stand in more than one partition."""
    return nodes.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.countDistinct(partition).alias("n_partitions")).where("n_partitions > 1")


def edges_across(edges: DataFrame, nodes: DataFrame, partition: str) -> DataFrame:
    """Edges whose ends stand in different partitions: src, dst, and both partitions."""
    a = nodes.select(F.col("node").alias("src"), F.col(partition).alias("src_part"))
    b = nodes.select(F.col("node").alias("dst"), F.col(partition).alias("dst_part"))
    return edges.join(a, "src").join(b, "dst").where("src_part <> dst_part").select("src", "dst", "src_part", "dst_part")


def freeze_before_access(frozen: DataFrame, outcomes: DataFrame, edges: DataFrame) -> DataFrame:
    """Representations (node, rep_id, frozen_at) not frozen strictly before an outcome (node,
    outcome_id, accessible_at) of the node itself or of what descends from it became accessible.

    A node lies on the way from such a representation to such an outcome just if the latest freeze above it isn't before the
    earliest access below it; both are carried along ``edges`` (src, dst) with one row a node.  Paths are closed among these
    nodes only, so a ledger in order has none to close.  Rows with a null node or time are never in breach.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    access = graph.least_below(edges, outcomes.select("node", micros("accessible_at").alias("value")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    freeze = graph.least_below(back, frozen.select("node", (-micros("frozen_at")).alias("value")))
    late = access.withColumnRenamed("least", "access").join(freeze, "node").where(-F.col("least") >= F.col("access")).select("node")
    late = graph.written(late)
    inside = edges.join(late.select(F.col("node").alias("src")), "src", "left_semi").join(late.select(F.col("node").alias("dst")), "dst", "left_semi")
    reach = graph.closure(inside).select(F.col("src").alias("node"), F.col("dst").alias("at")).unionByName(late.select("node", F.col("node").alias("at"))).distinct()
    met = frozen.join(reach, "node").join(outcomes.select(F.col("node").alias("at"), "outcome_id", "accessible_at"), "at")
    return met.where("frozen_at >= accessible_at").select("rep_id", "outcome_id", "frozen_at", "accessible_at").dropDuplicates(["rep_id", "outcome_id"])


def denominators(df: DataFrame, counts: dict[str, Column], declared: dict[str, int] | None = None) -> DataFrame:
    """(name, actual, declared, ok): counts of one table in a single aggregate against a declaration."""
    row = df.agg(*[c.cast("long").alias(k) for k, c in counts.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("actual"), F.lit((declared or {}).get(k)).cast("long").alias("declared")) for k in counts])
    return row.select(F.inline(cells)).withColumn("ok", F.col("declared").isNull() | (F.col("actual") == F.col("declared")))


def bridge_crossing(rows: DataFrame, condition: str, environment: str, unit: str, least_units: int = 1) -> DataFrame:
    """(condition, environments, units, crossed): whether a condition was met in every environment
    with ``least_units`` units in each."""
    cells = rows.groupBy(condition, environment).agg(F.countDistinct(unit).alias("u"))
    total = rows.agg(F.countDistinct(environment).alias("every"))
    by = cells.groupBy(condition).agg(F.count(F.lit(1)).alias("environments"), F.sum("u").alias("units"), F.min("u").alias("least"))
    return by.join(F.broadcast(total)).select(F.col(condition).alias("condition"), "environments", "units", ((F.col("environments") == F.col("every")) & (F.col("least") >= least_units)).alias("crossed"))
