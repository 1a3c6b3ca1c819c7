"""Governance of studies: firewalls, locks and signatures, source denominators, and the crossing of a bridge panel.

As in ``study``, any number of studies is checked in one run: documents become flat relations keyed by
study_id, and rules join them with ledger rows.  Clocks are times with an offset.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import offset_timestamp
from ..sources import strict_json
from .ledger import TABLES, empty
from .study import _get

LOCKS = ("design_lock", "analysis_freeze", "raw_freeze", "representation_freeze")
SNAPSHOT_VERSION = "partner_source_denominator.v1"  # a fixed value of the format
ISSUE = ("study_id", "code", "severity", "row_id", "detail")

FIREWALL = (
    ("has_firewall", "$.firewall_and_freeze", "object"),
    ("access_matrix", "$.firewall_and_freeze.access_control_matrix_artifact_id", "string"),
    ("representation_roles", "$.firewall_and_freeze.representation_builder_roles", "array<string>"),
    ("outcome_roles", "$.firewall_and_freeze.outcome_builder_roles", "array<string>"),
    ("access_roles", "$.firewall_and_freeze.outcome_table_access_roles", "array<string>"),
    ("assignment_sha256", "$.firewall_and_freeze.assignment_sha256", "string"),
    ("study_sha256", "$.firewall_and_freeze.study_spec_sha256", "string"),
    ("design_sha256", "$.firewall_and_freeze.design_lock.manifest_sha256", "string"),
)


def relations(studies: DataFrame, bundles: DataFrame) -> dict[str, DataFrame]:
    """Flat relations of study and bundle documents (study_id, doc variant): firewall, lock, signoff, release."""
    access = offset_timestamp(_get("doc", "$.firewall_and_freeze.first_outcome_access_at", "string"))
    lock = lambda n: F.struct(
        F.lit(n).alias("lock"),
        _get("doc", f"$.firewall_and_freeze.{n}.status", "string").alias("status"),
        _get("doc", f"$.firewall_and_freeze.{n}.manifest_artifact_id", "string").alias("artifact_id"),
        _get("doc", f"$.firewall_and_freeze.{n}.manifest_sha256", "string").alias("sha256"),
        offset_timestamp(_get("doc", f"$.firewall_and_freeze.{n}.locked_at", "string")).alias("locked_at"),
    )
    firewall = studies.select("study_id", access.alias("first_access"), *[_get("doc", p, k).alias(c) for c, p, k in FIREWALL]).where("has_firewall")
    locks = studies.select("study_id", F.inline(F.array(*map(lock, LOCKS)))).where("status = 'locked'")
    named = F.expr("map_values(map_filter(try_variant_get(doc, '$.signoffs', 'map<string,variant>'), (k, v) -> k <> 'additional_signoffs'))")
    more = F.expr("try_variant_get(doc, '$.signoffs.additional_signoffs', 'array<variant>')")
    none = F.array().cast("array<variant>")
    signs = studies.select("study_id", F.explode(F.concat(F.coalesce(named, none), F.coalesce(more, none))).alias("item"))
    signs = signs.select("study_id", *[_get("item", f"$.{p}", "string").alias(p) for p in ("signatory_id", "status", "signed_spec_sha256")])
    release = lambda df, p: df.select(
        "study_id", _get("doc", f"$.{p}.release_artifact_id", "string").alias("artifact_id"), _get("doc", f"$.{p}.release_sha256", "string").alias("sha256")
    )
    releases = release(studies, "release").unionByName(release(bundles, "release_status")).where("artifact_id is not null or sha256 is not null")
    return {"firewall": firewall, "lock": locks, "signoff": signs, "release": releases}


RULES = (
    (
        "governance_artifact_missing",
        "SELECT f.study_id, f.access_matrix AS detail FROM {firewall} f LEFT ANTI JOIN {artifact} a ON a.study_id = f.study_id AND a.artifact_id = f.access_matrix",
    ),
    (
        "firewall_role_overlap",
        """SELECT study_id, array_join(array_sort(both), ',') AS detail FROM
        (SELECT study_id, array_intersect(representation_roles, array_union(outcome_roles, access_roles)) AS both FROM {firewall}) WHERE size(both) > 0""",
    ),
    (
        "frozen_assignment_hash_mismatch",
        """SELECT f.study_id, f.assignment_sha256 AS detail FROM {firewall} f
        LEFT ANTI JOIN {file} t ON t.study_id = f.study_id AND t.table_id = 'assignments' AND t.sha256 = f.assignment_sha256 WHERE f.assignment_sha256 IS NOT NULL""",
    ),
    (
        "freeze_manifest_hash_mismatch",
        """SELECT l.study_id, concat(l.lock, ' ', coalesce(l.artifact_id, 'none')) AS detail FROM {lock} l LEFT SEMI JOIN {firewall} f ON f.study_id = l.study_id
        LEFT ANTI JOIN {artifact} a ON a.study_id = l.study_id AND a.artifact_id = l.artifact_id AND a.sha256 <=> l.sha256""",
    ),
    (
        "freeze_after_outcome_access",
        "SELECT l.study_id, l.lock AS detail FROM {lock} l JOIN {firewall} f ON f.study_id = l.study_id WHERE l.locked_at >= f.first_access",
    ),
    (
        "detached_study_hash_mismatch",
        """SELECT f.study_id, coalesce(f.study_sha256, 'none') AS detail FROM {firewall} f LEFT SEMI JOIN {lock} l ON l.study_id = f.study_id
        WHERE f.study_sha256 IS NULL OR NOT f.study_sha256 <=> f.design_sha256""",
    ),
    (
        "signoff_study_hash_mismatch",
        """SELECT s.study_id, coalesce(s.signatory_id, 'none') AS detail FROM {signoff} s JOIN {firewall} f ON f.study_id = s.study_id
        WHERE s.status = 'signed' AND NOT s.signed_spec_sha256 <=> f.study_sha256""",
    ),
    (
        "release_artifact_hash_mismatch",
        """SELECT r.study_id, coalesce(r.artifact_id, 'none') AS detail FROM {release} r LEFT SEMI JOIN {firewall} f ON f.study_id = r.study_id
        LEFT ANTI JOIN {artifact} a ON a.study_id = r.study_id AND a.artifact_id = r.artifact_id AND a.sha256 <=> r.sha256""",
    ),
)


def _issues(rows: DataFrame, code: str | Column, severity: str | Column = "error") -> DataFrame:
    code, severity = (F.lit(x) if isinstance(x, str) else x for x in (code, severity))
    return rows.select("study_id", code.alias("code"), severity.alias("severity"), F.lit(None).cast("string").alias("row_id"), F.col("detail").cast("string"))


def _filled(tables: dict[str, DataFrame], spark) -> dict[str, DataFrame]:
    return {k: tables[k] if k in tables else empty(spark, k) for k in TABLES}


def violations(studies: DataFrame, bundles: DataFrame, tables: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """(study_id, code, severity, row_id, detail): firewall, lock, signature and release rules.

    ``files``: (study_id, table_id, sha256) of delivered ledger files.  A study without a firewall breaks none.
    """
    spark = studies.sparkSession
    run = uuid.uuid4().hex[:8]
    frames = relations(studies, bundles) | {"artifact": _filled(tables, spark)["artifact"], "file": files}
    names = {k: f"{k}_{run}" for k in frames}
    for k, df in frames.items():
        df.createOrReplaceTempView(names[k])
    return reduce(DataFrame.unionByName, [_issues(spark.sql(text.format(**names)), code) for code, text in RULES]).distinct()


# --- source denominators


def observed_denominators(tables: dict[str, DataFrame]) -> DataFrame:
    """(study_id, field, n): the seventeen denominators of every study; a study that lacks rows of a
    table has no row for its fields.  One pass and one pre-aggregated shuffle a table."""
    a, t, o = tables["assignment"], tables["attempt"], tables["outcome"]
    n = F.count(F.lit(1))
    when = lambda c, v: F.count_if(F.col(c) == v)
    a = a.groupBy("study_id").agg(
        n.alias("source_population_count"), n.alias("planned_assignments"), *[when("status", s).alias(f"{s}_assignments") for s in ("released", "not_started", "cancelled")]
    )
    states = {"completed": "success", "failed": "failure", "ambiguous": "ambiguous", "aborted": "aborted", "unknown": "unknown"}
    t = t.groupBy("study_id").agg(
        n.alias("initiated_attempts"), *[when("execution_status", s).alias(f"{k}_attempts") for k, s in states.items()],
        F.count("retry_of_attempt_id").alias("retries"), F.count("rework_of_attempt_id").alias("reworks"),
    )
    ok = F.coalesce(F.col("eligible"), F.lit(False))
    left_out = F.coalesce(F.col("followup_status").isin("not_selected", "unknown"), F.lit(False)) | F.col("status").eqNullSafe("not_followed")
    flags = {
        "eligible_followup_units": ok,
        "followed_units": ok & ~left_out,
        "right_censored_units": F.col("status").eqNullSafe("right_censored"),
        "missing_outcome_units": F.coalesce(F.col("status").isin("missing", "not_followed", "unresolved"), F.lit(False)),
    }
    # a subject counts once: its flags are joined before studies are summed (a null subject is one subject)
    o = o.groupBy("study_id", "subject_node_id").agg(*[F.bool_or(c).alias(k) for k, c in flags.items()])
    o = o.groupBy("study_id").agg(*[F.count_if(k).alias(k) for k in flags])
    long = lambda df: df.unpivot(["study_id"], [c for c in df.columns if c != "study_id"], "field", "n")
    return reduce(DataFrame.unionByName, map(long, (a, t, o)))


DENOMINATORS = (
    "source_population_count", "planned_assignments", "released_assignments", "not_started_assignments", "cancelled_assignments", "initiated_attempts", "completed_attempts",
    "failed_attempts", "ambiguous_attempts", "aborted_attempts", "unknown_attempts", "retries", "reworks", "eligible_followup_units", "followed_units", "right_censored_units", "missing_outcome_units",
)


def denominator_issues(bundles: DataFrame, tables: dict[str, DataFrame], snapshots: DataFrame) -> DataFrame:
    """(study_id, code, severity, row_id, detail): declared source denominators against the ledger, their artifact and
    its snapshot.

    ``snapshots``: (study_id, path, value) of delivered files, value their text.  Bundles that declare nothing are left alone.
    """
    tables = _filled(tables, bundles.sparkSession)
    counts = "$.source_denominator_counts"
    declared = bundles.where(_get("doc", counts, "object")).select(
        "study_id", F.try_variant_get("doc", counts, "variant").alias("counts"), _get("doc", f"{counts}.source_ledger_artifact_id", "string").alias("artifact_id"),
        _get("doc", f"{counts}.source_ledger_sha256", "string").alias("declared_sha256"),
    )
    cells = F.array(*[F.struct(F.lit(f).alias("field"), strict_json.field("counts", f"$.{f}", "double").alias("said")) for f in DENOMINATORS])
    said = declared.select("study_id", F.inline(cells))
    seen = observed_denominators(tables)
    off = said.join(seen, ["study_id", "field"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where(~F.col("said").eqNullSafe(F.col("n").cast("double")))
    text = F.concat("field", F.lit(" "), F.coalesce(F.col("said").cast("long").cast("string"), F.lit("none")), F.lit("<>"), F.col("n"))
    found = [_issues(off.select("study_id", text.alias("detail")), "source_denominator_mismatch")]

    artifacts = tables["artifact"].select("study_id", "artifact_id", "sha256", "location")
    met = declared.join(artifacts.withColumn("there", F.lit(True)), ["study_id", "artifact_id"], "left")
    name = F.coalesce("artifact_id", F.lit("none"))
    code = F.when(F.col("there").isNull(), "source_denominator_artifact_missing").when(~F.col("sha256").eqNullSafe(F.col("declared_sha256")), "source_denominator_hash_mismatch")
    found.append(_issues(met.where(code.isNotNull()).withColumn("detail", name), code))
    held = met.where("there")
    available = F.coalesce(F.col("location.status") == "available_bundle_file", F.lit(False))
    found.append(_issues(held.where(~available).withColumn("detail", name), "source_denominator_snapshot_unavailable"))
    held = held.where(available).select("study_id", "artifact_id", "counts", F.col("location.path").alias("path"))
    read = held.join(snapshots.withColumn("delivered", F.lit(True)), ["study_id", "path"], "left")
    read = read.withColumn("snapshot", F.when(strict_json.safe_path(F.col("path")), strict_json.parse(F.col("value"))))
    bad = F.col("snapshot").isNull()
    found.append(_issues(read.where(bad).withColumn("detail", name), "source_denominator_snapshot_invalid"))
    entries = F.expr("map_entries(try_variant_get(counts, '$', 'map<string,variant>'))")
    version = F.expr(f"struct('schema_version' AS key, parse_json('\"{SNAPSHOT_VERSION}\"') AS value)")
    keys = F.filter(F.concat(entries, F.array(version)), lambda e: ~e["key"].isin("source_ledger_artifact_id", "source_ledger_sha256"))
    pairs = read.where(~bad).select("study_id", F.explode(keys).alias("e"), F.expr("try_variant_get(snapshot, '$', 'map<string,variant>')").alias("s"))
    got, want = F.expr("s[e.key]"), F.col("e.value")
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    same = F.when(number(got).isNotNull() & number(want).isNotNull(), number(got) == number(want)).otherwise(F.coalesce(F.to_json(got), F.lit("null")) == F.to_json(want))
    found.append(_issues(pairs.where(~same).withColumn("detail", F.col("e.key")), "source_denominator_snapshot_mismatch"))
    return reduce(DataFrame.unionByName, found).distinct()


# --- the bridge panel

BRIDGE = (
    ("axis", "$.environment_design.primary_held_out_axis", "string"),
    ("has_coverage", "$.environment_design.bridge_coverage", "object"),
    ("least_levels", "$.environment_design.bridge_coverage.minimum_primary_environment_levels", "double"),
    ("least_conditions", "$.environment_design.bridge_coverage.minimum_conditions_per_environment", "double"),
    ("least_units", "$.environment_design.bridge_coverage.minimum_independent_units", "double"),
    ("blocks", "$.environment_design.bridge_coverage.coverage_failure_blocks_claim", "boolean"),
    ("repeated", "$.environment_design.bridge_coverage.conditions_repeated_across_primary_environments", "boolean"),
    ("has_crossed", "$.environment_design.crossed_environment_design", "object"),
    ("conditions_cross", "$.environment_design.crossed_environment_design.conditions_cross_primary_environment", "boolean"),
    ("not_nested", "$.environment_design.crossed_environment_design.crossed_not_nested", "boolean"),
)


def bridge(studies: DataFrame, tables: dict[str, DataFrame], blocking: bool) -> DataFrame:
    """(study_id, attempts, explicit_membership, environment_levels, conditions, independent_units, failed, blocks, passed).

    Whether the conditions of a study's bridge panel cross its environments.  An attempt belongs to the panel if its
    assignment is marked so; without any mark all attempts count.  A condition meets all environments if
    it meets as many as the study has, so the division needs the distinct (condition, environment)
    pairs and counts, no sets.  ``blocking``: only actual environments count and the frozen design must say what it crosses;
    otherwise a planned environment stands in for one that isn't recorded.  Studies without an axis or coverage have no row.
    """
    tables = _filled(tables, studies.sparkSession)
    design = studies.select("study_id", *[_get("doc", p, k).alias(c) for c, p, k in BRIDGE], F.expr("try_variant_get(doc, '$.environment_design.crossed_environment_design.axes', 'array<variant>')").alias("axes"))
    design = design.where("axis is not null and has_coverage")
    mine = F.expr("filter(axes, x -> try_variant_get(x, '$.axis_name', 'string') = axis)")
    truth = lambda p: F.coalesce(strict_json.field(F.get("axes", 0), p, "boolean"), F.lit(False))
    frozen = F.col("has_crossed") & F.coalesce("conditions_cross", F.lit(False)) & F.coalesce("not_nested", F.lit(False))
    design = design.withColumn("axes", mine).withColumn("frozen", frozen & (F.coalesce(F.size("axes"), F.lit(0)) == 1) & truth("$.held_out") & truth("$.crossed_with_condition"))
    full = F.col("has_crossed") & (F.coalesce("not_nested", F.lit(False)) | F.coalesce("repeated", F.lit(False)))
    design = design.withColumn("full", full).drop("axes")

    marked = F.coalesce((F.col("stream") == "bridge") | F.col("bridge_panel"), F.lit(False))
    assignments = tables["assignment"].select("study_id", "assignment_id", "planned_condition", "planned_environment", marked.alias("marked"), F.lit(True).alias("assigned"))
    rows = tables["attempt"].select("study_id", "assignment_id", "attempt_id", "provenance").join(assignments, ["study_id", "assignment_id"], "left")
    rows = rows.join(design.select("study_id", "axis"), "study_id")
    explicit = rows.groupBy("study_id").agg(F.coalesce(F.bool_or("marked"), F.lit(False)).alias("explicit"))
    rows = rows.join(explicit, "study_id").where("not explicit or marked")
    text = lambda c: F.expr(f"try_variant_get(try_variant_get({c}, '$', 'map<string,variant>')[axis], '$', 'string')")
    environment = text("provenance") if blocking else F.coalesce(text("provenance"), text("planned_environment"))
    condition = F.coalesce(F.to_json("planned_condition"), F.lit("null"))
    rows = rows.select("study_id", "attempt_id", "explicit", F.when(F.col("assigned"), environment).alias("environment"), condition.alias("condition"))
    size = rows.groupBy("study_id").agg(F.bool_or("explicit").alias("explicit"), F.count(F.lit(1)).alias("attempts"), F.count("environment").alias("placed"))
    placed = rows.where("environment is not null")
    pairs = placed.select("study_id", "condition", "environment").distinct()
    by_environment = pairs.groupBy("study_id", "environment").agg(F.count(F.lit(1)).alias("n")).groupBy("study_id").agg(F.count(F.lit(1)).alias("levels"), F.min("n").alias("fewest_conditions"))
    by_condition = pairs.groupBy("study_id", "condition").agg(F.count(F.lit(1)).alias("n")).groupBy("study_id").agg(F.count(F.lit(1)).alias("conditions"), F.min("n").alias("fewest_levels"))
    nodes = tables["physical_node"].select("study_id", F.explode("source_attempt_ids").alias("attempt_id"), "independent_parent_id").where("independent_parent_id is not null")
    units = nodes.join(placed.select("study_id", "attempt_id").distinct(), ["study_id", "attempt_id"], "left_semi").groupBy("study_id").agg(F.countDistinct("independent_parent_id").alias("units"))

    out = design
    for part in (size, by_environment, by_condition, units):
        out = out.join(part, "study_id", "left")
    out = out.fillna(0, ["attempts", "placed", "levels", "conditions", "units"]).fillna(False, ["explicit"])
    least = lambda c, n: F.coalesce(F.col(c).cast("long"), F.lit(n))
    levels = least("least_levels", 2)
    on = F.lit(blocking)
    crossing = (F.col("fewest_levels") < levels) | (F.col("full") & (F.col("fewest_levels") != F.col("levels")))
    tests = {
        "frozen_crossed_design": on & ~F.col("frozen"),
        "explicit_bridge_membership": on & ~F.col("explicit"),
        "actual_environment_complete": on & (F.col("placed") < F.col("attempts")),
        "primary_environment_levels": F.col("levels") < levels,
        "independent_units": F.col("units") < least("least_units", 1),
        "conditions_per_environment": F.col("fewest_conditions") < least("least_conditions", 1),
        "condition_crossing": (F.col("conditions") > 0) & crossing,
    }
    failed = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]), lambda x: x.isNotNull())
    out = out.withColumn("failed", failed)
    return out.select(
        "study_id", "attempts", F.col("explicit").alias("explicit_membership"), F.col("levels").alias("environment_levels"), "conditions", F.col("units").alias("independent_units"),
        "failed", F.coalesce("blocks", F.lit(False)).alias("blocks"), (F.size("failed") == 0).alias("passed"),
    )


def bridge_issues(panel: DataFrame, blocking: bool) -> DataFrame:
    """(study_id, code, severity, row_id, detail) of the rows of ``bridge``: an error where the study says that it blocks
    its claim, a warning otherwise."""
    implicit = panel.where("attempts > 0 and not explicit_membership").withColumn("detail", F.lit(""))
    short = panel.where("not passed").withColumn("detail", F.array_join("failed", ","))
    severe = F.when(F.lit(blocking) & F.col("blocks"), "error").otherwise("warning")
    return _issues(implicit, "bridge_membership_implicit", "error" if blocking else "warning").unionByName(_issues(short, "bridge_crossing_insufficient", severe))
