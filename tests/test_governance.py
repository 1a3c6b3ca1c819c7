"""Firewalls, locks, source denominators and bridge panels: clean studies, and one study per broken rule."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import governance, ledger

T = "2024-01-0{}T00:00:00Z"


def clean() -> dict:
    lock = lambda k, day: {"status": "locked", "manifest_artifact_id": k, "manifest_sha256": f"h-{k}", "locked_at": T.format(day)}
    study = {
        "firewall_and_freeze": {
            "access_control_matrix_artifact_id": "acl", "representation_builder_roles": ["b"], "outcome_builder_roles": ["o"], "outcome_table_access_roles": ["s"], "assignment_sha256": "h-as",
            "first_outcome_access_at": T.format(5), "study_spec_sha256": "h-design", "design_lock": lock("design", 1), "analysis_freeze": lock("an", 2), "raw_freeze": {"status": "open"},
        },
        "signoffs": {"owner": {"status": "signed", "signed_spec_sha256": "h-design", "signatory_id": "p"}, "note": "text", "additional_signoffs": [{"status": "pending", "signatory_id": "q"}]},
        "release": {"release_artifact_id": None, "release_sha256": None},
        "environment_design": {
            "primary_held_out_axis": "batch",
            "crossed_environment_design": {"axes": [{"axis_name": "batch", "held_out": True, "crossed_with_condition": True}], "conditions_cross_primary_environment": True, "crossed_not_nested": True},
            "bridge_coverage": {"minimum_primary_environment_levels": 2, "minimum_conditions_per_environment": 2, "minimum_independent_units": 2, "coverage_failure_blocks_claim": True},
        },
    }
    counts = dict.fromkeys(governance.DENOMINATORS, 0) | {"source_population_count": 5, "planned_assignments": 5, "released_assignments": 5, "initiated_attempts": 5, "completed_attempts": 4, "failed_attempts": 1, "retries": 1}
    counts |= {"eligible_followup_units": 2, "followed_units": 1, "right_censored_units": 1, "missing_outcome_units": 1}
    artifact = lambda k, **more: {"artifact_id": k, "sha256": f"h-{k}"} | more
    return {
        "study": study,
        "bundle": {"release_status": {"release_artifact_id": "acl", "release_sha256": "h-acl"}, "source_denominator_counts": counts | {"source_ledger_artifact_id": "snap", "source_ledger_sha256": "h-snap"}},
        "snapshot": counts | {"schema_version": "partner_source_denominator.v1", "more": 1},
        "path": "source/snap.json",
        "artifact": [artifact("acl"), artifact("design"), artifact("an"), artifact("snap", location={"status": "available_bundle_file", "path": "source/snap.json"})],
        "assignment": [{"assignment_id": f"a{i}", "status": "released", "planned_condition": {"x": i % 2, "y": {"b": 1, "a": 2}, "bridge_panel": i < 4}, "planned_environment": {"batch": f"b{i // 2}"}} for i in range(5)],
        "attempt": [
            {"attempt_id": f"t{i}", "assignment_id": f"a{i}", "execution_status": "failure" if i == 4 else "success", "retry_of_attempt_id": "t0" if i == 1 else None, "provenance": {"batch": f"b{i // 2}"}}
            for i in range(5)
        ],
        "physical_node": [{"node_id": f"n{i}", "source_attempt_ids": [f"t{i}"], "independent_parent_id": f"p{i // 2}"} for i in range(5)],
        "outcome": [
            {"outcome_id": "o1", "subject_node_id": "n1", "eligible": True, "status": "right_censored", "followup_status": "complete"},
            {"outcome_id": "o2", "subject_node_id": "n1", "eligible": True, "status": "observed_exact", "followup_status": "not_selected"},
            {"outcome_id": "o3", "subject_node_id": "n2", "eligible": True, "status": "missing", "followup_status": "unknown"},
        ],
    }


def put(bundle, path, value):
    *head, last = path
    for k in head:
        bundle = bundle[k]
    bundle[last] = value


W, C = ("study", "firewall_and_freeze"), ("bundle", "source_denominator_counts")
#: (codes that must come, changes)
MUTATIONS = [
    ({"governance_artifact_missing"}, [((*W, "access_control_matrix_artifact_id"), "gone")]),
    ({"firewall_role_overlap"}, [((*W, "outcome_builder_roles"), ["o", "b"])]),
    ({"firewall_role_overlap"}, [((*W, "outcome_table_access_roles"), ["b"])]),
    ({"frozen_assignment_hash_mismatch"}, [((*W, "assignment_sha256"), "other")]),
    ({"freeze_manifest_hash_mismatch"}, [((*W, "analysis_freeze", "manifest_sha256"), "other")]),
    ({"freeze_manifest_hash_mismatch"}, [((*W, "analysis_freeze", "manifest_artifact_id"), None)]),
    ({"freeze_after_outcome_access"}, [((*W, "analysis_freeze", "locked_at"), T.format(5))]),
    ({"detached_study_hash_mismatch", "signoff_study_hash_mismatch"}, [((*W, "study_spec_sha256"), None)]),
    ({"signoff_study_hash_mismatch"}, [(("study", "signoffs", "additional_signoffs"), [{"status": "signed", "signed_spec_sha256": "x"}])]),
    ({"release_artifact_hash_mismatch"}, [(("study", "release"), {"release_artifact_id": "acl", "release_sha256": "x"})]),
    ({"release_artifact_hash_mismatch"}, [(("bundle", "release_status", "release_artifact_id"), None)]),
    (set(), [(W, None), (("bundle", "release_status", "release_artifact_id"), None)]),
    ({"source_denominator_mismatch", "source_denominator_snapshot_mismatch"}, [((*C, "retries"), 2)]),
    ({"source_denominator_mismatch"}, [(("attempt", 0, "execution_status"), "aborted")]),
    ({"source_denominator_mismatch"}, [(("outcome", 2, "subject_node_id"), "n1")]),
    ({"source_denominator_artifact_missing"}, [((*C, "source_ledger_artifact_id"), "gone")]),
    ({"source_denominator_hash_mismatch"}, [((*C, "source_ledger_sha256"), "x")]),
    ({"source_denominator_snapshot_unavailable"}, [(("artifact", 3, "location", "status"), "available_external")]),
    ({"source_denominator_snapshot_invalid"}, [(("path",), "elsewhere.json")]),
    ({"source_denominator_snapshot_invalid"}, [(("artifact", 3, "location", "path"), "../snap.json"), (("path",), "../snap.json")]),
    ({"source_denominator_snapshot_mismatch"}, [(("snapshot", "schema_version"), "v2")]),
    ({"source_denominator_snapshot_mismatch"}, [(("snapshot",), [1])]),
    (set(), [(("snapshot", "retries"), 1.0)]),
    (set(), [(("bundle", "source_denominator_counts"), None)]),
    ({"bridge_crossing_insufficient"}, [(("assignment", 3, "planned_condition", "x"), 5)]),
    ({"bridge_crossing_insufficient"}, [(("attempt", 3, "provenance"), None)]),
    ({"bridge_crossing_insufficient"}, [(("study", "environment_design", "bridge_coverage", "minimum_independent_units"), 3)]),
    ({"bridge_crossing_insufficient"}, [(("study", "environment_design", "crossed_environment_design", "axes"), [])]),
    (set(), [(("study", "environment_design", "bridge_coverage"), None)]),
]


def frames(spark, bundles):
    docs = lambda k: spark.createDataFrame([(f"st{i}", json.dumps(b[k])) for i, b in enumerate(bundles)], "study_id string, value string").select("study_id", F.try_parse_json("value").alias("doc"))
    tables = {}
    for kind in ("artifact", "assignment", "attempt", "physical_node", "outcome"):
        rows = [(json.dumps(r | {"study_id": f"st{i}"}),) for i, b in enumerate(bundles) for r in b[kind]]
        tables[kind] = ledger.typed(spark.createDataFrame(rows, "value string").select(F.try_parse_json("value").alias("doc")), kind).cache()
    files = spark.createDataFrame([(f"st{i}", "assignments", "h-as") for i in range(len(bundles))], "study_id string, table_id string, sha256 string")
    snapshots = spark.createDataFrame([(f"st{i}", b["path"], json.dumps(b["snapshot"])) for i, b in enumerate(bundles)], "study_id string, path string, value string")
    return docs("study"), docs("bundle"), tables, files, snapshots


@pytest.fixture(scope="module")
def found(spark):
    bundles = [clean()]
    for _, changes in MUTATIONS:
        b = copy.deepcopy(clean())
        for path, value in changes:
            put(b, path, value)
        bundles.append(b)
    studies, bundle, tables, files, snapshots = frames(spark, bundles)
    rows = governance.violations(studies, bundle, tables, files).collect() + governance.denominator_issues(bundle, tables, snapshots).collect()
    rows += governance.bridge_issues(governance.bridge(studies, tables, True), True).collect()
    out: dict[str, set] = {}
    for r in rows:
        assert r.severity == "error"
        out.setdefault(r.study_id, set()).add(r.code)
    return out


def test_clean_study(found):
    assert found.get("st0", set()) == set()


@pytest.mark.parametrize("at", range(len(MUTATIONS)), ids=[f"{i}-{'-'.join(sorted(m[0]))}"[:80] for i, m in enumerate(MUTATIONS)])
def test_mutation(found, at):
    assert found.get(f"st{at + 1}", set()) == MUTATIONS[at][0]


def test_bridge_without_marks_and_planned_environments(spark):
    b = clean()
    for a in b["assignment"]:
        a["planned_condition"]["bridge_panel"] = False
    for t in b["attempt"]:
        t["provenance"] = None
    studies, _, tables, _, _ = frames(spark, [b])
    open_ = governance.bridge(studies, tables, False)
    r = open_.first()
    assert (r.attempts, r.explicit_membership, r.environment_levels, r.conditions, r.independent_units) == (5, False, 3, 2, 3)
    assert r.failed == ["conditions_per_environment", "condition_crossing"] and not r.passed
    assert {(i.code, i.severity) for i in governance.bridge_issues(open_, False).collect()} == {("bridge_membership_implicit", "warning"), ("bridge_crossing_insufficient", "warning")}
    closed = governance.bridge(studies, tables, True)
    assert closed.first().failed == ["explicit_bridge_membership", "actual_environment_complete", "primary_environment_levels", "independent_units"]
    assert {(i.code, i.severity) for i in governance.bridge_issues(closed, True).collect()} == {("bridge_membership_implicit", "error"), ("bridge_crossing_insufficient", "error")}


def test_denominators_match_the_ledger_operator(spark):
    _, _, tables, _, _ = frames(spark, [clean()])
    got = {r.field: r.n for r in governance.observed_denominators(tables).collect()}
    assert set(got) == set(governance.DENOMINATORS) and got == ledger.denominators(tables).first().asDict()
