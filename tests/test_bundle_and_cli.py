"""A bundle on disk, from its index to its issues, and the command line."""

import hashlib
import json

import pytest

from tallyforge import cli
from tallyforge.sources import bundle
from tests.test_ledger import CLEAN


def write(root, change=lambda index: None, spoil=lambda root: None):
    (root / "ledgers").mkdir(parents=True)
    listed = []
    for tid, kind in bundle.TABLE_IDS.items():
        rows = [dict(r, row_type=kind) for r in CLEAN[kind]]
        data = json.dumps(rows).encode()
        (root / "ledgers" / f"{tid}.json").write_bytes(data)
        listed.append({"table_id": tid, "path": f"ledgers/{tid}.json", "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "row_count": len(rows)})
    counts = dict(source_population_count=2, planned_assignments=2, released_assignments=2, not_started_assignments=0, cancelled_assignments=0, initiated_attempts=2, completed_attempts=1, failed_attempts=1, ambiguous_attempts=0, aborted_attempts=0, unknown_attempts=0, retries=1, reworks=0, eligible_followup_units=1, followed_units=1, right_censored_units=0, missing_outcome_units=0)
    index = {"study_id": "st", "purpose": "confirmatory", "tables": listed, "source_denominator_counts": counts}
    change(index)
    (root / "bundle.json").write_text(json.dumps(index))
    spoil(root)
    return f"file://{root}"


def test_clean_bundle_by_command_line(spark, tmp_path, capsys):
    root = write(tmp_path / "b")
    assert cli.main(["validate", root, "--readiness", "outcome_reveal", "--no-study"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["valid"] and said["readiness"]["outcome_reveal"] and all(said["checks"].values())


def test_table_issues(spark, tmp_path):
    def change(index):
        index["tables"][0]["bytes"] += 1
        index["tables"][1]["sha256"] = "0"
        index["tables"][2]["path"] = "../x.json"
        index["tables"][3]["path"] = "ledgers/gone.json"
        index["tables"][4]["row_count"] = 9
        index["tables"][7]["path"] = "./" + index["tables"][6]["path"]
        index["tables"].append(index["tables"][5])
        index["nonconfirmatory_scope"] = {"cost_ids": ["co1", "gone"]}

    index, tables, issues, files = bundle.load(spark, write(tmp_path / "b", change))
    assert {r.code for r in issues.collect()} == {"table_bytes_mismatch", "table_hash_mismatch", "unsafe_table_path", "table_file_missing", "table_row_count_mismatch", "duplicate_table_id", "duplicate_table_path"}
    assert {(r.code, r.row_id) for r in bundle.scope_issues(index, tables).collect()} == {("nonconfirmatory_scope_flag_mismatch", "co1"), ("nonconfirmatory_scope_reference_missing", "gone")}


@pytest.mark.parametrize(("text", "code"), [("{", "bundle_index_invalid_json"), ('{"a": 1, "a": 2}', "bundle_index_invalid_json"), ("[]", "bundle_index_not_object"), ("{}", "bundle_schema_invalid")])
def test_index_errors(spark, tmp_path, text, code):
    (tmp_path / "bundle.json").write_text(text)
    with pytest.raises(bundle.BundleError) as e:
        bundle.read_index(spark, f"file://{tmp_path}")
    assert e.value.code == code


def test_grade_command(spark, tmp_path, capsys):
    from tests.test_operators import LADDER

    (tmp_path / "events.json").write_text(json.dumps(LADDER[4][0]))
    assert cli.main(["grade", "--events", f"file://{tmp_path}/events.json", "--output", str(tmp_path / "out.json")]) == 0
    assert json.loads((tmp_path / "out.json").read_text())["level"] == 2


def with_study(root, change=lambda b: None, told=lambda d: None):
    """A bundle whose rows keep a study's contract, though not all rules of the ledger."""
    from tests.test_governance import clean as governed
    from tests.test_study import clean

    b = clean()
    b["study"] |= {k: v for k, v in governed()["study"].items() if k != "environment_design"}
    b["study"]["firewall_and_freeze"]["assignment_sha256"] = None
    b["artifact"] += governed()["artifact"]
    change(b)
    listed = []
    (root / "ledgers").mkdir(parents=True)
    (root / "source").mkdir()
    for tid, kind in bundle.TABLE_IDS.items():
        data = json.dumps([dict(r, row_type=kind, study_id="st") for r in b.get(kind, [])]).encode()
        (root / "ledgers" / f"{tid}.json").write_bytes(data)
        listed.append({"table_id": tid, "path": f"ledgers/{tid}.json", "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "row_count": len(b.get(kind, []))})
    data = json.dumps(b["study"]).encode()
    (root / "study.json").write_bytes(data)
    counts = dict.fromkeys(("planned_assignments", "released_assignments", "not_started_assignments", "cancelled_assignments", "source_population_count", "completed_attempts", "failed_attempts", "ambiguous_attempts", "aborted_attempts", "unknown_attempts", "retries", "reworks", "right_censored_units", "missing_outcome_units"), 0)
    counts |= {"initiated_attempts": 1, "eligible_followup_units": 1, "followed_units": 1}
    (root / "source" / "snap.json").write_text(json.dumps(counts | {"schema_version": "partner_source_denominator.v1"}))
    index = {"study_id": "st", "tables": listed, "study_spec": {"path": "study.json", "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}, "source_denominator_counts": counts | {"source_ledger_artifact_id": "snap", "source_ledger_sha256": "h-snap"}}
    told(index)
    (root / "bundle.json").write_text(json.dumps(index))
    return f"file://{root}"


def found(spark, root, **options):
    index, tables, _, files = bundle.load(spark, root)
    return {(r.code, r.severity) for r in bundle.study_issues(spark, root, index, tables, files, **options).collect()}


def test_a_bundle_with_its_study(spark, tmp_path):
    assert found(spark, with_study(tmp_path / "a")) == set()

    def change(b):
        b["study"]["analysis_arms"]["arms"][0]["primary"] = False
        b["study"]["firewall_and_freeze"]["outcome_builder_roles"] = ["b"]
        b["representation"][0]["feature_schema"]["version"] = "v2"
        b["study"]["environment_design"] |= {"primary_held_out_axis": "batch", "bridge_coverage": {"coverage_failure_blocks_claim": True}}

    root = with_study(tmp_path / "b", change, lambda index: index["source_denominator_counts"].update(retries=3) or index["study_spec"].update(bytes=1))
    want = {"primary_arm_missing", "firewall_role_overlap", "feature_schema_mismatch", "source_denominator_mismatch", "source_denominator_snapshot_mismatch", "study_bytes_mismatch"}
    bridge = {"bridge_membership_implicit", "bridge_crossing_insufficient"}
    assert found(spark, root) == {(c, "error") for c in want} | {(c, "warning") for c in bridge}
    schemas = {"s": {"type": "object", "required": ["decision", "more"], "properties": {"decision": {"required": ["cost"]}}}}
    assert found(spark, root, readiness="pilot", schemas=schemas, schema_name="s") == {(c, "error") for c in want | bridge | {"study_schema_invalid"}}


@pytest.mark.parametrize(
    ("told", "code"),
    [({"path": "gone.json"}, "study_file_missing"), ({"path": "../x.json"}, "unsafe_study_path"), (None, "study_descriptor_missing"), ({"path": "source/list.json"}, "study_not_object"), ({"path": "source/bad.json"}, "study_json_invalid")],
)
def test_study_documents_that_cannot_be_used(spark, tmp_path, told, code):
    root = with_study(tmp_path / "a", told=lambda index: index.update(study_spec=told))
    (tmp_path / "a" / "source" / "list.json").write_text("[1]")
    (tmp_path / "a" / "source" / "bad.json").write_text('{"a": 1, "a": 2}')
    index, _, _, files = bundle.load(spark, root)
    assert code in {c for c, _ in bundle.read_study(spark, root, index, files)[1]}


def test_check_numbers_command(spark, tmp_path, capsys):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{"auc": 0.8765, "ci": [0.81, 0.92]}')
    (tmp_path / "paper.md").write_text("an AUC of 0.88")
    source = {"kind": "manifest", "manifest": "m/a.json", "pointer": "auc"}
    entries = {
        "_note": "text", "good": {"display": "0.88", "ci95_display": "0.81-0.92", "source": source | {"ci_pointer": "ci"}, "cited_in": ["paper.md"]},
        "literal": {"display": "7", "source": {"kind": "literal", "pointer_todo": True}, "cited_in": ["gone.md", "paper.md"]},
    }
    (tmp_path / "ledger.json").write_text(json.dumps(entries))
    assert cli.main(["check-numbers", f"file://{tmp_path}/ledger.json", "--root", f"file://{tmp_path}"]) == 1  # "0.81-0.92" shows -0.92
    said = json.loads(capsys.readouterr().out)
    assert {(e["key"], e["field"], e["state"]) for e in said["entries"]} == {("good", "ci_pointer", "stale"), ("literal", "pointer", "pointer_todo"), ("literal", "gone.md", "document_missing"), ("literal", "paper.md", "not_shown")}
    entries["good"]["ci95_display"] = "0.81 to 0.92"
    (tmp_path / "ledger.json").write_text(json.dumps(entries))
    assert cli.main(["check-numbers", f"file://{tmp_path}/ledger.json", "--root", f"file://{tmp_path}"]) == 0
    assert {e["advisory"] for e in json.loads(capsys.readouterr().out)["entries"]} == {True}
