"""A bundle: an index that lists hashed ledger tables, read into typed tables with issues."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance, ledger, study
from ..operators.graph import written
from . import ranges, strict_json
from .schema import SchemaSet

#: Table ids of an index and the row types they hold.
TABLE_IDS = {f"{k}s": k for k in ledger.TABLES}
#: Lists of ids in the index's nonconfirmatory scope and the row types they name.
SCOPES = {f"{k}_ids": k for k in ("assignment", "attempt", "physical_node", "artifact", "transformation", "representation", "outcome", "decision", "correction", "cost")}


class BundleError(ValueError):
    """The index can't be used; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is repeated")
    return out


def _constant(name):
    raise ValueError(f"{name} is not JSON")


def read_index(spark: SparkSession, root: str, name: str = "bundle.json") -> dict:
    """The index: one small document, held on the driver."""
    try:
        text = spark.read.text(f"{root}/{name}", wholetext=True).first().value
    except Exception as e:
        raise BundleError("bundle_index_unreadable", str(e).splitlines()[0]) from e
    try:
        index = json.loads(text, object_pairs_hook=_unique, parse_constant=_constant)
    except ValueError as e:
        raise BundleError("bundle_index_invalid_json", str(e)) from e
    if not isinstance(index, dict):
        raise BundleError("bundle_index_not_object", type(index).__name__)
    if not isinstance(index.get("tables"), list) or not isinstance(index.get("study_id"), str):
        raise BundleError("bundle_schema_invalid", "study_id and tables are required")
    return index


def _relative(path, root: str):
    return F.regexp_replace(F.regexp_replace(path, "^.*?" + root.removeprefix("file://").replace(".", "[.]").rstrip("/") + "/", ""), "%20", " ")


def load(spark: SparkSession, root: str, name: str = "bundle.json") -> tuple[dict, dict[str, DataFrame], DataFrame, DataFrame]:
    """(index, typed tables, issues of files and rows, files of the bundle)."""
    index = read_index(spark, root, name)
    # each file is hashed once, by blocks; what is held after is a row a file
    files = written(ranges.file_hashes(spark, root, recursiveFileLookup="true").select(_relative(F.col("path"), root).alias("path"), "bytes", "sha256"))
    declared = [t for t in index["tables"] if isinstance(t, dict)]
    rows, issues = [], []
    seen: set[str] = set()
    taken: set[str] = set()
    tables: dict[str, DataFrame] = {}
    held = {r.path: r for r in files.where(F.col("path").isin([posixpath.normpath(str(t.get("path"))) for t in declared])).collect()}  # as many as the index lists
    for t in declared:
        kind, path, tid = TABLE_IDS.get(t.get("table_id")), str(t.get("path")), str(t.get("table_id"))
        if tid in seen:
            issues.append(("duplicate_table_id", tid, ""))
            continue
        seen.add(tid)
        if kind is None:
            issues.append(("table_row_schema_type_mismatch", tid, path))
            continue
        if path.startswith("/") or ".." in path.replace("\\", "/").split("/") or not path:
            issues.append(("unsafe_table_path", tid, path))
            continue
        path = posixpath.normpath(path)
        f = held.get(path)
        if f is None:
            issues.append(("table_file_missing", tid, path))
            continue
        if path in taken:
            # one file can't be two tables
            issues.append(("duplicate_table_path", tid, path))
            continue
        taken.add(path)
        if t.get("bytes") != f.bytes:
            issues.append(("table_bytes_mismatch", tid, path))
        if t.get("sha256") != f.sha256:
            issues.append(("table_hash_mismatch", tid, path))
        docs = strict_json.read_rows(spark, f"{root}/{path}")
        tables[kind] = ledger.typed(docs.where("ok"), kind)
        n = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad")).first()
        if n.bad:
            issues.append(("table_json_invalid", tid, str(n.bad)))
        if t.get("row_count") != n.n - n.bad:
            issues.append(("table_row_count_mismatch", tid, f"{t.get('row_count')}<>{n.n - n.bad}"))
        wrong = tables[kind].where((F.col("row_type") != kind) & F.lit(kind != "event"))
        rows.append(wrong.select(F.lit("row_type_mismatch").alias("code"), F.lit(kind).alias("row_type"), F.col(ledger.KEYS[kind]).alias("row_id"), F.col("row_type").alias("detail")))
    for tid in sorted(set(TABLE_IDS) - seen):
        issues.append(("table_file_missing", tid, "not declared"))
    out = spark.createDataFrame([(c, "table", i, d) for c, i, d in issues], "code string, row_type string, row_id string, detail string")
    for r in rows:
        out = out.unionByName(r)
    return index, tables, out, files


def scope_issues(index: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """Scope-listed ids that are absent or not flagged, and rows that a golden or pilot bundle may not hold."""
    spark = next(iter(tables.values())).sparkSession
    scope = index.get("nonconfirmatory_scope") or {}
    listed = spark.createDataFrame([(SCOPES[k], i) for k, ids in scope.items() if k in SCOPES for i in ids or []], "kind string, id string")
    every = None
    for k, df in tables.items():
        if k == "event":
            continue
        part = df.select(F.lit(k).alias("kind"), F.col(ledger.KEYS[k]).alias("id"), "nonconfirmatory")
        every = part if every is None else every.unionByName(part)
    met = listed.join(every.withColumn("there", F.lit(True)), ["kind", "id"], "left")
    code = F.when(F.col("there").isNull(), "nonconfirmatory_scope_reference_missing").when(~F.col("nonconfirmatory").eqNullSafe(True), "nonconfirmatory_scope_flag_mismatch")
    out = met.select(code.alias("code"), F.col("kind").alias("row_type"), F.col("id").alias("row_id"), F.lit("").alias("detail")).where("code is not null")
    if index.get("purpose") in ("golden_bundle_nonconfirmatory", "pilot_nonconfirmatory"):
        loose = every.where(~F.col("nonconfirmatory").eqNullSafe(True))
        out = out.unionByName(loose.select(F.lit("nonconfirmatory_bundle_contains_confirmatory_row").alias("code"), F.col("kind").alias("row_type"), F.col("id").alias("row_id"), F.lit("").alias("detail")))
    return out


#: Readiness levels at which the bridge panel must be crossed; elsewhere it is only told of.
BRIDGE_BLOCKS = {"pilot", "input_close", "outcome_reveal", "external_validation", "release"}
CHECKS = ledger.CHECKS | {
    "study_contract_semantics": study.CODES,
    "governance_hashes_and_access": tuple(code for code, _ in governance.RULES),
    "source_denominators_reconcile": (
        "source_denominator_mismatch", "source_denominator_artifact_missing", "source_denominator_hash_mismatch",
        "source_denominator_snapshot_unavailable", "source_denominator_snapshot_invalid", "source_denominator_snapshot_mismatch",
    ),
    "bridge_crossing": ("bridge_crossing_insufficient",),
}


def read_study(spark: SparkSession, root: str, index: dict, files: DataFrame) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(study_id, doc) of the study document that the index names, null if it can't be used, and (code, detail) of what is
    wrong with its file."""
    told = index.get("study_spec")
    if not isinstance(told, dict):
        return None, [("study_descriptor_missing", "")]
    path = told.get("path")
    if not isinstance(path, str) or path.startswith("/") or ".." in path.replace("\\", "/").split("/") or not path:
        return None, [("unsafe_study_path", str(path))]
    held = files.where(F.col("path") == path).first()
    if held is None:
        return None, [("study_file_missing", path)]
    issues = [(code, path) for code, field in (("study_hash_mismatch", "sha256"), ("study_bytes_mismatch", "bytes")) if told.get(field) != held[field]]
    doc = strict_json.read_documents(spark, f"{root}/{path}").select(F.lit(index["study_id"]).alias("study_id"), "doc", F.coalesce(F.schema_of_variant("doc"), F.lit("")).alias("shape"))
    shape = doc.first().shape
    if not shape.startswith("OBJECT"):
        return None, [*issues, ("study_not_object" if shape else "study_json_invalid", path)]
    return doc.select("study_id", "doc"), issues


def study_issues(spark: SparkSession, root: str, index: dict, tables: dict[str, DataFrame], files: DataFrame, readiness: str | None = None, schemas: dict[str, dict] | None = None, schema_name: str | None = None) -> DataFrame:
    """(code, row_type, row_id, detail, severity): the study's file and, with ``schemas``, its form; its contract with the ledger,
    governance, source denominators and the bridge panel."""
    studies, wrong = read_study(spark, root, index, files)
    as_rows = lambda df: df.select("code", F.coalesce(F.col("row_type"), F.lit("study")).alias("row_type"), "row_id", "detail", "severity")
    out = spark.createDataFrame([(c, "study", None, d, "error") for c, d in wrong], "code string, row_type string, row_id string, detail string, severity string")
    if studies is None:
        return out
    index_text = spark.createDataFrame([(index["study_id"], json.dumps(index))], "study_id string, value string")
    bundles = index_text.select("study_id", F.try_parse_json("value").alias("doc"))
    if schemas:
        told = studies.select("study_id", F.explode(SchemaSet(schemas).errors(F.col("doc"), schema_name)).alias("e"))
        told = told.select(F.lit("study_schema_invalid").alias("code"), F.lit(None).cast("string").alias("row_type"), F.col("e.path").alias("row_id"), F.col("e.message").alias("detail"), F.lit("error").alias("severity"))
        out = out.unionByName(as_rows(told))
    paths = {str(t.get("path")): str(t.get("table_id")) for t in index["tables"] if isinstance(t, dict)}
    listed = spark.createDataFrame(list(paths.items()), "path string, table_id string")
    delivered = files.join(listed, "path").select(F.lit(index["study_id"]).alias("study_id"), "table_id", "sha256")
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    snapshots = texts.select(F.lit(index["study_id"]).alias("study_id"), _relative(F.col("_metadata.file_path"), root).alias("path"), "value")
    blocking = readiness in BRIDGE_BLOCKS
    found = [
        study.violations(studies, tables).withColumn("severity", F.lit("error")),
        governance.violations(studies, bundles, tables, delivered),
        governance.denominator_issues(bundles, tables, snapshots),
        governance.bridge_issues(governance.bridge(studies, tables, blocking), blocking),
    ]
    for df in found:
        out = out.unionByName(as_rows(df if "row_type" in df.columns else df.withColumn("row_type", F.lit(None).cast("string"))))
    return out


def validate(spark: SparkSession, root: str, name: str = "bundle.json", with_study: bool = True, readiness: str | None = None, schemas: dict[str, dict] | None = None, schema_name: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All issues of a bundle (code, row_type, row_id, detail, severity) in a stable order, and its tables.

    ``with_study``: the study document is read and held against the ledger too; without it only the ledger is
    checked.  ``schemas`` and ``schema_name``: JSON schemas and the one for study documents.
    """
    index, tables, issues, files = load(spark, root, name)
    issues = issues.withColumn("severity", F.lit("error"))
    if tables:
        counts = index.get("source_denominator_counts")
        declared = None if with_study else counts if isinstance(counts, dict) else {}
        rows = ledger.validate(tables, index["study_id"], declared, files).unionByName(scope_issues(index, tables))
        issues = issues.unionByName(rows.withColumn("severity", F.lit("error")))
        if with_study:
            issues = issues.unionByName(study_issues(spark, root, index, tables, files, readiness, schemas, schema_name))
    return issues.distinct().orderBy("code", "row_type", "row_id", "detail"), tables
