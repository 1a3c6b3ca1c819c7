"""Command line: grade events, validate a bundle, check a ledger of displayed numbers, hash files."""

from __future__ import annotations

import argparse
import json
import sys

from .operators import conformance, downstream, grammar, ledger
from .session import session
from .sources import bundle, strict_json


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tallyforge", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("grade", help="conformance level of an event file, table or folder")
    g.add_argument("--events", required=True)
    g.add_argument("--dataset", default="events")
    g.add_argument("--output")
    v = sub.add_parser("validate", help="issues of a bundle; exit code 1 if there are any")
    v.add_argument("bundle")
    v.add_argument("--readiness")
    v.add_argument("--output")
    v.add_argument("--no-study", action="store_true", help="the ledger alone, without its study document")
    v.add_argument("--schema-dir", help="folder of JSON schemas; study documents are held against the one named in --study-schema")
    v.add_argument("--study-schema", default="partner_study.v1.schema.json")
    n = sub.add_parser("check-numbers", help="displayed numbers of a ledger against the manifests that they point to; exit code 1 if one is stale")
    n.add_argument("ledger")
    n.add_argument("--root", required=True, help="folder that manifests' paths start from")
    f = sub.add_parser("hash", help="bytes and hashes of files")
    f.add_argument("path")
    a = p.parse_args(argv)
    spark = session()
    code = 0
    if a.command == "grade":
        rows = strict_json.read_rows(spark, a.events) if a.events.endswith((".json", ".jsonl", ".ndjson")) else strict_json.read_documents(spark, f"{a.events}/*.json")
        found = conformance.grade(grammar.flatten(grammar.parse_events(rows.where("ok")))).first().asDict()
        result = {"dataset": a.dataset, "rejected": rows.where("not ok").count()} | found
    elif a.command == "validate":
        schemas = {}
        if a.schema_dir:
            for r in spark.read.text(f"{a.schema_dir}/*.json", wholetext=True).select("_metadata.file_name", "value").collect():  # as many as there are schemas
                schemas[r.file_name] = json.loads(r.value)
        every, tables = bundle.validate(spark, a.bundle, with_study=not a.no_study, readiness=a.readiness, schemas=schemas, schema_name=a.study_schema)
        every = every.cache()
        issues, warnings = every.where("severity = 'error'").drop("severity"), every.where("severity = 'warning'").drop("severity")
        levels = {r.level: r.passed for r in ledger.readiness(issues, tables).collect()} if tables else {}
        n = issues.count()
        if a.readiness and not levels.get(a.readiness, False):
            code = 1
        code = code or int(n > 0)
        # a report is for people: the first thousand rows; --output holds them all
        result = {"valid": n == 0, "issues": n, "first": [r.asDict() for r in issues.limit(1000).collect()], "checks": {r.check: r.passed for r in ledger.checks(issues, ledger.CHECKS if a.no_study else bundle.CHECKS).collect()}, "readiness": levels}
        result["warnings"] = [r.asDict() for r in warnings.limit(1000).collect()]
        if a.output:
            # written before the cache goes
            strict_json.to_strict_json(issues).write.mode("overwrite").text(a.output)
        every.unpersist()
    elif a.command == "check-numbers":
        bad = downstream.check_numbers(spark, a.ledger, a.root).where("state <> 'ok'").cache()
        code = int(bad.where("not advisory").limit(1).count() > 0)
        result = {"valid": code == 0, "entries": [r.asDict() for r in bad.orderBy("key", "field").limit(1000).collect()]}
        bad.unpersist()
    else:
        result = {"files": [r.asDict() for r in strict_json.file_ledger(spark, a.path).orderBy("path").limit(1000).collect()]}
    text = json.dumps(result, sort_keys=True, indent=2, allow_nan=False)
    if a.command == "grade" and a.output:
        with open(a.output, "w") as out:
            out.write(text + "\n")
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
