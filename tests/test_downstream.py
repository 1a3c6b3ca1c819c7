"""Operators of the downstream audit beyond their queries, schemas, resampling and the command line."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import downstream, features, model, resample
from tallyforge.sources import schema


def test_success_without_life_stops(spark):
    df = spark.createDataFrame([("success", None, False, 3.0)], "s string, x double, t boolean, l double")
    with pytest.raises(Exception, match="finite positive life"):
        downstream.with_target(df, "s", "x", "t", "l").collect()


def test_targets_of_odd_rows(spark):
    df = spark.createDataFrame([("success", 100.0, None, None), (None, None, True, 7.0), ("odd", 5.0, None, 1.0), (None, None, None, None)], "s string, x double, t boolean, l double")
    got = [(r.target_status, r.target_exact, r.log_life, r.lower_bound) for r in downstream.with_target(df, "s", "x", "t", "l").collect()]
    assert got == [("observed_eol", True, 2.0, None), ("right_censored", False, None, 8.0), ("unavailable_odd", False, None, None), ("unavailable_unknown", False, None, None)]


def test_unknown_comparison_and_verdicts(spark):
    with pytest.raises(KeyError):
        downstream.audit_comparisons(spark.range(1).toDF("x"), {"a": ("x", "x")}, [("a", "b")])
    one = spark.createDataFrame([("loss_detected",)], "v string")
    assert downstream.environment_verdicts(one, "v").first()[:] == (1, "not_estimable", "not_estimable")
    two = one.union(one)
    assert downstream.environment_verdicts(two, "v", rule_declared=False).first().transfer == "not_declared"
    pairs = spark.createDataFrame([(1, 2, 1.0, True)], "left_id long, right_id long, weight double, universe boolean")
    rep = spark.createDataFrame([(1, 5), (2, 5)], "row_id long, token long")
    row = downstream.pair_collision_audit(rep, pairs).first()
    assert (row.collision_verdict, row.support_verdict, row.ceiling) == ("not_declared", "within_decision_support_tolerances", 0.5)
    none = downstream.pair_collision_audit(rep, pairs.where("false"), tolerance=0.1).first()
    assert (none.collision_verdict, none.support_verdict) == ("not_estimable", "not_estimable")


def test_bootstrap_of_a_mean(spark):
    r = np.random.default_rng(1)
    rows = [(i, i // 5, float(x)) for i, x in enumerate(r.normal(10, 2, 1000))]
    df = spark.createDataFrame(rows, "id long, c long, v double")
    a = resample.bootstrap_mean(df, "v", "id").first()
    b = resample.bootstrap_mean(df.repartition(7), "v", "id").first()
    assert a.n == 1000 and abs(a.low - b.low) < 1e-9 and a.low < a.mean < a.high
    assert abs((a.high - a.low) - 2 * 1.96 * 2 / 1000**0.5) < 0.05
    c = resample.bootstrap_mean(df.withColumn("v", F.col("c").cast("double")), "v", "id", "c").first()
    assert c.clusters == 200 and c.high - c.low > resample.bootstrap_mean(df.withColumn("v", F.col("c").cast("double")), "v", "id").first().high - c.mean
    assert resample.bootstrap_mean(df.where("false"), "v", "id").first()[:] == (0, 0, None, None, None)


def test_alpha_by_macro_error(spark):
    """Against fitting every model by rows."""
    r = np.random.default_rng(3)
    rows = [(int(b), f"p{p}", float(x), float(z), float(x * 2 + z * (p - 2) + r.normal())) for b in range(3) for p in range(6) for x, z in r.normal(size=(int(r.integers(4, 12)), 2))]
    alphas = (0.01, 1.0, 100.0)

    def fit(data, alpha):
        x, y = np.array([d[2:4] for d in data]), np.array([d[4] for d in data])
        mean, sd = x.mean(axis=0), x.std(axis=0)
        s = (x - mean) / sd
        w = np.linalg.solve(s.T @ s + alpha * np.eye(2), s.T @ (y - y.mean()))
        return lambda q: y.mean() + ((np.array([d[2:4] for d in q]) - mean) / sd) @ w

    want = {}
    for b in range(3):
        train = [d for d in rows if d[0] != b]
        sizes = {p: sum(d[1] == p for d in train) for p in {d[1] for d in train}}
        of = model.balanced_folds(sizes, 5)
        scores = []
        for a in alphas:
            error = {}
            for f in range(5):
                held = [d for d in train if of[d[1]] == f]
                predicted = fit([d for d in train if of[d[1]] != f], a)(held)
                for d, q in zip(held, predicted, strict=True):
                    error.setdefault(d[1], []).append(abs(d[4] - q))
            scores.append((np.mean([np.mean(e) for e in error.values()]), a))
        alpha = min(scores)[1]
        held = [d for d in rows if d[0] == b]
        want |= {d: (alpha, q) for d, q in zip(held, fit(train, alpha)(held), strict=True)}
    df = spark.createDataFrame(rows, "b long, p string, x double, z double, y double")
    for g in model.held_out_ridge(df, "b", "p", ["x", "z"], "y", alphas).collect():
        alpha, predicted = want[g[:5]]
        assert g.alpha == alpha and abs(g.prediction - predicted) < 1e-6


def test_schema_set(spark):
    s = {"a": {"type": "object", "required": ["x"], "properties": {"x": {"$ref": "b#/$defs/list"}, "y": {"type": ["string", "null"], "pattern": "^q"}}, "additionalProperties": False}, "b": {"$defs": {"list": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "integer", "minimum": 0}}}}}
    docs = [{"x": [1, 2], "y": None}, {"x": [1, 1, -2, 1.5, True], "y": "z", "w": 1}, []]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, d string")
    got = {i: [] for i in range(3)}
    for r in sorted(schema.schema_errors(df, "id", "d", s, "a").collect()):
        got[r.id].append((r.path, r.message))
    assert got[0] == []
    assert got[1] == [("$.w", "is not allowed"), ("$.x", "has equal items"), ("$.x[2]", "breaks minimum 0"), ("$.x[3]", "is not of type integer"), ("$.x[4]", "is not of type integer"), ("$.y", "doesn't match the pattern")]
    assert got[2] == [("$", "is not of type object")]
    with pytest.raises(KeyError):
        schema.SchemaSet(s).resolve("c#/x", "a")
    assert schema.json_pointer({"a/b": [{"c": 3}]}, "/a~1b/0/c") == 3


def test_schema_errors_of_odd_documents(spark):
    df = spark.createDataFrame([(1, None), (2, "{"), (3, "{}"), (4, "[1]")], "id long, d string")
    got = sorted(schema.schema_errors(df, "id", "d", {"s": {"type": "object"}}, "s").collect())
    assert [tuple(r) for r in got] == [(1, "$", "is not JSON"), (2, "$", "is not JSON"), (4, "$", "is not of type object")]
    assert schema.schema_errors(df.where("false"), "id", "d", {"s": {}}, "s").count() == 0


def test_assignment_file_and_identity(spark, tmp_path):
    downstream.write_assignment(features.counterbalanced_design(spark), f"file://{tmp_path}/design")
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"file://{tmp_path}/design").collect()
    assert len(back) == 48 and [(r.session, r.run_order) for r in back] == sorted((r.session, r.run_order) for r in back)
    found = downstream.run_identity(spark, str(tmp_path), {"task": "x"})
    assert found["commit"] is None and found["task"] == "x" and json.dumps(found)


def test_raman_members_that_do_not_parse(spark):
    names = ["z/Quartz__R1__Raman__514-5__Raman_Data_RAW__1a.txt", "z/Quartz__R1__Raman__514-5__Raman_Data_Processed__2b.txt", "Calcite__R2_laser_change__Raman____Raman_Data_RAW__3c.txt", "odd.txt", "notes.md", "A__B__R1__Raman__5__Raman_Data_RAW__1.txt", "Q__R3__Raman__5-__Raman_Data_RAW__1.txt", "Q__R3__Raman__5__Raman_Data_Odd__1.txt", "Q__R3__Raman__5Raman_Data_RAW__1.txt", "Q__R3__Raman__5__Raman_Data_RAW__xyz.txt"]
    out, skipped = downstream.raman_observations(spark.createDataFrame([(n,) for n in names], "n string"), "n")
    assert sorted((r.specimen, r.line_nm, r.variant, r.selected, r.other_member) for r in out.collect()) == [("B", 5.0, "_R1", "RAW", None), ("R1", 514.5, "", "Processed", names[0]), ("R2", -1.0, "laser_change", "RAW", None)]
    assert sorted(r.member for r in skipped.collect()) == sorted(["odd.txt", *names[-4:]])


def test_nearest_rows_without_training_rows(spark):
    df = spark.createDataFrame([(i, random.random(), 1.0) for i in range(20)], "k long, x double, y double")
    assert model.knn(df.where("false"), df, "k", ["x"], "y").where("prediction is null").count() == 20


def test_records_without_a_barcode_or_a_policy(spark):
    rows = [("b1", "3C-60", 1), ("b1", "new-3C-60", 2), (None, "3C", 3), (None, "3C", 4), ("b2", None, 5), ("b2", "3C", 6), ("b3", None, 7)]
    out = downstream.continuation_groups(spark.createDataFrame(rows, "b string, p string, part int"), "b", "p", "part").collect()
    assert sorted((r.event_id, r.b or "", r.records, r.policy or "", r.merged) for r in out) == [
        ("3", "", 1, "3C", False), ("4", "", 1, "3C", False), ("b1", "b1", 2, "new-3C-60", True), ("b2:5", "b2", 1, "", False), ("b2:6", "b2", 1, "3C", False), ("b3:7", "b3", 1, "", False),
    ]


def test_ledger_check_walks_documents(spark):
    body = json.dumps({"a": [{"b.c": 1}, {"x": 0.125, "ci": [0.5, 0.75], "n": None, "t": "1", "0": True}], "runs": {"k": 7}})
    entries = [
        ("scalar", "m", "a[1].x", "0.12", None, None), ("wrong", "m", "a[1].x", "0.13", None, None), ("last", "m", "a[-1].x", "at 0.125", None, None), ("dotted index", "m", "a.1.x", "0.1", None, None),
        ("list", "m", "a[1].ci", "0.50 to 0.75", None, None), ("list short", "m", "a[1].ci", "0.50", None, None), ("null", "m", "a[1].n", "0", None, None), ("text", "m", "a[1].t", "1", None, None),
        ("truth", "m", "a[1].0", "1", None, None), ("gone", "m", "a[7].x", "1", None, None), ("no key", "m", "runs.z", "1", None, None), ("through a number", "m", "runs.k.z", "1", None, None),
        ("no file", "other", "runs.k", "7", None, None), ("two", "m", "runs.k", "7", "a[1].ci", "1 and 1"), ("hidden", "m", "runs.k", None, None, None), ("none", "m", None, None, None, None),
    ]
    df = spark.createDataFrame(entries, "key string, manifest string, pointer string, display string, ci_pointer string, ci95_display string")
    got = {(r.key, r.field): r.state for r in downstream.ledger_check(df, spark.createDataFrame([("m", body), ("bad", "{")], "manifest string, body string")).collect()}
    ok, stale, lost = ("scalar", "last", "dotted index", "list"), ("wrong", "list short", "null", "text", "truth"), ("gone", "no key", "through a number", "no file")
    want = {(k, "pointer"): s for ks, s in ((ok, "ok"), (stale, "stale"), (lost, "unresolved")) for k in ks}
    assert got == want | {("two", "pointer"): "ok", ("two", "ci_pointer"): "stale", ("hidden", "pointer"): "undisplayed"}
