"""Grammar, conformance, integrity, graph, compression, feature and model operators on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import compression, conformance, features, grammar, graph, integrity, model
from tallyforge.sources import strict_json


def event(i, plan="p", status="success", payload=True, axes=2, n_obs=2, **more):
    prov = {a: f"{a}-{i % 2}" for a in grammar.AXES[:axes]}
    obs = [{"time_s": float(k), **({"payload": {"v": 1}} if payload else {})} for k in range(n_obs)]
    return {"event_id": f"e{i}", "system": "s", "intent": {"planned": {"x": plan}}, "observations": obs, "outcome": {"status": status}, "provenance": prov} | more


def grade(spark, events):
    df = spark.createDataFrame([(json.dumps(e),) for e in events], "value string")
    return conformance.grade(grammar.flatten(grammar.parse_events(strict_json.with_document(df)))).first()


LADDER = [
    ([event(i, payload=False) for i in range(4)], -1), ([event(i, axes=0) for i in range(4)], 0), ([event(i, axes=1) for i in range(4)], 0), ([event(i, n_obs=1) for i in range(6)], 1),
    ([*[event(i) for i in range(5)], event(9, status="failure")], 2), ([event(i, plan=f"p{i // 3}", status="failure" if i % 3 == 0 else "success") for i in range(12)], 3),
    ([event(i, plan=f"p{i // 3}", status="failure", provenance={"operator_id": f"o{i // 3}", "lab_id": "l"}) for i in range(12)], 2),
    ([*[event(i) for i in range(5)], event(9, status="failure", labels={"assigned_after_raw_data_frozen": False, "entries": [{"label": "x"}]})], 1), ([event(1), event(1)], -1),
]


@pytest.mark.parametrize(("events", "level"), LADDER)
def test_ladder(spark, events, level):
    assert grade(spark, events).level == level


def test_selection_risk(spark):
    assert grade(spark, [event(i) for i in range(6)]).success_bias_risk == "high_no_negatives_recorded"
    assert grade(spark, [event(i, outcome={}) for i in range(6)]).success_bias_risk == "unknown_outcomes_not_recorded"
    assert grade(spark, [event(i, axes=0) for i in range(6)]).few_units_risk == "none_logged"


def test_parsing_defaults(spark):
    doc = {"event_id": 5, "observations": [{"timestamp": "", "measurement_time": "t", "time_s": True, "spatial_position": {"x": 1}}, 7, {"payload": {}}], "outcome": {"status": "unknown"}, "labels": {"entries": [{"label": "a"}, {"labeler_id": "z"}]}, "intent": {"planned": 3, "plan_id": "q"}}
    r = grammar.parse_events(strict_json.with_document(spark.createDataFrame([(json.dumps(doc),)], "value string"))).first()
    assert r.system == "unknown" and len(r.observations) == 2 and r.outcome.recorded and r.outcome.status == "unknown"
    assert r.observations[0].timestamp == "t" and r.observations[0].time_s is None and r.observations[0].spatial_position.x == 1.0 and not r.observations[1].has_values
    assert [(e.labeler_id, e.label) for e in r.labels.entries] == [("unknown", "a")] and r.intent.planned == {}


def test_empty_dataset_is_below_l0(spark):
    assert grade(spark, [event(1)][:0] or [{}]).level == -1


# --- integrity


def test_missing_references_explode_lists(spark):
    t = {"a": spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, None), (4, ["y", "y"])], "id int, refs array<string>"), "b": spark.createDataFrame([("x",), ("z",)], "k string")}
    got = integrity.missing_references(t, integrity.Reference("a", "refs", "b", "k"), "id").collect()
    assert sorted((r.row_id, r.detail) for r in got) == [("1", "refs=y"), ("4", "refs=y")]


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, None), (4, "x")], "k int, v string")
    assert {r.k: r.state for r in integrity.reconcile(a, b, "k", "v", "v").collect()} == {1: "left_only", 2: "differs", 3: "same", 4: "right_only"}


def test_outcome_rules(spark):
    rows = [(1, "exact", None, None, None), (2, "exact", 1.0, 0.5, None), (3, "right_censored", None, None, None), (4, "right_censored", 1.0, 1.0, None), (5, "missing", 1.0, None, None), (6, "exact", 1.0, None, None), (7, "interval_censored", None, 2.0, 1.0), (8, "left_censored", None, None, 3.0)]
    df = spark.createDataFrame(rows, "id int, s string, v double, lo double, hi double")
    got = {int(r.row_id): r.code for r in integrity.outcome_rules(df, "id", "s", "v", "lo", "hi").collect()}
    assert got == {1: "exact_without_value", 2: "exact_with_bounds", 3: "censored_without_bound", 4: "censored_with_value", 5: "missing_with_value", 7: "interval_not_ordered"}


def test_freeze_is_strict(spark):
    frozen = spark.createDataFrame([("a", "r1", 5), ("a", "r2", 4)], "node string, rep_id string, frozen_at int")
    outcomes = spark.createDataFrame([("c", "o1", 5), ("a", "o2", 9)], "node string, outcome_id string, accessible_at int")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    got = integrity.freeze_before_access(frozen, outcomes, edges).collect()
    assert [(r.rep_id, r.outcome_id) for r in got] == [("r1", "o1")]


def test_clocks(spark):
    df = spark.createDataFrame([("a", 1, 2, 3), ("b", 3, 2, 3), ("c", 1, None, 0)], "id string, t0 int, t1 int, t2 int")
    assert [(r.row_id, r.code) for r in integrity.report(integrity.ordered_clocks(df, "x", "id", ["t0", "t1", "t2"])).collect()] == [("b", "t1_before_t0")]


# --- graph


def test_closure_of_chain_diamond_and_cycle(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)]
    edges = spark.createDataFrame([*chain, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x")], "src string, dst string")
    got = {(r.src, r.dst) for r in graph.closure(edges).collect()}
    assert len([p for p in got if p[0][0] == "n"]) == 40 * 41 // 2
    assert ("a", "d") in got and ("x", "x") in got and ("a", "a") not in got


def test_cyclic_residue_holds_what_follows(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "f")], "src string, dst string")
    assert {r.node for r in graph.cyclic_residue(edges).collect()} == {"b", "c", "d"}
    assert graph.cyclic_residue(edges.where("src = 'e'")).count() == 0 and graph.closure(edges.where("false")).count() == 0


# --- compression


def arms(spark):
    rows = [(0, True, True, True, 1.0, 1.0, 1.0, 2.0, "a"), (1, True, False, True, 3.0, 1.0, 9.0, 1.0, "a"), (2, True, True, False, 1.0, 1.0, 9.0, 9.0, "b"), (3, False, True, True, 1.0, 1.0, 9.0, 9.0, "b"), (4, True, True, True, 1.0, 3.0, 5.0, 4.0, "b")]
    return spark.createDataFrame(rows, "row_id long, universe boolean, compact boolean, reference boolean, importance double, weight double, compact_loss double, reference_loss double, cluster string")


def test_support_and_risk(spark):
    s = compression.support(arms(spark)).first()
    assert (s.universe_count, s.compact_count, s.reference_count, s.excluded_count) == (4, 3, 3, 1) and s.support_loss == 0.25 and s.weighted_support_loss == 0.5 and s.support_verdict == "support_loss"
    r = compression.common_risk(arms(spark)).first()
    assert r.common_count == 2 and r.compact_risk == 4.0 and r.reference_risk == 3.5 and r.risk_gap == 0.5


def test_bootstrap(spark):
    low, high = compression.bootstrap_interval(arms(spark), draws=200).first()[1:]
    assert -1.0 <= low <= 0.5 <= high <= 1.0
    one = compression.bootstrap_interval(arms(spark).where("cluster = 'a'")).first()
    assert tuple(one) == (1, None, None)


def test_cutoff(spark):
    df = spark.createDataFrame([(1.0, 2.0, True), (5.0, 4.0, True), (float("nan"), 1.0, True), (9.0, 99.0, False)], "s double, a double, on boolean")
    r = compression.information_cutoff(df, "s", 4.0, "a", 3.5, "on").first()
    assert (r.state_violations, r.deadline_violations, r.order_violations, r.violations, r.unknown_times, r.verdict) == (1, 1, 1, 1, 1, "violated")
    assert compression.information_cutoff(df.where("isnan(s)"), "s", 4.0).first().verdict == "unverifiable"
    assert compression.information_cutoff(df.where("false"), "s", 4.0).first().verdict == "passed"


def test_collisions(spark):
    rep = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, None)], "row_id long, token string")
    pairs = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0), (0, 3, 1.0)], "left_id long, right_id long, weight double")
    r = compression.pair_collisions(rep, pairs).first()
    assert (r.pairs, r.covered, r.collisions, r.collision_rate, r.weighted_rate, r.ceiling) == (3, 2, 1, 0.5, 0.25, 0.75)


# --- features and models


def test_fixed_grid(spark):
    rows = [("ok", 0, 0.0), ("ok", 1, 10.0), ("ok", 4, 40.0), ("twice", 0, 1.0), ("twice", 0, 1.0), ("twice", 4, 1.0), ("short", 0, 1.0), ("short", 3, 1.0), ("nan", 0, float("nan")), ("nan", 4, 1.0)]
    got = features.fixed_grid(spark.createDataFrame(rows, "k string, t int, v double"), "k", "t", "v", 0, 4).orderBy("t").collect()
    assert [(r.k, r.t, r.v, r.filled) for r in got] == [("ok", 0, 0.0, False), ("ok", 1, 10.0, False), ("ok", 2, 20.0, True), ("ok", 3, 30.0, True), ("ok", 4, 40.0, False)]


def test_ranking_pairs(spark):
    rows = [("g", 0, 10, None), ("g", 1, 20, None), ("g", 2, None, 15), ("g", 3, None, 10), ("g", 4, 10, None)]
    got = {(r.lpos, r.rpos): (r.kind, r.winner) for r in features.ranking_pairs(spark.createDataFrame(rows, "g string, p int, life int, low int"), "g", "p", "life", "low").collect()}
    assert got[(0, 1)] == ("exact", 1) and got[(0, 2)] == ("censor_resolved", 2) and got[(1, 2)] == ("unresolvable", None) and got[(0, 3)] == ("unresolvable", None) and got[(0, 4)] == ("tied", None) and got[(2, 4)] == ("censor_resolved", 2)


def test_continued_positions(spark):
    rows = [("c", 0, p) for p in (1, 2, 3)] + [("c", 1, p) for p in (1, 2)] + [("c", 2, p) for p in (9, 10)]
    got = features.continued_positions(spark.createDataFrame(rows, "k string, part int, pos int"), "k", "part", "pos").orderBy("part", "pos").collect()
    assert [r.merged for r in got] == [1, 2, 3, 4, 5, 9, 10]


def test_spearman(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 2.0), ("g", 2.0, 3.0), ("g", 4.0, 4.0)], "g string, a double, b double")
    assert features.spearman(df, "g", "a", "b").first().rho == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1, 2, 3, 4])[0, 1])


def test_ridge_matches_normal_equations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(i % 3, i % 4, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "batch int, inner int, a double, b double, y double")
    out = model.held_out_ridge(df, "batch", "inner", ["a", "b"], "y").toPandas()
    for b in range(3):
        here, rest = out[out.batch == b], out[out.batch != b]
        z = (rest[["a", "b"]] - rest[["a", "b"]].mean()) / rest[["a", "b"]].std(ddof=0)
        w = np.linalg.solve(z.T @ z + here.alpha.iloc[0] * len(rest) / len(rest) * np.eye(2), z.T @ (rest.y - rest.y.mean()))
        p = (here[["a", "b"]] - rest[["a", "b"]].mean()) / rest[["a", "b"]].std(ddof=0) @ np.asarray(w) + rest.y.mean()
        assert np.allclose(p, here.prediction)


def test_probe_finds_a_planted_leak(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "a" if i % 2 else "b", (rng.normal(8.0 if i % 2 else 0.0, 0.2, 3)).tolist(), rng.normal(size=3).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, label string, leak array<double>, noise array<double>")
    assert model.recoverability(df, "label", "leak", "id").first().severity == "severe"
    assert model.recoverability(df, "label", "noise", "id").first().score < 0.4


def test_folds_and_overlap(spark):
    df = spark.createDataFrame([(i, "xy"[i % 2], i // 5) for i in range(40)], "id int, label string, g int")
    dealt = model.stratified_folds(df, "label", "id", 4)
    assert {r["count"] for r in dealt.groupBy("label", "fold").count().collect()} == {5}
    grouped = model.group_folds(df, "g", 3)
    for f in range(3):
        assert model.overlap(grouped.where(F.col("fold") != f), grouped.where(F.col("fold") == f), "g").count() == 0


def test_leave_group_out_matches_separate_fits(spark):
    rng = np.random.default_rng(8)
    rows = [(f"g{i % 7}" if i % 13 else None, float(rng.normal()), float(rng.normal()), float(rng.normal()), bool(i % 5), "x") for i in range(200)] + [("untaught", 1.0, 2.0, 3.0, False, "x"), ("g1", 1.0, 1.0, None, True, "x")]
    df = spark.createDataFrame(rows, "grp string, a double, b double, y double, t boolean, s string").repartition(4)
    got = {(r.grp, r.a, r.b): r.prediction for r in model.leave_group_out(df, "grp", ["a", "b"], "y", 2.0, F.col("t")).collect()}
    assert len(got) == len(rows)
    for g, a, b, _, _, _ in rows:
        train = np.array([(c, d, e) for h, c, d, e, t, _ in rows if h is not None and h != g and t and e is not None])
        x, y = train[:, :2], train[:, 2]
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + 2.0 * np.eye(2), z.T @ (y - y.mean()))
        want = None if g is None else y.mean() + ((np.array([a, b]) - x.mean(0)) / x.std(0)) @ w
        assert got[g, a, b] == (None if want is None else pytest.approx(want, abs=1e-9))
    assert model.leave_group_out(df.limit(0), "grp", ["a", "b"], "y").count() == 0
    alone = model.leave_group_out(df.where("grp = 'g2'"), "grp", ["a", "b"], "y")
    assert alone.where("prediction is null").count() == alone.count() > 0
