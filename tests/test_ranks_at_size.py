"""Many small groups are counted together, and models meet rows without dealing them by batch."""

import re

import numpy as np
from pyspark.sql import functions as F

from tallyforge.operators import model, ranks


def test_dominated_in_runs():
    r = np.random.default_rng(5)
    run = np.sort(r.integers(0, 40, 700)) * 3
    score, weight = r.integers(0, 9, 700), r.integers(0, 4, 700)
    assert ranks.dominated(score, weight, run).tolist() == [int(weight[:i][(score[:i] < score[i]) & (run[:i] == run[i])].sum()) for i in range(700)]


def test_small_groups_share_a_call(spark, monkeypatch):
    """Runs cut by the ends of Arrow batches, small blocks, and no Python call for each group."""
    monkeypatch.setattr(ranks, "BLOCK", 16)
    r = np.random.default_rng(6)
    rows = [(int(g), int(life), int(s)) for g, life, s in zip(r.integers(0, 60, 3000) ** 2 // 60, r.integers(0, 50, 3000), r.integers(0, 20, 3000))]
    df = spark.createDataFrame(rows, "g int, life int, s int").withColumn("low", F.lit(None).cast("int"))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = ranks.pair_counts(df, ["g"], "life", "low", "s")
        assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {x.g: (x.n, x.correct) for x in found.where("kind = 'exact'").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {}
    for g, life, s in rows:
        want.setdefault(g, []).append((life, s))
    for g, items in want.items():
        x, s = np.array(items).T
        longer = x[:, None] > x[None, :]
        assert got[g] == (int(longer.sum()), float((longer * ((s[:, None] > s[None, :]) + (s[:, None] == s[None, :]) / 2)).sum()))


def test_rows_are_not_dealt_by_batch(spark):
    df = spark.range(400).selectExpr("id", "string(id % 3) AS b", "string(id % 5) AS g", "double(id % 17) AS x", "double(id % 23) AS y")
    plan = model.held_out_ridge(df, "b", "g", ["x"], "y")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(_[bg]#\d+, \d+\)", plan) and plan.count("BroadcastHashJoin") == 2


def test_heldout_ridge_sorts_and_deals_no_rows(spark):
    """The query itself, three features and five alphas: neither join shuffles or sorts the rows of a batch into one task."""
    from tallyforge.plans import queries

    plan = queries.QUERIES["heldout_ridge"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(hashpartitioning\(|Sort \[)_[bg]#\d+( ASC NULLS FIRST\]|, \d+\))", plan)
    assert plan.count("BroadcastHashJoin") == 2  # the models meet the rows twice; models meet errors by batch in a small join


def test_fits_are_spread_over_tasks(spark, monkeypatch):
    """Rows of one small file make several tasks, and every row is predicted once."""
    from tallyforge.operators import probe

    monkeypatch.setattr(probe, "ROWS", 20)
    df = spark.range(90).selectExpr("id", "id % 3 AS fold", "array(double(id % 7), double(id % 5)) AS x", "double(id % 7 * 2 - id % 5) AS y").coalesce(1)
    out = probe.held_out_predictions(df, "fold", "x", "y", "ridge")
    assert out.rdd.getNumPartitions() == 3 * 5
    rows = out.toPandas()
    assert sorted(rows.id) == list(range(90)) and np.corrcoef(rows.y, rows.prediction)[0, 1] > 0.95
