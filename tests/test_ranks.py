"""Running sums, ranks and pair counts against brute force; hot groups and ties."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import ranks


def test_running_sums_of_hot_and_null_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), i, r.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, v long").repartition(5)
    got = {x.t: x.s for x in ranks.running_sums(df, ["g"], ["t"], {"s": "v"}).collect()}
    want, so_far = {}, Counter()
    for g, t, v in rows:
        want[t] = so_far[g]
        so_far[g] += v
    assert got == want
    down = {x.t: x.s for x in ranks.running_sums(df, ["g"], ["t"], {"s": "v"}, descending=("t",)).collect()}
    assert all(down[t] + got[t] + v == so_far[g] for g, t, v in rows)


def test_no_window_over_a_whole_group(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id AS v")
    plan = ranks.average_ranks(df, ["g"], "v", "r")._jdf.queryExecution().optimizedPlan().toString()
    # a range of a group is summed by itself; of a whole group only one row a range is ever numbered or counted
    assert all("_range" in line or "_cut" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window"))


def test_average_ranks(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0), (None, 2.0), (None, 2.0)]
    out = ranks.average_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "r").collect()
    assert sorted((str(x.g), str(x.v), x.r) for x in out) == [("None", "2.0", 1.5), ("None", "2.0", 1.5), ("a", "1.0", 2.0), ("a", "3.0", 3.5), ("a", "3.0", 3.5), ("a", "None", 1.0), ("b", "2.0", 1.0)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 513])
def test_dominated(n):
    r = np.random.default_rng(n)
    score, weight = r.integers(0, 12, n), r.integers(0, 4, n)
    assert ranks.dominated(score, weight).tolist() == [int(weight[:i][score[:i] < score[i]].sum()) for i in range(n)]


def brute(rows):
    out, right = Counter(), Counter()
    by = {}
    for g, life, low, s in rows:
        by.setdefault(g, []).append((life, low, s))
    for g, items in by.items():
        for a, b in combinations(items, 2):
            win = None
            if a[0] is not None and b[0] is not None:
                kind = "tied" if a[0] == b[0] else "exact"
                if kind == "exact":
                    win, lose = (a, b) if a[0] > b[0] else (b, a)
            else:
                kind = "unresolvable"
                for x, y in ((a, b), (b, a)):
                    if x[0] is not None and y[0] is None and y[1] is not None and y[1] > x[0]:
                        kind, win, lose = "censor_resolved", y, x
            out[g, kind] += 1
            if win and win[2] is not None and lose[2] is not None:
                right[g, kind] += 1.0 if win[2] > lose[2] else 0.5 if win[2] == lose[2] else 0.0
    return {(g, k, n, right[g, k] if k in ("exact", "censor_resolved") else None) for (g, k), n in out.items()}


@pytest.mark.parametrize("block", [4, 32, 8192])
def test_pair_counts(spark, monkeypatch, block):
    monkeypatch.setattr(ranks, "BLOCK", block)
    r = random.Random(block)
    rows = []
    for _ in range(260):
        g, x = r.choice([1, 1, 1, 2, None]), r.randint(0, 30)
        kind = r.random()
        rows.append((g, x if kind < 0.6 else None, x if kind > 0.55 else None, r.choice([None] + list(range(8)))))
    rows += [(9, 1, None, 1), (8, None, None, None), (8, None, None, 2)]
    df = spark.createDataFrame(rows, "g int, life int, low int, s int").repartition(4)
    got = {(x.g, x.kind, x.n, x.correct) for x in ranks.pair_counts(df, ["g"], "life", "low", "s").collect()}
    assert got == brute(rows)
    assert {(x.g, x.kind, x.n) for x in ranks.pair_counts(df, ["g"], "life", "low").collect()} == {x[:3] for x in got}


def test_a_million_rows_of_one_group(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("g"), F.col("id").alias("life"), F.lit(None).cast("long").alias("low"), ((F.col("id") * 7919) % n).alias("s"))
    got = {x.kind: (x.n, x.correct) for x in ranks.pair_counts(df, ["g"], "life", "low", "s").collect()}
    s = np.arange(n) * 7919 % n
    assert got == {"exact": (n * (n - 1) // 2, float(ranks.dominated(s, np.ones(n, np.int64)).sum()))}


def test_pairs_of_nothing(spark):
    assert ranks.pair_counts(spark.createDataFrame([], "g int, life int, low int, s int"), ["g"], "life", "low", "s").count() == 0


def test_exact_quantiles(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 5 + ["a", None]), r.choice([1.5, 2.5, r.random()])) for _ in range(2000)] + [("one", 4.0), ("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    at = (0.0, 0.05, 0.25, 0.5, 0.99, 1.0)
    got = {x.g: (x.n, x.q) for x in ranks.quantiles(df, ["g"], "v", at).collect()}
    want = {g: [v for h, v in rows if h == g and v is not None] for g in {g for g, _ in rows}}
    assert set(got) == {g for g, v in want.items() if v}
    for g, (n, q) in got.items():
        assert n == len(want[g]) and q == pytest.approx(np.quantile(want[g], at).tolist(), abs=1e-12)
