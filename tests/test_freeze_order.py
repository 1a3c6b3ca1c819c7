"""Least values below nodes, and the order of freezes and accesses, against walks over every path."""

import datetime
import random

import pytest

from tallyforge.operators import graph, integrity


def below(edges, node):
    seen, todo = set(), [node]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [d for s, d in edges if s == n]
    return seen


GRAPHS = {
    "random": [(random.Random(i).randrange(20), random.Random(i + 100).randrange(20)) for i in range(24)],
    "odd cycle": [(0, 1), (1, 2), (2, 0), (5, 0), (2, 7)],
    "diamond": [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (3, 3), (4, 5), (4, 6), (0, 1)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_least_below(spark, name):
    edges, r = GRAPHS[name], random.Random(name)
    values = [(r.randrange(22), r.randrange(100)) for _ in range(9)] + [(None, 1), (3, None), (21, 4)]
    got = graph.least_below(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(values, "node int, value int"))
    want = {}
    for n in range(22):
        at = [v for m, v in values if m in below(edges, n) and v is not None]
        if at:
            want[n] = min(at)
    assert dict(map(tuple, got.collect())) == want


def test_deep_chain_takes_few_rounds(spark, monkeypatch):
    n, tables, plain = 1000, [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: (tables.append(1), plain(df))[1])
    edges = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    got = graph.least_below(edges, spark.createDataFrame([(n, 3), (500, 2)], "node long, value int"))
    assert sorted(map(tuple, got.collect())) == [(i, 2 if i <= 500 else 3) for i in range(n + 1)]
    assert len(tables) <= 3 * 13


def test_freeze_order_against_all_paths(spark):
    r, day = random.Random(5), lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    edges = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(30)]
    frozen = [(f"n{r.randrange(27)}", f"r{i}", day(r.randrange(20))) for i in range(15)] + [(None, "r90", day(1)), ("n1", "r91", None)]
    outcomes = [(f"n{r.randrange(27)}", f"o{i}", day(r.randrange(5, 40))) for i in range(30)] + [(None, "o90", day(0)), ("n1", "o91", None)]
    got = integrity.freeze_before_access(
        spark.createDataFrame(frozen, "node string, rep_id string, frozen_at date"), spark.createDataFrame(outcomes, "node string, outcome_id string, accessible_at date"),
        spark.createDataFrame(edges, "src string, dst string"),
    )
    want = {(rep, o) for n, rep, f in frozen for m, o, a in outcomes if n and m and f and a and m in below(edges, n) and f >= a}
    assert want and sorted((x.rep_id, x.outcome_id) for x in got.collect()) == sorted(want)


def test_a_ledger_in_order_closes_nothing(spark, monkeypatch):
    seen, plain = [], graph.closure
    monkeypatch.setattr(graph, "closure", lambda e: (seen.append(e.count()), plain(e))[1])
    d = datetime.date
    got = integrity.freeze_before_access(
        spark.createDataFrame([("a", "r", d(2024, 1, 1))], "node string, rep_id string, frozen_at date"), spark.createDataFrame([("c", "o", d(2024, 1, 2))], "node string, outcome_id string, accessible_at date"),
        spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"),
    )
    assert got.count() == 0 and seen == [0]
