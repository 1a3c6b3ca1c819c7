"""Nearest rows over many blocks against a plain search: ties, repeated rows, nulls, and nothing to learn from."""

import math

import numpy as np
import pytest

from tallyforge.operators import model


def plain(train, test, k):
    out = []
    for key, *at in test:
        if any(v is None or math.isnan(v) for v in at):
            out.append((key, None))
            continue
        known = [(sum((a - b) ** 2 for a, b in zip(at, p, strict=True)), n, y) for n, y, *p in train if None not in (n, y, *p) and not any(map(math.isnan, (y, *p)))]
        near = [y for _, _, y in sorted(known)[:k]]
        out.append((key, sum(near) / len(near) if near else None))
    return out


@pytest.mark.parametrize("block", [20_000, 37, 3])
def test_every_block_size_gives_the_same(spark, block):
    r = np.random.default_rng(3)
    # whole numbers, so that many distances are equal
    train = [(int(i), float(r.integers(9)), float(r.integers(4)), float(r.integers(4))) for i in r.permutation(80)] + [(None, 1.0, 0.0, 0.0), (81, None, 0.0, 0.0), (82, 1.0, None, 0.0), (83, 1.0, math.nan, 0.0)]
    test = [(i % 25, float(r.integers(5)), float(r.integers(5))) for i in range(30)] + [(99, None, 1.0), (98, math.nan, 1.0)]
    a = spark.createDataFrame(train, "id long, y double, u double, v double").repartition(3)
    b = spark.createDataFrame(test, "id long, u double, v double").repartition(3)
    order = lambda rows: sorted((k, -1.0 if p is None else round(p, 9)) for k, p in rows)
    got = model.knn(a, b, "id", ["u", "v"], "y", k=5, block=block)
    assert order(map(tuple, got.collect())) == order(plain(train, test, 5))


def test_fewer_rows_than_neighbours_and_none(spark):
    a = spark.createDataFrame([(1, 2.0, 0.0), (2, 4.0, 1.0)], "id long, y double, u double")
    assert sorted(map(tuple, model.knn(a, a, "id", ["u"], "y", k=5).collect())) == [(1, 3.0), (2, 3.0)]
    assert model.knn(a.where("id > 9"), a, "id", ["u"], "y").where("prediction is null").count() == 2
    assert model.knn(a, a.where("id > 9"), "id", ["u"], "y").count() == 0
