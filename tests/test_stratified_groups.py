"""Folds of whole groups with alike shares of labels, against dealing every group one by one."""

import numpy as np
import pandas as pd
import pytest

from tallyforge.operators import model


def worst(pdf, k):
    """The largest distance of a label's share in a fold from 1/k."""
    table = pdf.pivot_table(index="fold", columns="label", values="g", aggfunc="count", fill_value=0).reindex(range(k), fill_value=0)
    return float(np.abs(table / table.sum() - 1 / k).to_numpy().max())


def greedy(pdf, k):
    n = pdf.groupby(["g", "label"]).size().unstack(fill_value=0)
    n = n.loc[n.sum(axis=1).sort_values(ascending=False, kind="stable").index]
    load, of = np.zeros((k, n.shape[1])), {}
    for g, x in zip(n.index, n.to_numpy() / n.sum().to_numpy(), strict=True):
        of[g] = min(range(k), key=lambda f: ((load[f] + x) ** 2).sum() - (load[f] ** 2).sum())
        load[of[g]] += x
    return pdf.assign(fold=pdf.g.map(of))


def sample(n, groups, seed):
    rng = np.random.default_rng(seed)
    g = rng.zipf(1.5, n) % groups
    return pd.DataFrame({"g": [f"g{x}" for x in g], "label": np.where(rng.random(n) < 0.05, "rare", np.where((g + rng.integers(0, 3, n)) % 3 == 0, "a", "b"))})


@pytest.mark.parametrize("parts", [2000, 20, 2])
def test_shares_against_dealing_one_by_one(spark, parts):
    pdf = sample(20000, 3000, 1)
    got = model.stratified_group_folds(spark.createDataFrame(pdf), "label", "g", 3, parts=parts).toPandas()
    assert len(got) == len(pdf) and got.fold.notna().all()
    assert (got.groupby("g").fold.nunique() == 1).all()
    assert worst(got, 3) <= worst(greedy(pdf, 3), 3) + 0.03


def test_a_hot_group_is_made_up_for(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": ["hot"] * 6000 + [f"s{i}" for i in range(12000)], "label": rng.choice(["a", "b"], 18000)})
    got = model.stratified_group_folds(spark.createDataFrame(pdf), "label", "g", 4, parts=5).toPandas()
    sizes = got.groupby("fold").size().to_dict()
    hot = got[got.g == "hot"].fold.iloc[0]
    assert sizes[hot] == pytest.approx(6000, abs=10) and all(n == pytest.approx(4000, abs=20) for f, n in sizes.items() if f != hot)


def test_nulls_and_edges(spark):
    rows = [("g1", "a"), ("g1", None), (None, "a"), ("g2", None), ("", "b")]
    got = model.stratified_group_folds(spark.createDataFrame(rows, "g string, label string"), "label", "g", 2).collect()
    assert len(got) == 5 and {r.fold is None for r in got if r.g is None} == {True} and all(r.fold in (0, 1) for r in got if r.g is not None)
    one = model.stratified_group_folds(spark.createDataFrame(rows, "g string, label string"), "label", "g", 1)
    assert {r.fold for r in one.where("g is not null").collect()} == {0}
    assert model.stratified_group_folds(spark.createDataFrame([], "g string, label string"), "label", "g", 2).count() == 0
